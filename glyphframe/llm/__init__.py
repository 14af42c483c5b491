"""Operators for building language-model training corpora on Spark.

One module per operator. Operators take DataFrames and keyword arguments and return
DataFrames; the thin registered queries are in ``queries.py``. Text kernels work on whole
Arrow batches with numpy inside tasks; Spark partitions and shuffles the work.
"""
