"""glyphframe: the data side of text-recognition work as Spark DataFrame operators.

Every public function takes DataFrames (and plain keyword arguments) and returns a
DataFrame. Building it may run jobs of bounded size (a probe before a broadcast, a
vocabulary) or write a step to the shared folder; rows are never collected to the driver.
See README.md for the operator map.
"""

import sys

__version__ = "0.1.0"

# Functions of this package used inside Python UDFs are pickled by value, so Python
# workers can run them even where the package is not installed or on the path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: ship with --py-files
    pass
