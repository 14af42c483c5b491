"""The trigram model is counted over all rows, however many there are."""

from pyspark.sql import functions as F

from glyphframe.llm import langid


def test_every_row_teaches_the_model(spark, monkeypatch):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.lit("a.com").alias("source"))
    taught, plain = [], type(rows).mapInArrow

    def noted(self, fn, schema, *args, **options):
        if "bin long" in schema:
            taught.append(self.count())
        return plain(self, fn, schema, *args, **options)

    monkeypatch.setattr(type(rows), "mapInArrow", noted)
    langid.identify(rows)
    assert taught == [60_000]
