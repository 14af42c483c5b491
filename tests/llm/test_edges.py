"""Every operator on awkward tables: nulls in every column, empty and very long texts, ties,
repeated rows, no rows, and further columns whose names clash with those used inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphframe.llm import decontaminate, langid, licences, multiindex, neardup, packing, styletree, suffixdedup, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, print string, doc string, mark int, own int, kept int, removed int, key int, node int, id int, score int, Text2 string, cut int, features int"
LONG = "the licence is in the house of words " * 20_000


def document_rows():
    base = [(0, "a plain text of some words, you see", "en", "s0"), (1, "", "en", "s0"), (2, None, None, None), (None, None, None, None), (None, "text of a null id", "en", "s1"), (3, LONG, "en", "s0"), (3, LONG, "en", "s0"), (4, "éè � \x00 \U0001f600", "fr", "s1"), (5, " \t\n", "en", None), (6, "...", "de", "s1"), (7, "a plain text of some words, you see", "en", "s2")]
    return [(*r, len(r[1]) if r[1] is not None else None, *("x" if k in (0, 1, 10) else k for k in range(13))) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "some words"), (2, None), (None, "plain text"), (3, ""), (3, "of some words, you")], "item_id long, text string")


def ids(df, col="doc_id"):
    return sorted((r[0] if r[0] is not None else -1) for r in df.select(col).collect())


ALL = sorted(r[0] if r[0] is not None else -1 for r in document_rows())


def test_decontamination(docs, none, bench):
    out = decontaminate.find_contamination(docs, bench)
    assert ids(out) == ALL
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[0]["items"] == ["1", "3"] and [tuple(h) for h in by[0]["hits"]] == [(1, 6)]
    assert by[2].n_words == 0 and by[1].n_words == 0 and not by[5]["hits"]
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert ids(decontaminate.find_contamination(docs, bench.where("false"))) == ALL
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and 0 not in ids(kept) and ids(kept).count(3) == 2


def test_near_duplicates(docs, none):
    out = neardup.near_duplicates(docs)
    assert ids(out) == ALL
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[7].component_id == 0 and not by[7].kept and by[0].kept
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[5].kept and by[1].kept
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and ids(kept) == [-1, -1, 0, 1, 2, 3, 4, 5, 6]
    assert neardup.keep_one(none).count() == 0


def test_suffix_arrays(docs, none):
    out = suffixdedup.find_repeats(docs)
    assert ids(out) == ALL
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[3]["removed"][0].begin == 0 and by[3].n_bytes == len(LONG) and bytes(by[3].kept) == b""
    assert by[2].n_bytes == 0 and bytes(by[4].kept) == document_rows()[7][1].encode()
    assert suffixdedup.find_repeats(none).count() == 0
    out = suffixdedup.remove_repeats(docs)
    assert out.columns == docs.columns and ids(out) == ALL
    assert {r.n_chars for r in out.where("doc_id = 3").collect()} == {0}
    assert out.where("doc_id = 2").first().text is None


def test_packing(docs, none):
    out = packing.pack_documents(docs, capacity=64, shard_rows=4)
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert words[0] == 8 and words[3] == 2 * 8 * 20_000 and 2 not in words and words[None] == 5
    assert packing.pack_documents(none).count() == 0


def test_licences(docs, none):
    out = licences.scan_licences(docs)
    assert ids(out) == ALL and out.where("score > 0").count() == 0
    assert licences.scan_licences(none).count() == 0


def test_language(docs, none):
    out = langid.identify(docs)
    assert ids(out) == ALL
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[2].language == by[1].language == by[6].language == "und" and not by[6].accepted and by[0].accepted
    assert langid.identify(none).count() == 0
    kept = langid.keep_accepted(docs)
    assert kept.columns == docs.columns and 3 in ids(kept) and 2 not in ids(kept)
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("language <> 'und'").count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, None), (None, 1), (99, 0), (4, 0)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels)
    assert ids(out) == ALL and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, None), (4, [0.0] * 4), (5, [nan, 1.0, 0.0, 0.0]), (6, [inf, 1.0, 0.0, 0.0]), (7, [1.0]), (8, [None, 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (40, [])]
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, id int, cell int")
    got = multiindex.nearest_neighbours(table).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20)}
    assert by == {0: [(1, 1.0), (20, 1.0), (2, 0.0)], 20: [(0, 1.0), (1, 1.0), (2, 0.0)]}
    assert multiindex.nearest_neighbours(table.where("false")).count() == 0


PAGES = "page_id long, url string, html string, host string, page int, rule string, verdict int, cut int, path int"


@pytest.fixture(scope="module")
def pages(spark):
    deep = "<div>" * 2000 + "deep text" + "</div>" * 2000
    rows = [(0, "http://a.org/x", "<p>one<p>two &amp; three"), (1, None, None), (None, "x", ""), (2, "http://A.ORG/x?y", deep), (2, "http://A.ORG/x?y", deep), (3, "http://", "<nav>no</nav>plain < text &am"), (4, "ftp://b.com#z", "<!-- open"), (5, "http://b.com/de/1", "<script>x")]
    return spark.createDataFrame([(*r, "h", 1, "r", 1, 1, 1) for r in rows], PAGES).repartition(3)


def test_pages(spark, pages):
    out = styletree.extract(pages)
    by = {r.page_id: r.text for r in out.collect()}
    assert by[0] == "one two & three" and by[1] == by[4] == by[5] == by[None] == "" and by[2] == "deep text" and by[3] == "plain < text &am"
    assert out.count() == 8 and styletree.extract(pages.where("false")).count() == 0
    rules = urlfilter.rule_table(spark, [("allow", "org/"), ("block", "com/de/")])
    out = urlfilter.judge(pages, rules)
    by = {r.page_id: (r.host, r["path"], r["rule"], r.verdict) for r in out.collect()}
    assert by[0] == by[2][:0] + ("a.org", "/x", "org/", "allow") and by[1] == ("", "", None, "allow") and by[None] == ("", "", None, "allow")
    assert by[3] == ("", "", None, "allow") and by[5] == ("b.com", "/de/1", "com/de/", "block") and by[4] == ("b.com", "", None, "block")
    assert out.count() == 8 and urlfilter.judge(pages.where("false"), rules).count() == 0
    assert urlfilter.judge(pages, rules.where("false")).where("rule is not null").count() == 0


def test_pipeline_stages(spark, docs, none, bench, tmp_dir):
    bench.write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    for start in (docs, none):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, tmp_dir)
            out.write.parquet(path := f"{tmp_dir}/{'some' if start is docs else 'none'}-{k}")
            now = spark.read.parquet(path)
            assert k == 4 or now.columns == docs.columns
        assert (now.count() > 0) == (start is docs)
