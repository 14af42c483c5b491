"""Licences, language, neighbours, style trees, URL filter and toxicity."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphframe.llm import langid, licences, multiindex, queries, styletree, toxicity, urlfilter
from glyphframe.llm.kernels import WORD_TABLE, text_chunks

SF = "/root/testdata/sf0.01"


# ---- licences
@pytest.mark.parametrize(
    ("text", "tokens", "valid", "required", "offered"),
    [
        ("MIT", "MIT", True, {"mit"}, {"mit"}),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", "MIT Apache-2.0 BSD-3-Clause and or", True, set(), {"mit", "apache-2.0", "bsd-3-clause"}),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", "MIT Apache-2.0 or BSD-3-Clause and", True, {"bsd-3-clause"}, {"mit", "apache-2.0", "bsd-3-clause"}),
        ("GPL-2.0-only WITH Classpath-exception-2.0 or MIT */", "GPL-2.0-only Classpath-exception-2.0 with MIT or", True, set(), {"gpl-2.0-only", "mit"}),
        ("MIT OR", "MIT or", False, {"mit"}, {"mit"}),
        ("(MIT", "MIT", False, {"mit"}, {"mit"}),
        ("MIT and some other words", "MIT some and", True, {"mit", "some"}, {"mit", "some"}),
    ],
)
def test_shunting_yard(text, tokens, valid, required, offered):
    got, ok = licences.postfix(text)
    assert (" ".join(got), ok) == (tokens, valid)
    assert licences.evaluate(got) == (frozenset(required), frozenset(offered))


def test_licence_places_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(-1, "x MIT License, mit-license the Mit\nLicense"), (-2, "GNU General Public License"), (-3, "license"), (-4, "mit"), (-5, "SPDX-License-Identifier: MIT OR (Apache-2.0 AND ISC)\n")]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate({k: k + 32 for k in range(65, 91)}))
        at = [(k, label) for p, label in licences.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert x.base_labels == sorted({label for _, label in at}) and set(x.base_labels) <= set(x.labels)
    assert got[-5].labels == ["apache", "isc", "mit"] and got[-5].score > 0.9 and got[-2].labels == ["gpl"]


def test_added_labels(spark):
    texts = ["Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0", "SPDX-License-Identifier: MIT and thanks to all", "license ---- /* identifier: Zlib-1.2 OR LicenseRef-mine", "license.\n\n\n  identifier: ISC"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.scan_licences(df).collect()}
    assert got == {0: ["cc-by-nc"], 1: ["cc-by"], 2: ["mit"], 3: ["licenseref-mine", "zlib-1.2"], 4: ["isc"]}


# ---- language
def test_language_by_text_alone_on_rows_without_declaration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    out = langid.identify(docs.withColumn("lang", F.when(~hidden, F.col("lang"))).withColumn("source", F.lit(None).cast("string")))
    both = out.join(docs.select("doc_id", F.col("lang").alias("truth"), hidden.alias("hidden")), "doc_id").where("hidden").toPandas()
    assert len(both) > 200 and (both.language == both.truth).mean() > 0.95


def test_evidence_decides_where_the_text_does_not(spark):
    rows = [(i, "der die das und nicht", "de", "www.a.de") for i in range(60)] + [(100 + i, "the and of that with", "en", "www.b.com") for i in range(60)]
    rows += [(500, "qqq", None, "www.a.de"), (501, "qqq", None, "www.b.com"), (502, "qqq", "de", None)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in out.where("doc_id >= 500").collect()}
    assert (got[500].language, got[501].language, got[502].language) == ("de", "en", "de")
    assert abs(sum(got[500].posteriors.values()) - 1) < 1e-9


def test_pages_agree_with_their_declared_language(spark):
    out = queries.language_id_pages(spark, SF)
    truth = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("truth"))
    both = out.join(truth, "page_id").toPandas()
    assert (both.language == both.truth).mean() > 0.97


# ---- neighbours
def test_recall_and_exact_scores(spark):
    got = queries.op6_multi_index_search(spark, SF).toPandas()
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    m, ids = np.stack([np.asarray(x, float) for x in e.embedding]), e.vec_id.to_numpy()
    found = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = m @ m[q]
        scores[q] = -np.inf
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and ids[q] not in set(mine.vec_id)
        assert np.allclose(mine.score, [scores[ids == v][0] for v in mine.vec_id])
        found += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -scores))[:20]]))
        total += 20
    assert found / total >= 0.9


def test_walk_goes_by_falling_sums():
    rng = np.random.default_rng(1)
    left, right, sizes = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 4, 63)
    cells = multiindex.walk(left, right, sizes.tolist(), 10**9)
    sums = [left[c // 7] + right[c % 7] for c in cells]
    assert sums == sorted(sums, reverse=True) and sorted(cells) == np.flatnonzero(sizes).tolist()


def test_a_hot_vector_is_found_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multiindex.search(*multiindex.build(multiindex.valid_vectors(table, "vec_id", "embedding"), 8)[:2], spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "id long, vec array<double>"), 1.0, block_rows=50).collect()
    assert len(got) == 20


# ---- pages
def test_article_text_of_every_page(spark):
    import html

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    got = queries.op4_html_extraction(spark, SF).toPandas().set_index("page_id")
    for i, r in pages.iterrows():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert got.loc[i, "text"] == " ".join(x for x in parts if x) and got.loc[i, "n_chars"] == len(got.loc[i, "text"])


def test_unnamed_branches_go_by_entropy(spark):
    page = lambda k: f"<body><div><p>Welcome to our site</p><p>All rights</p></div><section><p>story {k} begins</p><p>and ends {k * 7}</p></section></body>"
    pages = spark.createDataFrame([(k, f"http://h.net/{k}", page(k)) for k in range(200)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in styletree.extract(pages).collect()}
    assert got == {k: f"story {k} begins and ends {k * 7}" for k in range(200)}


def test_named_branches(spark):
    page = "<header>H</header><main><div class='x comments'>C</div><p>A &lt;b&gt; <i>it</i>s<br>line\n two</p><aside>S</aside><form><p>F</p></form><ul><li>one<li>two</ul></main><div id=cookie-notice>N</div>"
    got = styletree.extract(spark.createDataFrame([(1, "http://h.net/", page)], "page_id long, url string, html string")).first()
    assert got.text == "A <b> its line two one two" and got.blocks == ["A <b> its line two", "one", "two"]


@pytest.mark.parametrize("wrap", ['<div class="content-sidebar-wrap">{}</div>', '<form id="aspnetForm"><article>{}</article></form>', '<div class="post related-topics-on">{}</div>', '<div class="page no-sidebar"><article>{}</article></div>', "<article>{}</article>"])
def test_articles_inside_wrappers(spark, wrap):
    """Two hundred pages of one host; a notice that repeats on all of them goes wherever it is."""
    rnd = np.random.default_rng(1)
    words = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 5000, n))
    texts = [[words(30), words(25)] for _ in range(200)]
    menu = "<nav><a href='/'>Home</a> <a href='/about'>About</a></nav><div class='main-menu'>Menu</div>"
    body = [wrap.format(f"<p>{a}</p><p>We use cookies here.</p><p>{b}</p>") for a, b in texts]
    pages = spark.createDataFrame([(k, f"http://a.net/{k}", f"<html><body>{menu}{x}<footer>the end</footer></body></html>") for k, x in enumerate(body)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in styletree.extract(pages).collect()}
    assert got == {k: f"{a} {b}" for k, (a, b) in enumerate(texts)}


def test_copies_of_a_page_keep_their_article(spark):
    rows = [(k, f"http://a.net/{k}", "<body><nav>Home</nav><article><p>one and the same</p><p>article again</p></article></body>") for k in range(300)]
    got = {r.text for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"one and the same article again"}


def test_stray_quotes_are_no_text():
    shown = lambda page: [t for _, t in styletree.blocks(page)[0]]
    assert shown('<p title="5" tall">Hello</p>') == ["Hello"]
    assert shown("<p title='it's'>Hello</p>") == ["Hello"] and shown('<p title="a>b">Hello</p>') == ["Hello"]
    assert shown('<p title="open>Hello</p>') == ["Hello"]
    assert shown("<p " + "a=b " * 5000) == ["<p " + ("a=b " * 5000).strip()]


def test_roles_of_names():
    cases = {"body>div.content-sidebar-wrap>p": 0, "body>article.comment>p": -1, "body>div.main-menu": -1, "body>div.entry-content>p": 1, "body>aside>article>p": -1, "body>form>article>p": 1, "body>article>form>p": -1, "body>form>p": -1, "body>header>h1": -1, "body>article>header>h1": 1, "body>div.post.related-topics-on": 1, "body>div.main.sidebar-left": 0}
    assert {p: styletree.role(p) for p in cases} == cases


def test_rules_equal_brute_force(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = queries.op3_url_filter(spark, SF).toPandas().set_index("page_id")
    for r in pages.itertuples():
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", r.url).groups()
        fits = [(len(rule), rule, v) for v, rule in queries.URL_RULES if (host.lower() == rule.split("/")[0] or host.lower().endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        x = got.loc[r.page_id]
        assert (x.host, x.path) == (host.lower(), path)
        if fits:
            assert (x["rule"], x.verdict) == max(fits)[1:]
        else:
            assert x["rule"] is None and x.verdict == ("block" if x.trust < x.distrust else "allow")


def test_trust_and_distrust_equal_power_iteration(spark):
    rng = np.random.default_rng(3)
    n = 12
    edges = sorted({(f"h{a}", f"h{b}") for a, b in rng.integers(0, n, (30, 2)).tolist() if a != b})
    seeds = [("h0", 1, 1.0), ("h1", 1, 0.5), ("h2", -1, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, kind int, weight double"), tolerance=1e-9).collect()}
    for k, flip in ((0, False), (1, True)):
        start = np.zeros(n)
        for h, kind, w in seeds:
            start[int(h[1:])] += w if kind == (1, -1)[k] else 0
        start /= start.sum()
        link = np.zeros((n, n))
        for a, b in edges:
            link[(int(a[1:]), int(b[1:]))[:: -1 if flip else 1]] = 1
        out = link.sum(1, keepdims=True)
        link = np.divide(link, out, where=out > 0, out=np.zeros_like(link))
        rank = start
        for _ in range(200):
            flow = 0.85 * rank @ link
            rank = flow + (1 - flow.sum()) * start
        assert np.allclose([got.get(f"h{i}", (0, 0))[k] for i in range(n)], rank, atol=1e-8)


def test_links_of_pages_spread_trust(spark):
    pages = [(1, "http://good.org/", "<a href='https://friend.net/x'>"), (2, "http://friend.net/", ""), (3, "http://farm.net/", '<A HREF="//bad.com/de/">'), (4, "http://bad.com/de/", ""), (5, "http://alone.net/", "<a href='/x'>")]
    rules = urlfilter.rule_table(spark, [("allow", "org/"), ("block", "com/de/")])
    got = {r.page_id: (r.verdict, r.trust > 0, r.distrust > 0) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("allow", True, False), 2: ("allow", True, False), 3: ("block", False, True), 4: ("block", False, True), 5: ("allow", False, False)}


def test_distrust_goes_as_far_as_the_links(spark):
    """Thirty hosts in a chain to a blocked one, which the default settings must reach."""
    pages = [(k, f"http://h{k}.net/", f"<a href='http://h{k + 1}.net/'>") for k in range(30)] + [(30, "http://h30.net/x/", "")]
    rules = urlfilter.rule_table(spark, [("block", "h30.net/x/")])
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == dict.fromkeys(range(31), "block")


# ---- toxicity
def test_held_out_accuracy(spark):
    out = toxicity.score_toxicity(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    got = out.select("doc_id", "held_out", "score", "predicted").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert 0.15 < got.held_out.mean() < 0.25
    assert (held.predicted == held.toxic).mean() > 0.97 and held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.5


def test_features_see_disguise():
    words = toxicity.Words()
    insults, person = words.of(toxicity.INSULTS), words.of(toxicity.SECOND_PERSON)
    import pyarrow as pa

    texts = ["you are an idiot today", "you are an 1d10t today", "a quiet day in the park", "WHAT A DAY!!!", "sooo good", None]
    _, _, raw, ends = next(text_chunks(pa.array(texts)))
    x = pd.DataFrame(toxicity.features(raw, ends, words, insults, np.zeros(0, np.uint64), person), columns=toxicity.FEATURES)
    assert x.insults_per_word.tolist() == [0.2, 0, 0, 0, 0, 0] and x.near_second_person[0] == 0.2 and x.disguised[1] > 0
    assert x.shouted_words[3] > 0.6 and x.repeated_signs[3] > 0 and x.drawn_out[4] > 0 and (x.iloc[5] == 0).all()
    assert WORD_TABLE[ord("A")] == ord("a")
