"""Registered queries of the training-data operators: each applies one operator, with
production parameters, to its whole table and derives the columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.llm import chatformat, convrepair, decontaminate, langid, licences, multiindex, neardup, packing, ranked, styletree, suffixdedup, toxicity, urlfilter
from glyphframe.llm.graph import stored

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(col: str) -> F.Column:
    return F.array_join(F.col(col), ",")


@register
def op1_best_fit_packing(spark, sf_dir):
    """Every document packed into sequences of 2,048 words, no two pieces of one source or
    one duplicate cluster in a bin."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op2_benchmark_decontamination(spark, sf_dir):
    """Every document against all 10-word windows of the benchmark."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined("items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@register
def op3_url_filter(spark, sf_dir):
    """Verdict on the url of every page: rules, else trust over the host graph."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


@register
def op4_html_extraction(spark, sf_dir):
    """Main text of every page by the style tree of its site."""
    found = styletree.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register
def op5_license_scan(spark, sf_dir):
    """Licence phrases and expressions of every document."""
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), "score")


@register
def op6_multi_index_search(spark, sf_dir):
    """The 20 nearest of every 20th vector."""
    return multiindex.nearest_neighbours(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


@register
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@register
def op8_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate components of every document (shingles of 3 words, similarity 0.85)."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register
def op9_suffix_array_dedup(spark, sf_dir):
    """Every byte of a 400-byte string that stands twice or more, over all documents; after
    that the passages of over 50 words that do, and the text without them."""
    found = suffixdedup.find_repeats(table(spark, sf_dir, "documents"), words=51)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"])
    return found.select(
        "doc_id",
        "n_bytes",
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        "text",
    )


@register
def op10_language_id(spark, sf_dir):
    """Language of every document: text, declared language, and its source as the host."""
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language", "text_language", "posterior", "accepted")


def damaged(conversations):
    """Rows with faults, drawn by the checksum of ``conv_id:turn``; ``copies`` says how often each
    stands."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


@register
def op11_structure_repair(spark, sf_dir):
    """Cheapest repair of every conversation after damage."""
    return convrepair.repair_conversations(damaged(table(spark, sf_dir, "conversations")), copies=F.col("copies"))


CONFLICT = "</s>[INST] ok [/INST]"


@register
def op12_chat_format(spark, sf_dir):
    """Every conversation, and one that says control strings, rendered and read back."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    out = stored(chatformat.format_conversations(rows), "chat-formatted")
    turns = F.transform(chatformat.parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = out.select("conv_id", turns.alias("turns"), chatformat.learned_text(F.col("formatted"), F.col("mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@register
def op13_ranked_search(spark, sf_dir):
    """The 50 best documents for every benchmark item."""
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def language_id_pages(spark, sf_dir):
    """The same over every page: language declared in its markup, address suffix, host."""
    pages = table(spark, sf_dir, "pages")
    address = F.regexp_extract("url", "://([^/?#]*)", 1)
    tag = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z-]+)", 1)
    rows = pages.select("page_id", "html", F.when(tag != "", tag).alias("declared"), F.when(address != "", address).alias("host"))
    found = langid.identify(rows, "page_id", "html", "declared", "host", markup=True)
    return found.select("page_id", "language", "text_language", "posterior", "accepted")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op2_benchmark_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT row, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
),
hit AS (SELECT row, k, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM hit) GROUP BY row),
items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""

SQL["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL["op9_suffix_array_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, p, md5_number(substr(h, 2 * p + 1, 800)) AS win FROM (SELECT row, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800)),
twice AS MATERIALIZED (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1),
cover AS (SELECT row, p, max(p) OVER (PARTITION BY row ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM twice),
runs AS (SELECT row, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY p) AS run FROM cover),
spans AS (SELECT row, run, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY row, run),
gaps AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS s FROM spans),
kept AS (
  SELECT g.row, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * s + 1, 2 * (a - s)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM gaps g JOIN d USING (row) GROUP BY g.row
),
words AS MATERIALIZED (
  SELECT row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS k, regexp_extract(coalesce(text, ''), '[\x20\x09-\x0D]*\z') AS tail FROM documents
),
ww AS (SELECT row, i, md5_number(regexp_replace(array_to_string(k[i:i + 50], ''), '^[\x20\x09-\x0D]+', '')) AS win FROM (SELECT row, k, unnest(range(1, len(k) - 49)) AS i FROM words WHERE len(k) > 50)),
ptwice AS MATERIALIZED (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY win) AS n FROM ww) WHERE n > 1),
pcover AS (SELECT row, i, max(i) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ptwice),
pruns AS (SELECT row, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS run FROM pcover),
pspans AS MATERIALIZED (SELECT row, run, min(i) AS a, max(i) + 50 AS b FROM pruns GROUP BY row, run),
gone AS (SELECT row, a, unnest(range(a, b + 1)) AS i FROM pspans),
told AS (SELECT row, unnest(k) AS tok, unnest(range(1, len(k) + 1)) AS i FROM words WHERE row IN (SELECT row FROM pspans)),
left_over AS (
  SELECT told.row, string_agg(CASE WHEN a IS NULL THEN tok WHEN a = told.i THEN regexp_extract(tok, '^[\x20\x09-\x0D]*') ELSE '' END, '' ORDER BY told.i) AS rest
  FROM told LEFT JOIN gone ON gone.row = told.row AND gone.i = told.i GROUP BY told.row
),
passages AS (SELECT row, count(*) AS n FROM pspans GROUP BY row)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.k, h))) AS kept_sha256, CAST(coalesce(passages.n, 0) AS BIGINT) AS n_passages, coalesce(rest || words.tail, decode(unhex(h))) AS text
FROM d LEFT JOIN kept USING (row) JOIN words USING (row) LEFT JOIN left_over USING (row) LEFT JOIN passages USING (row)
"""

SQL["op13_ranked_search"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
size AS (SELECT count(*) AS n_docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
b AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
),
p AS MATERIALIZED (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY row, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, size GROUP BY t),
score AS (
  SELECT item_id, row, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n_docs) // total)))) AS BIGINT) AS score
  FROM p JOIN weight USING (t) JOIN b USING (t) JOIN d USING (row), size GROUP BY item_id, row
),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM score JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

SQL["op12_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
r AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*/?(?:s>|(?:SYS|INST|OUT|ROLE)\]))', '\1\\\2', 'g') AS shown, regexp_replace(role, '([<\[])(\\*/?(?:s>|(?:SYS|INST|OUT|ROLE)\]))', '\1\\\2', 'g') AS named FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length(shown) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 20 WHEN 'assistant' THEN 18 ELSE 20 + length(named) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

SQL["op11_structure_repair"] = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
),
f AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(unicode(substr(key, i, 1)) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), CAST(4294967295 AS BIGINT))) % 20 AS fault FROM c
),
d AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f
),
o AS (
  SELECT *, row_number() OVER w AS pos, lead(role) OVER w AS next, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM o),
r AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(blank) AS BIGINT) AS blank, CAST(count_if(seen AND NOT blank) AS BIGINT) AS duplicate, CAST(count_if(open AND NOT seen AND NOT blank) AS BIGINT) AS truncated,
         CAST(count_if(next IS NOT NULL AND role[1:1] || next[1:1] NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal
  FROM g GROUP BY conv_id
),
inserts(s, s2, c, a, t) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
  (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
keeps(s, initial, s2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
rerole(s, s2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
edits AS (
  SELECT conv_id, pos, s, s AS s2, 2 AS c, 'D' AS a, CAST([] AS VARCHAR[]) AS t FROM g, unnest([0, 1, 2, 3]) AS states(s)
  UNION ALL SELECT conv_id, pos, s, s2, CASE WHEN open THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM g JOIN keeps ON role[1:1] = initial WHERE NOT blank AND NOT seen
  UNION ALL SELECT conv_id, pos, s, s2, CASE WHEN open THEN 6 ELSE 1 END, 'R', [rerole.role || ':' || text] FROM g, rerole WHERE NOT blank AND NOT seen
),
ways(conv_id, pos, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} FROM r
  UNION ALL
  SELECT ways.conv_id, ways.pos + 1, edits.s2, min({'c': CAST(best.c + inserts.c + edits.c AS BIGINT), 'a': best.a || inserts.a || edits.a, 't': list_concat(list_concat(best.t, inserts.t), edits.t)})
  FROM ways JOIN inserts ON inserts.s = ways.s JOIN edits ON edits.conv_id IS NOT DISTINCT FROM ways.conv_id AND edits.pos = ways.pos + 1 AND edits.s = inserts.s2
  GROUP BY ways.conv_id, ways.pos, edits.s2
),
ends AS (
  SELECT ways.conv_id, min({'c': CAST(best.c + inserts.c AS BIGINT), 'a': best.a || inserts.a, 't': list_concat(best.t, inserts.t)}) AS b
  FROM ways JOIN r ON r.conv_id IS NOT DISTINCT FROM ways.conv_id AND ways.pos = r.n JOIN inserts ON inserts.s = ways.s WHERE s2 IN (0, 3) GROUP BY ways.conv_id
)
SELECT r.conv_id, gaps, blank, duplicate, truncated, illegal, b.c AS cost, b.a AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM r JOIN ends ON ends.conv_id IS NOT DISTINCT FROM r.conv_id
UNION ALL SELECT DISTINCT conv_id, 0, 0, 0, 0, 0, 0, '', sha256('') FROM conversations WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id IS NOT DISTINCT FROM conversations.conv_id)
"""
