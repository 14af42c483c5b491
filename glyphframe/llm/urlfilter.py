"""URL filter: rules first, then trust propagated over the link graph of hosts.

Rules name a host (with its subdomains) and the beginning of a path; the longest rule that
fits decides. Pages without a rule are judged by their host: hosts get trust as far as rules
allow their pages and distrust as far as rules block them. Trust follows links (a host that
trusted hosts link to is trusted), distrust goes against them (a host that links to blocked
hosts is distrusted), each as a personalised PageRank over the distinct edges between hosts.
A host whose trust minus distrust is below ``threshold`` is blocked. Rounds go on until a round
moves less than ``TOLERANCE``, which damping brings about in a known number of them; what is
further from all seeds than that reaches gets no score and is allowed.

All steps are DataFrame operations: host and path by string functions, rules by a join on
host suffixes (a rule list of any size is a table), both rankings in one iterated join and
sum per round, stored each round. Sums are taken map-side, so a host that a third of all
links point to is one row per task.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; the
empty host has neither seeds nor edges and is allowed; rules that tie in length are taken in
alphabetical order; repeated pages and repeated links change nothing but counts; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.llm.graph import small_side, stored

DAMPING = 0.85
THRESHOLD = 0.0
TOLERANCE = 1e-6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(verdict, rule)`` pairs such as ``("allow", "org/")`` as a table."""
    return spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to ``pages`` (with ``host`` and ``path``)."""
    parts = rules.select(F.regexp_extract("rule", "^([^/]*)", 1).alias("rule_host"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("start"), "rule", "verdict")
    labels = F.split("host", "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = pages.select("host").distinct().where("host <> ''")
    fits = hosts.withColumn("rule_host", F.explode(ends)).join(parts, "rule_host")
    # Longest first, then by name: the first that fits a path is the rule.
    order = F.struct((-F.length("rule")).alias("size"), "rule", "start", "verdict")
    fits = stored(fits.groupBy("host").agg(F.array_sort(F.collect_set(order)).alias("fits")), "url-rules")
    first = F.try_element_at(F.filter("fits", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(1))
    found = pages.join(small_side(fits), "host", "left").withColumn("fit", first)
    return found.select(*pages.columns, F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """Distinct ``src, dst`` pairs of different hosts, by the absolute links of the pages."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^"'/?#>\s]+)"""), F.lit(1))
    found = pages.select(F.col("host").alias("src"), F.explode(links).alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    return found.where("src <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Two personalised PageRanks at once: ``seeds`` (``host, kind, weight``; kind 1 trust,
    kind -1 distrust) -> ``host, trust, distrust``. Distrust runs over reversed edges; what
    hosts without edges hold goes back to the seeds."""
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = stored(seeds.join(F.broadcast(totals), "kind").where("total > 0").select("host", "kind", (F.col("weight") / F.col("total")).alias("seed")), "url-seeds")
    ways = edges.select(F.lit(1).alias("kind"), "src", "dst").unionAll(edges.select(F.lit(-1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = stored(ways.groupBy("kind", "src").agg(F.count("*").alias("out")), "url-degrees")
    ways = stored(ways.join(degree, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (1.0 / F.col("out")).alias("share")), "url-ways")
    rank = start.select("host", "kind", F.col("seed").alias("score"))
    if not ways.isEmpty():
        # A round moves at most ``damping`` of what the one before has moved, and the first
        # no more than all scores of both rankings twice.
        most = math.ceil(math.log(tolerance / 4) / math.log(damping)) + 1
        for done in range(1, most + 2):
            sent = rank.join(ways, ["host", "kind"]).groupBy(F.col("dst").alias("host"), "kind").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
            new = start.join(sent, ["host", "kind"], "full").select("host", "kind", F.coalesce("seed", F.lit(0.0)).alias("seed"), (damping * F.coalesce("got", F.lit(0.0))).alias("got"))
            left = new.groupBy("kind").agg((1.0 - F.sum("got")).alias("left"))
            new = new.join(F.broadcast(left), "kind").select("host", "kind", (F.col("got") + F.col("left") * F.col("seed")).alias("score"))
            new = stored(new, "url-rank")
            moved = new.alias("n").join(rank.alias("o"), ["host", "kind"], "full").agg(F.sum(F.abs(F.coalesce("n.score", F.lit(0.0)) - F.coalesce("o.score", F.lit(0.0))))).first()[0]
            rank = new
            if (moved or 0.0) < tolerance:
                break
            if done > most:
                raise RuntimeError(f"ranks still move by {moved} after {done} rounds")
    score = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0))
    return rank.groupBy("host").agg(score(1).alias("trust"), score(-1).alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (null: none), ``verdict``, ``trust``
    and ``distrust`` of its host."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    judged = stored(apply_rules(rows.select("page", "host", "path"), rules), "url-judged")
    ruled = judged.where("rule is not null").groupBy("host", "rule_verdict").count()
    size = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    seeds = ruled.join(size, "host").select("host", F.when(F.col("rule_verdict") == "allow", 1).otherwise(-1).alias("kind"), (F.col("count") / F.col("pages")).alias("weight"))
    ranks = small_side(stored(propagate(host_edges(rows, "html"), seeds), "url-ranks"))
    out = judged.join(ranks, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(trust - distrust < threshold, "block").otherwise("allow")
    return out.select(F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
