"""Main-text extraction with site style trees.

1. Every page is cut into blocks; a block knows the path of elements that it stands in. An
   element's label is its tag with the words of its class, id and role; equal labels nested
   in each other count once.
2. The pages of a host are merged into one tree: per path, on how many pages it stands, in
   which styles (sequences of child labels) and with which contents, all by grouped counts.
3. Importance of a branch. Content: a text that stands on ``c`` of the ``m`` pages with its
   path has the entropy ``ln c / ln m``; a branch's content importance is 1 minus the mean
   entropy of the distinct texts below it, smoothed by ``SMOOTH`` pages towards the same path
   over all hosts, and that towards 1 (few pages say little). Presentation: how the branch is marked up. An
   element may name a role (``article`` or ``main``; ``nav``, ``footer``, ``aside``,
   ``class="ad"`` ...). A wrapper names none: a form around a main element, and a class of
   several words that speaks of layout (``content-sidebar-wrap``) or stands beside a main word or tag
   (``post related-topics-on``). Where no role is named, variety of styles speaks. The two are
   combined with ``ROLE_WEIGHT`` where a role is named, else with ``STYLE_WEIGHT``.
4. Importance of a content node: 1 minus the entropy of its text, smoothed the same way. A text
   that nearly all pages of a host have in one place (below ``NODE_THRESHOLD``) is a notice even
   inside an article, unless such texts are over half of a page: then the page is a copy.
5. Branches below ``threshold`` and such nodes are cut from each page, but no main element for
   what stands around it; what is left is the main text.

A hot host is merged by map-side sums and joined by its small list of cut branches; nothing
gathers the pages of a host.

Defined results: null or empty html, and a page without text, give an empty text; a null or
host-less url has the empty host; a page with an unclosed or unknown element is read to its
end; repeated pages each count and each have a result; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import small_side, stored, text_session

THRESHOLD = 0.3
NODE_THRESHOLD = 0.15
ROLE_WEIGHT, STYLE_WEIGHT = 0.75, 0.1
SMOOTH = 20.0

# Elements without text of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never text of the page.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title"
# Elements inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Elements that an opening tag of a block ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Roles by element, and by word in class, id or role.
MAIN_TAGS = frozenset("article main".split())
AWAY_TAGS = frozenset("nav footer aside button menu dialog".split())
MAIN_WORDS = frozenset("article articlebody main content maincontent post entry story".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar navbar nav navigation sidebar footer header masthead "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe signup comment comments commentlist disqus replies respond share sharing social "
    "related recommended breadcrumb breadcrumbs pagination pager widget toolbar login search copyright legal disclaimer".split()
)
# Words of layout; a name that has one names no role.
LAYOUT_WORDS = frozenset("wrap wrapper container layout page grid row column columns col with without no has free on off".split())

# A quote opens a value only after a sign of equality; elsewhere it is part of a name.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def label(tag: str, attributes: str) -> str:
    """Tag with the names in class, id and role, words joined by ``-``: ``div.ad.main-menu``."""
    if not attributes:
        return tag
    names = [x for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()]
    names = sorted({"-".join(words) for x in names if (words := _WORD.findall(x))})
    return ".".join([tag, *names])


def step_role(step: str, inside: bool) -> int:
    """Role that one element names; ``inside``: it stands in a main element."""
    tag, *names = step.split(".")
    single = {x for x in names if "-" not in x}
    several = [set(x.split("-")) for x in names if "-" in x]
    if tag in ("html", "body"):
        return 0
    if tag in AWAY_TAGS or single & AWAY_WORDS or (tag == "header" and not inside):
        return -1
    main = tag in MAIN_TAGS or bool(single & MAIN_WORDS)
    plain = [x for x in several if not x & LAYOUT_WORDS]
    if any(x & AWAY_WORDS for x in plain):
        return 0 if main else -1  # beside a main tag or word it settles nothing
    return 1 if main or any(x & MAIN_WORDS for x in plain) else 0


def role(path: str) -> int:
    """1: main text, -1: not, 0: not said; nothing inside a branch that is none is main text."""
    found, form = 0, False
    for step in path.split(">"):
        mine = step_role(step, found == 1)
        if mine < 0:
            return -1
        found = max(found, mine)
        # A form is none, but one around a main element is only a wrapper.
        form = step.partition(".")[0] == "form" or form and mine <= 0
    return -1 if form else found


def blocks(page: str | None) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """``(path, text)`` of the blocks of a page in order, and the children's labels of every
    path (its style on this page)."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = [("", "")]  # tag, path
    children: dict[str, list[str]] = {"": []}
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            path = next(p for t, p in reversed(stack) if t not in INLINE)
            out.append((path, text))

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                held.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            continue
        if tag in VOID:
            flush()
            continue
        flush()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ()):
            stack.pop()
        name = label(tag, m[4])
        parent = stack[-1][1]
        path = parent if parent.rpartition(">")[2] == name else f"{parent}>{name}" if parent else name
        kin = children[parent]
        if not kin or kin[-1] != name:
            kin.append(name)
        children.setdefault(path, [])
        if not m[4].rstrip().endswith("/"):
            stack.append((tag, path))
    held.append(entities.unescape(page[at:]) if at < len(page) else "")
    flush()
    return out, {p: " ".join(c) for p, c in children.items()}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, pages by ``(host, path, kind, value)``: kind 0 has a value per style, kind 1
    per text."""
    for batch in batches:
        seen: Counter = Counter()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, styles = blocks(page)
            for path, style in styles.items():
                seen[host, path, 0, _hash(style)] += 1
            for path, value in {(p, _hash(t)) for p, t in found}:
                seen[host, path, 1, value] += 1
        host, path, kind, value = zip(*seen, strict=True) if seen else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(list(seen.values()), pa.int64())],
            names=["host", "path", "kind", "value", "pages"],
        )


def _importances(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per path: pages, distinct texts, sum of their importances, variety of styles."""
    pages = counts.where("kind = 0").groupBy(*keys).agg(F.sum("pages").alias("m"), F.sum(F.col("pages") * F.log("pages")).alias("s"))
    # Entropy to the base m: 1 - sum(n ln n) / (m ln m); one page has no entropy.
    styles = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    pages = pages.select(*keys, "m", styles.alias("style"))
    texts = counts.where("kind = 1").groupBy(*keys).agg(F.count("*").alias("texts"), F.sum(F.log("pages")).alias("logs"))
    entropy = F.when(F.col("m") > 1, F.col("logs") / F.log("m")).otherwise(0.0)
    both = pages.join(texts, keys, "left")
    return both.select(*keys, "m", "style", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce(F.col("texts") - entropy, F.lit(0.0)).alias("worth"))


def branch_importance(pages: DataFrame) -> DataFrame:
    """``host, path, importance`` of every branch of the merged trees of ``pages`` (``host,
    html``)."""
    return _branches(site_counts(pages))


def site_counts(pages: DataFrame) -> DataFrame:
    """``host, path, kind, value, pages`` of the merged trees, stored."""
    counts = pages.select("host", "html").mapInArrow(_tree, "host string, path string, kind int, value long, pages long")
    return stored(counts.groupBy("host", "path", "kind", "value").agg(F.sum("pages").alias("pages")), "style-counts")


def repeated_nodes(counts: DataFrame, threshold: float = NODE_THRESHOLD) -> DataFrame:
    """``host, path, value`` of the texts that nearly all pages of the host have at a path."""
    pages = counts.where("kind = 0").groupBy("host", "path").agg(F.sum("pages").alias("m")).where("m > 1")
    # A text of one page has importance 1; without those a hot host has few rows a path.
    texts = counts.where("kind = 1 and pages > 1").select("host", "path", "value", F.col("pages").alias("c"))
    importance = (F.col("m") * (1 - F.log("c") / F.log("m")) + SMOOTH) / (F.col("m") + SMOOTH)
    return texts.join(pages, ["host", "path"]).where(importance < threshold).select("host", "path", "value")


def _branches(counts: DataFrame) -> DataFrame:
    own = _importances(counts, ["host", "path"])
    everywhere = _importances(counts.groupBy("path", "kind", "value").agg(F.sum("pages").alias("pages")), ["path"])
    shrink = lambda n, toward: (F.col("m") * F.col("worth") / F.col("texts") + n * toward) / (F.col("m") + n)
    everywhere = everywhere.select("path", F.when(F.col("texts") > 0, shrink(SMOOTH, F.lit(1.0))).alias("usual"))
    smooth = shrink(SMOOTH, F.coalesce("usual", F.lit(1.0)))
    nodes = stored(own.join(everywhere, "path", "left").withColumn("worth", F.when(F.col("texts") > 0, smooth * F.col("texts")).otherwise(0.0)), "style-nodes")
    # A branch has the texts of every path below it.
    steps = F.split("path", ">")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), ">"))
    below = nodes.where("texts > 0").select("host", F.explode(up).alias("path"), "texts", "worth")
    below = below.groupBy("host", "path").agg((F.sum("worth") / F.sum("texts")).alias("content"))
    roles = F.pandas_udf(lambda s: s.map(role).astype("int32"), "int")
    both = nodes.select("host", "path", "style").join(below, ["host", "path"]).withColumn("role", roles("path"))
    weight = F.when(F.col("role") == 0, STYLE_WEIGHT).otherwise(ROLE_WEIGHT)
    mark = F.when(F.col("role") == 0, F.col("style")).otherwise((F.col("role") + 1) / 2)
    return both.select("host", "path", (weight * mark + (1 - weight) * F.col("content")).alias("importance"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts, kept_all = [], []
        for page, cut, nodes in zip(*(batch.column(names.index(c)).to_pylist() for c in ("html", "cut", "nodes")), strict=True):
            cut = set(cut or ())
            repeats = {(x["path"], x["value"]) for x in nodes or ()}
            found = blocks(page)[0]
            kept = []
            known: dict[str, bool] = {}
            for path, text in found:
                if path not in known:
                    at, known[path], main = path, True, role(path) == 1
                    # What stands around a main element does not cut it.
                    while at and (not main or role(at) == 1):
                        if at in cut:
                            known[path] = False
                            break
                        at = at.rpartition(">")[0]
                if known[path]:
                    kept.append((text, bool(repeats) and (path, _hash(text)) in repeats))
            notices = sum(len(t) for t, again in kept if again)
            if 2 * notices <= sum(len(t) for t, _ in kept):
                kept = [(t, again) for t, again in kept if not again]
            kept_all.append([t for t, _ in kept])
            texts.append(" ".join(kept_all[-1]))
        arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(kept_all, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["page", "url", "text", "blocks"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, url, ``text`` (main text) and ``blocks`` (its parts)."""
    text_session(pages)
    address = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, "://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    counts = site_counts(rows)
    low = _branches(counts).where(F.col("importance") < threshold).select("host", "path", F.lit(None).cast("long").alias("value"))
    # What is cut of a host is bounded by the paths and texts of a page, not by its pages.
    whole = F.collect_set(F.when(F.col("value").isNull(), F.col("path"))).alias("cut")
    nodes = F.collect_set(F.when(F.col("value").isNotNull(), F.struct("path", "value"))).alias("nodes")
    cut = small_side(stored(low.unionAll(repeated_nodes(counts)).groupBy("host").agg(whole, nodes), "style-cut"))
    id_type = rows.schema["page"].dataType.simpleString()
    out = rows.join(cut, "host", "left").select("page", "url", "html", "cut", "nodes").mapInArrow(_read, f"page {id_type}, url string, text string, blocks array<string>")
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", "blocks")
