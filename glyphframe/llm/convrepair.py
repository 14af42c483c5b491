"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. The cheapest edits
that make it so (keep, rerole, delete, insert) are a shortest path over four states: at the
start, after a system row, after a user row, after an assistant row. A single conversation may
hold a large part of all rows, so its rows are cut into chunks that are solved at once.

1. *Rows.* Equal rows are counted before anything is shuffled; a row that stands ``m`` times is
   one row of multiplicity ``m`` from there on. The first place of each (conversation, role,
   text) comes from a partial aggregate and is joined back, so repeats are known
   without gathering a conversation.
2. *Chunks.* Rows are range-partitioned by (conversation, turn, role, text) and sorted; a task
   cuts its rows into chunks of one conversation, ``CHUNK_ROWS`` rows or ``CHUNK_CHARS``
   characters at most, numbered ``g`` in order. A conversation of several chunks, in one
   task or over many, is a chain of consecutive numbers.
3. *Backward costs.* Every chunk of a chain starts at once from a speculative cost vector (that of a
   conversation which ends there). Fix-up passes then give each chunk the vector its
   successor has found: it reruns from its end with the old and the new vector side by side
   until the two differ only by a constant, from where on its old result holds. Passes
   rerun until no chunk gets a vector that differs by more than a constant. Rows that must be
   deleted shift all costs alike and take no part, so a run of them holds up no pass.
4. *Tracing.* With the stitched vectors a chunk knows the cheapest way on from every state. Four
   traces give the state in which it ends for each state in which it may begin; these maps
   are composed by doubling until they are constant or reach the head of the chain. Then
   every chunk is traced once from its true state, taking at each step the least of the
   letters D, I, K, R that keeps the cost: the ASCII-least cheapest audit.
5. *Result.* Conversations of one chunk are finished there. The others are joined chunk by
   chunk: a task reads the chunks of a conversation in order and holds one of them, the
   digest and the audit, which is an output value of one letter an edit.

Defined results: rows go by turn (null first), equal turns by role and text; null roles and texts are
what the caller makes of them (here empty); a null conversation id is one
conversation; repeated rows are duplicates of the first; a role counts by its first letter, and one
without letters or with another letter than s, u, a cannot stay; other columns play no part; no rows give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import stored

CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 20

SPACE = r"[\x20\x09-\x0D]"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5

# States: 0 at the start, 1 after system, 2 after user, 3 after assistant.
ADDED = (2, 2, 3, 2)  # state after an inserted or reroled row, the only sound one
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # by initial s, u, a, other
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 60
LEGAL = ("su", "ua", "au")


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs where rows may be inserted first; two inserts reach every state."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[ADDED[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


END = _with_inserts([0, FAR, FAR, 0])


@cache
def before_row(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row, less their least, and that least. ``code``: 2 * initial + cut."""
    kind, cut = code >> 1, CUT * (code & 1)
    costs = []
    for s in range(4):
        ways = [DELETE + after[s], REROLE + cut + after[ADDED[s]]]
        if s in KEPT[kind]:
            ways.append(cut + after[KEPT[kind][s]])
        costs.append(min(ways))
    full = _with_inserts(costs)
    least = min(full)
    return tuple(c - least for c in full), least


def backward(codes: list[int], end: tuple[int, ...]) -> tuple[int, ...]:
    """Costs at the beginning of a chunk, up to a constant, given those at its end."""
    for code in reversed(codes):
        if code >= 0:
            end, _ = before_row(code, end)
    return end


def fix_up(codes: list[int], old_end: tuple[int, ...], old: tuple[int, ...], end: tuple[int, ...]) -> tuple[int, ...]:
    """The same, given what another end has led to: stops where both differ by a constant."""
    for code in reversed(codes):
        if end == old_end:
            return old
        if code >= 0:
            end, _ = before_row(code, end)
            old_end, _ = before_row(code, old_end)
    return end if end != old_end else old


def trace(codes: list[int], times: list[int], end: tuple[int, ...], state: int, last: bool) -> tuple[list[tuple[str, int, int]], int, int]:
    """The ASCII-least cheapest edits ``(letter, row, state after)``, their cost and the state at the
    end; ``row`` is -1 for an inserted row. ``codes`` are -1 for rows that must go; a row that stands
    ``times`` times loses all but the first of them besides."""
    vectors, sums = [end], [0]
    for code in reversed(codes):
        vector, add = (vectors[-1], 0) if code < 0 else before_row(code, vectors[-1])
        vectors.append(vector)
        sums.append(sums[-1] + add)
    vectors.reverse()
    sums.reverse()
    edits: list[tuple[str, int, int]] = []
    cost = 0
    for i, code in enumerate(codes):
        if code < 0:
            edits += [("D", i, state)] * times[i]
            cost += DELETE * times[i]
            continue
        kind, cut = code >> 1, CUT * (code & 1)
        while True:
            here = sums[i] + vectors[i][state]
            after = lambda s: sums[i + 1] + vectors[i + 1][s]  # noqa: E731, B023
            if DELETE + after(state) == here:
                edits.append(("D", i, state))
                cost += DELETE
                break
            if INSERT + sums[i] + vectors[i][ADDED[state]] == here:
                state = ADDED[state]
                edits.append(("I", -1, state))
                cost += INSERT
                continue
            if state in KEPT[kind] and cut + after(KEPT[kind][state]) == here:
                state = KEPT[kind][state]
                edits.append(("K", i, state))
                cost += cut
                break
            state = ADDED[state]
            edits.append(("R", i, state))
            cost += REROLE + cut
            break
        edits += [("D", i, state)] * (times[i] - 1)
        cost += DELETE * (times[i] - 1)
    while last and end[state]:
        state = ADDED[state]
        edits.append(("I", -1, state))
        cost += INSERT
    return edits, cost, state


def _first_places(rows: DataFrame) -> DataFrame:
    """``conv, role, text, first`` of what stands in more than one turn."""
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    found = rows.groupBy("conv", "role", "text").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return found.select(F.col("conv").alias("conv2"), F.col("role").alias("role2"), F.col("text").alias("text2"), "first")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``code`` (2 * initial + truncated, or -1: blank, -2: seen at an earlier turn)."""
    first = stored(_first_places(rows), "repair-first")
    joined = rows.join(first, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("role") == F.col("role2")) & (F.col("text") == F.col("text2")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    cut = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(blank, -1).when(F.col("first").isNotNull() & (place > F.col("first")), -2).otherwise(2 * kind + cut.cast("int"))
    return joined.select("conv", "turn", "role", "text", "m", code.alias("code"))


def _chunk_type(conv: str, turn: str) -> str:
    return f"conv {conv}, part int, seq long, inner_left boolean, inner_right boolean, roles array<string>, texts array<string>, times array<long>, codes array<int>, lo {turn}, hi {turn}, first {turn}, last {turn}, turns long, illegal long, head string, tail string, blank long, duplicate long, truncated long"


def _cut_chunks(types: tuple[pa.DataType, pa.DataType], max_rows: int, max_chars: int) -> Callable:
    """Sorted rows to chunks; ``inner_left``, ``inner_right``: the neighbour may belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        chars, begun, out, size = 0, True, [], 0
        schema = pa.schema(
            [("conv", types[0]), ("part", pa.int32()), ("seq", pa.int64()), ("inner_left", pa.bool_()), ("inner_right", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("times", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))]
            + [(k, types[1]) for k in ("lo", "hi", "first", "last")]
            + [("turns", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())]
        )

        def chunk(left: bool, right: bool) -> dict:
            conv, turns, roles, texts, times, codes = rows[0][0], *(list(x) for x in list(zip(*rows, strict=True))[1:])
            told = [t for t in turns if t is not None]
            return {
                "conv": conv, "part": part, "seq": seq, "inner_left": left, "inner_right": right, "roles": roles, "texts": texts, "times": times, "codes": codes,
                "lo": min(told, default=None), "hi": max(told, default=None), "first": turns[0], "last": turns[-1], "turns": len(set(told)),
                "illegal": sum(m - 1 for m in times) + sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False)), "head": roles[0][:1], "tail": roles[-1][:1],
                "blank": sum(m for m, c in zip(times, codes, strict=True) if c == -1), "duplicate": sum(m if c == -2 else m - 1 for m, c in zip(times, codes, strict=True) if c != -1), "truncated": sum(c >= 0 and c & 1 for c in codes),
            }

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = bool(rows) and rows[0][0] == row[0]
                if rows and (not same or len(rows) >= max_rows or chars >= max_chars):
                    out.append(chunk(begun, same))
                    size += chars
                    seq, begun, rows, chars = seq + 1, same, [], 0
                    if len(out) >= 1000 or size >= 8 * max_chars:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                rows.append(row)
                chars += len(row[2]) + len(row[3])
        if rows:
            out.append(chunk(begun, True))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _mapped(fn: Callable[[dict], dict], schema: pa.Schema) -> Callable:
    """Arrow batches row by row: what ``fn`` gives replaces or joins the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = [fn(r) for r in batch.slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in rows], schema)

    return run


_INTS = pa.list_(pa.int32())


def _begin(row: dict) -> dict:
    return row | {"end": END, "out": backward(row["codes"], END)}


def _rerun(row: dict) -> dict:
    if row["wanted"] is None or row["wanted"] == row["end"]:
        return row
    new = tuple(row["wanted"])
    return row | {"end": new, "out": fix_up(row["codes"], tuple(row["end"]), tuple(row["out"]), new)}


def _ends(row: dict) -> dict:
    """State at the end for each state at the beginning."""
    times = [1] * len(row["codes"])
    return row | {"ends": [trace(row["codes"], times, tuple(row["end"]), s, False)[2] for s in range(4)]}


def chain_costs(chain: DataFrame) -> DataFrame:
    """``g, has_next, codes, end``: cost vectors at the end of every chunk (up to a constant)."""
    state_type = "g long, has_next boolean, codes array<int>, end array<int>, out array<int>"
    schema = pa.schema([("g", pa.int64()), ("has_next", pa.bool_()), ("codes", _INTS), ("end", _INTS), ("out", _INTS)])
    state = stored(chain.select("g", "has_next", "codes").mapInArrow(_mapped(_begin, schema), state_type), "repair-costs")
    while True:
        found = state.select((F.col("g") - 1).alias("g"), F.lit(True).alias("has_next"), F.col("out").alias("wanted"))
        asked = state.join(found, ["g", "has_next"], "left").select("g", "has_next", "codes", "end", "out", "wanted")
        if not asked.where("wanted is not null and wanted <> end").limit(1).count():
            return state
        state = stored(asked.mapInArrow(_mapped(_rerun, schema), state_type), "repair-costs")


def chain_states(costs: DataFrame, chain: DataFrame) -> DataFrame:
    """``g, start``: the state in which the trace of every chunk begins."""
    schema = pa.schema([("g", pa.int64()), ("ends", _INTS)])
    ends = costs.select("g", "codes", "end").mapInArrow(_mapped(_ends, schema), "g long, ends array<int>")
    # ``back``: the chunk whose end the map starts from; null at the head, where it is state 0.
    maps = stored(ends.join(chain.select("g", "has_prev"), "g").select("g", "ends", F.when(F.col("has_prev"), F.col("g") - 1).alias("back")), "repair-states")
    constant = F.size(F.array_distinct("ends")) == 1
    while maps.where(F.col("back").isNotNull() & ~constant).limit(1).count():
        earlier = maps.select(F.col("g").alias("back"), F.col("ends").alias("earlier"), F.col("back").alias("further"))
        joined = maps.join(earlier, "back", "left")
        composed = F.when(F.col("earlier").isNull(), F.col("ends")).otherwise(F.transform("earlier", lambda s: F.get(F.col("ends"), s)))
        maps = stored(joined.select("g", composed.alias("ends"), F.col("further").alias("back")), "repair-states")
    known = maps.select((F.col("g") + 1).alias("g"), F.get("ends", F.lit(0)).alias("start"))
    return chain.where("has_prev").select("g").join(known, "g")


def _numbered(chunks: DataFrame) -> DataFrame:
    """Adds ``g``: chunks counted over all tasks in order. One number a task passes the driver."""
    counts = sorted((r.part, r.n) for r in chunks.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = chunks.sparkSession.createDataFrame(offsets, "part int, offset long")
    return chunks.join(F.broadcast(table), "part").withColumn("g", F.col("offset") + F.col("seq"))


def plan_repairs(rows: DataFrame, max_rows: int = CHUNK_ROWS, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of the rows ``conv, turn, role, text, m`` (distinct but for ``m``), each with the
    state it begins in, the cost vector at its end and whether neighbours belong to it."""
    conv, turn = rows.schema["conv"].dataType, rows.schema["turn"].dataType
    types = tuple(f.type for f in _arrow_types(rows.select("conv", "turn")))
    near = F.substring("text", 1, 256)
    # ``near`` keeps whole texts out of the sampled range bounds; equal ones meet in a task.
    flat = _faults(rows).select("conv", "turn", "role", "text", "m", "code")
    ranged = flat.repartitionByRange("conv", "turn", F.substring("role", 1, 256), near).sortWithinPartitions("conv", "turn", "role", "text")
    chunks = stored(ranged.mapInArrow(_cut_chunks(types, max_rows, max_chars), _chunk_type(conv.simpleString(), turn.simpleString())), "repair-chunks")
    chunks = _numbered(chunks)
    edge = chunks.where("inner_left or inner_right").select("g", "conv", "codes", "first", "last", "head", "tail", "inner_left", "inner_right")
    right = edge.where("inner_left").select((F.col("g") - 1).alias("g"), F.col("conv").alias("conv2"), F.col("first").alias("first2"), F.col("head").alias("head2"))
    pairs = edge.where("inner_right").join(right, "g").where(F.col("conv").eqNullSafe(F.col("conv2")))
    same_turn = F.col("last").isNotNull() & F.col("last").eqNullSafe(F.col("first2"))
    legal = F.concat("tail", "head2").isin(*LEGAL)
    pairs = stored(pairs.select("g", same_turn.cast("long").alias("turns_less"), (~legal).cast("long").alias("illegal_more")), "repair-pairs")
    nexts, prevs = pairs.withColumn("has_next", F.lit(True)), pairs.select((F.col("g") + 1).alias("g"), F.lit(True).alias("has_prev"))
    chain = nexts.join(prevs, "g", "full").select("g", F.coalesce("has_next", F.lit(False)).alias("has_next"), F.coalesce("has_prev", F.lit(False)).alias("has_prev"), "turns_less", "illegal_more")
    chain = stored(chain.join(edge.select("g", "codes"), "g"), "repair-chain")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    if not chain.limit(1).count():
        return chunks.select("*", F.lit(False).alias("linked"), F.lit(True).alias("ending"), F.lit(0).alias("start"), F.array(*map(F.lit, END)).alias("end"), F.lit(0).cast("long").alias("turns_less"), F.lit(0).cast("long").alias("illegal_more"))
    costs = chain_costs(chain)
    starts = stored(chain_states(costs, chain), "repair-starts")
    fixes = chain.select("g", "has_next", "turns_less", "illegal_more").join(costs.select("g", "end"), "g").join(starts, "g", "left")
    return chunks.join(fixes, "g", "left").select(
        *chunks.columns,
        F.col("has_next").isNotNull().alias("linked"),
        (~F.coalesce("has_next", F.lit(False))).alias("ending"),
        F.coalesce("start", F.lit(0)).alias("start"),
        F.coalesce("end", F.array(*map(F.lit, END))).alias("end"),
        zero("turns_less"),
        zero("illegal_more"),
    )


def _arrow_types(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _repaired(row: dict) -> tuple[list[tuple[str, str, str]], int]:
    """``(letter, role, text)`` of every edit of a chunk, and the cost."""
    edits, cost, _ = trace(row["codes"], row["times"], tuple(row["end"]), row["start"], row["ending"])
    out = []
    for letter, i, state in edits:
        role = ROLES[state] if letter in "IR" else row["roles"][i]
        out.append((letter, role, row["texts"][i] if i >= 0 else ""))
    return out, cost


def _finish(row: dict) -> dict:
    edits, cost = _repaired(row)
    body = "\n".join(f"{role}:{text}" for letter, role, text in edits if letter != "D").encode()
    done = not row["linked"]
    return row | {
        "cost": cost,
        "audit": "".join(e[0] for e in edits),
        "digest": hashlib.sha256(body).hexdigest() if done else None,
        "body": None if done else body,
        "turns": row["turns"] - row["turns_less"],
        "illegal": row["illegal"] + row["illegal_more"],
    }


_COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal", "cost")


def _gather(schema: pa.Schema) -> Callable:
    """The chunks of each conversation, in order, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def closed() -> pa.RecordBatch:
            row = now | {"digest": now["sha"].hexdigest(), "audit": "".join(now["audits"])}
            return pa.RecordBatch.from_pylist([{c: row[c] for c in schema.names}], schema)

        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                for row in batch.slice(k, 16).to_pylist():
                    if now is None or now["conv"] != row["conv"]:
                        if now:
                            yield closed()
                        now = {"conv": row["conv"], "lo": None, "hi": None, "sha": hashlib.sha256(), "audits": [], "any": False} | dict.fromkeys(_COUNTS, 0)
                    now["lo"] = min((x for x in (now["lo"], row["lo"]) if x is not None), default=None)
                    now["hi"] = max((x for x in (now["hi"], row["hi"]) if x is not None), default=None)
                    for c in _COUNTS:
                        now[c] += row[c]
                    if row["body"]:
                        now["sha"].update(b"\n" * now["any"] + row["body"])
                        now["any"] = True
                    now["audits"].append(row["audit"])
        if now:
            yield closed()

    return run


def distinct_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None = None) -> DataFrame:
    """``conv, turn, role, text, m``: equal rows counted by their copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    flat = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("m"))
    return flat.groupBy("conv", "turn", "role", "text").agg(F.sum("m").alias("m"))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, max_rows: int = CHUNK_ROWS, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per conversation: ``gaps, blank, duplicate, truncated, illegal, cost`` (longs),
    ``audit`` and ``repaired_sha256``. ``copies`` says how often a row stands (1); a conversation
    all of whose rows stand 0 times is an empty one."""
    conv = rows.schema[conv_col].dataType.simpleString()
    all_rows = stored(distinct_rows(rows, conv_col, turn_col, role_col, text_col, copies), "repair-rows")
    live = all_rows.where("m > 0")
    chunks = plan_repairs(live, max_rows, max_chars)
    kinds = {f.name: f for f in _arrow_types(chunks.select("conv", "lo", "hi"))}
    longs = [(c, pa.int64()) for c in _COUNTS]
    whole = pa.schema([*kinds.values(), *longs, ("audit", pa.string()), ("digest", pa.string())])
    turn = chunks.schema["lo"].dataType.simpleString()
    sql = f"conv {conv}, lo {turn}, hi {turn}, {', '.join(c + ' long' for c in _COUNTS)}, audit string, digest string"
    traced = pa.schema([*whole, ("g", pa.int64()), ("linked", pa.bool_()), ("body", pa.binary())])
    done = stored(chunks.mapInArrow(_mapped(_finish, traced), sql + ", g long, linked boolean, body binary"), "repair-traced")
    columns = whole.names
    single = done.where("not linked").select(*columns)
    chained = done.where("linked").repartition("conv").sortWithinPartitions("conv", "g").select(*columns, "body").mapInArrow(_gather(whole), sql)
    empty = all_rows.groupBy("conv").agg(F.sum("m").alias("m")).where("m = 0").select("conv", *(F.lit(None).cast(turn).alias(c) for c in ("lo", "hi")), *(F.lit(0).cast("long").alias(c) for c in _COUNTS), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("digest"))
    gaps = F.coalesce((F.col("hi") - F.col("lo") + 1).cast("long") - F.col("turns"), F.lit(0).cast("long"))
    return single.unionAll(chained).unionAll(empty).select(F.col("conv").alias(conv_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, max_rows: int = CHUNK_ROWS, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """The repaired conversations, a row per turn: ``conv_col``, ``place`` (chunk and number in
    it; turns of a conversation go by it), ``edit`` (K, R or I), ``role`` and ``text``."""
    conv = rows.schema[conv_col].dataType.simpleString()
    live = stored(distinct_rows(rows, conv_col, turn_col, role_col, text_col, copies).where("m > 0"), "repair-rows")
    chunks = plan_repairs(live, max_rows, max_chars)
    turn = pa.struct([("n", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([*_arrow_types(chunks.select("conv")), ("g", pa.int64()), ("turns", pa.list_(turn))])

    def shown(row: dict) -> dict:
        edits, _ = _repaired(row)
        return row | {"turns": [{"n": n, "edit": e, "role": role, "text": text} for n, (e, role, text) in enumerate(edits) if e != "D"]}

    out = chunks.mapInArrow(_mapped(shown, schema), f"conv {conv}, g long, turns array<struct<n:long,edit:string,role:string,text:string>>")
    flat = out.select("conv", "g", F.explode("turns").alias("t"))
    return flat.select(F.col("conv").alias(conv_col), F.struct("g", F.col("t.n").alias("n")).alias("place"), F.col("t.edit").alias("edit"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))
