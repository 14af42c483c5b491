import random
import re

from glyphframe.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


def data(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "ab", "aa", "éa", "the", "THE", "x1", "longerword", "anotherlongword"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", ".", "-", "  "]) for _ in range(rnd.randint(0, n)))
    items = [(i, text(25)) for i in range(25)] + [(90, "a"), (91, "zz"), (92, "longerword, the"), (None, "b b b"), (93, None)]
    docs = [(i, text(60)) for i in range(60)] + [(100 + k, f"pre {items[k][1]} post") for k in range(25)]
    return docs, items


def test_equals_brute_force(spark):
    for seed, block in ((1, decontaminate.BLOCK_CHARS), (2, 300)):  # the second: several chained blocks
        docs, items = data(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.find_contamination(d, b, block_chars=block).collect()
        assert sorted((r.doc_id, r.n_words, sum(h.last - h.first + 1 for h in r.hits), r["items"]) for r in got) == brute(docs, items)
        kept = {r.doc_id for r in decontaminate.drop_contaminated(d, b, block_chars=block).collect()}
        assert kept == {r.doc_id for r in got if not r.hits}


def test_shift_table_jumps():
    table = decontaminate.WuManber([b"abcdefghijklmnopqrstuvwxyz0123456789", b"the quick brown fox jumps over it"])
    assert table.block == 8 and table.shift.max() == table.m - 8 + 1
