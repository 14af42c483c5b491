import random
from collections import defaultdict

from glyphframe.llm import neardup


def shingles(text, width=3):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width=3, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def rows(seed, n, edits):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 6)))
    bases = [[word() for _ in range(rnd.choice([1, 2, 3, 20, 80, 150]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = word()
        out.append((i * 3 + 1, rnd.choice([" ", "\n", "\t "]).join(w)))
    return out


def check(spark, data):
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_equals_brute_force(spark):
    check(spark, rows(1, 300, 6))


def test_blocks_of_one_hot_bucket(spark, monkeypatch):
    """Many near copies of one text, some near enough and some not, in blocks of 20."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    data = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10_000)}"
        data.append((i, " ".join(w)))
    check(spark, data)
