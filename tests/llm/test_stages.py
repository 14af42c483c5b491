"""The pipeline's stages against their own contracts, which differ from those of the queries."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline

DOC = "doc_id long, text string"


def shingles(text, width):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def similarity(a, b, width):
    a, b = shingles(a, width), shingles(b, width)
    return len(a & b) / len(a | b)


def first_of_groups(rows, width, percent):
    """Ids of the first document of every component."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def kept(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, DOC).repartition(4), "").collect())


# ---- near-duplicates: 5 words, 0.8
def test_a_copy_with_a_block_appended_goes_and_one_of_scattered_edits_stays(spark):
    base = [f"w{k}" for k in range(200)]
    longer = base + [f"x{k}" for k in range(44)]  # 0.82 at any width
    edited = [f"y{k}" if k % 40 == 20 else w for k, w in enumerate(f"v{k}" for k in range(200))]  # five words changed
    rows = [(1, " ".join(base)), (2, " ".join(longer)), (3, " ".join(f"v{k}" for k in range(200))), (4, " ".join(edited))]
    assert 0.8 <= similarity(rows[0][1], rows[1][1], 5) < 0.85 and similarity(rows[0][1], rows[1][1], 3) < 0.85
    assert similarity(rows[2][1], rows[3][1], 5) < 0.8 and similarity(rows[2][1], rows[3][1], 3) >= 0.85
    assert kept(spark, rows) == [1, 3, 4]


def test_groups_equal_brute_force(spark):
    rnd = random.Random(7)
    bases = [[f"b{b}w{k}" for k in range(rnd.choice([3, 6, 60, 150]))] for b in range(15)]
    rows = []
    for i in range(250):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10_000)}"
        w += [f"z{rnd.randrange(10_000)}" for _ in range(rnd.randint(0, len(w) // 4))]
        rows.append((i, " ".join(w)))
    expected = first_of_groups(rows, 5, 80)
    assert expected != first_of_groups(rows, 3, 85)
    assert kept(spark, rows) == expected


# ---- passages of over 50 words
def without_passages(texts, words=51):
    raw = [(t or "").encode() for t in texts]
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    windows = [[(p[i][0], p[i + words - 1][1]) for i in range(len(p) - words + 1)] for p in places]
    seen = Counter(b[x:y] for b, w in zip(raw, windows, strict=True) for x, y in w)
    out = []
    for b, w in zip(raw, windows, strict=True):
        gone = bytearray(len(b))
        for x, y in w:
            if seen[b[x:y]] > 1:
                gone[x:y] = b"\1" * (y - x)
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g).decode())
    return out


def shortened(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4)
    return [r.text or "" for r in corpus_pipeline.without_repeats(spark, df, "").orderBy("doc_id").collect()]


def test_a_passage_of_51_short_words_goes_and_one_of_50_long_words_stays(spark):
    short = " ".join("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNO")
    long = " ".join(f"longword{k}" for k in range(50))
    assert len(short) == 101 and len(short.split()) == 51 and len(long) > 400
    texts = [f"one {short} two", f"three {short} four", f"five {long} six", f"seven {long} eight", f"nine {short[2:]} ten"]
    assert shortened(spark, texts) == ["one  two", "three  four", *texts[2:]] == without_passages(texts)


def test_two_short_passages_side_by_side_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "pq")
    texts = [f"{a} {b}", f"{a} r", f"s {b}", None, "", " \n"]
    assert shortened(spark, texts) == [t or "" for t in texts]


def test_passages_equal_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: [rnd.choice("abcdeé") * rnd.choice([1, 1, 2, 9]) for _ in range(rnd.randint(0, n))]
    shared = [(text(140) + text(140) + text(140))[:140] for _ in range(5)]
    texts = []
    for _ in range(120):
        w = text(120)
        for _ in range(rnd.randint(0, 2)):
            s, at = rnd.choice(shared), rnd.randint(0, len(w))
            w = w[:at] + s[rnd.randint(0, 40) : rnd.randint(80, 140)] + w[at:]
        texts.append(rnd.choice([" ", " ", "\n", " \t"]).join(w))
    texts += [" ".join("ab" * 60), " ".join("x" * 51), " ".join("y" * 52), texts[7], texts[7]]
    expected = without_passages(texts)
    assert sum(a != b for a, b in zip(texts, expected, strict=True)) > 30
    assert shortened(spark, texts) == expected
