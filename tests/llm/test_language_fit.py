"""Texts that speak none of the modelled languages are not accepted; those that do, stay."""

import base64
import random

import pytest

from glyphframe.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def marked(spark):
    rnd = random.Random(1)
    foreign = [
        "今天天气很好，我们一起去公园散步吧。这个城市有很多美丽的地方，春天的时候花都开了。" * 3,
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        base64.b64encode(bytes(rnd.randrange(256) for _ in range(600))).decode(),
        " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(rnd.randint(2, 9))) for _ in range(100)),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    known = docs.where("lang = 'en'").orderBy("doc_id").first()
    rows = [(-1 - k, t, None, None) for k, t in enumerate(foreign)]
    rows += [(-10, foreign[1], "pl", None), (-11, known.text, "xx", known.source)]  # codes without a model
    out = langid.identify(docs.unionAll(spark.createDataFrame(rows, docs.schema)))
    return {r.doc_id: (r.posterior, r.accepted) for r in out.select("doc_id", "posterior", "accepted").collect()}


def test_foreign_and_random_texts_are_not_accepted(marked):
    assert {k: marked[k][1] for k in range(-6, 0)} == dict.fromkeys(range(-6, 0), False)
    assert max(marked[k][0] for k in range(-6, 0)) > 0.9  # the posterior alone would take them


def test_rows_of_rare_declared_languages_are_not_accepted(marked):
    assert not marked[-10][1] and not marked[-11][1]


def test_clean_documents_stay(marked):
    assert all(ok for k, (p, ok) in marked.items() if k >= 0 and p >= langid.ACCEPT)


def test_a_language_of_a_small_share_is_modelled(spark):
    """Thirty rows among thousands: a share far below one in five hundred."""
    rnd = random.Random(2)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8)))
    common = [(k, " ".join(word("etaoinshr") for _ in range(12)), "en", "a.com") for k in range(20_000)]
    rare = [(-1 - k, " ".join(word("žščřěů") for _ in range(30)), "cs", "b.cz") for k in range(30)]
    lone = [(-100, " ".join(word("žščřěů") for _ in range(30)), "sk", "b.sk")]
    df = spark.createDataFrame(common + rare + lone, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.language, r.accepted) for r in langid.identify(df, sample_rows=2000).where("doc_id < 0").collect()}
    assert {got[-1 - k] for k in range(30)} == {("cs", True)}
    assert not got[-100][1], "nothing can be told of a code that one row declares"
    with pytest.raises(ValueError, match="max_languages"):
        langid.identify(df, max_languages=1)
