import random

import pytest

SYLLABLES = "ba ke lo mi nu ra so ti vu wa ze do fi gu he jo".split()
#: Columns whose names the operators use inside, so that they could clash.
CLASHING = {"score": 1.5, "items": "x", "node": 7, "key": "k", "spans": "s", "size": 3, "h": "h", "part": 1, "n": 2, "did": 4, "curve": 5, "copies": 6}


def prose(seed: int, n_words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n_words))


def edited(text: str, seed: int, share: float) -> str:
    """The text with about that share of its words replaced."""
    rng = random.Random(seed)
    return " ".join(f"new{rng.randint(0, 10**9)}" if rng.random() < share else w for w in text.split(" "))


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["web"])[i % len(sources or ["web"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts and sources, empty and blank texts, a long one, repeated rows, and columns with clashing names."""
    long = prose(1, 4000)
    rows = [
        (1, None, "en", "web"), (2, "", "en", "web"), (3, " \t\n", None, None), (4, "One", "en", "web"), (5, long, "en", "web"), (6, long, "de", None),
        (7, "Zwölf Boxkämpfer あ\U0001f600 jagen", "de", "news"), (None, "no id here at all", "en", "web"), (None, None, None, None), (8, "twice the same row of words", "en", "web"), (8, "twice the same row of words", "en", "web"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, node long, key string, spans string, size long, h string, part long, n long, did long, curve long, copies long"
    return spark.createDataFrame([(*r, len(r[1] or ""), *CLASHING.values()) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
