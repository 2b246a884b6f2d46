"""Small tables with the hard cases every operator must take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names an operator might use inside; they must not clash.
CLASHING = "rid int, id string, key string, label string, rank int, shard int, n int, band int"


def prose(seed, n, words=None):
    rng = random.Random(seed)
    words = words or [f"w{i}" for i in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


def hard_docs():
    """Nulls in every column, empty and long texts, copies, repeated rows."""
    long = prose(1, 6000)
    rows = [
        (1, prose(2, 120), "en", "a"), (2, prose(2, 120), "fr", "b"), (3, prose(3, 120), "en", "a"),
        (4, None, "en", "a"), (5, "", None, None), (6, "", "en", "b"), (7, long, "en", None),
        (8, long + " tail", "fr", "a"), (9, "é", None, "a"), (10, "...  \n\t", "en", "c"),
        (11, "word", "fr", "c"), (12, "Word!", "fr", "c"), (3, prose(3, 120), "en", "a"),
        (None, prose(4, 90), "en", "a"), (None, None, None, None), (13, "\U0001f600 x \U0001f600", "en", "z"),
    ]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


def hard_frame(spark):
    """The hard rows with extra columns of clashing names."""
    extra = (1, "x", None, "y", 2, 3, 4, 5)
    return spark.createDataFrame([(*r, *extra) for r in hard_docs()], f"{DOCS}, {CLASHING}")


def empty_frame(spark):
    return spark.createDataFrame([], DOCS)
