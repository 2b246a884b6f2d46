"""Operator 5: language identification with a blended-spectrum presence kernel.

k(x, y) counts the byte n-grams (n = 1..3, ASCII lower-cased) present in both
texts, divided by the root of both texts' own counts; n-grams of no landmark text
are left out of all three. Landmark texts give the Nyström features; one-versus-rest kernel ridge regression is solved on them.
The kernel is a dot product of presence vectors, so a batch of texts is scored
by one matrix product with the folded weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import materialize

SAMPLE_PER_LANG = 400  # labelled texts the fit uses, lowest id hashes first
LANDMARKS_PER_LANG = 24
RANK_BUCKETS = 16  # parts of a label that are ranked apart before the whole
RIDGE = 1e-3
SHARPNESS = 8.0  # turns kernel scores into 0..1 by a softmax
CHUNK = 1 << 21  # text bytes vectorised at once

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
SPACE = 256 + (1 << 16) + (1 << 24)  # n-gram codes: 1, 2 and 3 bytes


def _codes(data: np.ndarray):
    """Per n, the code of the n-gram that ends at each byte from n-1 on."""
    b = _LOWER[data]
    yield 1, b
    two = (b[:-1] << 8) | b[1:]
    yield 2, two + 256
    yield 3, ((two[:-1] << 8) | b[2:]) + (256 + (1 << 16))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n, at = len(texts), texts.offset
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[at : at + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, off


def distinct_grams(text: str) -> np.ndarray:
    """Sorted codes of the n-grams in a text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found = [np.unique(c) for n, c in _codes(data) if len(data) >= n]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Presence:
    """Rows of n-gram presence over a fixed vocabulary."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.size = len(vocabulary)
        kind = np.uint16 if self.size < 1 << 16 else np.uint32  # 33 or 67 MB
        self.index = np.full(SPACE, self.size, dtype=kind)  # one column for all others
        self.index[vocabulary] = np.arange(self.size, dtype=kind)

    def rows(self, texts: pa.Array, max_rows: int = 256):
        """Presence matrices (float32) of consecutive runs of texts."""
        data, off = _bytes(texts)
        n, start = len(texts), 0
        while start < n:
            end = start + 1
            while end < n and end - start < max_rows and off[end + 1] - off[start] <= CHUNK:
                end += 1
            x = np.zeros((end - start, self.size + 1), dtype=np.float32)
            for i in range(start, end):  # whole texts; a long one in overlapping pieces
                for lo in range(int(off[i]), max(int(off[i]) + 1, int(off[i + 1]) - 2), CHUNK):
                    piece = data[lo : min(int(off[i + 1]), lo + CHUNK + 2)]
                    for k, codes in _codes(piece):
                        if len(piece) >= k:
                            x[i - start][self.index[codes]] = 1.0
            yield x[:, : self.size]
            start = end


def _normal(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(x.sum(axis=1), 1.0))


class Model:
    """Labels and the folded weights, one column of n-gram weights per label."""

    def __init__(self, labels: list[str], vocabulary: np.ndarray, weights: np.ndarray) -> None:
        self.labels, self.vocabulary, self.weights = labels, vocabulary, weights
        self._presence: Presence | None = None

    def __getstate__(self):
        return self.labels, self.vocabulary, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(label numbers, scores in 0..1); ties go to the first label."""
        if self._presence is None:
            self._presence = Presence(self.vocabulary)
        out, score = [], []
        for x in self._presence.rows(texts):
            f = (x @ self.weights) / _normal(x)[:, None]
            e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
            out.append(f.argmax(axis=1))
            score.append(1.0 / e.sum(axis=1))
        if not out:
            return np.zeros(0, int), np.zeros(0)
        return np.concatenate(out), np.concatenate(score).astype(np.float64)


def fit(rows: list[tuple[str, np.ndarray]], landmarks: list[np.ndarray], labels: list[str],
        vocabulary: np.ndarray, ridge: float = RIDGE) -> Model:
    """Solve the ridge regression. ``rows``: (label, kernel row against the landmarks)."""
    lm = np.zeros((len(landmarks), len(vocabulary)), dtype=np.float32)
    for i, g in enumerate(landmarks):
        lm[i, np.searchsorted(vocabulary, g)] = 1.0
    lm /= _normal(lm)[:, None]
    kmm = (lm @ lm.T).astype(np.float64)
    val, vec = np.linalg.eigh(kmm)
    keep = val > 1e-6 * val.max()
    root = vec[:, keep] / np.sqrt(val[keep])  # K_mm^(-1/2)
    phi = np.stack([k for _, k in rows]) @ root
    y = np.array([[1.0 if lab == c else -1.0 for c in labels] for lab, _ in rows])
    a = phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1])
    beta = root @ np.linalg.solve(a, phi.T @ y)
    return Model(labels, vocabulary, (lm.T @ beta.astype(np.float32)).astype(np.float32))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
          per_lang: int = SAMPLE_PER_LANG, landmarks_per_lang: int = LANDMARKS_PER_LANG):
    """A model from a bounded sample of labelled rows, or None if there is none.

    Rows are eligible if the label and id are not null, the text has a letter
    and crc32 of the id as text, modulo 4, is not 2. Per label the rows of
    lowest id hash are taken, told by id, label and a hash of the text, so no text
    is sorted and no other row of a repeated id is learned from; repeated rows
    count once. They are ranked in hash buckets of a label first, so a
    label with a third of all rows is ranked in many tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("h"),
    )
    key = ["lang", "id", "h"]
    sample = rows.where(
        F.col("lang").isNotNull() & has_letter(F.col("text")) & ~held_out(F.col("id")) & F.col("id").isNotNull()
    ).select(key).distinct()
    sample = sample.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(RANK_BUCKETS)))
    for part in (["lang", "bucket"], ["lang"]):
        order = W.partitionBy(*part).orderBy(F.xxhash64("id"), "id", "h")
        sample = sample.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    sample = materialize(sample.drop("bucket"), "langid-ids")
    # at most per_lang rows a label: bounded, so broadcast
    picked = materialize(rows.join(F.broadcast(sample), key).dropDuplicates(key), "langid-sample")

    def grams(batches):
        for b in batches:
            out = [distinct_grams(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "g"])

    ids = picked.schema["id"].dataType.simpleString()
    top = picked.where(F.col("rank") <= landmarks_per_lang).orderBy("id", "lang", "h").select("id", "text")
    landmarks = [
        np.frombuffer(r["g"], dtype=np.uint32)
        for r in top.mapInArrow(grams, f"id {ids}, g binary").collect()
    ]
    if not landmarks:
        return None
    vocabulary = np.unique(np.concatenate(landmarks))
    shared = spark.sparkContext.broadcast((vocabulary, landmarks))

    def kernel(batches):
        vocab, lms = shared.value
        presence = Presence(vocab)
        lm = np.zeros((len(lms), len(vocab)), dtype=np.float32)
        for i, g in enumerate(lms):
            lm[i, np.searchsorted(vocab, g)] = 1.0
        lm /= _normal(lm)[:, None]
        for b in batches:
            got = [(x @ lm.T) / _normal(x)[:, None] for x in presence.rows(b.column("text"))]
            if got:
                rows = [r.astype(np.float64).tobytes() for r in np.concatenate(got)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("lang"), pa.array(rows, pa.binary())], ["id", "lang", "k"]
                )

    got = picked.select("id", "lang", "text").mapInArrow(kernel, f"id {ids}, lang string, k binary")
    rows = [(r["lang"], np.frombuffer(r["k"])) for r in got.orderBy("id", "lang", "k").collect()]
    return fit(rows, landmarks, sorted({lab for lab, _ in rows}), vocabulary)


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    The prediction uses the whole text and nothing else. ``und`` with score 0
    if the text is null, has no letter, or no label could be learned. Equal
    texts get equal answers; ties go to the label first in order. Other columns
    pass through; the three new names must not be taken. No rows in, none out.

    The fit takes at most ``SAMPLE_PER_LANG`` rows a label, a documented bound;
    prediction is one narrow pass over all rows with the broadcast weights
    (one float per label and n-gram of the landmark texts).
    """
    model = train(docs, id_col, text_col, lang_col)
    keep = has_letter(F.col(text_col))
    if model is None:
        pred = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(texts: pa.Array) -> pa.Array:
            m = shared.value
            best, score = m.predict(texts)
            names = pa.array([m.labels[i] for i in best], pa.string())
            return pa.StructArray.from_arrays([names, pa.array(score, pa.float64())], ["lang", "score"])

        pred = F.arrow_udf(run, "struct<lang:string,score:double>")(F.col(text_col))
    return (
        docs.withColumn("__pred", pred)
        .withColumns(
            {
                "held_out": held_out(F.col(id_col)),
                "lang_pred": F.when(keep, F.col("__pred.lang")).otherwise("und"),
                "score": F.when(keep, F.col("__pred.score")).otherwise(0.0),
            }
        )
        .drop("__pred")
    )
