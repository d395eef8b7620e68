"""Quality by votes of the nearest labelled documents in a latent-semantic space.

Terms are pairs of neighbouring character classes (each ASCII punctuation mark, letters by case, digits, spaces, line
ends, other scripts) and three marks of repetition: a word that equals the one before, a line seen before, a word seen
before. Counts are damped, weighted by inverse document frequency over the labelled sample, brought to unit length and
projected on its leading singular vectors. Every document is compared with every labelled vector in blocks of exact
cosine products; its ``k`` nearest vote with their similarity, so that the score is the weighted share of label 1.

The labelled sample holds at most ``SAMPLE`` rows, so what is broadcast is bounded; whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.llm.shared import free_name

#: Labelled rows that the model is fitted on at most, singular vectors kept, neighbours that vote.
SAMPLE = 6000
RANK = 64
NEIGHBOURS = 15
#: Votes' similarity is raised to this power; prior weight of the sample's mean, which decides where nothing is near.
SHARPNESS = 8
PRIOR = 0.05
_BLOCK = 512


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, white space, line ends, other scripts, and each ASCII mark alone."""
    out = np.zeros(256, np.int64)
    mark = 7
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 1
        elif c.islower():
            out[b] = 2
        elif c.isupper():
            out[b] = 3
        elif c.isdigit():
            out[b] = 4
        elif c == "\n":
            out[b] = 5
        elif c.isspace():
            out[b] = 6
        elif b > 32 and b != 127:
            out[b] = mark
            mark += 1
    return out


_CLASS = _classes()
_N = int(_CLASS.max()) + 1
TERMS = _N * _N + 3


def counts(text: bytes) -> np.ndarray:
    """Damped term frequencies of a text, as float32."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    if len(kinds) > 1:
        out[:-3] = np.bincount(kinds[:-1] * _N + kinds[1:], minlength=TERMS - 3)
    words, lines = text.lower().split(), text.split(b"\n")
    n = max(1, len(words))
    out[:-3] *= 100 / len(kinds)
    out[-3] = 100 * sum(map(eq, words, words[1:])) / n
    out[-2] = 100 * (len(lines) - len(set(lines))) / len(lines)
    out[-1] = 20 * (1 - len(set(words)) / n)
    return np.log1p(out)


class Model:
    """Labelled latent vectors with what projects a text among them."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, rank: int, k: int):
        n = len(terms)
        self.idf = (np.log((1 + n) / (1 + (terms > 0).sum(axis=0))) + 0.3).astype(np.float32)
        x = self.weighted(terms)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64)) if n else (np.zeros(TERMS), np.eye(TERMS))
        self.axes = vectors[:, np.argsort(-values)[:rank]].astype(np.float32)
        self.vectors = self.latent(terms)
        self.labels = labels.astype(np.float32)
        self.k = min(k, n)
        self.mean = float(self.labels.mean()) if n else 0.5

    def weighted(self, terms: np.ndarray) -> np.ndarray:
        x = terms * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    def latent(self, terms: np.ndarray) -> np.ndarray:
        z = self.weighted(terms) @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.mean)
        for at in range(0, len(texts), _BLOCK) if self.k else ():
            z = self.latent(np.stack([counts(x) for x in texts[at : at + _BLOCK]]))
            near = z @ self.vectors.T
            top = np.argpartition(-near, self.k - 1, axis=1)[:, : self.k]
            weight = np.clip(np.take_along_axis(near, top, 1), 0, 1).astype(np.float64) ** SHARPNESS
            out[at : at + _BLOCK] = ((weight * self.labels[top]).sum(1) + PRIOR * self.mean) / (weight.sum(1) + PRIOR)
        return out.clip(0, 1)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1).cast(pa.binary())]
        kept = [r.nonzero()[0].astype(np.int32) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int32())), pa.array([r[k] for r, k in zip(rows, kept, strict=True)], pa.list_(pa.float32()))], names=["label", "term", "value"])


def held_out(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, rank: int = RANK, k: int = NEIGHBOURS) -> Model:
    """Fit on at most ``sample`` labelled rows that aren't held out, those first by a hash of their id and text.

    Null ids and null labels are left out; of an id with several labels the largest counts; of an id with several
    texts each is a row, within the limit.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).join(chosen, "_id")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"), "_text").limit(sample).select("label", "_text")
    found = rows.mapInArrow(_terms, "label int, term array<int>, value array<float>").toArrow()
    terms = np.zeros((found.num_rows, TERMS), np.float32)
    for i, (t, v) in enumerate(zip(found["term"], found["value"], strict=True)):
        terms[i, t.values.to_numpy()] = v.values.to_numpy()
    return Model(terms, (found["label"].to_numpy() > 0), rank, k)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` (0 to 1, higher: label 1 likelier), all else as it was.

    A null text counts as empty; an empty one gets the mean label of the sample. Nothing but the text is looked at, so
    null, repeated and tied ids are rows like any other, equal texts get equal scores, and an empty table gives an empty
    one. Neighbours at equal similarity beyond the ``k``-th are left out as they come.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, columns as they were; see ``with_score``."""
    name = free_name(docs, "_score")
    return with_score(docs, fit(docs, labels), text_col, name).where(F.col(name) >= threshold).drop(name)
