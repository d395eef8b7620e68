"""Packing token sequences as a cutting-stock problem solved by column generation.

Documents become token ids; each is cut into whole sequences and one remainder. What has to be packed is then a
histogram over at most ``SEQUENCE`` lengths, whatever the number of documents. A pattern is a multiset of lengths that
fits a sequence; a linear program over patterns covers the histogram with the fewest sequences, and a knapsack dynamic
program prices new patterns by the program's duals until the program is within ``GAP`` of a bound that no cover can pass. Pattern counts are
rounded down; what is left, a bounded number of pieces, gets further patterns by an exact-fill dynamic program. Then
every piece is ranked among those of its length, and ranks are dealt to the patterns' slots.

A piece is ranked among those of its length by the task that cuts it, and a task's ranks go on where those of the tasks
before it end. So a length, a document or a repeated row that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.llm.shared import Scratch
from lontar.llm.tokens import tokens

SEQUENCE = 1024
END = 0
#: Relative distance from the linear program's bound at which no more columns are priced.
GAP = 2e-3
#: Most basis changes for each length. Were they used up, the patterns found so far would be rounded; nothing is left out.
STEPS = 8


def _cut(path: str | None, sequence: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, ranks = tokens(path).batch, TaskContext.get().partitionId(), [0] * (sequence + 1)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, max(1, whole.num_rows), 256)):
            rows: list[tuple] = []
            for doc, own in zip(batch.column(0).to_pylist(), ids_of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(own, np.uint32(end)).astype("<u4")
                n = len(ids)
                for a in range(0, n, sequence):
                    length = min(sequence, n - a)
                    rows.append((doc, a, length, zlib.crc32(ids[a : a + sequence].tobytes()), n, part, ranks[length]))
                    ranks[length] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part, rank: each document's ids and an ``end``, cut at multiples of
    ``sequence``; a piece is the ``rank``-th of its length in the task ``part``.

    A null text counts as empty and yields its end alone. ``path`` names the tokenizer's file (default: the public one).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(path, sequence, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long")


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: counts per length, unbounded, of total length up to ``capacity``."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    low = int(lengths.min())
    for c in range(low, capacity + 1):
        fit = int(np.searchsorted(lengths, c, side="right"))
        gain = best[c - lengths[:fit]] + values[:fit]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    count = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if pick[c] >= 0:
            count[pick[c]] += 1
            c -= int(lengths[pick[c]])
        else:
            c -= 1
    return float(best[capacity]), count


def filled(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern of pieces that are left: the longest one, and others that fill its sequence as far as any choice can.

    Bit t of ``reach`` tells whether total t can be met; after each length its bits are kept to go back through.
    """
    count = np.zeros(len(lengths), np.int64)
    top = int(np.flatnonzero(left)[-1])
    count[top] = 1
    room = capacity - int(lengths[top])
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for k in np.flatnonzero(left)[::-1]:
        size, have = int(lengths[k]), int(left[k]) - int(count[k])
        for _ in range(min(have, room // size)):
            after = (reach | reach << size) & mask
            if after == reach:
                break
            steps.append((int(k), size, reach))
            reach = after
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for k, size, before in reversed(steps):
        if not before >> total & 1:
            count[k] += 1
            total -= size
    return count


def solve(histogram: dict[int, int], capacity: int = SEQUENCE, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: copies} with how often each is used; together they hold exactly the histogram."""
    lengths = np.array(sorted(length for length, n in histogram.items() if n > 0), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    out: list[tuple[np.ndarray, int]] = []
    if not len(lengths):
        return []
    # First columns: patterns that fill sequences from the histogram itself, next to one pattern for each length.
    ready, left = [], need.copy()
    while left.any():
        column = filled(lengths, left, capacity)
        ready.append(column)
        left -= column * int((left[column > 0] // column[column > 0]).min())
    pool = np.array(ready, float)
    basis = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / (capacity // lengths))
    use = need / (capacity // lengths)
    bound = float(need @ lengths) / capacity  # no cover has fewer sequences
    for step in range(STEPS * len(lengths)):
        if use.sum() <= bound * (1 + gap):
            break
        dual = inverse.sum(axis=0)
        worth = pool @ dual
        column = pool[int(worth.argmax())]
        if worth.max() <= 1 + 1e-6:
            value, column = knapsack(lengths, dual, capacity)
            if value <= 1 + gap:
                break
            pool = np.vstack([pool, column])
        direction = inverse @ column
        ratio = np.full(len(use), np.inf)
        np.divide(use, direction, out=ratio, where=direction > 1e-9)
        k = int(ratio.argmin())
        amount = max(0.0, float(ratio[k]))
        use -= amount * direction
        use[k] = amount
        basis[:, k] = column
        row = inverse[k] / direction[k]
        inverse -= np.outer(direction, row)
        inverse[k] = row
        if step % 500 == 499:
            inverse = np.linalg.inv(basis)
            use = inverse @ need
        np.maximum(use, 0, out=use)
    left = need.copy()
    for k in np.argsort(-use):
        column = basis[:, k].astype(np.int64)
        times = min(int(use[k] + 1e-6), int((left[column > 0] // column[column > 0]).min()))
        if times > 0:
            out.append((column, times))
            left -= column * times
    while left.any():
        column = filled(lengths, left, capacity)
        times = int((left[column > 0] // column[column > 0]).min())
        out.append((column, times))
        left -= column * times
    return [({int(lengths[i]): int(column[i]) for i in np.flatnonzero(column)}, times) for column, times in out]


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies per sequence, first offset): how ranks are dealt out."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            out.setdefault(length, []).append((taken.get(length, 0), sequence, copies, offset))
            taken[length] = taken.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _deal(rules: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                rule = rules[int(size)]
                rule = rule[np.searchsorted(rule[:, 0], rank[at], side="right") - 1]
                turn, copy = np.divmod(rank[at] - rule[:, 0], rule[:, 2])
                sequence[at], offset[at] = rule[:, 1] + turn, rule[:, 3] + copy * size
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Each row of ``docs`` is packed, rows with null or repeated ids and with empty or null texts too. Sequences are
    numbered from 0 without gaps, their pieces laid end to end from offset 0. An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.write(pieces(docs, id_col, text_col, path, sequence, end))
    counts = scratch.write(cut.groupBy("length", "part").agg((F.max("rank") + 1).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = scratch.write(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")))
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rules = slots(solve(histogram, sequence))
    return ranked.select(*fields, "rank").mapInArrow(_deal(rules), ", ".join(f"{c} long" for c in [*fields, "sequence_id", "offset"]))
