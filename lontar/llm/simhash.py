"""SimHash near-duplicates through a hierarchical index in Gray order.

A document's fingerprint is the majority, bit by bit, of the XXH64 (seed 42) of its word 4-shingles. Two
fingerprints link at ``distance`` or fewer differing bits; a class is all that links reach.

The index. The 64 bits are cut into ``distance + j`` segments. Codes that link agree on at least j segments, so
the top nodes are the masked patterns of every choice of j segments: a node's codes share that pattern (an
accumulated difference of zero) and each linked pair meets under at least one top node, which is a group of a
shuffle. j grows with the number of distinct fingerprints, so that a node holds about as many codes at every size.
Under a top node, codes are sorted by Gray rank. ``FAN`` neighbours form a node that keeps the bits on which all its
codes agree, ``FAN`` such nodes the next one, and so on. Pairs of nodes are followed from the top; differences on bits on
which both sides agree are accumulated from level to level, and a pair is pruned with all below it as soon as they
exceed the distance. Codes of a top node of over ``MOST`` are held against their neighbours in Gray order, and those that
are then outside its largest class against all others. Links are reduced to spanning edges where they are found; exact
copies never get there, since the index holds distinct fingerprints only.

Near copies (``keep_one``). Documents whose sets of word 5-shingles have a Jaccard similarity of 0.8 differ in 15 % of
fingerprint bits at most, which is more than choices of whole segments can index. So a wider fingerprint is taken, of
``WIDE`` x 64 bits over these sets, the top nodes are the patterns under random masks of as many bits as the corpus's
size asks for, and there are as many masks as ``RECALL`` of pairs at that similarity need. Under a top node differences
are accumulated and nodes pruned as above. Pairs at ``APART`` or fewer bits link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.shared import Scratch, connected_components, free_name, spanning

SEED = 42
#: Neighbours in Gray order that a node of the index holds, and pairs of nodes that are followed at once.
FAN = 8
_PAIRS = 1 << 14
MOST = 2048
#: Groups of up to this many codes are compared at once, without a tree.
SMALL = 16
#: Codes that a top node should hold on average at most.
NODE = 1024
_BLOCK = 1 << 16
SHINGLE = 5
#: 64-bit words of the wider fingerprint, differing bits at which it links, share of pairs at similarity 0.8 that masks find.
WIDE, APART, RECALL = 4, 50, 0.97
#: Share of bits that differ at similarity 0.8, where the angle of two sets' vectors has the cosine 2 x 0.8 / 1.8.
_SHARE = float(np.arccos(1.6 / 1.8) / np.pi)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of UTF-8 text, as a signed integer; 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < 4:
        h = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        h = [digest(joined[i:j], SEED) for i, j in zip((ends - lengths)[: n - 3].tolist(), ends[3:].tolist(), strict=True)]
    hashes = np.array(h, dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        out = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "code"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code (long): one row per row of ``docs``; a null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, code long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order (the inverse Gray code)."""
    out = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def segments(distance: int, j: int) -> list[tuple[int, int]]:
    """(first bit, width) of the distance + j segments of 64 bits."""
    n = distance + j
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def top_masks(distance: int, j: int) -> list[int]:
    """The masks of the top nodes: every choice of j of the distance + j segments."""
    parts = [((1 << width) - 1) << first for first, width in segments(distance, j)]
    return [sum(chosen) for chosen in combinations(parts, j)]


def tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of nodes over ``codes`` (n x words), from the codes up: (bits, mask of the bits on which all codes below a
    node agree). A node holds ``FAN`` neighbours of the level below."""
    levels = [(codes, np.full_like(codes, ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN:
        bits, agree = levels[-1]
        starts = np.arange(0, len(bits), FAN)
        ones = np.bitwise_and.reduceat(bits & agree, starts)
        none = np.bitwise_and.reduceat(~bits & agree, starts)
        levels.append((ones, ones | none))
    return levels


def linked_pairs(codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of positions in ``codes`` (uint64, in Gray order; or n x words) at ``distance`` or fewer bits, each once.

    Pairs of nodes are followed from the top. A pair's differences are those found above plus those on bits on which
    both nodes have come to agree; a pair leaves with all below it as soon as they exceed ``distance``.
    """
    codes = codes.reshape(len(codes), -1)
    levels = tree(codes)
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    waiting = [(top, i, j, np.zeros(len(i), np.int64), np.zeros((len(i), codes.shape[1]), np.uint64))]
    while waiting:
        level, i, j, apart, known = waiting.pop()
        if len(i) > _PAIRS:
            waiting.append((level, i[_PAIRS:], j[_PAIRS:], apart[_PAIRS:], known[_PAIRS:]))
            i, j, apart, known = i[:_PAIRS], j[:_PAIRS], apart[:_PAIRS], known[:_PAIRS]
        bits, agree = levels[level]
        both = agree[i] & agree[j]
        apart = apart + np.bitwise_count((bits[i] ^ bits[j]) & both & ~known).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= distance)
        i, j, apart, known = i[near], j[near], apart[near], both[near]
        if not len(i):
            continue
        if not level:
            apart = i < j
            yield i[apart], j[apart]
            continue
        step = np.arange(FAN)
        a = np.broadcast_to((i[:, None] * FAN + step)[:, :, None], (len(i), FAN, FAN))
        b = np.broadcast_to((j[:, None] * FAN + step)[:, None, :], (len(i), FAN, FAN))
        inside = (a < len(levels[level - 1][0])) & (b < len(levels[level - 1][0])) & (a <= b)
        parent = np.nonzero(inside)[0]
        waiting.append((level - 1, a[inside], b[inside], apart[parent], known[parent]))


def _held(batches: Iterator[pa.RecordBatch], columns: int, key: int, done) -> None:
    """Call ``done`` with matrices of rows whose groups, told by the first ``key`` columns, are whole."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        m = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(columns)])
        last = int(np.flatnonzero((m[:key] != m[:key, -1:]).any(axis=0))[-1] + 1) if (m[:key, 0] != m[:key, -1]).any() else 0
        if last:
            done(np.concatenate([*held, m[:, :last]], axis=1))
            held = [m[:, last:]]
        elif held and (held[-1][:key, -1] != m[:key, 0]).any():
            done(np.concatenate(held, axis=1))
            held = [m]
        else:
            held.append(m)
    if held:
        done(np.concatenate(held, axis=1))


class _Edges:
    """Edges that are reduced to spanning ones whenever they become many."""

    def __init__(self):
        self.found: list[np.ndarray] = []
        self.count = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.found.append(np.stack([a, b]))
        self.count += len(a)
        if self.count > 2_000_000:
            self.found = [np.stack(spanning(*np.concatenate(self.found, axis=1)))]
            self.count = self.found[0].shape[1]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            a, b = spanning(*np.concatenate(self.found, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _links(distance: int, words: int):
    """Rows (node, rep, words) sorted by node -> spanning edges of what links under a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Edges()

        def groups(m: np.ndarray) -> None:
            codes = m[2:].T.copy().view(np.uint64)
            first = np.append(0, np.flatnonzero(np.diff(m[0])) + 1)
            sizes = np.diff(np.append(first, m.shape[1]))
            for size in range(2, SMALL):  # small groups of one size at once
                at = first[sizes == size][:, None]
                if len(at):
                    i, j = np.triu_indices(size, 1)
                    a, b = (at + i).ravel(), (at + j).ravel()
                    near = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1) <= distance
                    edges.add(m[1, a[near]], m[1, b[near]])
            for at, size in zip(first[sizes >= SMALL], sizes[sizes >= SMALL], strict=True):
                order = at + np.argsort(gray_rank(codes[at : at + size, 0]), kind="stable")
                for a, b in linked_pairs(codes[order], distance):
                    edges.add(m[1, order[a]], m[1, order[b]])

        _held(batches, 2 + words, 1, groups)
        yield from edges.batches()

    return run


def _neighbours(distance: int, words: int):
    """Rows (node, rep, words) in Gray order under each node -> spanning edges between a row and the next ``FAN`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Edges()
        kept = np.zeros((2 + words, 0), np.int64)
        for batch in batches:
            m = np.concatenate([kept, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(2 + words)])], axis=1)
            codes = m[2:].view(np.uint64)
            for step in range(1, min(FAN, m.shape[1] - 1) + 1):
                near = (m[0, step:] == m[0, :-step]) & (np.bitwise_count(codes[:, step:] ^ codes[:, :-step]).sum(axis=0) <= distance)
                edges.add(m[1, step:][near], m[1, :-step][near])
            kept = m[:, -FAN:]
        yield from edges.batches()

    return run


def _strays(distance: int, words: int):
    """Rows (node, part, stray, rep, words) sorted by node and part -> spanning edges between strays and all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Edges()

        def groups(m: np.ndarray) -> None:
            first = np.append(0, np.flatnonzero((np.diff(m[:2]) != 0).any(axis=0)) + 1)
            for rows in np.split(m, first[1:], axis=1):
                stray = rows[2] == 1
                own, others = rows[4:, stray].view(np.uint64), rows[4:, ~stray].view(np.uint64)
                for at in range(0, own.shape[1], 64):
                    a, b = np.nonzero(np.bitwise_count(own[:, at : at + 64, None] ^ others[:, None, :]).sum(axis=0) <= distance)
                    edges.add(rows[3, stray][at + a], rows[3, ~stray][b])

        _held(batches, 4 + words, 2, groups)
        yield from edges.batches()

    return run


def _gray(code: Column) -> Column:
    """``gray_rank`` as an expression, shifted so that it sorts as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def index_classes(codes: DataFrame, masks: list[list[int]], distance: int, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(node, component) of the ``rep`` ids of distinct ``codes`` (rep, w0, w1, ...) that link under a common mask.

    Nodes of up to ``most`` codes are searched as a whole. Under a larger one each code is first held against its
    neighbours in Gray order; then only codes outside the node's largest class so far are held against all others, so a
    group of near copies costs its size and not its square.
    """
    words = [c for c in codes.columns if c != "rep"]
    w = len(words)
    signed = [[m - (1 << 64) if m >> 63 else m for m in mask] for mask in masks]
    tops = F.array(*[F.xxhash64(F.lit(k), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(words, mask, strict=True) if m]) for k, mask in enumerate(signed)])
    nodes = codes.select("rep", *words, F.explode(tops).alias("node")).select("node", "rep", *words)
    hot = scratch.write(nodes.groupBy("node").count().where(F.col("count") > most))
    out = "a long, b long"
    # Without the hot rows no node has over `most`; a table, so it is broadcast if it is small.
    rest = nodes.join(hot.select("node"), "node", "left_anti").repartition("node").sortWithinPartitions("node")
    edges = scratch.write(rest.mapInArrow(_links(distance, w), out))
    if not hot.head(1):
        return connected_components(edges, scratch)
    rows = scratch.write(nodes.join(hot.select("node"), "node"))
    ranged = rows.withColumn("gray", _gray(F.col(words[0]))).repartitionByRange("node", "gray").sortWithinPartitions("node", "gray")
    edges = scratch.write(edges.unionByName(ranged.select("node", "rep", *words).mapInArrow(_neighbours(distance, w), out)))
    classes = connected_components(edges, scratch)
    known = scratch.write(rows.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    sizes = known.groupBy("node", "component").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.ceil(F.sum("n") / most).cast("int").alias("k"), F.count("*").alias("classes"))
    open_ = scratch.write(sizes.where("classes > 1").drop("classes"))
    apart = known.join(open_, "node")
    every = apart.select("node", F.pmod(F.xxhash64("rep"), "k").cast("int").alias("part"), F.lit(0).alias("stray"), "rep", *words)
    strays = apart.where("component <> main").select("node", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(1).alias("stray"), "rep", *words)
    dealt = every.unionByName(strays).repartition("node", "part").sortWithinPartitions("node", "part")
    found = dealt.mapInArrow(_strays(distance, w), out)
    return connected_components(edges.unionByName(found), scratch)


def link_classes(codes: DataFrame, distance: int, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(node, component) of the ``rep`` ids of distinct ``code`` rows: the classes of codes that link."""
    n = codes.count()
    j = next(j for j in range(1, 5) if j == 4 or n >> min(w for _, w in segments(distance, j)) * j <= NODE)
    return index_classes(codes.select("rep", F.col("code").alias("w0")), [[m] for m in top_masks(distance, j)], distance, scratch, most)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself included).

    One row per row of ``docs``. A null or wordless text has fingerprint zero and is linked like any other. A row
    with a null id keeps its fingerprint, stands for nothing, and gets the class that its fingerprint belongs to,
    null if all of that class have null ids. Repeated rows appear as often as they came. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, id_col, text_col))
    codes = prints.where("doc_id is not null").groupBy("code").agg(F.min("doc_id").alias("rep"))
    codes = scratch.write(codes)
    classes = link_classes(codes, distance, scratch)
    roots = codes.join(classes, codes.rep == classes.node, "left").select("code", F.coalesce("component", "rep").alias("component_id"))
    roots = scratch.write(roots)
    return prints.join(roots, "code", "left").select("doc_id", hex16("code").alias("fingerprint"), "component_id")


def hex16(col: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(col))), 16, "0")


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct word 5-shingles in order; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - SHINGLE + 1].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def wide(hashes: np.ndarray) -> np.ndarray:
    """The majority of the hashes, bit by bit, under each of ``WIDE`` mixings, as signed 64-bit words."""
    votes = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(hashes), _BLOCK):
        for k in range(WIDE):
            h = hashes[at : at + _BLOCK] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            votes[k] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits((votes * 2 > len(hashes)).astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()


def _wide_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1).cast(pa.binary())]
        sets = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0 for h in found], np.uint64).view(np.int64)
        prints = [wide(h) if len(h) else None for h in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "set", "print"])


def random_masks(rows: int) -> list[list[int]]:
    """Masks of WIDE words: of log2(rows) bits, so that a pattern is shared by chance about once, and as many as RECALL needs."""
    bits = min(48, max(8, int(np.ceil(np.log2(max(rows, 2))))))
    n = int(np.ceil(np.log(1 - RECALL) / np.log(1 - (1 - _SHARE) ** bits)))
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(n):
        chosen = rng.choice(64 * WIDE, bits, replace=False)
        out.append([sum(1 << int(b) % 64 for b in chosen if b // 64 == k) for k in range(WIDE)])
    return out


def near_copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", distance: int = APART, most: int = MOST) -> DataFrame:
    """(doc_id, component_id) of the rows of ``docs`` that have an id: the smallest id that links of near copies reach.

    A null text counts as empty, and texts without words are copies of each other only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    read = scratch.write(rows.mapInArrow(_wide_prints, "doc_id long, set long, print array<long>"))
    reps = scratch.write(read.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("print").alias("print")))
    known = reps.where("print is not null")
    codes = known.select("rep", *[F.col("print")[w].alias(f"w{w}") for w in range(WIDE)])
    classes = index_classes(codes, random_masks(known.count()), distance, scratch, most)
    roots = scratch.write(reps.join(classes, reps.rep == classes.node, "left").select("set", F.coalesce("component", "rep").alias("component_id")))
    return read.select("doc_id", "set").join(roots, "set").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = APART) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class of near copies, columns as they were; rows with a null
    id stay, and repeated rows of an id that stays all do. An empty table gives an empty one."""
    scratch = Scratch(docs.sparkSession)
    copy = free_name(docs, "_copy")
    found = near_copies(docs, scratch, id_col, text_col, distance)
    drop = scratch.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct())
    return docs.join(drop, F.col(id_col).cast("long") == F.col(copy), "left_anti")
