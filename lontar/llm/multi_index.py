"""Near-duplicate vectors through an inverted multi-index.

Vectors are brought to unit length and cut in halves; each half has its own codebook (k-means on a bounded sample),
and a vector lies in the cell (nearest code of the first half, nearest code of the second). A query visits cells in
ascending sum of its two squared distances, the multi-sequence order, until ``target`` of near pairs would be met;
how many cells that takes is measured, by turning sample vectors by exactly the threshold angle in random directions,
the hardest pairs that may link. Codes grow with the rows of the largest label, and where no bounded number of cells would
do, codebooks are halved until one does; with one code each, the search is exact. Every distinct vector is indexed and
every one is a query; what meets in a cell is verified by its cosine in double precision.

A pair counts if either side visits the other's cell. Each side then counts the link once: the visitor where it
visits, the visited only if it doesn't visit the visitor's cell itself. So counts are symmetric and no pair leaves
its task; links are reduced to spanning edges there. Equal vectors are one entry with a multiplicity, and a cell of
many vectors is dealt to several tasks by chunks of its entries and of its visitors.

Codebooks are for the number of dimensions that most vectors have. Vectors of another number share one cell for each
label and number, so they are compared exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.shared import Scratch, connected_components, spanning

#: Rows that the codebooks are fitted on at most, and codes of a codebook at most.
SAMPLE = 16_384
CODES = 1024
#: Rows of the largest label for each cell, and cells that a query visits at most before smaller codebooks are tried.
FULL, VISITS = 64, 256
#: Entries, and visitors, of a cell that one task compares at once.
MOST = 2048
_BLOCK = 512


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        centres[~full] = x[rng.choice(len(x), (~full).sum())]
    return centres


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The first ``cells`` cells of each row's multi-sequence order, as i * |second book| + j; the first is its own.

    A cell among the first t has at most t cells at or below it in both orders, so only ranks (i, j) with
    (i + 1)(j + 1) <= t are ever reached.
    """
    half = x.shape[1] // 2
    d = [((b**2).sum(1) - 2 * part @ b.T) for part, b in zip((x[:, :half], x[:, half:]), books, strict=True)]
    order = [np.argsort(v, axis=1, kind="stable") for v in d]
    d = [np.take_along_axis(v, o, 1) for v, o in zip(d, order, strict=True)]
    cells = min(cells, len(books[0]) * len(books[1]))
    i, j = np.array([(i, j) for i in range(min(cells, len(books[0]))) for j in range(min(cells // (i + 1), len(books[1])))]).T
    total = d[0][:, i] + d[1][:, j]
    first = np.argsort(total, axis=1, kind="stable")[:, :cells]
    return np.take_along_axis(order[0], i[first], 1) * len(books[1]) + np.take_along_axis(order[1], j[first], 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fitted(x: np.ndarray, vectors: int, threshold: float, target: float) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Codebooks from sample rows ``x`` of unit length for labels of up to ``vectors`` rows, and the number of cells to
    visit for ``target``."""
    half = x.shape[1] // 2
    rng = np.random.default_rng(9)
    turn = rng.standard_normal(x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.maximum(np.sqrt((turn**2).sum(1, keepdims=True)), 1e-12)
    near = threshold * x + np.sqrt(1 - threshold**2) * turn
    k = int(max(1, min(CODES, np.sqrt(vectors / FULL), len(x) // 16)))
    while True:
        books = (kmeans(x[:, :half], k), kmeans(x[:, half:], k, seed=8))
        most = min(len(books[0]) * len(books[1]), VISITS)
        a, b = visits(x, books, most), visits(near, books, most)

        def rank(order: np.ndarray, own: np.ndarray, most: int = most) -> np.ndarray:
            hit = order == own[:, None]
            return np.where(hit.any(1), hit.argmax(1), most)

        need = np.quantile(np.minimum(rank(a, b[:, 0]), rank(b, a[:, 0])), target) if len(x) else 0
        if need < most or k == 1:
            return books, int(min(most, need + 1))
        k //= 2


def _visit(books: tuple[np.ndarray, np.ndarray], cells: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.diff(column.offsets.to_numpy())
            plain = sizes == dim
            counts = np.where(plain, cells, 1)
            out = np.full(counts.sum(), -1, np.int32)  # the cell of vectors of other sizes
            if plain.any():
                x = column.filter(pa.array(plain)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = unit(np.pad(x, ((0, 0), (0, dim % 2))))
                out[np.repeat(plain, counts)] = visits(x, books, cells).astype(np.int32).ravel()
            flat = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "visits"])

    return run


def _verify(threshold: float):
    """Rows sorted by (space, cell, part_i, part_j): entries and visitors -> (id, n, root), partial counts and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, edges, n_edges = [], [], [], 0

        def group(rows: pa.Table) -> None:
            nonlocal edges, n_edges
            role = rows["role"].to_numpy()
            at = [np.flatnonzero(role == r) for r in (0, 1)]
            if not len(at[0]) or not len(at[1]):
                return
            vectors = rows["vector"].combine_chunks()
            x = unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(role), -1))
            rep, copies, own = (rows[c].to_numpy() for c in ("rep", "copies", "own"))
            lists = rows["visits"].combine_chunks().take(pa.array(at[0]))
            seen = lists.flatten().to_numpy().reshape(len(at[0]), -1)
            entry = x[at[0]].T
            for k in range(0, len(at[1]), _BLOCK):
                v = at[1][k : k + _BLOCK]
                a, b = np.nonzero(x[v] @ entry >= threshold)
                apart = rep[v[a]] != rep[at[0][b]]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                va, eb = v[a], at[0][b]
                back = ~(seen[b] == own[va][:, None]).any(axis=1)  # the entry doesn't visit its visitor's cell
                ids.extend((rep[va], rep[eb][back]))
                counts.extend((copies[eb], copies[va][back]))
                edges.append(np.stack([rep[va], rep[eb]]))
                n_edges += len(a)
                if n_edges > 1_000_000:
                    edges = [np.stack(spanning(*np.concatenate(edges, axis=1)))]
                    n_edges = edges[0].shape[1]
                    u, where = np.unique(np.concatenate(ids), return_inverse=True)
                    sums = np.bincount(where, np.concatenate(counts)).astype(np.int64)
                    ids[:], counts[:] = [u], [sums]

        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = np.stack([batch.column(c).to_numpy() for c in ("space", "cell", "part_i", "part_j")])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                now = tuple(keys[:, a])
                if held and now != last:
                    group(pa.concat_tables(held))
                    held = []
                last = now
                held.append(table.slice(a, b - a))
        if held:
            group(pa.concat_tables(held))
        if edges:
            u, where = np.unique(np.concatenate(ids), return_inverse=True)
            n = np.bincount(where, np.concatenate(counts)).astype(np.int64)
            node, root = spanning(*np.concatenate(edges, axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(u, node)), pa.array(np.append(n, np.zeros(len(node), np.int64))), pa.array(np.append(u, root))], names=["id", "n", "root"]
            )

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.93, target: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``rows``; vectors link at cosine >= ``threshold``
    under equal labels.

    A null label, and a vector that is null, empty, zero or has a null or non-finite component, links with nothing:
    n_links 0, its own component. Vectors of different lengths never link. A null id links with nothing either and
    has a null component. Rows that repeat an id and its vector count as copies of one another. Other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession)
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).cast("string").alias("label"))
    base = base.withColumn("sound", sound)
    # Equal vectors are told by 128 bits, so that vectors themselves move once.
    same = ["label", "h1", "h2"]
    good = base.where("sound").select("vec_id", "label", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), "vector")
    distinct = scratch.write(good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    sized = distinct.groupBy("label", F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    common = sized.groupBy("size").agg(F.sum("n").alias("n"), F.max("n").alias("largest")).orderBy(F.desc("n"), "size").first()
    dim, largest = (common["size"], common["largest"]) if common else (2, 0)
    half = dim + dim % 2
    sample = distinct.where(F.size("vector") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    x = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = np.pad(x, ((0, 0), (0, dim % 2)))
    books, cells = fitted(unit(x), largest, threshold, target) if len(x) else ((np.zeros((1, half // 2)),) * 2, 1)
    fields = f"space long, rep long, copies long, vector {kind}"
    spaced = distinct.select(F.xxhash64("label", F.size("vector")).alias("space"), "rep", "copies", "vector")
    placed = scratch.write(spaced.mapInArrow(_visit(books, cells, dim), f"{fields}, visits array<int>"))
    entries = placed.select("space", F.col("visits")[0].alias("cell"), F.lit(0).alias("role"), "rep", "copies", F.col("visits")[0].alias("own"), "vector", "visits")
    visitors = placed.select("space", F.explode("visits").alias("cell"), F.lit(1).alias("role"), "rep", "copies", F.col("visits")[0].alias("own"), "vector", F.array().cast("array<int>").alias("visits"))
    # Cells with more entries or visitors than a task should hold: how many chunks of each.
    sizes = placed.select("space", F.col("visits")[0].alias("cell"), F.lit(0).alias("role")).unionAll(placed.select("space", F.explode("visits").alias("cell"), F.lit(1).alias("role")))
    sizes = sizes.groupBy("space", "cell").agg(F.ceil(F.sum(1 - F.col("role")) / MOST).cast("int").alias("ni"), F.ceil(F.sum("role") / MOST).cast("int").alias("nj"))
    hot = scratch.write(sizes.where("ni > 1 or nj > 1 and ni > 0"))
    both = entries.unionByName(visitors).join(hot, ["space", "cell"], "left").withColumn("ni", F.coalesce("ni", F.lit(1))).withColumn("nj", F.coalesce("nj", F.lit(1)))
    chunk = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("ni")).otherwise(F.col("nj"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("nj")).otherwise(F.col("ni")) - 1))
    both = both.select("*", chunk.alias("_own"), other.alias("_other"))
    both = both.withColumn("part_i", F.when(F.col("role") == 0, F.col("_own")).otherwise(F.col("_other"))).withColumn("part_j", F.when(F.col("role") == 0, F.col("_other")).otherwise(F.col("_own")))
    dealt = both.select("space", "cell", "part_i", "part_j", "role", "rep", "copies", "own", "vector", "visits")
    dealt = dealt.repartition("space", "cell", "part_i", "part_j").sortWithinPartitions("space", "cell", "part_i", "part_j")
    found = scratch.write(dealt.mapInArrow(_verify(threshold), "id long, n long, root long"))
    degree = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    classes = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    reps = distinct.join(degree, distinct.rep == degree.id, "left").join(classes, F.col("rep") == F.col("node"), "left")
    reps = reps.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class"))
    reps = scratch.write(reps)
    linked = good.drop("vector").join(reps, same).select("vec_id", "n_links", F.col("class").alias("component_id"))
    rest = base.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
