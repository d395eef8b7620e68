"""Chat formatting through a prefix tree of conversations.

Turns become nodes, named by a digest of all turns up to and including them, so conversations that start with the same
turns share nodes. Distinct conversations are sorted by the names along their paths, which is a depth-first order of
the tree, and each emits the tokens of the nodes that its predecessor doesn't have. So the output is one stream in
which a shared turn stands once; a node has its place in the stream, position ids that count along its own path, and
the intervals of its ancestors, which its tokens may attend to besides themselves.

The sort is by range over distinct paths, so neither copies of a conversation nor a first turn that very many share
meet in one task. Each range numbers its own tokens; ranges are then joined by one row each (first and last path,
tokens), which is all the driver sees.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. In texts and roles a backslash is doubled and ``<|`` becomes
``<\\|``, and a line end in a role becomes ``\\n``, so no text can hold a control string and all can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.shared import Scratch
from lontar.llm.tokens import Tokens, tokens

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


@lru_cache(maxsize=1024)
def _around(role: str, path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids before and behind a turn's text."""
    plain = tokens(path, plain=True)
    start, stop = control_ids(plain)
    return np.append(start, plain.ids(escape_role(role) + "\n")).astype("<i4"), np.append(stop, plain.ids("\n")).astype("<i4")


def turn_tokens(role: str, body: np.ndarray, path: str | None = None) -> tuple[np.ndarray, int, int]:
    """Ids of a turn whose escaped text has the ids ``body``, and where its learned part begins and ends."""
    head, end = _around(role, path)
    learned = (len(head), len(head) + len(body)) if role == LEARNED else (0, 0)
    return np.concatenate([head, body.astype("<i4"), end]), *learned


def control_ids(plain: Tokens) -> tuple[int, int]:
    """Ids of the two control strings, behind the vocabulary's own."""
    return plain.size, plain.size + 1


def _paths(path: str | None):
    kind = pa.list_(pa.struct([("key", pa.binary()), ("size", pa.int32()), ("tokens", pa.binary()), ("loss_from", pa.int32()), ("loss_to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                out = []
                conversations = batch.column(1).to_pylist()
                bodies = iter(tokens(path, plain=True).batch([escape(t["text"]) for turns in conversations for t in turns]))
                for turns in conversations:
                    name, nodes = b"", []
                    for t in turns:
                        role, text = t["role"], t["text"]
                        name = hashlib.blake2b(b"%s%d\n%s\n%s" % (name, len(role), role.encode(), text.encode()), digest_size=16).digest()
                        ids, a, b = turn_tokens(role, next(bodies), path)
                        nodes.append({"key": name, "size": len(ids), "tokens": ids.tobytes(), "loss_from": a, "loss_to": b})
                    out.append(nodes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["conv_id", "nodes"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of paths in order: the start of each node in this range's own stream."""
    before: list[bytes] = []
    stack: list[int] = []
    at = 0
    for batch in batches:
        out = []
        for keys, sizes in zip(batch.column("keys").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            same = 0
            while same < min(len(keys), len(before)) and keys[same] == before[same]:
                same += 1
            stack = stack[:same]
            for size in sizes[same:]:
                stack.append(at)
                at += size
            before = keys
            out.append((list(stack), same))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.list_(pa.int64())), pa.array([n for _, n in out], pa.int32())], names=[*batch.schema.names, "starts", "same"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of placed paths: the nodes that no path before has, each with its place, position and ancestors' intervals."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for whole in batches:
        for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
            keys, starts, positions, ancestors = [], [], [], []
            for names, sizes, places, fresh in zip(*(batch.column(c).to_pylist() for c in ("keys", "sizes", "places", "fresh")), strict=True):
                position, path = 0, []
                for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
                    if fresh[k]:
                        keys.append(names[k])
                        starts.append(place)
                        positions.append(position)
                        ancestors.append([dict(p) for p in path])
                    position += size
                    if path and path[-1]["stop"] == place:
                        path[-1]["stop"] += size
                    else:
                        path.append({"start": place, "stop": place + size})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(positions, pa.int64()), pa.array(ancestors, spans)], names=["key", "start", "first_position", "ancestors"])


def prefix_tree(turns: DataFrame, scratch: Scratch, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations) of ``turns`` (conv_id, turn, role, text).

    nodes: start, tokens (little-endian 32-bit ids), first_position, loss_from, loss_to (offsets in the node),
    ancestors (start, stop; those that touch are merged): the stream is the nodes in order of start, without gaps.
    conversations: conv_id, number (its own), starts of the nodes along its path.

    Turns are ordered by turn, role and text, nulls first; a null role or text counts as empty; each row with a null
    conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives empty ones. Other
    columns are ignored.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    known = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    single = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    fields = "conv_id long, nodes array<struct<key:binary,size:int,tokens:binary,loss_from:int,loss_to:int>>"
    convs = scratch.write(known.unionByName(single).mapInArrow(_paths(path), fields).withColumn("number", F.monotonically_increasing_id()))
    leaf = F.element_at("nodes.key", -1)
    paths = convs.select(leaf.alias("leaf"), F.col("nodes.key").alias("keys"), F.col("nodes.size").alias("sizes")).groupBy("leaf").agg(F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))
    # The groups above are written before they are sorted, so that sampling the ranges doesn't compute them twice.
    paths = scratch.write(paths)
    ranged = paths.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "keys").sortWithinPartitions("keys").withColumn("range", F.spark_partition_id())
    numbered = scratch.write(ranged.mapInArrow(_number, "leaf binary, keys array<binary>, sizes array<int>, range int, starts array<long>, same int"))
    ends = numbered.groupBy("range").agg(F.min("keys").alias("first"), F.min_by("sizes", "keys").alias("first_sizes"), F.max("keys").alias("last"), F.max_by("starts", "keys").alias("last_starts"), F.max(F.element_at("starts", -1) + F.element_at("sizes", -1)).alias("tokens"))
    joints, base, before, place = [], 0, [], []
    for r in sorted(ends.collect(), key=lambda r: r["range"]):  # a row for each range
        shared = 0
        while shared < min(len(before), len(r["first"])) and before[shared] == r["first"][shared]:
            shared += 1
        skipped = sum(r["first_sizes"][:shared])
        carried = place[:shared]
        joints.append((r["range"], base, skipped, carried))
        place = [carried[k] if k < shared and s < skipped else base + s - skipped for k, s in enumerate(r["last_starts"])]
        before = r["last"]
        base += r["tokens"] - skipped
    joint = F.broadcast(spark.createDataFrame(joints, "range int, base long, skipped long, carried array<long>"))
    placed = numbered.join(joint, "range")
    # A start below `skipped` is a node on the path that the range before ended with: its place was found there.
    places = F.expr("transform(starts, (s, k) -> if(s < skipped, carried[k], base + s - skipped))")
    fresh = F.expr("transform(starts, (s, k) -> k >= same and s >= skipped)")
    placed = placed.select("leaf", "keys", "sizes", places.alias("places"), fresh.alias("fresh"))
    emitted = placed.select("keys", "sizes", "places", "fresh").mapInArrow(_emit, "key binary, start long, first_position long, ancestors array<struct<start:long,stop:long>>")
    ids = convs.select(F.explode("nodes").alias("n")).groupBy(F.col("n.key").alias("key")).agg(F.first("n.tokens").alias("tokens"), F.first("n.loss_from").alias("loss_from"), F.first("n.loss_to").alias("loss_to"))
    nodes = scratch.write(emitted.join(ids, "key").select("start", "tokens", "first_position", "loss_from", "loss_to", "ancestors"))
    owners = scratch.write(convs.select("conv_id", "number", leaf.alias("leaf")).join(placed.select("leaf", F.col("places").alias("starts")), "leaf").select("conv_id", "number", "starts"))
    for table in (convs, paths, numbered):
        scratch.drop(table)
    return nodes, owners


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = tokens(path, plain=True)
        shown_as = [*plain.bytes_of, START.encode(), STOP.encode()]
        turn = re.compile(rf"{re.escape(START)}(.*?)\n(.*){re.escape(STOP)}\n", re.DOTALL)

        def decode(ids: np.ndarray) -> str:
            return b"".join(map(shown_as.__getitem__, ids.tolist())).decode()

        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                out = []
                for conv, nodes in zip(batch.column("conv_id").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                    turns, learned, loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                    for n in nodes:
                        ids = np.frombuffer(n["tokens"], "<i4")
                        a, b = n["loss_from"], n["loss_to"]
                        masked = decode(ids[a:b])
                        shown = decode(ids[:a]) + masked + decode(ids[b:])
                        chars += len(shown)
                        m = turn.fullmatch(shown)
                        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                        text = unescape(masked)
                        learned.update(text.encode())
                        loss += len(text)
                    out.append((conv, len(nodes), turns.hexdigest(), loss, learned.hexdigest(), chars))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                columns = zip(*out, strict=True) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(nodes: DataFrame, conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each conversation as the stream holds it: its nodes are looked up by the places along its path."""
    wanted = conversations.select("conv_id", "number", F.posexplode("starts").alias("k", "start"))
    found = wanted.join(nodes.select("start", "tokens", "loss_from", "loss_to"), "start")
    whole = found.groupBy("number", "conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "tokens", "loss_from", "loss_to"))).alias("nodes"))
    return whole.select("conv_id", "nodes").mapInArrow(_digests(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
