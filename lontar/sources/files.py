"""Readers and writers of the toolkit's file formats, as DataFrames.

Faulty lines fail the query with the file's name, the reason and the line itself. A line's number is its place in its
file, which a reader of splits can't know; ``located`` finds it, for faulty lines only, once a query has failed.
"""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
import warnings
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.errors import BadInput, MissingDependency

PASSAGE = "struct<docid:string,doc_id:string,id:string,title:string,text:string>"
JUDGED = f"query_id string, id string, query string, text string, positive_passages array<{PASSAGE}>, negative_passages array<{PASSAGE}>"
DEFAULT_ROOTS = ["rumah", "buku", "pidato", "karya"]


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line, value of each line that isn't blank.

    ``path``: a file, a folder or a glob. ``line`` is (block, row): it orders the lines of a file, and costs no shuffle.
    """
    raw = _raw(spark, path)
    return raw.select("file", F.struct("block", "row").alias("line"), "value").where(F.trim("value") != "")


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _checked(column: Column, valid: Column, why: str) -> Column:
    return F.when(valid, column).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(f": {why}: "), F.left("value", F.lit(80)))))


def _object() -> Column:
    return F.ltrim("value").startswith("{") & F.from_json("value", T.MapType(T.StringType(), T.StringType())).isNotNull()


def located(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """file, line (from 1, blank ones counted), reason of each faulty line of ``path``; kind: jsonl, qrels or run."""
    parts = F.split(F.trim("value"), r"\s+")
    if kind == "jsonl":
        reason = F.when(~_object(), "JSONL row must be an object").when(F.try_parse_json("value").isNull(), "invalid JSON")
    elif kind == "qrels":
        reason = F.when(F.size(parts) != 4, "qrels row must have 4 columns").when(parts[3].try_cast("int").isNull(), "relevance must be an integer")
    elif kind == "run":
        reason = F.when(F.size(parts) != 6, "run row must have 6 columns").when(parts[3].try_cast("int").isNull(), "rank must be an integer").when(parts[4].try_cast("double").isNull(), "score must be a number")
    else:
        raise BadInput(f"unknown kind of file {kind!r}")
    raw = _raw(spark, path)
    faulty = raw.where((F.trim("value") != "") & reason.isNotNull()).select("file", F.col("block").alias("b"), F.col("row").alias("r"), reason.alias("reason"))
    before = faulty.join(raw.select("file", "block", "row"), "file").where("block < b or block = b and row <= r")
    return before.groupBy("file", "b", "r", "reason").agg(F.count("*").alias("line")).select("file", "line", "reason").orderBy("file", "line")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, place: str | None = None) -> DataFrame:
    """Rows of JSON lines under ``schema``; anything but an object fails. Blank lines are skipped. ``place`` names a column
    that orders rows as the files have them."""
    rows = lines(spark, path)
    value = _checked(_checked(F.col("value"), _object(), "JSONL row must be an object"), F.try_parse_json("value").isNotNull(), "invalid JSON")
    fields = T.StructType.fromDDL(schema)
    parsed = rows.select(F.from_json(value, fields).alias("row"), F.struct("file", "line").alias("_place"))
    return parsed.select("row.*", *([F.col("_place").alias(place)] if place else []))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII as it is; the committer makes the folder appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def _split(rows: DataFrame, n: int, what: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return rows.select("file", "line", "value", _checked(parts, F.size(parts) == n, f"{what} row must have {n} columns").alias("c"))


def _number(column: Column, kind: str, what: str) -> Column:
    return _checked(column.try_cast(kind), column.try_cast(kind).isNotNull(), f"{what} must be {'an integer' if kind in ('int', 'bigint') else 'a number'}")


def read_judgments(spark: SparkSession, path: str | list[str], last_wins: bool = True) -> DataFrame:
    """query_id, iteration, doc_id, relevance of four-column judgments; of repeated pairs the last line counts."""
    rows = _split(lines(spark, path), 4, "qrels")
    c = F.col("c")
    out = rows.select("file", "line", c[0].alias("query_id"), c[1].alias("iteration"), c[2].alias("doc_id"), _number(c[3], "int", "relevance").alias("relevance"))
    if last_wins:
        return latest(out)
    return out.drop("file", "line")


def latest(rows: DataFrame) -> DataFrame:
    """Of judgments (query_id, doc_id, ..., file, line) that repeat a pair, the last."""
    order = F.struct("file", "line")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("iteration", order).alias("iteration"), F.max_by("relevance", order).alias("relevance")).select("query_id", "iteration", "doc_id", "relevance")


def parse_run(rows: DataFrame) -> DataFrame:
    """query_id, iteration, doc_id, rank, score, run_id of lines (file, line, value) with six columns."""
    c = F.col("c")
    return _split(rows, 6, "run").select(c[0].alias("query_id"), c[1].alias("iteration"), c[2].alias("doc_id"), _number(c[3], "int", "rank").alias("rank"), _number(c[4], "double", "score").alias("score"), c[5].alias("run_id"), "line")


def read_run(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A run, ordered by query and stored rank (not score), then by line."""
    return parse_run(lines(spark, path)).orderBy("query_id", "rank", "line").drop("line")  # as the file has them


def run_lines(run: DataFrame) -> DataFrame:
    """value: query, Q0, document, rank, score to six decimals, run."""
    return run.select(F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), "run_id").alias("value"))


def write_run(run: DataFrame, path: str) -> None:
    ordered = run.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank")
    run_lines(ordered).write.mode("overwrite").text(path)


def write_judgments(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("string"))).write.mode("overwrite").text(path)


def alias_queries(rows: DataFrame) -> DataFrame:
    """query_id, text of raw query rows with any of their names; a row without one fails."""
    from lontar.functions.text import first_filled, required

    return rows.select(required(first_filled(*_have(rows, "query_id", "id")), "query needs one of query_id, id").alias("query_id"), required(first_filled(*_have(rows, "query", "text")), "query needs one of query, text").alias("text"), *_place(rows))


def alias_passages(rows: DataFrame) -> DataFrame:
    """doc_id, title (null if empty), text of raw passage rows; a row without an id or text fails."""
    from lontar.functions.text import first_filled, required

    title = first_filled(*_have(rows, "title")) if "title" in rows.columns else F.lit(None).cast("string")
    return rows.select(required(first_filled(*_have(rows, "docid", "doc_id", "id")), "passage needs one of docid, doc_id, id").alias("doc_id"), title.alias("title"), required(first_filled(*_have(rows, "text")), "passage needs text").alias("text"), *_place(rows))


def _place(rows: DataFrame) -> list[str]:
    return ["place"] if "place" in rows.columns else []


def _have(rows: DataFrame, *names: str) -> list[Column]:
    found = [F.col(n) for n in names if n in rows.columns]
    return found or [F.lit(None).cast("string")]


def contents(passages: DataFrame) -> DataFrame:
    """id, contents: the title and a line end before the text, where there is a title."""
    return passages.select(F.col("doc_id").alias("id"), F.concat_ws("\n", "title", "text").alias("contents"), *_place(passages))


def read_roots(spark: SparkSession, path: str | None) -> DataFrame:
    """root: one to a line, stripped, blank lines dropped. No path is an error: an empty dictionary guards everything."""
    if path is None:
        raise BadInput("a root dictionary is needed: without one no clitic would ever be stripped")
    return spark.read.text(path).select(F.trim("value").alias("root")).where("root <> ''").distinct()


def roots_or_default(spark: SparkSession, path: str | None = None, bundled: str | None = None) -> DataFrame:
    """Roots of the file ``path``, else of a dictionary that another package brings along, else a few for tests. A
    ``bundled`` file that isn't there is told by a warning."""
    if path:
        return read_roots(spark, path)
    if bundled:
        if os.path.exists(bundled):
            return read_roots(spark, bundled)
        warnings.warn(f"{bundled} isn't there; only {len(DEFAULT_ROOTS)} roots are known", stacklevel=2)
    return spark.createDataFrame([(r,) for r in DEFAULT_ROOTS], "root string")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, which an empty table has too."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, paths: list[str], metric: str) -> DataFrame:
    """query_id, condition, value, place of all CSV files; each must have these columns. What isn't a number is null.

    A metric may be written as ndcg_10 or as ndcg@10. ``place`` orders rows as the files have them, in order of ``paths``,
    so that the first of repeated rows can be told.
    """
    out = None
    for k, path in enumerate(paths):
        rows = spark.read.option("header", True).csv(path)
        name = next((m for m in (metric, metric_name(metric), column_name(metric)) if m in rows.columns), metric)
        if missing := {"query_id", "condition", name} - set(rows.columns):
            raise BadInput(f"{path}: missing columns {', '.join(sorted(missing))}")
        place = F.struct(F.lit(k).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        rows = rows.select("query_id", "condition", F.col(f"`{name}`").try_cast("double").alias("value"), place.alias("place"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise BadInput("no metric file given")
    return out


def metric_name(column: str) -> str:
    """ndcg_10 as published tables write it: ndcg@10."""
    head, _, k = column.rpartition("_")
    return f"{head}@{k}" if head and k.isdigit() else column


def column_name(metric: str) -> str:
    return metric.replace("@", "_")


def published(rows: DataFrame) -> DataFrame:
    """Metric columns under their published names (ndcg@10; in summaries ndcg@10_mean)."""
    def name(c: str) -> str:
        for end in ("_mean", "_std", "_missing"):
            if c.endswith(end):
                return metric_name(c.removesuffix(end)) + end
        return metric_name(c)

    return rows.toDF(*[name(c) for c in rows.columns])


def read_baseline(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """value of each row of a one-condition CSV that holds a number; blanks and text go. No such column is an error."""
    rows = spark.read.option("header", True).csv(path)
    name = next((m for m in (metric, metric_name(metric), column_name(metric)) if m in rows.columns), None)
    if name is None:
        raise BadInput(f"{path}: missing column {metric}")
    return rows.select(F.col(f"`{name}`").try_cast("double").alias("value")).where("value is not null")


def read_per_query(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """query_id, value of a CSV; a row without a number is left out and of repeated queries the last row counts. A file
    without the columns has no rows."""
    rows = spark.read.option("header", True).csv(path)
    name = next((m for m in (metric, metric_name(metric), column_name(metric)) if m in rows.columns), None)
    if name is None or "query_id" not in rows.columns:
        return spark.createDataFrame([], "query_id string, value double")
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    known = rows.select("query_id", F.col(f"`{name}`").try_cast("double").alias("value"), at.alias("at")).where("value is not null and query_id is not null")
    return known.groupBy("query_id").agg(F.max_by("value", "at").alias("value"))


def read_sensitivity(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    if missing := {"query_id", "tertile"} - set(rows.columns):
        raise BadInput(f"{path}: missing columns {', '.join(sorted(missing))}")
    return rows.select(F.col("query_id").cast("string").alias("query_id"), "tertile")


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, of a file or folder."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_dense_metadata(spark: SparkSession, path: str) -> dict:
    """num_docs, dimension, model, created of a dense index."""
    return spark.read.json(f"{path}/metadata").first().asDict()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def archive(spark: SparkSession, path: str, output: str) -> int:
    """Files under ``path`` and their manifest as a zip file on this machine; returns how many. They pass one by one."""
    with zipfile.ZipFile(output, "w", zipfile.ZIP_DEFLATED) as z:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").orderBy("path")
        listed = []
        for r in files.toLocalIterator():
            name = r["path"].split(path.split("://")[-1].rstrip("/") + "/")[-1]
            z.writestr(name, bytes(r["content"]))
            listed.append({"path": name, "bytes": len(r["content"]), "sha256": hashlib.sha256(r["content"]).hexdigest()})
        z.writestr("manifest.json", json.dumps(listed, indent=1))
    return len(listed)


def load_config(path: str) -> dict:
    """A mapping from JSON, TOML or YAML, by the file's name."""
    kind = os.path.splitext(path)[1].lower()
    with open(path, "rb") as f:
        data = f.read()
    if kind == ".json":
        out = json.loads(data)
    elif kind == ".toml":
        out = tomllib.loads(data.decode())
    elif kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise MissingDependency("PyYAML", "yaml") from e
        out = yaml.safe_load(data)
    else:
        raise BadInput(f"{path}: unknown kind of configuration {kind!r}")
    if not isinstance(out, dict):
        raise BadInput(f"{path}: the top level must be a mapping")
    return out


def stable_hash(payload: object, length: int = 12) -> str:
    """Prefix of the SHA-256 of ``payload`` as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:length]
