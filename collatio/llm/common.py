"""What several operators share: shared storage, row identity, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK_DIR = "/tmp/checkpoints"
#: A key with more than this part of all rows is hot; there are at most as many.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir; only where that is unset (tests,
    local mode) a local folder is set instead.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its machines share")
        named = _FALLBACK_DIR
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, slim: bool = False) -> DataFrame:
    """Materialise in the shared folder and drop the lineage.

    slim: rows of a few numbers, fewer than their producers read; they are
    dealt out anew to a few files for each core of the cluster, so that neither
    many small files are written nor the producers' tasks made larger.
    """
    shared_dir(df.sparkSession)
    if slim:
        df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what a path of the shared storage holds, if anything."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def open_fs(path: str):
    """(file system, path in it) of a path of the shared storage, on any machine."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        uri = path if "://" in path else "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path


def narrow(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text, a row at least."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def coded(words: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of every word among the distinct ones, distinct words, words in each row), without empty words."""
    sizes = pa.compute.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    found = words.flatten().dictionary_encode()
    index, distinct = found.indices.to_numpy(), found.dictionary.to_pylist()
    if "" in distinct:
        real = index != distinct.index("")
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        index = index[real]
    return index, distinct, sizes


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every pair, one behind the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return flat.take(at)


def null_safe(left: DataFrame, right: DataFrame, names: list[str]):
    on = None
    for name in names:
        each = left[name].eqNullSafe(right[name])
        on = each if on is None else on & each
    return on


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with table (one row per key) where one key may hold most rows.

    table's column `count` says how many rows bear each key.  Keys with more
    than 1 of HOT_PARTS of all rows, of which there are fewer than HOT_PARTS,
    are broadcast, so their rows stay where they are; the others are joined by
    merging.  keys are null-free; table is read three times, rows twice.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total / HOT_PARTS
    names = F.broadcast(table.where(hot).select(*keys))
    many = rows.join(F.broadcast(table.where(hot)), keys)
    return many.unionByName(rows.join(names, keys, "left_anti").join(table.where(~hot).hint("shuffle_merge"), keys, how))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node, by alternating star steps.

    edges: (a long, b long), in any direction, repeats allowed.  Returns
    (node, root) for every node that an edge names.  Each round rewires every
    edge to the smaller ends of both its nodes' neighbourhoods, so the number
    of edges never grows and the depth falls at least by half; rounds end when
    nothing changes.  Only minima are gathered per node, never neighbour
    lists, and every round is written to the shared folder.
    Empty input gives an empty table; loops and null ends are dropped.
    """
    start = (
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("hi <> lo")
        .distinct()
    )
    links = cut(start, slim=True)
    if links.isEmpty():
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node moves to the node's minimum
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        # small star: every smaller neighbour, and the node, move to the minimum
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(floor, "hi")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                        F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                    )
                ).alias("e")
            )
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        after = cut(small, slim=True)
        # every node now points at one root, and no root points further: done
        deep = after.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1")
        chained = after.select(F.col("lo").alias("hi")).join(after, "hi", "left_semi")
        if deep.isEmpty() and chained.isEmpty():
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                after.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        links = after
    raise RuntimeError("connected components did not settle")


def retain(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs named by keys (id, sha, n), one row for each key.

    sha: sha2-256 of the text (null: empty); n: how many rows of docs bear the
    pair.  Where n is 1 the rows are found by a semi-join; the rest are rows
    repeated in full identity, of which partial aggregation keeps one.
    """
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.col(f"`{id_col}`").alias("_k_id"),
        F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("_k_sha"),
    )
    keys = cut(keys.select(F.col("id").alias("_k_id"), F.col("sha").alias("_k_sha"), "n"), slim=True)
    one, more = keys.where("n = 1"), keys.where("n > 1")
    kept = packed.join(one, null_safe(packed, one, ["_k_id", "_k_sha"]), "left_semi")
    if not more.isEmpty():
        several = packed.join(more, null_safe(packed, more, ["_k_id", "_k_sha"]), "left_semi")
        kept = kept.union(several.groupBy("_k_id", "_k_sha").agg(F.first("_row").alias("_row")).select("_row", "_k_id", "_k_sha"))
    return kept.select("_row.*")
