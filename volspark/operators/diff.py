"""Differences between two copies of a table, by content-defined chunks.

Both sides are sorted by key over common key ranges and cut behind rows at which a rolling hash of the keys meets a condition, so
that a missing or additional row moves no cuts but those next to it. Chunks with equal fingerprints (row count, key range
and two additive hashes of all rows) on both sides are alike; an anti-join leaves the others, and only their rows are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import additive, additive_names, row_hash
from ..session import written

#: A chunk has this many rows on average; the rolling hash covers ROLL keys.
CHUNK_ROWS, ROLL = 16, 3


def chunked(both: DataFrame, key: str, fields: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of both sides (`_side` 0 and 1) with their range, chunk and two row hashes; a table in the shared folder."""
    ranged = both.repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    own = W.partitionBy("_range", "_side").orderBy(key)
    cols = [key, *fields]
    df = ranged.withColumns({"_k": F.xxhash64(key).bitwiseAND(0xFFFFFF), "_h1": row_hash(ranged, cols, 1), "_h2": row_hash(ranged, cols, 2)})
    rolling = F.sum("_k").over(own.rowsBetween(1 - ROLL, 0))
    df = df.withColumn("_cut", (F.pmod(F.xxhash64(rolling), F.lit(chunk_rows)) == 0).cast("int"))
    df = df.withColumn("_chunk", F.coalesce(F.sum("_cut").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return written(df.drop("_k", "_cut"), "chunks")


def unmatched(rows: DataFrame, key: str) -> DataFrame:
    """The chunks of either side that the other side doesn't have."""
    prints = ["n", "k0", "k1", *additive_names("a"), *additive_names("b")]
    chunks = rows.groupBy("_range", "_side", "_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("k0"), F.max(key).alias("k1"), *additive(F.col("_h1"), "a"), *additive(F.col("_h2"), "b")
    )
    left, right = chunks.where("_side = 0"), chunks.where("_side = 1")
    place = ["_range", "_side", "_chunk"]
    return (
        left.join(right.select(*prints), prints, "left_anti").select(*place).unionByName(right.join(left.select(*prints), prints, "left_anti").select(*place))
    )


def diff_tables(
    left: DataFrame, right: DataFrame, key: str, fields: list[str], missing_right: str = "missing_right", missing_left: str = "missing_left", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(row_key, field): rows missing on either side and fields whose values differ, null being unlike any value but null.

    Both sides have `key` (unique; rows with a null key are passed over) and `fields`, in equal types; other columns are left out.
    Empty tables are legal: all rows of the other side are then missing.
    """
    cols = [key, *fields]
    sides = [df.where(F.col(key).isNotNull()).select(*cols, F.lit(k).alias("_side")) for k, df in enumerate((left, right))]
    rows = chunked(sides[0].unionByName(sides[1]), key, fields, chunk_rows)
    suspect = rows.join(unmatched(rows, key), ["_range", "_side", "_chunk"], "left_semi")
    values = F.struct(*[F.col(f) for f in fields])
    pairs = suspect.groupBy(F.col(key).alias("row_key")).agg(
        *[F.max(F.when(F.col("_side") == k, F.lit(True))).alias(f"has{k}") for k in (0, 1)],
        *[F.first(F.when(F.col("_side") == k, values), ignorenulls=True).alias(f"s{k}") for k in (0, 1)],
    )
    unlike = [F.when(~F.col(f"s0.{f}").eqNullSafe(F.col(f"s1.{f}")), F.lit(f)) for f in fields]
    found = F.when(F.col("has1").isNull(), F.array(F.lit(missing_right))).when(F.col("has0").isNull(), F.array(F.lit(missing_left))).otherwise(F.array_compact(F.array(*unlike)))
    return pairs.select("row_key", F.explode(found).alias("field"))


# copies of object trees --------------------------------------------------------------------------------------------
_NUMBER = "try_cast(regexp_replace({}, '^\\\\s+|\\\\s+$', '') as decimal(38,6))"


def local_states(objects: DataFrame) -> DataFrame:
    """Each key's last state by `listed_at`, then `row_id`; rows with a null key, size or mtime_ns are passed over."""
    rows = objects.where("key is not null and size is not null and mtime_ns is not null")
    last = rows.groupBy("key").agg(F.max(F.struct("listed_at", "row_id", "size", "mtime_ns")).alias("s"))
    return last.select("key", *[F.col(c).cast("decimal(38,6)").alias(n) for c, n in (("s.size", "size"), ("s.size", "meta_size"), ("s.mtime_ns", "mtime_ns"))])


def remote_states(remote: DataFrame) -> DataFrame:
    """Each key's highest version, one leading slash ignored, without deleted objects; ties: the largest values."""
    key = F.regexp_replace("key", "^/", "")
    last = (
        remote.where("key is not null")
        .groupBy(key.alias("key"))
        .agg(F.max(F.struct("version_no", "is_delete_marker", "content_length", "meta_size", "meta_mtime_ns")).alias("s"))
        .where("not coalesce(s.is_delete_marker, false)")
    )
    return last.select(
        "key",
        F.expr("cast(s.content_length as decimal(38,6)) as size"),
        F.expr(_NUMBER.format("s.meta_size") + " as meta_size"),
        F.expr(_NUMBER.format("s.meta_mtime_ns") + " as mtime_ns"),
    )


def diff_objects(objects: DataFrame, remote: DataFrame) -> DataFrame:
    return diff_tables(local_states(objects), remote_states(remote), "key", ["size", "meta_size", "mtime_ns"], "missing_remote", "missing_local")


def diff_counts(counts: DataFrame) -> DataFrame:
    """The client's and the server's figures; repeated rows count once (of unequal ones the largest), null run_id, status or side are passed over."""
    rows = counts.where("run_id is not null and status is not null").select(F.concat_ws("/", F.col("run_id").cast("string"), "status").alias("k"), "side", "object_count", "byte_count")
    one = rows.groupBy("k", "side").agg(F.max(F.struct("object_count", "byte_count")).alias("s")).select("k", "side", "s.*")
    left, right = (one.where(F.col("side") == s).drop("side") for s in ("client", "server"))
    return diff_tables(left, right, "k", ["object_count", "byte_count"], "missing_server", "missing_client")
