"""Processing only new or changed records.

`IncrementalRefresh` keeps a derived table up to date. The sources are cut into partitions; each has a fingerprint of its
row count and of additive row hashes. A run recomputes the partitions whose fingerprint differs from that of the last
successful run, replaces each through dynamic partition overwrite, and only then commits the new fingerprints. A run that
dies leaves the old fingerprints and the announcement of what it was to write, so the next one computes those partitions again and replaces whatever
was half done: nothing is skipped and nothing appears twice. Of two runs at once one commits and the other raises.

`sync_deltas` is the computation for object listings: the objects that each succeeded run has to carry.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.hashing import additive, additive_names, row_hash
from ..session import Files

#: A partition has about so many rows; there are at most MOST_PARTS, whose fingerprints the driver holds.
PART_ROWS, MOST_PARTS = 1_000_000, 1 << 16
#: A hot group is one with more than this many rows and than a HOT_SHARE-th of all; so there are at most HOT_SHARE of them.
GROUP_ROWS = 50_000
HOT_SHARE = 1000


@dataclass
class Source:
    """An input and the partitions its rows belong to: `part` gives a partition number, or `parts_of` all that a row touches."""

    df: DataFrame
    part: Column
    #: From the number that `part` gives to the numbers of output partitions; None: they are the same.
    fan_out: Callable[[int], list[int]] | None = None
    #: The filter that keeps the rows of some output partitions; None: `part` is among them.
    keep: Callable[[list[int]], Column] | None = None


@dataclass
class Refreshed:
    version: int
    changed: list[int]
    unchanged: list[int]
    removed: list[int] = field(default_factory=list)


class IncrementalRefresh:
    """A derived table below `root` (`out/` and `state/`), partitioned by `part`.

    Defined results: an empty source gives an empty table; repeated rows count as often as they occur; a changed
    `signature` (the version of the computation) makes every partition count as changed; partitions that vanish from all
    sources, or that come out empty, vanish from the table.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, signature: str = "1", part: str = "part", lease: float = 86_400):
        self.spark, self.root, self.schema, self.signature, self.part = spark, root.rstrip("/"), schema, signature, part
        #: How many seconds a run may take from its announcement to its commit.
        self.lease = lease
        self.files = Files(spark, self.root)

    # state ---------------------------------------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.files.names(f"{self.root}/state") if n.startswith("v="))

    def _state(self) -> tuple[int, dict]:
        versions = self._versions()
        return (versions[-1], json.loads(self.files.read_text(f"{self.root}/state/v={versions[-1]}"))) if versions else (0, {"prints": {}, "layout": None, "run": None})

    def committed(self) -> tuple[int, dict[int, str]]:
        """Number and fingerprints of the last successful run; (0, {}) before the first."""
        version, state = self._state()
        return version, {int(k): x for k, x in state["prints"].items()}

    def layout(self) -> object:
        """What the last successful run said of its partitions, None before the first."""
        return self._state()[1]["layout"]

    def _commit(self, version: int, prints: dict[int, str], layout: object, run: str) -> None:
        """The fingerprints become visible at once, by a file that only one writer can create; the last two versions are kept."""
        text = json.dumps({"prints": prints, "layout": layout, "run": run})
        if not self.files.publish(f"{self.root}/state/v={version}", text):
            raise RuntimeError(f"another run has committed version {version}; what this one wrote may stand, so the next run computes those partitions again")
        for old in self._versions()[:-2]:
            self.files.delete(f"{self.root}/state/v={old}")

    # fingerprints --------------------------------------------------------------------------------------------------
    def fingerprints(self, sources: list[Source]) -> dict[int, str]:
        """One line for each partition: never more than there are partitions, whatever the size of the data."""
        found: dict[int, list[str]] = {}
        for k, source in enumerate(sources):
            df = source.df
            h = row_hash(df, df.columns, k)
            rows = (
                df.select(source.part.alias("_part"), h.alias("_h"))
                .groupBy("_part")
                .agg(F.count(F.lit(1)).alias("n"), *additive(F.col("_h"), "h"))
                .collect()
            )
            for r in rows:
                if r["_part"] is None:
                    continue
                line = f"{k}:" + ",".join(str(r[c]) for c in ["n", *additive_names("h")])
                for p in source.fan_out(r["_part"]) if source.fan_out else [r["_part"]]:
                    found.setdefault(p, []).append(line)
        return {p: hashlib.sha256("|".join([self.signature, *sorted(x)]).encode()).hexdigest()[:32] for p, x in found.items()}

    # runs ----------------------------------------------------------------------------------------------------------
    def run(self, sources: list[Source], compute: Callable[[list[DataFrame]], DataFrame], layout: object = None, fail_after_write: bool = False) -> Refreshed:
        """One run. `compute` gets the sources cut down to changed partitions and gives rows with the partition column.

        A run announces its partitions before it writes and withdraws that when it has committed; partitions that another run has announced count as changed,
        until `lease` seconds after, when it has surely ended: so whatever two runs at once or a run that died have left is computed again. A `layout` unlike the last one makes every partition count as changed.
        """
        began = time.time()
        version, state = self._state()
        before = {int(k): x for k, x in state["prints"].items()} if state["layout"] == layout else {}
        now = self.fingerprints(sources)
        begun = f"{self.root}/begun"
        others = {n: json.loads(self.files.read_text(f"{begun}/{n}")) for n in self.files.names(begun) if not n.startswith(".")}
        touched = {p for x in others.values() for p in x["parts"]}
        changed = sorted(p for p, x in now.items() if before.get(p) != x or p in touched)
        removed = sorted(({int(k) for k in state["prints"]} | touched) - now.keys())
        out, token = f"{self.root}/out", uuid.uuid4().hex
        if changed or removed:
            self.files.publish(f"{begun}/{token}", json.dumps({"parts": changed + removed, "at": time.time()}))
        if changed:
            every = len(changed) == len(now)  # then no row needs to be tested
            cut = [s.df if every else s.df.where(s.keep(changed) if s.keep else s.part.isin(changed)) for s in sources]
            rows = compute(cut).select(*[F.col(f.name).cast(f.dataType) for f in self.schema], F.col(self.part).cast("int"))
            (
                rows.withColumn("_token", F.lit(token))
                .repartition(F.col(self.part))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .option("compression", "zstd")
                .partitionBy(self.part)
                .parquet(out)
            )
            if fail_after_write:
                raise RuntimeError("failed before the commit, as asked")
            there = {r[0] for r in self._raw().where((F.col("_token") == token)).select(self.part).distinct().collect()}
            removed += [p for p in changed if p not in there]
        for p in removed:
            self.files.delete(f"{out}/{self.part}={p}")
        if changed or removed or not version:
            version += 1
            self._commit(version, now, layout, token)
            for n in [token, *[n for n, x in others.items() if x["at"] + self.lease <= began]]:
                self.files.delete(f"{begun}/{n}")
        return Refreshed(version, changed, sorted(set(now) - set(changed)), sorted(removed))

    def _raw(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_token", T.StringType()), T.StructField(self.part, T.IntegerType())])
        if not self.files.exists(f"{self.root}/out"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/out")

    def read(self) -> DataFrame:
        return self._raw().select(*self.schema.names)


# object listings ---------------------------------------------------------------------------------------------------
def side_for(rows: int) -> int:
    """How many parts of trees, and of keys in each, a listing of so many rows is cut into: a power of 2, at least 8."""
    parts = min(MOST_PARTS, max(64, rows // PART_ROWS))
    return 1 << math.ceil(math.log2(parts) / 2)


def _tree_part(c: Column, side: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(side)).cast("int")


def sync_part(side: int) -> Column:
    """Partition of an object: of its tree and, as a tree may hold a third of all rows, of its key."""
    return (_tree_part(F.col("tree"), side) * side + F.pmod(F.xxhash64("key"), F.lit(side))).cast("int")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The succeeded runs by their row with the latest `logged_at` (of equal ones the largest status, then start)."""
    last = F.max(F.struct("logged_at", "status", "started_at", "tree")).alias("r")
    return (
        runs.where(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(last)
        .select("run_id", "r.*")
        .where((F.col("status") == "succeeded") & F.col("started_at").isNotNull() & F.col("tree").isNotNull())
        .select("run_id", "tree", "started_at")
    )


def hot_groups(df: DataFrame, by: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The groups too large for one task and into how many pieces to cut each.

    At most HOT_SHARE rows, since each holds more than that share of all; so it may be broadcast.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    total = df.count()
    size = max(group_rows, total // HOT_SHARE + 1)
    rows = counts.where(F.col("n") > size).select(by, F.ceil(F.col("n") / size).cast("int").alias("_pieces")).collect()
    schema = T.StructType([df.schema[by], T.StructField("_pieces", T.IntegerType())])
    return df.sparkSession.createDataFrame(rows, schema)


def sync_deltas(objects: DataFrame, runs: DataFrame, group_rows: int = GROUP_ROWS, side: int = 8) -> DataFrame:
    """(part, run_id, key): a succeeded run and a key of its tree whose state changed since the tree's run before.

    Each row is first given the earliest succeeded run of its tree that started at or after `seen_at`: an as-of match by one
    window over rows and runs, in which hot trees are cut into pieces of random rows with the runs in each piece. Rows of a
    key and run are reduced to the newest before the keys' histories are walked, so that no key outgrows its number of runs.
    Rows with a null tree, key, size, mtime_ns or seen_at are passed over; a null listed_at counts as the earliest.
    """
    needed = ["tree", "key", "size", "mtime_ns", "seen_at"]
    rows = objects.where(" and ".join(f"{c} is not null" for c in needed)).select("row_id", *needed, "listed_at")
    hot = F.broadcast(hot_groups(rows.select("tree"), "tree", group_rows))
    pieces = F.coalesce("_pieces", F.lit(1))
    state = F.struct("listed_at", "row_id", "size", "mtime_ns")
    left = rows.join(hot, "tree", "left").select(
        "tree",
        F.pmod(F.xxhash64("row_id", "seen_at"), pieces).cast("int").alias("piece"),
        F.col("seen_at").alias("t"),
        F.lit(1).alias("kind"),
        "key",
        state.alias("state"),
        F.lit(None).cast("struct<started_at:timestamp,run_id:bigint>").alias("run"),
    )
    right = (
        latest_runs(runs)
        .join(hot, "tree", "left")
        .select(
            "tree",
            F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"),
            F.col("started_at").alias("t"),
            F.lit(0).alias("kind"),
            F.lit(None).cast("string").alias("key"),
            F.lit(None).cast(left.schema["state"].dataType).alias("state"),
            F.struct("started_at", F.col("run_id").cast("bigint").alias("run_id")).alias("run"),
        )
    )
    later = W.partitionBy("tree", "piece").orderBy(F.desc("t"), "kind", F.desc("run.run_id")).rowsBetween(W.unboundedPreceding, 0)
    matched = left.unionByName(right).withColumn("run", F.last("run", ignorenulls=True).over(later)).where("kind = 1 and run is not null")
    newest = matched.groupBy("tree", "key", "run.started_at", "run.run_id").agg(F.max("state").alias("state"))
    history = W.partitionBy("tree", "key").orderBy("started_at", "run_id")
    so_far = newest.withColumn("state", F.max("state").over(history.rowsBetween(W.unboundedPreceding, 0)))
    before = so_far.withColumn("before", F.lag("state").over(history))
    same = F.col("before").isNotNull() & (F.col("before.size") == F.col("state.size")) & (F.col("before.mtime_ns") == F.col("state.mtime_ns"))
    return before.where(~same).select(sync_part(side).alias("part"), "run_id", "key")


def refresh_sync(spark: SparkSession, root: str, objects: DataFrame, runs: DataFrame) -> tuple[IncrementalRefresh, Refreshed]:
    """Bring the table of deltas below `root` up to date with the listings and the run log."""
    schema = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("key", T.StringType())])
    table = IncrementalRefresh(spark, root, schema)
    # partitions follow the size of the listing; they are cut anew, and then all computed, where it has outgrown them sixteen times
    wanted, old = side_for(objects.count()), table.layout()
    side = wanted if old is None or wanted >= 4 * old else old
    used = objects.select("row_id", "tree", "key", "size", "mtime_ns", "listed_at", "seen_at")
    logged = runs.select("run_id", "tree", "started_at", "status", "logged_at")
    sources = [
        Source(used, sync_part(side)),
        Source(logged, _tree_part(F.col("tree"), side), lambda t: [t * side + k for k in range(side)], lambda ps: _tree_part(F.col("tree"), side).isin(sorted({p // side for p in ps}))),
    ]
    return table, table.run(sources, lambda cut: sync_deltas(*cut, side=side), side)
