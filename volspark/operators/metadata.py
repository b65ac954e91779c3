"""Nodes and frames of self-describing files as tables, settings and scripts.

h5 nodes: (file, path, parent, kind, shape array<bigint>, dtype, value, visit bigint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def projection_dataset(nodes: DataFrame) -> DataFrame:
    """(file, path): `exchange/data`, else the first visited dataset of three dimensions whose last name is `data`."""
    rows = nodes.where((F.col("kind") == "dataset") & (F.size("shape") == 3) & F.col("path").rlike("(^|/)data$"))
    rank = F.struct(F.when(F.col("path") == "exchange/data", 0).otherwise(1), "visit")
    return rows.groupBy("file").agg(F.min_by("path", rank).alias("path"))


def select_path(nodes: DataFrame, path: str, max_values: int = 0) -> DataFrame:
    """A dataset or a group with all below it; values of more than `max_values` numbers are left out (0: none are)."""
    p = path.strip("/")
    below = (F.col("path") == p) | F.col("path").startswith(p + "/") if p else F.lit(True)
    count = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, b: a * b)
    return nodes.where(below).withColumn("value", F.when((count <= max_values) | F.lit(max_values == 0), F.col("value")))


def collapsed(nodes: DataFrame, most: int = 8, shown: int = 2) -> DataFrame:
    """Of groups with more than `most` datasets only the first `shown`, with the number left out."""
    own = W.partitionBy("file", "parent", "kind")
    rows = nodes.withColumns({"_n": F.count(F.lit(1)).over(own), "_k": F.row_number().over(own.orderBy("visit"))})
    kept = rows.where((F.col("kind") != "dataset") | (F.col("_n") <= most) | (F.col("_k") <= shown))
    return kept.withColumn("left_out", F.when((F.col("kind") == "dataset") & (F.col("_n") > most), F.col("_n") - shown).otherwise(0)).drop("_n", "_k")


def image_datasets(nodes: DataFrame) -> DataFrame:
    """(file, path, lead): numeric datasets of two dimensions or more; of four, one stack for each leading index; of more, an error."""
    rows = nodes.where((F.col("kind") == "dataset") & (F.size("shape") >= 2) & F.col("dtype").rlike("^(u?int|float)"))
    lead = F.when(F.size("shape") == 4, F.sequence(F.lit(0).cast("bigint"), F.col("shape")[0] - 1)).when(F.size("shape") < 4, F.array(F.lit(0).cast("bigint")))
    checked = F.when(F.size("shape") > 4, F.raise_error(F.concat(F.col("path"), F.lit(" has too many dimensions"))).cast("array<bigint>")).otherwise(lead)
    return rows.select("file", "path", F.explode(checked).alias("lead"))


def timed_frames(frames: DataFrame, stamps: DataFrame) -> DataFrame:
    """Frames (file, label, index) with the stamp of the same rank under their label; none where the counts differ."""
    by = ["file", "label"]
    rank = lambda df, order: df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(order)))
    f, s = rank(frames, "index"), rank(stamps, "ord")
    counts = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("_a")).join(stamps.groupBy(*by).agg(F.count(F.lit(1)).alias("_b")), by).where("_a = _b").select(*by, F.lit(True).alias("_ok"))
    return f.join(counts, by, "left").join(s.select(*by, "_k", "stamp"), [*by, "_k"], "left").withColumn("stamp", F.when(F.col("_ok"), F.col("stamp"))).drop("_k", "_ok")


def every(df: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """Every `step`-th plane of first..last-1."""
    return df.where((F.col("z") >= first) & (F.col("z") < last) & ((F.col("z") - first) % step == 0))


def merged_settings(maps: DataFrame, order: str = "ord") -> DataFrame:
    """(key, value): settings of several sources, the last source winning."""
    rows = maps.select(order, F.explode("settings").alias("key", "value"))
    return rows.groupBy("key").agg(F.max_by("value", order).alias("value"))


def script_options(script: Column) -> Column:
    """`--key=value` pairs of a script as a map, `$name` in values replaced by the script's own `name=value` lines; the last of equal keys wins."""
    pairs = lambda p: F.transform(F.regexp_extract_all(script, F.lit(p), F.lit(0)), lambda t: F.split(F.regexp_replace(F.trim(t), "^--", ""), "=", 2))
    named = pairs(r"(?m)^\s*[A-Za-z_]\w*=\S+")
    filled = lambda v: F.aggregate(named, v, lambda acc, n: F.replace(acc, F.concat(F.lit("$"), n[0]), n[1]))
    asked = pairs(r"--[\w-]+=\S+")
    keys = F.array_distinct(F.transform(asked, lambda p: p[0]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, filled(F.element_at(F.filter(asked, lambda p: p[0] == k), -1)[1]))))


def file_report(stats: DataFrame) -> DataFrame:
    """For each file of frame statistics (source_file, type, mean, i0_move_x, i0_move_y): counts, spread of the white means, whether the stage never moved.

    Frames count and tell of moves whatever their mean; the spread passes over means that are null, NaN or 1e300 and more.
    """
    white = F.when((F.col("type") == "white") & ~F.isnan("mean") & (F.abs("mean") < 1e300), F.col("mean"))
    moved = F.coalesce(F.abs("i0_move_x"), F.lit(0.0)) + F.coalesce(F.abs("i0_move_y"), F.lit(0.0))
    return stats.groupBy("source_file").agg(
        F.count_if(F.col("type") == "white").alias("whites"), F.count_if(F.col("type") == "dark").alias("darks"),
        F.try_divide(F.max(white) - F.min(white), F.avg(white)).alias("spread"), (F.max(moved) == 0).alias("zero_move"),
    )


SCALE = "array<struct<key:string,encoding:string,size:array<bigint>,resolution:array<double>,voxel_offset:array<bigint>,chunk_sizes:array<array<int>>>>"


def scales_of(documents: DataFrame, body: str = "body") -> DataFrame:
    """(doc, mip, type, data_type, num_channels, key, encoding, size, resolution, voxel_offset, chunk_sizes, broken) of info documents; one row with `broken` for text that is none."""
    info = F.from_json(body, f"struct<type:string,data_type:string,num_channels:int,scales:{SCALE}>")
    rows = documents.select("doc", info.alias("i"), (F.try_parse_json(body).isNull() | info["scales"].isNull()).alias("broken"))
    return rows.select("doc", "i.type", "i.data_type", "i.num_channels", "broken", F.posexplode_outer("i.scales").alias("mip", "s")).select("doc", "mip", "type", "data_type", "num_channels", "s.*", "broken")


def yaml_settings(files: DataFrame) -> DataFrame:
    """(path, key, value): leaves of YAML texts (path, value string) by dotted key, values as JSON; a broken text gives a row with a null key."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    def leaves(x: object, at: str = "") -> list[tuple[str, str]]:
        if isinstance(x, dict) and x:
            return [p for k, v in x.items() for p in leaves(v, f"{at}.{k}" if at else str(k))]
        return [(at, json.dumps(x, default=str))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["value"]):
                try:
                    rows += [(path, k, v) for k, v in leaves(yaml.safe_load(text))]
                except yaml.YAMLError:
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return files.select("path", "value").mapInPandas(run, "path string, key string, value string")
