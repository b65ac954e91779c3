"""Viewer documents as tables: layers (doc, ord, name, type, source), annotations (layer, ord, px, py, pz), and their JSON."""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

U16_MAX = 65535


def copy_layers(source: DataFrame, target: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """The target with the named layers of the source behind its own. A name that the target has or the source lacks raises, or with
    `strict` false is left out."""
    wanted = source.where(F.col("name").isin(names))
    if strict:
        clash = [r[0] for r in wanted.join(target, "name", "left_semi").select("name").limit(5).collect()]
        missing = set(names) - {r[0] for r in wanted.select("name").distinct().collect()}
        if clash or missing:
            raise ValueError(f"already there: {sorted(clash)}; not found: {sorted(missing)}")
    new = wanted.join(target.select("name"), "name", "left_anti").select(*target.columns)
    return target.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))


def extract_layers(layers: DataFrame, names: list[str]) -> DataFrame:
    """(pos, name, source) in the order asked for; the source of a missing layer is null."""
    asked = layers.sparkSession.createDataFrame(list(enumerate(names)), "pos int, name string")
    return F.broadcast(asked).join(layers.select("name", "source"), "name", "left").select("pos", "name", "source")


def tag_plan(names: list[str], intensities: list[int], radii: list[int], radius: int = 30) -> list[tuple[str, int, int]]:
    """Fill in what isn't given (-1): the next multiple of an even step that no layer has asked for, and the common radius."""
    step = U16_MAX // (len(names) + 2)
    free = (k for k in range(step, U16_MAX, step) if k not in intensities)
    return [(n, next(free) if i == -1 else i, radius if r == -1 else r) for n, i, r in zip(names, intensities, radii)]


def tag_layers(layers: DataFrame, plan: list[tuple[str, int, int]]) -> DataFrame:
    table = layers.sparkSession.createDataFrame(plan, "name string, intensity int, radius int")
    rows = layers.join(F.broadcast(table), "name", "left")
    return rows.withColumn("name", F.when(F.col("intensity").isNotNull(), X.tagged(F.col("name"), F.col("intensity"), F.col("radius"))).otherwise(F.col("name"))).drop("intensity", "radius")


def recolor(segments: DataFrame, colors: DataFrame) -> DataFrame:
    """Segments (id, color) with the colours of an override table; ids it has beyond are left out (`unknown_colors` lists them)."""
    bad = colors.where(~X.is_color(F.col("color")))
    checked = colors.join(bad.select("id"), "id", "left_anti").withColumnRenamed("color", "_new")
    return segments.join(checked, "id", "left").withColumn("color", F.coalesce("_new", "color")).drop("_new")


def unknown_colors(segments: DataFrame, colors: DataFrame) -> DataFrame:
    return colors.join(segments, "id", "left_anti")


def url_shift(layers: DataFrame) -> DataFrame:
    """`a|b` sources of image and segmentation layers as `precomputed://a`."""
    return layers.withColumn("source", F.when(F.col("type").isin("image", "segmentation"), X.layer_address(F.col("source"))).otherwise(F.col("source")))


def shift_points(points: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({c: F.col(c) + d for c, d in zip(("px", "py", "pz"), by)})


def sort_points(points: DataFrame, axis: str, backward: bool = False) -> DataFrame:
    """A new `ord` in each layer by a coordinate, equal ones in their old order; backward turns the whole order round."""
    keys = [F.desc(axis), F.desc("ord")] if backward else [axis, "ord"]
    return points.withColumn("ord", F.row_number().over(W.partitionBy("layer").orderBy(*keys)) - 1)


def merge_points(points: DataFrame, lists: list[tuple[int, bool]]) -> DataFrame:
    """The annotations of several layers one after another, each forward or (True) backward: (pos, ord, px, py, pz)."""
    parts = [points.where(F.col("layer") == layer).withColumn("pos", F.lit(k)).withColumn("_o", -F.col("ord") if back else F.col("ord")) for k, (layer, back) in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("pos", F.row_number().over(W.partitionBy("pos").orderBy("_o")).alias("ord"), "px", "py", "pz")


# documents ---------------------------------------------------------------------------------------------------------
def layers_of(documents: DataFrame, body: str = "body") -> DataFrame:
    """(doc, ord, name, type, raw): the layers of viewer-state JSON; `raw` keeps every key, known or not."""
    state = documents.select("doc", F.posexplode(F.expr(f"cast(variant_get(parse_json({body}), '$.layers') as array<variant>)")).alias("ord", "v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    return state.select("doc", "ord", get("$.name").alias("name"), get("$.type").alias("type"), F.to_json("v").alias("raw"))


def documents_of(layers: DataFrame) -> DataFrame:
    """(doc, body): documents with their layers in order, as they were."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"])
    return layers.groupBy("doc").agg(F.concat(F.lit('{"layers":['), F.array_join(ordered, ","), F.lit("]}")).alias("body"))


#: The fields of a view that are carried from one document to another.
POSITION_FIELDS = ["position", "crossSectionOrientation", "crossSectionScale", "projectionOrientation", "projectionScale", "layout", "layerListPanel"]


def copy_position(target: Column, source: Column) -> Column:
    """Maps from key to JSON text: the target with the source's position fields, where it has them."""
    moved = F.map_filter(source, lambda k, _: k.isin(*POSITION_FIELDS))
    kept = F.map_filter(target, lambda k, _: ~F.array_contains(F.map_keys(moved), k))
    return F.map_concat(kept, moved)


#: The quaternion of the forward view at an angle.
FORWARD = "[0.3462526500225067,-0.14639334380626678,-0.36085399985313416,0.8535001277923584]"


def shift_angle(state: Column, orthographic: bool = False) -> Column:
    """A map from key to JSON text that looks forward at an angle; a layout that is a plain name becomes an object where it must say orthographic."""
    layout = F.try_element_at(state, F.lit("layout"))
    kind = F.when(layout.startswith('"'), F.concat(F.lit('{"type":'), layout, F.lit(',"orthographicProjection":true}'))).otherwise(
        F.to_json(F.map_concat(F.map_filter(F.from_json(layout, "map<string,variant>"), lambda k, _: k != "orthographicProjection"), F.create_map(F.lit("orthographicProjection"), F.parse_json(F.lit("true")))))
    )
    new = F.create_map(F.lit("projectionOrientation"), F.lit(FORWARD), *([F.lit("layout"), kind] if orthographic else []))
    return F.map_concat(F.map_filter(state, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def read_points(spark, path: str, layer: int = 0) -> DataFrame:  # noqa: ANN001
    """Annotations (layer, ord, px, py, pz) of a CSV file of three numbers a line, or of an `.npy` array of three columns, in the file's order; anything else raises."""
    if path.endswith(".npy"):

        def unpack(batches):  # noqa: ANN001, ANN202
            for b in batches:
                for content in b.column(0).to_pylist():
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                    if a.ndim != 2 or a.shape[1] != 3:
                        raise ValueError(f"points need three columns, not {a.shape}")
                    for first in range(0, len(a), 100_000):
                        part = a[first : first + 100_000].astype(float)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), *[pa.array(np.ascontiguousarray(c)) for c in part.T]], names=["ord", "px", "py", "pz"])

        points = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "ord bigint, px double, py double, pz double")
        return points.select(F.lit(layer).cast("bigint").alias("layer"), "*")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+\z", ""), r"\r?\n")).alias("ord", "line"))
    p = F.transform(F.split("line", ","), lambda t: F.trim(t).try_cast("double"))
    good = (F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull())
    checked = F.when(good, p).otherwise(F.raise_error(F.concat(F.lit("no three numbers: "), "line")).cast("array<double>"))
    return rows.select(F.lit(layer).cast("bigint").alias("layer"), F.col("ord").cast("bigint").alias("ord"), checked.alias("p")).select("layer", "ord", *[F.col("p")[k].alias(n) for k, n in enumerate(("px", "py", "pz"))])
