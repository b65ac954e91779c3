"""Queries of the general data problems p1 to p5, and their SQL where SQL can state them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, incremental, schema_drift, spikes
from ..session import load, scratch
from ..streaming import compactor


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = incremental.refresh_sync(spark, scratch(spark, "sync"), load(spark, sf_dir, "sync_objects"), load(spark, sf_dir, "sync_runs"))
    return table.read().select("run_id", "key")


def p1_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found in two rounds: listings and run log as they stood an hour before the last listing arrived, then all; the second computes only what that hour touched."""
    objects, runs, root = load(spark, sf_dir, "sync_objects"), load(spark, sf_dir, "sync_runs"), scratch(spark, "sync")
    end = objects.agg((F.max("seen_at") - F.expr("interval 1 hour")).alias("end")).first()["end"] or datetime(1970, 1, 1)
    incremental.refresh_sync(spark, root, objects.where(F.col("seen_at") <= F.lit(end)), runs.where(F.col("logged_at") <= F.lit(end)))
    table, _ = incremental.refresh_sync(spark, root, objects, runs)
    return table.read().select("run_id", "key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(load(spark, sf_dir, "frame_manifest")).select("source_file", "type", "index")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = diff.diff_objects(load(spark, sf_dir, "sync_objects"), load(spark, sf_dir, "remote_objects"))
    counts = diff.diff_counts(load(spark, sf_dir, "sync_counts"))
    return objects.select(F.lit("objects").alias("copied"), "row_key", "field").unionByName(counts.select(F.lit("counts").alias("copied"), "row_key", "field"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compactor.compact_inventory(spark, f"{sf_dir}/slice_files.parquet").select("stack_id", "slice_no")


def p4_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compactor.compact_inventory(spark, f"{sf_dir}/slice_files.parquet")
    return plan.groupBy("stack_id", "container").agg(
        F.count(F.lit(1)).alias("slices"), F.min("slice_no").alias("first_slice"), F.max("slice_no").alias("last_slice"), F.sum("size").alias("bytes")
    )


def p4_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan carried out and read back; as the inventory has no contents, each file's is the text of its checksum."""
    contents = load(spark, sf_dir, "slice_files").select("file_id", F.encode(F.coalesce(F.col("content_crc").cast("string"), F.lit("none")), "UTF-8").alias("content"))
    packs = compactor.Containers(spark, scratch(spark, "packs"))
    packs.write(compactor.compact_inventory(spark, f"{sf_dir}/slice_files.parquet"), contents)
    return packs.read().select("stack_id", "slice_no", "container", F.decode("content", "UTF-8").alias("content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(schema_drift.drift_tables(load(spark, sf_dir, "conf_files")))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = schema_drift.drift_tables(load(spark, sf_dir, "conf_files"))
    return schema_drift.project_fields(maps, schema_drift.resolved_columns(maps, apart=tuple(f"storage.{n}" for n in ("comment", "inner_comment", "outer_comment", "has_scan"))))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.path_statistics(schema_drift.drift_tables(load(spark, sf_dir, "conf_files")), [])


def _p2_sql() -> str:
    """The definition over whole sources, without proposals."""
    fields = ["mean", "min", "max"]

    def levels(source: str, skip: str | None) -> str:
        cols = []
        for f in fields:
            x = f'"{f}"' if skip is None else f'case when not {skip}_{f} then "{f}" end'
            side = lambda r, x=x: f"case when count({x}) over (partition by source_file, type order by index rows between {r}) >= 3 then median({x}) over (partition by source_file, type order by index rows between {r}) end"
            cols += [
                f"{side('9 preceding and 1 preceding')} as a_{f}", f"{side('1 following and 9 following')} as b_{f}",
                f"median({x}) over (partition by source_file, type order by index rows between 9 preceding and 9 following exclude current row) as l_{f}",
            ]
        return f"select *, {', '.join(cols)} from {source}"

    def off(f: str) -> str:
        a, b = f'("{f}" - coalesce(a_{f}, b_{f}, l_{f}))', f'("{f}" - coalesce(b_{f}, a_{f}, l_{f}))'
        return f"coalesce(case when {a} * {b} > 0 then least(abs({a}), abs({b})) end, 0) > 10 * coalesce(s_{f}, 0)"

    scatter = ", ".join(f'1.4826 * median(abs("{f}" - l_{f})) as s_{f}' for f in fields)
    base = "source_file, type, index, mean, min, max, " + ", ".join(f"s_{f}" for f in fields)
    order = "(partition by source_file, type order by index rows between 3 preceding and current row)"
    ahead = "(partition by source_file, type order by index rows between current row and 3 following)"
    return f"""
with f as (select source_file, type, index, arg_max(mean, row_id) as mean, arg_max(min, row_id) as min, arg_max(max, row_id) as max from frame_manifest
           where source_file is not null and type is not null and index is not null and mean is not null and min is not null and max is not null group by all),
g as (select *, not isfinite(mean) or min < 0 or max > 65535 or min > max or mean < min or mean > max as bad from f),
e as (select *, case when mean is not distinct from lag(mean) over q and min = lag(min) over q and max = lag(max) over q then 0 else 1 end as new from g window q as (partition by source_file, type order by index)),
i as (select *, sum(new) over (partition by source_file, type order by index) as run from e),
stuck as (select source_file, type, index from (select *, count(*) over (partition by source_file, type, run) as n from i) where n >= 5),
ok as (select source_file, type, index, mean, min, max from g where not bad),
l1 as ({levels('ok', None)}),
sc as (select source_file, type, {scatter} from l1 group by all),
p1 as (select l1.*, {', '.join(f's_{f}' for f in fields)} from l1 join sc using (source_file, type)),
c1 as (select {base}, {', '.join(f'{off(f)} as first_{f}' for f in fields)} from p1),
l2 as ({levels('c1', 'first')}),
c2 as (select source_file, type, index, {', '.join(f'cast(first_{f} or {off(f)} as int) as far_{f}' for f in fields)} from l2),
c3 as (select *, {', '.join(f'cast(sum(far_{f}) over {order} = 4 as int) as long_{f}' for f in fields)} from c2),
c4 as (select source_file, type, index, {' or '.join(f'(far_{f} = 1 and max(long_{f}) over {ahead} = 0)' for f in fields)} as spike from c3)
select source_file, type, index from g where bad union select source_file, type, index from stuck union select source_file, type, index from c4 where spike"""


_LEAVES = """
with files as (select conf_id, sample_id, written_at, body from conf_files where sample_id is not null and json_valid(body) and json_type(body) = 'OBJECT'),
tree as (select f.conf_id, replace(substr(t.fullkey, 3), '"', '') as field, t.type, t.value from files f, json_tree(f.body) t
         where t.fullkey <> '$' and not regexp_matches(t.fullkey, '\\[[0-9]+\\]') and (t.type <> 'OBJECT' or t.value = '{}')),
leaf as (select conf_id, field, case when type = 'VARCHAR' then 'string' when type = 'BOOLEAN' then 'boolean' when type = 'ARRAY' then 'array' when type = 'OBJECT' then 'object' when type = 'NULL' then 'null' else 'number' end as kind,
         case when type in ('VARCHAR', 'BOOLEAN', 'ARRAY', 'OBJECT', 'NULL') then cast(value as varchar) else cast(cast(value as double) as varchar) end as v from tree)"""
_P5_SQL = (
    _LEAVES
    + """,
pair as (select conf_id, lag(conf_id) over (partition by sample_id order by written_at, conf_id) as old from files),
gone as (select p.conf_id, l.field, l.kind, l.v from pair p join leaf l on l.conf_id = p.old where not exists (select 1 from leaf n where n.conf_id = p.conf_id and n.field = l.field)),
come as (select p.conf_id, l.field, l.kind, l.v from pair p join leaf l on l.conf_id = p.conf_id where p.old is not null and not exists (select 1 from leaf n where n.conf_id = p.old and n.field = l.field)),
moved as (select g.conf_id, g.field as before, c.field as after from gone g join come c on g.conf_id = c.conf_id and g.kind = c.kind and g.v = c.v where g.kind <> 'null' and g.v <> '""')
select distinct conf_id, before as field, 'renamed' as change from moved
union all select conf_id, field, 'removed' from gone g where not exists (select 1 from moved m where m.conf_id = g.conf_id and m.before = g.field)
union all select conf_id, field, 'added' from come c where not exists (select 1 from moved m where m.conf_id = c.conf_id and m.after = c.field)
union all select p.conf_id, n.field, 'type_changed' from pair p join leaf n on n.conf_id = p.conf_id join leaf o on o.conf_id = p.old and o.field = n.field where n.kind <> o.kind and n.kind <> 'null' and o.kind <> 'null'"""
)

QUERIES = {f.__name__: f for f in (p1_found, p1_rounds, p2_found, p3_found, p4_found, p4_containers, p4_contents, p5_found, p5_table, p5_paths)}

SQL = {
    "p2_found": _p2_sql(),
    "p5_found": _P5_SQL,
    "p5_paths": _LEAVES + " select field as path, kind as type, count(*) as files, min(conf_id) as first_file, max(conf_id) as last_file from leaf group by all",
    "p1_found": """
with logged as (select * from sync_runs qualify row_number() over (partition by run_id order by logged_at desc, status desc) = 1),
runs as (select run_id, tree, started_at from logged where status = 'succeeded' and started_at is not null),
rows as (select * from sync_objects where tree is not null and key is not null and size is not null and mtime_ns is not null and seen_at is not null),
seen as (select r.tree, r.key, r.listed_at, r.row_id, r.size, r.mtime_ns, s.started_at
         from rows r asof join runs s on r.tree = s.tree and r.seen_at <= s.started_at),
grouped as (select tree, key, started_at, max({'l': coalesce(listed_at, timestamp '0001-01-01'), 'r': row_id, 's': size, 'm': mtime_ns}) as st from seen group by all),
walked as (select tree, key, started_at, max(st) over (partition by tree, key order by started_at) as st from grouped),
compared as (select *, lag(st) over (partition by tree, key order by started_at) as before from walked),
first_run as (select tree, started_at, min(run_id) as run_id from runs group by all)
select f.run_id, c.key from compared c join first_run f using (tree, started_at)
where c.before is null or c.before.s <> c.st.s or c.before.m <> c.st.m""",
    "p3_found": r"""
with l as (select key, size, mtime_ns from sync_objects where key is not null and size is not null and mtime_ns is not null
           qualify row_number() over (partition by key order by listed_at desc, row_id desc) = 1),
r as (select * from (select regexp_replace(key, '^/', '') as key, version_no, content_length, try_cast(trim(meta_size) as decimal(38,6)) as meta_size,
             try_cast(trim(meta_mtime_ns) as decimal(38,6)) as meta_mtime_ns, is_delete_marker from remote_objects where key is not null)
      qualify row_number() over (partition by key order by version_no desc) = 1),
o as (select coalesce(l.key, r.key) as row_key, unnest(case when r.key is null then ['missing_remote'] when l.key is null then ['missing_local']
        else list_filter([case when l.size is distinct from r.content_length then 'size' end, case when l.size is distinct from r.meta_size then 'meta_size' end,
                          case when l.mtime_ns is distinct from r.meta_mtime_ns then 'mtime_ns' end], lambda x: x is not null) end) as field
      from l full join (select * from r where not is_delete_marker) r on l.key = r.key),
k as (select run_id || '/' || status as row_key, side, max({'o': object_count, 'b': byte_count}) as s from sync_counts group by all),
c as (select coalesce(a.row_key, b.row_key) as row_key, unnest(case when b.row_key is null then ['missing_server'] when a.row_key is null then ['missing_client']
        else list_filter([case when a.s.o is distinct from b.s.o then 'object_count' end, case when a.s.b is distinct from b.s.b then 'byte_count' end], lambda x: x is not null) end) as field
      from (select * from k where side = 'client') a full join (select * from k where side = 'server') b on a.row_key = b.row_key)
select 'objects' as copied, row_key, field from o union all select 'counts', row_key, field from c""",
    "p4_found": r"""
with f as (select stack_id, try_cast(nullif(regexp_extract(output_name, '([0-9]+)\.[tT][iI][fF][fF]?$', 1), '') as bigint) as slice_no, size, written_at, file_id
           from slice_files where size > 0 and stack_id is not null and output_name is not null)
select stack_id, slice_no from (select * from f where slice_no is not null
  qualify row_number() over (partition by stack_id, slice_no order by written_at desc nulls last, file_id desc) = 1) where size < 1048576""",
    "p4_contents": r"""
with f as (select stack_id, try_cast(nullif(regexp_extract(output_name, '([0-9]+)\.[tT][iI][fF][fF]?$', 1), '') as bigint) as slice_no, size, written_at, file_id, content_crc
           from slice_files where size > 0 and stack_id is not null and output_name is not null),
s as (select stack_id, slice_no, size, content_crc from (select * from f where slice_no is not null
  qualify row_number() over (partition by stack_id, slice_no order by written_at desc nulls last, file_id desc) = 1) where size < 1048576),
c as (select *, coalesce(sum(size) over (partition by stack_id order by slice_no rows between unbounded preceding and 1 preceding), 0) as before from s)
select stack_id, slice_no, cast(before // (134217728 - 1048576) as bigint) as container, coalesce(cast(content_crc as varchar), 'none') as content from c""",
    "p4_containers": r"""
with f as (select stack_id, try_cast(nullif(regexp_extract(output_name, '([0-9]+)\.[tT][iI][fF][fF]?$', 1), '') as bigint) as slice_no, size, written_at, file_id
           from slice_files where size > 0 and stack_id is not null and output_name is not null),
s as (select stack_id, slice_no, size from (select * from f where slice_no is not null
  qualify row_number() over (partition by stack_id, slice_no order by written_at desc nulls last, file_id desc) = 1) where size < 1048576),
c as (select *, coalesce(sum(size) over (partition by stack_id order by slice_no rows between unbounded preceding and 1 preceding), 0) as before from s)
select stack_id, cast(before // (134217728 - 1048576) as bigint) as container, count(*) as slices, min(slice_no) as first_slice, max(slice_no) as last_slice, cast(sum(size) as bigint) as bytes
from c group by all""",
}
SQL["p1_rounds"] = SQL["p1_found"]
