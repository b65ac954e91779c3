"""Queries of the text problems p6 to p8, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import leakage, splitting, tokenizer


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(load(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split(load(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece_no", "first_token", "end_token", F.size("ids").alias("tokens"), "fresh")


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p8_found, p8_pieces)}

SQL: dict[str, str] = {
    "p7_found": r"""
with d as (select doc_id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '\p{Cf}', '', 'g'))), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '\p{Cf}', '', 'g'))), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
n as (select *, least(len(w), 12) as k from i where len(w) > 0),
ig as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as g from (select *, unnest(generate_series(1, len(w) - k + 1)) as p from n)),
dg as (select distinct doc_id, k, array_to_string(w[p:p + k - 1], ' ') as g
       from (select d.*, ks.k, unnest(generate_series(1, len(w) - ks.k + 1)) as p from d, (select distinct k from n) ks where len(w) >= ks.k))
select distinct doc_id, item_id from dg join ig using (k, g)""",
}
