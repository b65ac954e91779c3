"""Stages of materialized tables that are taken up again where they ended.

A stage is done when its table was written under the fingerprint of the settings that shape it; another fingerprint in the same place is an error unless
it is to be replaced. The record is written after the table, in one rename, so that a stage that died is run again as a whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import Files


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


@dataclass
class Stage:
    name: str
    settings: dict  # what shapes the result; numbers of workers don't
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


class Stages:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def record(self, name: str) -> dict | None:
        path = f"{self.root}/{name}.state"
        return json.loads(self.files.read_text(path)) if self.files.exists(path) else None

    def run(self, stages: list[Stage], replace: bool = False) -> dict[str, str]:
        """Run what isn't done, in order; each stage gets the tables before it. Gives `done` or `kept` for each."""
        tables: dict[str, DataFrame] = {}
        said: dict[str, str] = {}
        above = ""
        for s in stages:
            mark, out = fingerprint({"settings": s.settings, "after": above}), f"{self.root}/{s.name}.parquet"
            record = self.record(s.name)
            if record and record["fingerprint"] != mark and not replace:
                raise ValueError(f"{s.name} was made with other settings")
            if record and record["fingerprint"] == mark and self.files.exists(f"{out}/_SUCCESS"):
                said[s.name] = "kept"
            else:
                self.files.delete(f"{self.root}/{s.name}.state")
                s.build(self.spark, tables).write.mode("overwrite").parquet(out)
                if not self.files.publish(f"{self.root}/{s.name}.state", json.dumps({"fingerprint": mark})):
                    raise RuntimeError(f"another run has recorded {s.name}")
                said[s.name] = "done"
            tables[s.name] = self.spark.read.parquet(out)
            above = mark
        return said
