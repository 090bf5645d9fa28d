"""Dataset names, their files, and a Parquet scan by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Catalog:
    """Maps dataset names to paths below a root; explicit ``paths`` override the pattern."""

    root: str
    names: tuple[str, ...]
    pattern: str = "{name}.parquet"
    paths: Mapping[str, str] | None = None

    def path(self, name: str) -> str:
        if self.paths and name in self.paths:
            return self.paths[name]
        if name not in self.names:
            raise KeyError(f"Unknown dataset '{name}'; known: {', '.join(self.names)}")
        return f"{self.root.rstrip('/')}/{self.pattern.format(name=name)}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))
