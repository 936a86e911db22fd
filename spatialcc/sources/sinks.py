"""Sinks and the registry of results (OP-K01..K05, S01, P16, P20)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_dataset(tables: dict[str, DataFrame], params: dict[str, str], path: str) -> None:
    """Each table in Parquet, by group where it has one, and the parameters as a table (OP-K01)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("grp") if "grp" in df.columns else writer).parquet(f"{path}/{name}")
    rows = [(k, str(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_dataset(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables and parameters that save_dataset() wrote (OP-S01)."""
    params = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/params").collect()}
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, params


def save_labels_csv(wide: DataFrame, path: str) -> None:
    """Component labels, one column per feature, as CSV with a header (OP-K02)."""
    if sum(c.startswith("Comb_CC_") for c in wide.columns) < 2:
        raise ValueError("component labels of at least two features are needed")
    wide.write.mode("overwrite").csv(path, header=True)


def save_results_csv(results: DataFrame, path: str) -> None:
    """Results by descending similarity as CSV (OP-K03, W06)."""
    results.orderBy(F.desc("j_comp"), "grp", "feat_1", "feat_2").write.mode("overwrite").csv(path, header=True)


class Registry:
    """Results of runs, one Parquet folder each, named <name>/<number> (OP-P16, P20, K05).

    The latest run is the one with the largest number, not the last name in order of letters.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def runs(self, name: str) -> list[int]:
        fs, at = self._folder(name)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def save(self, name: str, df: DataFrame) -> int:
        run = max(self.runs(name), default=-1) + 1
        df.write.parquet(f"{self.path}/{name}/{run}")
        return run

    def latest(self, name: str) -> DataFrame:
        if not (runs := self.runs(name)):
            raise ValueError(f"no result '{name}'")
        return self.spark.read.parquet(f"{self.path}/{name}/{runs[-1]}")

    def reset(self, pattern: str = "^J_") -> list[str]:
        """Drop the results whose name a regular expression finds, by default those of similarity (OP-K05); returns their names."""
        fs, at = self._folder()
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        gone = [n for n in names if re.search(pattern, n)]
        for name in gone:
            fs.delete(self._folder(name)[1], True)
        return gone
