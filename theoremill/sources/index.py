"""The declaration index as a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
#: Tables and the columns a reader may rely on.
TABLES = {
    "declarations": "id long, name string, module string, kind string, statement string, type_expr string, node_count int, symbol_set string, has_proof_body int",
    "dependencies": "src long, dst long, relation string",
    "symbol_freq": "symbol string, freq long",
    "aliases": "alias string, canonical string",
    "wl_vectors": "decl_id long, h int, histogram map<string,int>",
    "embeddings": "decl_id long, vector array<float>",
    "meta": "key string, value string",
}


class IndexMissing(FileNotFoundError):
    """There is no index at the path."""


class IndexVersionMismatch(ValueError):
    """The index was written by another version."""


class IntegrityError(ValueError):
    """A table breaks a rule of the index."""


class Index:
    """Reader of an index; opening it checks its version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        found = self.meta("schema_version")
        if found != VERSION:
            raise IndexVersionMismatch(f"version {found}, not {VERSION}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def optional(self, name: str) -> DataFrame:
        """A table that may be missing: then empty."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.table(name) if there else self.spark.createDataFrame([], TABLES[name])

    def meta(self, key: str) -> str | None:
        try:
            row = self.table("meta").filter(F.col("key") == key).select("value").first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise IndexMissing(self.path) from e
            raise
        return row[0] if row else None

    def by_name(self, name: str) -> DataFrame:
        return self.table("declarations").filter(F.col("name") == name)

    def by_ids(self, ids: list[int]) -> DataFrame:
        return self.table("declarations").filter(F.col("id").isin(*ids) if ids else F.lit(False))

    def by_module(self, module: str, without: int | None = None) -> DataFrame:
        rows = self.table("declarations").filter(F.col("module") == module)
        return rows if without is None else rows.filter(F.col("id") != without)

    def histograms(self, h: int = 3) -> DataFrame:
        """(tree, label, n) in rows."""
        return self.table("wl_vectors").filter(F.col("h") == h).select(F.col("decl_id").alias("tree"), F.explode("histogram").alias("label", "n"))

    def node_counts(self) -> DataFrame:
        return self.table("declarations").filter("node_count is not null").select("id", "node_count")


def check(tables: Mapping[str, DataFrame]) -> None:
    """Raise IntegrityError where a rule is broken; one aggregate per table."""
    if "declarations" in tables:
        r = tables["declarations"].agg(F.count("name").alias("n"), F.count_distinct("name").alias("d"), F.sum(F.when((F.col("node_count") <= 0) | ~F.col("has_proof_body").isin(0, 1, 2), 1).otherwise(0)).alias("bad")).first()
        if r.n != r.d or r.bad:
            raise IntegrityError("declarations: repeated names, or values out of range")
    if "dependencies" in tables and not tables["dependencies"].filter("src = dst").isEmpty():
        raise IntegrityError("dependencies: self loops")
    if "symbol_freq" in tables and not tables["symbol_freq"].filter("freq <= 0").isEmpty():
        raise IntegrityError("symbol_freq: frequencies below 1")


def write(tables: Mapping[str, DataFrame], path: str, meta: Mapping[str, str] | None = None) -> None:
    """Check ``tables`` and publish them with their meta data as an index at ``path``.

    They are written beside it first and moved last, so a reader never sees half an index.
    """
    check(tables)
    spark = next(iter(tables.values())).sparkSession
    jvm, conf, draft = spark._jvm, spark._jsc.hadoopConfiguration(), f"{path}.draft"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{draft}/{name}")
    values = {"schema_version": VERSION, **(meta or {})}
    spark.createDataFrame(list(values.items()), TABLES["meta"]).coalesce(1).write.mode("overwrite").parquet(f"{draft}/meta")
    at, to = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    fs.delete(to, True)
    fs.rename(at, to)
