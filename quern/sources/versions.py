"""Tables behind a manifest: files are written first, then one row makes them the current version.

A manifest is a Parquet file of one row in a folder of its own, so it appears whole or not at all. Readers see the folders of
the newest manifest when they ask, and go on with them while a later version is written. Old versions stay readable and a
rollback is a new manifest with the folders of an old one. One writer at a time: a second one that ends with the same
number fails, as the folder of its manifest is there. Files that a failed writer leaves are in no manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.lineage import shared_root

MANIFEST = "folders map<string, array<string>>, facts map<string, bigint>, note string, number bigint"


@dataclass(frozen=True)
class Version:
    """Folders of each table, and figures that a store keeps with them."""

    number: int = 0
    folders: Mapping[str, Sequence[str]] = field(default_factory=dict)
    facts: Mapping[str, int] = field(default_factory=dict)
    note: str = ""


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str | None = None, schemas: Mapping[str, str] | None = None, partitioned: Collection[str] = ()):
        """root: a folder that all executors share; a fresh one if none is named. schemas: of tables that may have no folder yet;
        partitioned: tables whose folders are partitioned by a column, the last of the schema."""
        self.spark, self.root, self.schemas = spark, root or f"{shared_root(spark)}/store-{uuid.uuid4().hex}", dict(schemas or {})
        self.partitioned = frozenset(partitioned)

    def history(self) -> DataFrame:
        """All manifests."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self, number: int | None = None) -> Version:
        """The version of a number, or the newest; one without tables if there is none at all."""
        rows = self.history() if number is None else self.history().filter(F.col("number") == number)
        row = rows.orderBy(F.desc("number")).first()
        if row is None:
            if number is not None:
                raise KeyError(f"no version {number} in {self.root}")
            return Version()
        return Version(row.number, row.folders or {}, row.facts or {}, row.note or "")

    def write(self, df: DataFrame, name: str, *partition_by: str) -> str:
        """A new folder with the rows of df. It belongs to no version until a manifest names it."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(folder)
        return folder

    def commit(self, folders: Mapping[str, Sequence[str]], facts: Mapping[str, int] | None = None, note: str = "", after: Version | None = None) -> Version:
        """The version after the one given (the newest otherwise) with just these folders."""
        number = (self.version() if after is None else after).number + 1
        row = ({k: list(v) for k, v in folders.items()}, {k: int(v) for k, v in (facts or {}).items()}, note, number)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifests/v{number:012d}")
        return Version(number, row[0], row[1], note)

    def read(self, name: str, version: Version | None = None) -> DataFrame:
        folders = (self.version() if version is None else version).folders.get(name, [])
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
        if name not in self.partitioned:
            return reader.parquet(*folders)
        return reduce(DataFrame.unionByName, (reader.parquet(f) for f in folders))  # each has partitions of its own

    def rollback(self, number: int) -> Version:
        """A new version with the tables and figures of an old one."""
        old = self.version(number)
        return self.commit(old.folders, old.facts, f"rollback to {number}")

    def replace(self, df: DataFrame, name: str, note: str = "") -> Version:
        """A new version in which one table has just these rows."""
        now = self.version()
        return self.commit({**now.folders, name: [self.write(df, name)]}, now.facts, note, now)

    def drop(self) -> Version:
        """A new version without tables; old ones can still be read and rolled back to."""
        return self.commit({}, {}, "dropped")
