"""Readers and writers: tables, Markdown folders, JSON lines, objects, and keyed writes."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their files give work to less than half of these: a small table in one file. Others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def markdown_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, source, content) of the Markdown files that aren't blank."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.filter(F.col("value").rlike(r"\S")).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary objects at any URI that Spark can open."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def uploaded_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of uploaded files, decoded as UTF-8 with replacement."""
    return objects(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("content"))


def upsert(old: DataFrame, new: DataFrame, key: str, partial: bool = True) -> DataFrame:
    """old with new merged by key. In a partial update only values that say something (not null, not empty) overwrite."""
    said = {c: (F.col(f"n.{c}").isNotNull() & (F.col(f"n.{c}").cast("string") != "")) if partial else F.col(f"n.{key}").isNotNull() for c in old.columns}
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c == key else F.when(said[c], F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def delete_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, by: Column, *columns: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(*[F.max_by(c, by).alias(c) for c in columns])


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): new, changed, deleted or same, by the digests of both sides."""
    joined = old.select(key, F.col(digest).alias("old_digest")).join(new.select(key, F.col(digest).alias("new_digest")), key, "full_outer")
    status = F.when(F.col("old_digest").isNull(), "new").when(F.col("new_digest").isNull(), "deleted").when(F.col("old_digest") != F.col("new_digest"), "changed").otherwise("same")
    return joined.select(key, status.alias("status"))


def append_once(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Appends to a Parquet log the rows whose key it doesn't hold yet, so a batch that is written again adds nothing."""
    fresh = rows.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").parquet(path)


def export_newest(rows: DataFrame, path: str, newest: list[Column], most: int = 1000) -> None:
    """Writes the newest rows as JSON lines."""
    rows.orderBy(*newest).limit(most).write.mode("overwrite").json(path)


def migrate(spark: SparkSession, sources: dict[str, tuple[str, str, str]], root: str, dry_run: bool = False) -> DataFrame:
    """(name, rows) of JSON lines (path, schema, key) by name, appended once to tables under root; a dry run only counts them."""
    counts = []
    for name, (path, schema, key) in sources.items():
        rows = json_lines(spark, path, schema)
        if not dry_run:
            append_once(spark, rows, f"{root}/{name}", key)
        counts.append(rows.groupBy().agg(F.lit(name).alias("name"), F.count("*").alias("rows")))
    return reduce(DataFrame.unionByName, counts)


def update_mode(changed: Column, total: Column) -> Column:
    """none, incremental, or full if more than half of the sources have changed."""
    return F.when(changed == 0, "none").when(changed > total * 0.5, "full").otherwise("incremental")


def given(rows: DataFrame, **equal: object) -> DataFrame:
    """rows with each column equal to its value; None asks for nothing."""
    for name, wanted in equal.items():
        rows = rows if wanted is None else rows.filter(F.col(name) == wanted)
    return rows


def tenant_context(token: Column, headers: Column) -> Column:
    """struct(tenant_id, user_id, role): what a token (a map) says, else a header (a map of lower-case names), else the default."""
    said = lambda *found: F.coalesce(*[F.nullif(x, F.lit("")) for x in found])
    return F.struct(
        said(F.try_element_at(token, F.lit("tenant_id")), F.try_element_at(headers, F.lit("x-tenant-id")), F.lit("default")).alias("tenant_id"),
        said(F.try_element_at(token, F.lit("sub")), F.try_element_at(token, F.lit("user_id")), F.try_element_at(headers, F.lit("x-user-id")), F.lit("anonymous")).alias("user_id"),
        said(F.try_element_at(token, F.lit("role")), F.try_element_at(headers, F.lit("x-role")), F.lit("basic")).alias("role"),
    )
