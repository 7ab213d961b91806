"""Tables of jobs, a page cache, idempotent submissions, result files, a data source."""

from __future__ import annotations

import os

from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The columns of the job tables.
SCHEMAS = {
    "tasks": "id string, seed_url string, task_dir string, mode string, status string, budget_json string, batch_json string, crawl_json string, created_at timestamp, updated_at timestamp",
    "attempts": "id string, task_id string, status string, started_at timestamp, ended_at timestamp, pages_fetched int, wall_ms long, cost_usd double, cost_unknown int, content_tokens long, "
    "content_tokens_unknown int, budget_exceeded string, recovered_from_attempt_id string, discovery_json string, charged_usd double",
    "steps": "id string, task_id string, attempt_id string, url string, canonical_url string, status string, result_json string, created_at timestamp",
    "list_pages": "task_id string, step_id string, page_no int, html string",
    "paid_calls": "id string, task_id string, vendor string, state string, cost_usd double, started_at timestamp",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def open_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The job tables of a folder, those that are not there empty."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda t: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet"))
    return {t: spark.read.schema(s).parquet(f"{folder}/{t}.parquet") if there(t) else empty(spark, t) for t, s in SCHEMAS.items()}


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both, the newest of a key; on a tie the new one. One aggregation, no join."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_o")).alias("r"))
    return best.select(*key, "r.*").select(*old.columns)


def first_submissions(rows: DataFrame, live: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """Submissions whose key is not live: not seen in the last ``hours``, the first of a batch."""
    recent = live.select(key, F.col(at).alias("_seen"))
    fresh = rows.join(recent, (rows[key] == recent[key]) & (F.col("_seen") > rows[at] - F.expr(f"interval {hours} hours")), "left_anti")
    rest = [c for c in rows.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), at).alias("r")).select(key, "r.*")


def write_results(rows: DataFrame, folder: str, markdown: Column | None = None) -> None:
    """Result files: JSON lines and CSV of the rows (each committed as a whole), and the texts
    as ``markdown`` JSON lines with their file names."""
    flat = rows.select(*[c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))])
    rows.write.mode("overwrite").json(f"{folder}/results.jsonl")
    flat.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(f"{folder}/results.csv")
    if markdown is not None:
        rows.where(markdown.isNotNull()).select("markdown_file", markdown.alias("text")).write.mode("overwrite").json(f"{folder}/markdown")


class PageFiles(DataSource):
    """``spark.read.format("page_files").load(folder)``: the HTML, XML and text files of a
    folder as ``path, kind, content``; a partition per ``filesPerPartition`` files, read on the
    executors. The folder is a path, or an address of any file system that Arrow knows, such
    as ``hdfs://`` or ``s3://``; on a cluster it is one that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "path string, kind string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.each = int(options.get("filesPerPartition", 256))

    def partitions(self) -> list[InputPartition]:
        fs, root = _file_system(self.folder)
        found = fs.get_file_info(pa_fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.type == pa_fs.FileType.File)
        return [_Files(paths[k : k + self.each]) for k in range(0, len(paths), self.each)] or [_Files([])]

    def read(self, partition: _Files):
        fs, _ = _file_system(self.folder)
        for p in partition.paths:
            with fs.open_input_file(p) as f:
                yield p, os.path.splitext(p)[1].lstrip(".").lower(), f.read()


def _file_system(folder: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a folder's address, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        return pa_fs.FileSystem.from_uri(folder)
    return pa_fs.LocalFileSystem(), os.path.abspath(folder)


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session."""
    spark.dataSource.register(PageFiles)
