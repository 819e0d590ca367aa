"""Writing tables, snapshots and upserts to files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.tables import upsert


def write_json(posts: DataFrame, path: str) -> None:
    """Snapshot as JSON lines (SNK1); times keep their microseconds."""
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    posts.write.mode("overwrite").option("timestampFormat", exact).json(path)


def write_overview(overview: DataFrame, path: str) -> None:
    """Overview as CSV with a header, sorted by ticker (SNK2)."""
    overview.orderBy("ticker").write.mode("overwrite").option("header", True).csv(path)


def append_history(candidates: DataFrame, path: str, as_of: datetime) -> None:
    """Scan results appended to the history, one folder per day (SNK3).

    A folder per scan inside the day makes a repeated scan replace itself.
    """
    moment = F.lit(as_of).cast("timestamp")
    rows = candidates.withColumn("ts", moment).withColumns(
        {"day": F.to_date("ts"), "scan": F.date_format("ts", "HHmmss")}
    )
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day", "scan").parquet(path)


def _place(spark: SparkSession, path: str):
    """Hadoop's file system and name of ``path``."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def _current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the last published version, and the folders that it consists of."""
    files, listed = _place(spark, f"{path}/_versions")
    if not files.exists(listed):
        return 0, []
    numbers = [int(s.getPath().getName()) for s in files.listStatus(listed) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, []
    stream = files.open(_place(spark, f"{path}/_versions/{max(numbers):08d}")[1])
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return max(numbers), text.split("\n")


def _publish(spark: SparkSession, path: str, number: int, folders: Sequence[str]) -> None:
    """Make ``folders`` the table: one file under another name, then its rename, which only one writer can do."""
    files, draft = _place(spark, f"{path}/_versions/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray("\n".join(folders).encode()))
    finally:
        stream.close()
    target = _place(spark, f"{path}/_versions/{number:08d}")[1]
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise FileExistsError(f"another writer published version {number} of {path}")


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The last published version of a table of :func:`upsert_partitions`."""
    number, folders = _current(spark, path)
    if not number:
        raise FileNotFoundError(path)
    reader = spark.read.option("basePath", path)
    if schema is not None:
        reader = reader.schema(StructType([f for f in schema.fields] + [StructField("version", StringType())]))
    return reader.parquet(*(f"{path}/{f}" for f in folders)).drop("version")


def upsert_partitions(changes: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Upsert into a partitioned Parquet table; only touched partitions are written (UPS1).

    A partition holds one folder for each version that wrote it, ``<partition>=<value>/version=<name>``.  The table
    is the list of folders that the last version names, so a reader sees the table before or after an
    upsert, an upsert that stops half way changes nothing, and repeating the same changes gives the same table.
    Of two writers at once the second to finish fails.  :func:`vacuum` removes folders that no late version names.
    """
    spark = changes.sparkSession
    number, folders = _current(spark, path)
    merged = changes
    if number:
        current = read_table(spark, path, changes.schema).select(*changes.columns)
        touched = changes.select(partition).distinct()
        merged = upsert(current.join(touched, partition, "left_semi"), changes, keys)
    version = f"{number + 1}-{uuid.uuid4().hex[:12]}"
    # Several tasks may share a partition (rebalance splits large ones), so a busy day does not gather in one task.
    rows = merged.hint("rebalance", F.col(partition)).withColumn("version", F.lit(version))
    rows.write.mode("append").partitionBy(partition, "version").parquet(path)
    files, pattern = _place(spark, f"{path}/{partition}=*/version={version}")
    written = [f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in files.globStatus(pattern)]
    if not written:
        return
    days = {f.split("/")[0] for f in written}
    _publish(spark, path, number + 1, sorted([f for f in folders if f.split("/")[0] not in days] + written))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete folders that none of the last ``keep`` versions names, and older version files; how many folders went.

    Run it when no upsert is under way: folders of an unpublished one look unused.
    """
    number, _ = _current(spark, path)
    files, listed = _place(spark, f"{path}/_versions")
    used: set[str] = set()
    for status in files.listStatus(listed) if number else []:
        name = status.getPath().getName()
        if not name.isdigit() or int(name) <= number - keep:
            files.delete(status.getPath(), False)
        else:
            stream = files.open(status.getPath())
            used |= set(bytes(stream.readAllBytes()).decode().split("\n"))
            stream.close()
    gone = 0
    for status in files.globStatus(_place(spark, f"{path}/*=*/version=*")[1]) if number else []:
        if f"{status.getPath().getParent().getName()}/{status.getPath().getName()}" not in used:
            files.delete(status.getPath(), True)
            gone += 1
    return gone
