"""A record store of snapshots and an operation log, in which every snapshot says how far it covers each file of the log.

Layout: ``<folder>/version=N/covered`` has the number of lines taken of every log file (file, n_lines), ``<folder>/version=N/records`` the
records after them (id, data, deleted_at, n_ops). ``covered`` is written first, a version counts once ``records`` is finished, so a
compaction that breaks leaves the version before in force, and one that succeeds is never replayed twice. The log is a folder of JSON lines;
entries are ordered by the path of their file and their place in it. Files may grow between compactions; covered ones may be removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.operators.store import load_records

ENTRY = "op string, id string, ts string, data map<string,string>"
RECORDS = "id string, data map<string,string>, deleted_at string, n_ops long"
COVERED = "file string, n_lines long"
FLUSH_ENTRIES, COMPACT_ENTRIES = 20, 50


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions, in order."""
    fs, root = _fs(spark, folder)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [n for n in names if n.startswith("version=") and fs.exists(_fs(spark, f"{folder}/{n}/records/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("version=")) for n in found)


def _version(spark: SparkSession, folder: str) -> tuple[int, DataFrame, DataFrame]:
    """The newest finished version with its records and coverage; version 0 is empty."""
    done = versions(spark, folder)
    if not done:
        return 0, spark.createDataFrame([], RECORDS), spark.createDataFrame([], COVERED)
    at = f"{folder}/version={done[-1]:012d}"
    return done[-1], spark.read.schema(RECORDS).parquet(f"{at}/records"), spark.read.schema(COVERED).parquet(f"{at}/covered")


def log_lines(spark: SparkSession, log: str) -> DataFrame:
    """value, file, block, line of every line of the log; empty where there is no log yet."""
    fs, root = _fs(spark, log)
    if not fs.exists(root):
        return spark.createDataFrame([], "value string, file string, block long, line long")
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.option("recursiveFileLookup", True).text(log).select("value", *place)


def entries_after(lines: DataFrame, covered: DataFrame, upto: DataFrame | None = None) -> DataFrame:
    """Log entries (op, id, ts, data, pos) after the covered lines of each file, and not after those of ``upto``; damaged lines are dropped.

    Files that either side covers in part have their lines numbered by block, each block in its own task; others are taken or left as a whole.
    """
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = blocks.withColumns({"_before": before, "_n": F.sum("n").over(Window.partitionBy("file"))}).drop("n")
    sized = sized.join(covered.select("file", F.col("n_lines").alias("_from")), "file", "left").fillna(0, "_from")
    if upto is None:
        sized = sized.withColumn("_to", F.col("_n"))
    else:
        sized = sized.join(upto.select("file", F.col("n_lines").alias("_to")), "file", "left").fillna(0, "_to")
    rows = lines.join(sized.where("_from < _to"), ["file", "block"])
    whole = (F.col("_from") == 0) & (F.col("_to") >= F.col("_n"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("line"))
    part = rows.where(~whole).withColumn("_number", number).where("_number > _from and _number <= _to")
    kept = rows.where(whole).select("value", "file", "block", "line").unionByName(part.select("value", "file", "block", "line"))
    entry = F.from_json("value", ENTRY, {"mode": "PERMISSIVE"})
    return kept.select(entry.alias("e"), F.struct("file", "block", "line").alias("pos")).where("e.op is not null").select("e.*", "pos")


def load(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """id, data, deleted_at, hard_deleted, n_ops: the newest snapshot with what came after it in the log."""
    _, records, covered = _version(spark, folder)
    return load_records(records, entries_after(log_lines(spark, log), covered))


def compact(spark: SparkSession, folder: str, log: str) -> int:
    """Write the next version; hard-deleted records leave, deleted ones stay so that they can be restored. Its number.

    Lines that come while it runs stay uncovered. An unfinished version of that number is replaced.
    """
    number, records, covered = _version(spark, folder)
    at = f"{folder}/version={number + 1:012d}"
    lines = log_lines(spark, log)
    now = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))
    # A file that is gone keeps its place, so that it isn't taken anew if it comes back.
    both = now.unionByName(covered).groupBy("file").agg(F.max("n_lines").alias("n_lines"))
    both.write.mode("overwrite").parquet(f"{at}/covered")
    upto = spark.read.schema(COVERED).parquet(f"{at}/covered")
    state = load_records(records, entries_after(log_lines(spark, log), covered, upto))
    state.where(~F.col("hard_deleted")).select("id", "data", "deleted_at", "n_ops").write.mode("overwrite").parquet(f"{at}/records")
    return number + 1


def compact_if_due(spark: SparkSession, folder: str, log: str, least: int = COMPACT_ENTRIES) -> int | None:
    """Compact once ``least`` entries are uncovered; the new version's number, else None."""
    _, _, covered = _version(spark, folder)
    waiting = entries_after(log_lines(spark, log), covered).limit(least).count()
    return compact(spark, folder, log) if waiting >= least else None


def append(entries: DataFrame, log: str, batch: int, order: str = "pos") -> None:
    """Add entries (op, id, ts, data, and their order) to the log as a batch; the same batch number again replaces the batch.

    Files of a batch sort by its number, then by ranges of the order, so the log keeps the order of the entries.
    """
    ranged = entries.repartitionByRange(order).sortWithinPartitions(order)
    ranged.select("op", "id", "ts", "data").write.mode("overwrite").json(f"{log}/batch={batch:012d}")


def trim(spark: SparkSession, folder: str, log: str) -> int:
    """Remove batches of the log all of whose files the newest version covers; how many."""
    _, _, covered = _version(spark, folder)
    lines = log_lines(spark, log).groupBy("file").agg(F.count(F.lit(1)).alias("n")).join(covered, "file", "left")
    batch = F.regexp_extract("file", r"/(batch=\d+)/[^/]*$", 1)
    done = lines.groupBy(batch.alias("batch")).agg(F.min(F.coalesce(F.col("n_lines") >= F.col("n"), F.lit(False))).alias("all")).where("all and batch <> ''")
    removed = 0
    for row in done.select("batch").toLocalIterator():
        fs, at = _fs(spark, f"{log}/{row.batch}")
        removed += bool(fs.delete(at, True))
    return removed
