"""Record store: op-log fold, content duplicates, retention, name lookup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.text import base_name, name_key, without_page_suffix


def read_oplog(spark, path: str) -> DataFrame:
    """op, id, ts, data, pos from JSON lines; damaged lines are dropped. pos orders by file name, place in the file and line."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("pos"))
    entry = F.from_json("value", "op string, id string, ts string, data map<string,string>", {"mode": "PERMISSIVE"})
    return lines.select(entry.alias("e"), "pos").where("e.op is not null").select("e.*", "pos")


def fold_entries(state: dict | None, entries) -> dict | None:
    """One id's state after (op, ts, data) in order; an update, delete or restore of an unknown id does nothing.

    The rule of ``fold_oplog`` step by step, for the state of a stream.
    """
    for op, ts, data in entries:
        if op == "upsert":
            state = {"data": dict(data or {}), "deleted_at": None, "hard": False, "n": (state["n"] if state else 0)}
        if state is None or (state["hard"] and op != "upsert"):
            continue
        if op == "update":
            state["data"].update(data or {})
        elif op == "soft_delete":
            state["deleted_at"] = ts
        elif op == "hard_delete":
            state["deleted_at"], state["hard"] = ts, True
        elif op == "restore":
            state["deleted_at"] = None
        state["n"] += 1
    return state


def fold_oplog(log: DataFrame) -> DataFrame:
    """Current state per id from (op, id, ts, data, pos), equal to ``fold_entries`` over the entries of each id in the order of pos.

    Folding by id makes replay idempotent: a repeated upsert replaces the record. An entry counts if the last upsert or hard deletion before
    it is an upsert. One sorted pass finds that, then sums per id and field; no entries of an id are gathered, so a hot id costs
    time but no memory. An entry ``snapshot`` is a record as a snapshot has it: ts is its time of deletion, if any; it is no operation.
    """
    begins = F.col("op").isin("upsert", "snapshot")
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(begins, F.lit(True)).when(F.col("op") == "hard_delete", F.lit(False))
    live = begins | F.coalesce(F.last(mark, True).over(before), F.lit(False))
    # The number of the record's life: data of earlier ones is gone.
    rows = log.select("id", "op", "ts", "data", "pos", live.alias("_live"), F.sum(begins.cast("int")).over(upto).alias("_life")).where("_live")
    given = F.when(begins | (F.col("op") == "update"), F.map_entries("data"))
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    fields = F.concat(F.array(none), F.coalesce(given, F.array().cast("array<struct<key:string,value:string>>")))
    rows = rows.withColumn("_field", F.explode(fields)).withColumn("_own", F.col("_field.key").isNull())
    gone = F.when(F.col("op").isin("soft_delete", "hard_delete", "snapshot"), F.col("ts"))
    per_field = rows.groupBy("id", F.col("_field.key").alias("key")).agg(
        F.max_by(F.struct("_life", F.col("_field.value").alias("value")), "pos").alias("last"), F.max("_life").alias("life"),
        F.max_by(F.struct(gone.alias("at")), F.when(F.col("op") != "update", F.col("pos"))).alias("gone"),
        F.max_by("op", F.when(begins | (F.col("op") == "hard_delete"), F.col("pos"))).alias("mark"),
        F.count_if(F.col("op") != "snapshot").alias("n"),
    )
    own = lambda c: F.max(F.when(F.col("key").isNull(), c))
    fields = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "last")))
    out = per_field.groupBy("id").agg(own(F.col("life")).alias("life"), own(F.struct("gone.at")).alias("gone"), own(F.col("mark")).alias("mark"), own(F.col("n")).alias("n"), fields.alias("fields"))
    kept = F.filter("fields", lambda x: x["last"]["_life"] == F.col("life"))
    data = F.map_from_entries(F.array_sort(F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["last"]["value"].alias("value")))))
    return out.select(F.col("id").cast("string").alias("id"), data.alias("data"), F.col("gone.at").alias("deleted_at"), (F.col("mark") == "hard_delete").alias("hard_deleted"), F.col("n").alias("n_ops"))


def load_records(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """State of a snapshot (id, data, and deleted_at and n_ops if there) after the operations of ``log``.

    Without n_ops every record of the snapshot counts as one operation before them.
    """
    has = snapshot.columns
    deleted = F.col("deleted_at").cast("string") if "deleted_at" in has else F.lit(None).cast("string")
    known = F.col("n_ops").cast("long") if "n_ops" in has else F.lit(1).cast("long")
    kind = log.schema["pos"].dataType
    order = lambda first, pos: F.struct(F.lit(first).alias("from"), pos.alias("at"))  # noqa: E731  the snapshot's records come first
    before = snapshot.select(
        F.lit("snapshot").alias("op"), F.col("id").cast("string").alias("id"), deleted.alias("ts"), "data", order(0, F.lit(None).cast(kind)).alias("pos")
    )
    later = log.select("op", F.col("id").cast("string").alias("id"), "ts", "data", order(1, F.col("pos")).alias("pos"))
    counts = snapshot.select(F.col("id").cast("string").alias("id"), known.alias("_known"))
    state = fold_oplog(before.unionByName(later)).join(counts, "id", "left")
    return state.withColumn("n_ops", F.col("n_ops") + F.coalesce("_known", F.lit(0))).drop("_known")


def last_state(log: DataFrame) -> DataFrame:
    """Deletion state per id without a fold: the last deleting or restoring entry decides. id, deleted_at, n_ops."""
    touches = F.col("op").isin("upsert", "soft_delete", "restore")
    gone = F.when(F.col("op") == "soft_delete", F.col("ts"))
    return log.groupBy("id").agg(
        F.max_by(F.struct(gone.alias("at")), F.when(touches, F.col("pos"))).alias("s"), F.count(F.lit(1)).alias("n_ops")
    ).select("id", F.col("s.at").alias("deleted_at"), "n_ops")


def content_duplicates(files: DataFrame) -> DataFrame:
    """Final store of live uploads (pos, hash, file_name): one row per hash and name key.

    The earliest row of a hash is its root; another name with that hash is a duplicate of it; the same
    hash and name refreshes the row, so the last upload's values stand. A null hash is always new.
    """
    key = F.coalesce(F.col("hash"), F.concat(F.lit("\0"), F.col("pos").cast("string")))
    keyed = files.withColumns({"name_key": name_key(F.col("file_name")), "_k": key})
    rows = keyed.groupBy("_k", "name_key").agg(
        F.min("pos").alias("pos"), F.max_by("file_name", "pos").alias("file_name"), F.first("hash").alias("hash"), F.count(F.lit(1)).alias("n_uploads")
    )
    root = rows.groupBy("_k").agg(F.min("pos").alias("root"))
    out = rows.join(root, "_k").withColumn("is_duplicate", (F.col("pos") != F.col("root")).cast("int"))
    return out.select("pos", "hash", "name_key", "n_uploads", "is_duplicate", F.when(F.col("is_duplicate") == 1, F.col("root")).alias("duplicate_of"))


def rooted_uploads(events: DataFrame) -> DataFrame:
    """What every upload does, in order: ``pos, id, hash, action, record, duplicate_of``.

    A hash points to its root. An upload with the root's own name key refreshes it (``refresh``, record is the root); another name makes a
    record that is a ``duplicate`` of the root; without a root, or while the root is deleted, it makes a record that is the new root (``new``). Restoring an earlier
    root does not make it the root again. ``events``: pos, op (upload, delete, restore), id (of the upload, or of the record deleted or restored), hash and
    file_name of uploads. An upload without a hash is always new.

    One fold over the sorted events of a hash, whose state is the root alone; a hot hash costs time but no memory.
    """
    uploads = events.where("op = 'upload'").select("pos", "op", "id", "hash", name_key(F.col("file_name")).alias("_key"))
    of = uploads.where("hash is not null").select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    other = events.where("op <> 'upload'").join(of, F.col("id") == F.col("_id")).select("pos", "op", "id", F.col("_hash").alias("hash"), F.lit(None).cast("string").alias("_key"))
    free = uploads.where("hash is null").select("pos", "id", "hash", F.lit("new").alias("action"), F.col("id").alias("record"), F.lit(None).cast("string").alias("duplicate_of"))

    def run(batches):
        now, root, name, live = None, None, None, False
        for batch in batches:
            out = []
            for hash_, pos, op, id_, key in zip(batch["hash"], batch["pos"], batch["op"], batch["id"], batch["_key"]):
                if hash_ != now:
                    now, root, name, live = hash_, None, None, False
                if op != "upload":
                    if id_ == root:
                        live = op == "restore"
                elif not live:
                    root, name, live = id_, key, True
                    out.append((pos, id_, hash_, "new", id_, None))
                elif key and key == name:
                    out.append((pos, id_, hash_, "refresh", root, None))
                else:
                    out.append((pos, id_, hash_, "duplicate", id_, root))
            yield pd.DataFrame(out, columns=["pos", "id", "hash", "action", "record", "duplicate_of"])

    kinds = {f.name: f.dataType.simpleString() for f in uploads.schema}
    schema = f"pos {kinds['pos']}, id string, hash string, action string, record string, duplicate_of string"
    rows = uploads.where("hash is not null").unionByName(other)
    return rows.repartition("hash").sortWithinPartitions("hash", "pos").mapInPandas(run, schema).unionByName(free)


def retained(records: DataFrame, cutoff: str, created: str = "created_at") -> DataFrame:
    """Records not older than ``cutoff``; a missing or unreadable time is kept."""
    at = F.col(created).try_cast("timestamp")
    return records.where(at.isNull() | (at >= F.lit(cutoff).cast("timestamp")))


def lookup_names(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests (pos, name) joined with live records (id, file_name, rec_pos): exact key, base name, then page suffix.

    Repeated requests repeat, misses are dropped; the last record of a key wins for the first two steps, the first for the third.
    """
    live = records.withColumn("k", name_key(F.col("file_name")))
    exact = live.groupBy("k").agg(F.max_by("id", "rec_pos").alias("id"))
    paged = live.where(F.col("k").contains("_p")).groupBy(without_page_suffix(F.col("k")).alias("k")).agg(F.min_by("id", "rec_pos").alias("id"))
    r = requests.withColumns({"k1": name_key(F.col("name")), "k2": name_key(base_name(F.col("name")))})
    for at, (table, key) in enumerate(((exact, "k1"), (exact, "k2"), (paged, "k1"), (paged, "k2"))):
        step = table.select(F.col("k").alias(f"_k{at}"), F.col("id").alias(f"_id{at}"))
        r = r.join(step, F.col(key) == F.col(f"_k{at}"), "left").drop(f"_k{at}")
    hit = F.coalesce("_id0", "_id1", "_id2", "_id3")
    return r.select("pos", "name", hit.alias("id")).where("id is not null")


def number_of_copies(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Import instance: the k-th copy of the same keys gets number k."""
    return rows.withColumn("instance", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))
