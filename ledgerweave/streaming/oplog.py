"""Op-log streams: file source, per-id state, micro-batch upsert into a versioned store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerweave.operators.store import fold_entries

LOG = "op string, id string, ts string, pos long, data map<string,string>"
STATE = "json string, deleted_at string, hard boolean, n long"
OUT = "id string, data string, deleted_at string, hard_deleted boolean, n_ops long"


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 20) -> DataFrame:
    """JSON-lines op log as a stream; damaged lines have no op and are dropped."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).json(folder).where("op is not null")


def fold_stream(log: DataFrame) -> DataFrame:
    """State per id after every micro-batch (update mode); equals the batch fold when each id's entries arrive in order."""

    def run(key, batches, state: GroupState):
        import json

        now = None
        if state.exists:
            text, deleted, hard, n = state.get
            now = {"data": json.loads(text), "deleted_at": deleted, "hard": hard, "n": n}
        rows = pd.concat(list(batches)).sort_values("pos")
        now = fold_entries(now, zip(rows["op"], rows["ts"], [dict(d) if d is not None else {} for d in rows["data"]]))
        if now is not None:
            text = json.dumps(now["data"], sort_keys=True, ensure_ascii=False)
            state.update((text, now["deleted_at"], now["hard"], now["n"]))
            yield pd.DataFrame([[key[0], text, now["deleted_at"], now["hard"], now["n"]]], columns=["id", "data", "deleted_at", "hard_deleted", "n_ops"])

    return log.groupBy("id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per type and window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def upsert_batches(changes: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch's latest states as one version folder: replaying a batch overwrites its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """Latest state per id over all versions."""
    rows = spark.read.parquet(path)
    return rows.groupBy("id").agg(F.max_by(F.struct("data", "deleted_at", "hard_deleted", "n_ops"), "version").alias("s")).select("id", "s.*")
