"""Decision records: where a document goes by the state of its fields, and queues whose fields are JSON inside JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FIELDS = "array<struct<field_id:string,value:string,status:string>>"


def decided(documents: DataFrame, at: str) -> DataFrame:
    """One record a document: queue, id, correlation_id, document_id, file_name, extracted_fields, fail_reasons, field_count, reason, status, created_at.

    A document with a reason failed before its fields were read and goes to ``exception_queue``; one with a field in state FAIL goes to ``review_queue`` with
    its fields and the names of the failed ones as JSON texts; any other to ``export_ready`` with the number of its fields. What a queue doesn't hold is null.
    ``documents``: correlation_id, document_id, file_name, fields (FIELDS), reason.
    """
    fields = F.coalesce("fields", F.array().cast(FIELDS))
    failed = F.transform(F.filter(fields, lambda x: x["status"] == "FAIL"), lambda x: x["field_id"])
    queue = F.when(F.col("reason").isNotNull(), "exception_queue").when(F.size(failed) > 0, "review_queue").otherwise("export_ready")
    rows = documents.select("*", fields.alias("_fields"), failed.alias("_failed"), queue.alias("queue"))
    review, ready = F.col("queue") == "review_queue", F.col("queue") == "export_ready"
    return rows.select(
        "queue", F.concat_ws("_", "document_id", "correlation_id").alias("id"), "correlation_id", "document_id", F.coalesce("file_name", F.lit("")).alias("file_name"),
        F.when(review, F.to_json("_fields", {"ignoreNullFields": "false"})).alias("extracted_fields"), F.when(review, F.to_json("_failed")).alias("fail_reasons"),
        F.when(ready, F.size("_fields")).alias("field_count"), "reason", F.when(ready, "export_ready").otherwise("pending").alias("status"), F.lit(at).alias("created_at"),
    )


def opened(records: DataFrame) -> DataFrame:
    """``records`` of a queue with fields (FIELDS) and failed (array) read from their JSON texts; a damaged text gives null."""
    read = lambda c, kind: F.from_json(c, kind, {"mode": "PERMISSIVE"})
    return records.withColumns({"fields": read(F.col("extracted_fields"), FIELDS), "failed": read(F.col("fail_reasons"), "array<string>")}).drop("extracted_fields", "fail_reasons")
