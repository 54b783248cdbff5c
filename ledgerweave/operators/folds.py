"""Sequential folds over sorted partitions.

Rows of a key are brought together by one shuffle and sorted; a task streams through its rows and
keeps the state of the current key only, so a large key costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], name: str, start: Callable, step: Callable) -> DataFrame:
    """Add an int column: ``step(state, *inputs)`` gives it row by row, ``start()`` the state of a new key."""
    schema = df.withColumn(name, F.lit(0)).schema

    def run(batches):
        key = state = None
        for batch in batches:
            out = []
            keyed = zip(*[batch[k] for k in keys])
            for now, values in zip(keyed, zip(*[batch[c] for c in inputs])):
                if now != key:
                    key, state = now, start()
                out.append(step(state, *values))
            yield batch.assign(**{name: pd.Series(out, index=batch.index, dtype="int32")})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
