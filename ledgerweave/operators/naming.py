"""Names without collisions: files that arrive with one name get numbered ones, none of which meets another name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """From the last dot on, if it isn't the first character; else ''."""
    return F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def archive_names(files: DataFrame, keys: list[str], name: str = "name", order: str = "pos") -> DataFrame:
    """Add final_name: in the order of arrival a file keeps its name if that is free, else gets the first free ``stem_1.ext``, ``stem_2.ext``, ...

    Only names that differ in numbers at the end of their stem can meet. Where such a family has one name, its n-th file has number n. In the others a
    task streams through the sorted files of a family and keeps the names that are taken. A null name counts as empty.
    """
    wanted = F.coalesce(F.col(name), F.lit(""))
    root = F.struct(F.regexp_replace(stem(wanted), r"(_\d+)+$", ""), extension(wanted))
    df = files.withColumns({"_wanted": wanted, "_stem": stem(wanted), "_ext": extension(wanted), "_family": F.to_json(root)})
    family = [*keys, "_family"]
    several = df.groupBy(*family).agg((F.min("_wanted") != F.max("_wanted")).alias("_several"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in family]
    df = df.alias("f").join(several.alias("s"), same).select("f.*", "_several")
    helpers = ("_wanted", "_stem", "_ext", "_family", "_several")
    n = F.row_number().over(Window.partitionBy(*family).orderBy(order)) - 1
    one = df.where(~F.col("_several")).withColumn("final_name", F.when(n == 0, F.col("_wanted")).otherwise(F.concat("_stem", F.lit("_"), n.cast("string"), "_ext")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, next_ = None, set(), {}
        for batch in batches:
            out = []
            for key, wanted, base, ext in zip(zip(*[batch[k] for k in family]), batch["_wanted"], batch["_stem"], batch["_ext"]):
                if key != now:
                    now, taken, next_ = key, set(), {}
                final, k = wanted, next_.get(wanted, 1)
                while final in taken:
                    final, k = f"{base}_{k}{ext}", k + 1
                next_[wanted] = k
                taken.add(final)
                out.append(final)
            yield batch.assign(final_name=out)

    many = df.where("_several").repartition(*family).sortWithinPartitions(*family, order)
    many = many.mapInPandas(run, many.withColumn("final_name", F.lit("")).schema)
    return one.drop(*helpers).unionByName(many.drop(*helpers))
