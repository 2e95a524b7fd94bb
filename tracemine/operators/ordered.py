"""Passes over the rows of a key in their order, for keys that may hold most of a table: rows are dealt by range, and only totals of ranges meet by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``. Only a local session may go without one; it gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written once as a table in the checkpoint folder. A checkpoint would run the last stage twice, for a count and for the files."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``__part``: rows by range of (keys, order); those that tie share a part. Written to the checkpoint folder, as parts must not change between two uses."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys, order).withColumn("__part", F.spark_partition_id()))


def _joined(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the totals of their part and key. Null keys equal each other; a key has no more rows in a part than the part."""
    names = ["__part", *keys]
    other = totals.select(*(F.col(k).alias(f"__of_{i}") for i, k in enumerate(names)), *(c for c in totals.columns if c not in names))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(names)]
    return rows.join(other, same).drop(*(f"__of_{i}" for i in range(len(names))))


def sum_so_far(df: DataFrame, keys: list[str], order: str, value, name: str, ties: bool = False) -> DataFrame:
    """Adds ``name``: the sum of value (whole numbers) over the rows of the key before this one or, with ties, up to it and those of the same order."""
    rows = placed(df.withColumn("__value", value.cast("long")), keys, order)
    totals = rows.groupBy("__part", *keys).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    totals = totals.select("__part", *keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__part", *keys).orderBy(order)
    own = own.rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties else own.rowsBetween(Window.unboundedPreceding, -1)
    summed = _joined(rows.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0))), totals, keys)
    return summed.withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__value", "__own", "__before")


def lifted_sum(df: DataFrame, keys: list[str], order: str, step, name: str, part: str = "__no") -> DataFrame:
    """Adds ``name``: the sum of step up to each row, less its least value so far where that is below 0: a level that steps down from 0 leave at 0. ``part`` names a column for the row's range."""
    so_far = Window.partitionBy("__part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed(df.withColumn("__step", step.cast("long")), keys, order).withColumn("__sum", F.sum("__step").over(so_far)).withColumn("__least", F.min("__sum").over(so_far))
    totals = rows.groupBy("__part", *keys).agg(F.sum("__step").alias("__total"), F.min("__sum").alias("__low"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    totals = totals.withColumn("__floor", F.least(F.lit(0), F.min(F.col("__before") + F.col("__low")).over(before))).drop("__total", "__low")
    level = F.col("__before") + F.col("__sum") - F.least("__floor", F.col("__before") + F.col("__least"))
    return _joined(rows, totals, keys).withColumn(name, level).withColumnRenamed("__part", part).drop("__no", "__step", "__sum", "__least", "__before", "__floor")


def with_next(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str) -> DataFrame:
    """Adds ``name``: a struct of order and columns of the key's next row; null after the last."""
    rows = placed(df, keys, order).withColumn("__row", F.struct(order, *columns))
    own = Window.partitionBy("__part", *keys).orderBy(order)
    firsts = rows.groupBy("__part", *keys).agg(F.min("__row").alias("__first"))
    firsts = firsts.withColumn("__later", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__part"))).drop("__first")  # a row per part
    found = _joined(rows.withColumn("__own", F.lead("__row").over(own)), firsts, keys)
    return found.withColumn(name, F.coalesce("__own", "__later")).drop("__part", "__row", "__own", "__later")


def last_so_far(df: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """Adds ``name``: the latest value of column that is not null, this row's included; null before the first."""
    so_far = Window.partitionBy("__part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed(df, keys, order).withColumn("__own", F.last(column, ignorenulls=True).over(so_far))
    lasts = rows.groupBy("__part", *keys).agg(F.max(F.when(F.col(column).isNotNull(), F.struct(order, column))).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    lasts = lasts.select("__part", *keys, F.last(f"__last.{column}", ignorenulls=True).over(before).alias("__earlier"))
    return _joined(rows, lasts, keys).withColumn(name, F.coalesce("__own", "__earlier")).drop("__part", "__own", "__earlier")


def _extreme(df: DataFrame, keys: list[str], order: str, value: str, name: str, after: bool) -> DataFrame:
    """Adds ``name``: the least value over the key's rows of a greater order (after), or the greatest over those of a lesser one. Rows that tie share a part, so other parts' rows never tie."""
    pick, both = (F.min, F.least) if after else (F.max, F.greatest)
    rows = placed(df, keys, order)
    own = Window.partitionBy("__part", *keys).orderBy(order)
    own = own.rangeBetween(1, Window.unboundedFollowing) if after else own.rangeBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy(*keys).orderBy("__part")  # a row per part
    others = others.rowsBetween(1, Window.unboundedFollowing) if after else others.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part", *keys).agg(pick(value).alias("__of_part")).withColumn("__others", pick("__of_part").over(others)).drop("__of_part")
    found = _joined(rows.withColumn("__own", pick(value).over(own)), totals, keys)
    return found.withColumn(name, both("__own", "__others")).drop("__part", "__own", "__others")


def greatest_before(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the greatest value over the rows of the key whose order (a long) is less; null without one."""
    return _extreme(df, keys, order, value, name, after=False)


def least_after(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the least value over the rows of the key whose order (a long) is greater; null without one."""
    return _extreme(df, keys, order, value, name, after=True)
