"""Tables that are kept and brought up to date by partitions: what is there is not made again, what did not change is not written.

A table is a folder of Parquet files by the values of a column.  An update writes the partitions that it touches and no
others (dynamic overwrite); those that it leaves empty are deleted.  Rows that an update takes from the table itself are
staged first, so that a job that fails half way leaves whole partitions, old or new.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import written


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, empty if nothing was written yet."""
    files, where = _folder(spark, path)
    return spark.read.schema(schema).parquet(path).select(schema.names) if files.exists(where) else spark.createDataFrame([], schema)


def put_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write the partitions that ``rows`` has, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _replace(path: str, rows: DataFrame, by: str, values: list) -> DataFrame:
    """The partitions ``values`` hold ``rows`` afterwards and nothing else; one job writes them."""
    spark = rows.sparkSession
    put_partitions(rows, path, [by])
    left = {str(r[0]) for r in rows.select(by).distinct().collect()}
    files, where = _folder(spark, path)
    for status in files.listStatus(where) if files.exists(where) else []:
        name, _, value = unquote(status.getPath().getName()).partition("=")
        if name == by and value in {str(v) for v in values} - left:
            files.delete(status.getPath(), True)
    return stored_table(spark, path, rows.schema)


def upsert_splits(path: str, new: DataFrame, splits: list[str], key: list[str], split: str = "source_split") -> DataFrame:
    """The named splits of the stored manifest become the rows of ``new``.  A row of another split and a repeated key are errors, found before anything is written."""
    if not new.where(~F.col(split).isin(splits) | F.col(split).isNull()).isEmpty():
        raise ValueError("a new row belongs to a split that is not named")
    new = written(new, "manifest")
    kept = stored_table(new.sparkSession, path, new.schema).where(~F.col(split).isin(splits))
    if not kept.select(*key).unionAll(new.select(*key)).groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("repeated manifest key")
    return _replace(path, new, split, splits)


def merge_stored(path: str, new: DataFrame, key: list[str], by: str) -> DataFrame:
    """New rows, and the stored rows whose key was not made again; partitions without either kind of change are not read for writing."""
    new = written(new, "merge")
    old = stored_table(new.sparkSession, path, new.schema)
    made = new.select(*key).distinct()
    touched = [r[0] for r in new.select(by).union(old.join(made, key, "left_semi").select(by)).distinct().collect()]  # names of folders
    rows = old.where(F.col(by).isin(touched)).join(made, key, "left_anti").select(*new.columns).unionByName(new)
    return _replace(path, written(rows, "merge"), by, touched)


def replace_stored_prefix(path: str, new: DataFrame, column: str, prefix: str, by: str) -> DataFrame:
    """Stored rows whose ``column`` begins with the prefix give way to ``new``."""
    new = written(new, "replace")
    old = stored_table(new.sparkSession, path, new.schema)
    touched = [r[0] for r in new.select(by).union(old.where(F.col(column).startswith(prefix)).select(by)).distinct().collect()]  # names of folders
    rows = old.where(F.col(by).isin(touched) & ~F.col(column).startswith(prefix)).unionByName(new)
    return _replace(path, written(rows, "replace"), by, touched)


def stored_deltas(path: str, pairs: DataFrame, n_units: int, n_resamples: int, seed: int, statistic: Callable[[Column, Column], Column], block: int = 100) -> DataFrame:
    """contrast, inputs, resample, delta of a paired bootstrap, kept under ``path`` by (contrast, block of resamples).

    ``pairs``: contrast, unit, baseline, method.  Blocks that are stored whole are not made again; a run that was stopped goes
    on with the next, and gives the rows of one that was not, as a draw depends on (seed, resample, number) alone.  Draws are
    made once for all contrasts that lack a block.  ``inputs`` is a digest of the contrast's pairs and the seed: when they
    change, its stored rows no longer count."""
    from ..operators.stats import pending_resamples, resampled

    spark = pairs.sparkSession
    pairs = written(pairs.select("contrast", "unit", "baseline", "method"), "pairs")
    each = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("unit", "baseline", "method"))).cast("decimal(38,0)")
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(n_units)), F.count("*").cast("string"), F.sum(each).cast("string")), 256)
    inputs = pairs.groupBy("contrast").agg(digest.alias("inputs"))
    schema = "contrast string, inputs string, resample int, delta double, block int"
    stored = stored_table(spark, path, StructType.fromDDL(schema)).join(inputs, ["contrast", "inputs"], "left_semi")
    planned = inputs.select("contrast", "inputs", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("resample"))
    missing = pending_resamples(planned, stored, ["contrast", "inputs", "resample"])
    open_ = written(missing.select("contrast", "inputs", F.floor(F.col("resample") / block).cast("int").alias("block")).distinct(), "open-blocks")
    if not open_.isEmpty():
        numbers = open_.select("block").distinct().select("block", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("i"))
        wanted = numbers.select((F.col("block") * block + F.col("i")).alias("resample")).where(F.col("resample") < n_resamples)
        asked = open_.select("contrast", "inputs", F.col("block").alias("_asked"))
        drawn = resampled(pairs, n_units, n_resamples, seed, wanted).withColumn("block", F.floor(F.col("resample") / block).cast("int"))
        drawn = drawn.groupBy("contrast", "resample", "block").agg(statistic(F.col("baseline"), F.col("method")).alias("delta")).join(inputs, "contrast")
        made = drawn.join(asked, (drawn["contrast"] == asked["contrast"]) & (drawn["inputs"] == asked["inputs"]) & (F.col("block") == F.col("_asked")), "left_semi")
        put_partitions(made.select("contrast", "inputs", "resample", "delta", "block"), path, ["contrast", "block"])
    whole = stored_table(spark, path, StructType.fromDDL(schema))
    return whole.join(inputs, ["contrast", "inputs"], "left_semi").where(F.col("resample") < n_resamples).select("contrast", "inputs", "resample", "delta")
