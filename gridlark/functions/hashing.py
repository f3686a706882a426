"""Stable hashes and fingerprints, equal in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_hash(text: Column) -> Column:
    """The first 60 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def stable_seed(*parts: Column) -> Column:
    """The first 64 bits of the SHA-256 of the parts joined by ``|``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_unit(*parts: Column) -> Column:
    return stable_seed(*parts).cast("double") / F.lit(float(2**64 - 1))


def source_key(name: Column) -> Column:
    """File name in lower case without folder, export suffix and extension."""
    return F.regexp_replace(F.lower(F.regexp_extract(name, r"([^/]+)$", 1)), r"(\.rf\.[0-9a-f]+)?(\.(jpg|jpeg|png))?$|(_(jpg|jpeg|png)\.rf\.[0-9a-f]+\.(jpg|jpeg|png))$", "")


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns, each as its length, a colon and its text (null: a minus), so that no two rows are written alike."""
    each = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*each), 256)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and a SHA-256 of the table that does not depend on the order of its rows: over the row count and the sums of four
    60-bit parts of all row hashes.  One row; partial sums on each task."""
    parts = [F.conv(F.substring(F.col("h"), 15 * i + 1, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(row_hash(columns).alias("h")).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))
