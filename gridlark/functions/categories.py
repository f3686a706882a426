"""Classes and attributes of rows: maps of class numbers with proof of what stayed, and named flags with rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import fingerprint


def remap_category(df: DataFrame, mapping: dict[int, int], column: str = "category_id") -> DataFrame:
    """Only the class changes; a class without an entry is an error."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    new = table[F.col(column)]
    unknown = F.raise_error(F.concat(F.lit("class without an entry: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int")
    return df.withColumn(column, F.coalesce(new, unknown).cast(df.schema[column].dataType))


def name_mapping(source: DataFrame, target: DataFrame) -> dict[int, int]:
    """Class numbers of two tables (id, name) that have the same name, whatever its case; a source name without a partner is an error."""
    have = {r["name"].strip().lower(): int(r["id"]) for r in target.select("id", "name").collect()}  # one row a class
    want = {int(r["id"]): r["name"].strip().lower() for r in source.select("id", "name").collect()}
    lost = sorted(set(want.values()) - have.keys())
    if lost:
        raise ValueError(f"no class of the target is named {lost}")
    return {i: have[n] for i, n in want.items()}


def remap_audit(before: DataFrame, after: DataFrame, mapping: dict[int, int], column: str = "category_id") -> DataFrame:
    """source, target, n_before, n_after for each entry of the map, beside whether all other columns are the same rows
    (``others_unchanged``) and their number (``same_count``).  Nothing is compared row by row: fingerprints of both tables are."""
    others = [c for c in before.columns if c != column]
    one, two = (fingerprint(df, others).select(F.col("fingerprint").alias(f"f{i}"), F.col("n_rows").alias(f"n{i}")) for i, df in enumerate((before, after)))
    proof = one.crossJoin(two).select((F.col("f0") == F.col("f1")).alias("others_unchanged"), (F.col("n0") == F.col("n1")).alias("same_count"))  # one row
    pairs = before.sparkSession.createDataFrame(list(mapping.items()), "source int, target int")
    counts = [df.groupBy(F.col(column).cast("int").alias(n)).agg(F.count("*").alias(c)) for df, n, c in ((before, "source", "n_before"), (after, "target", "n_after"))]
    return pairs.join(counts[0], "source", "left").join(counts[1], "target", "left").fillna(0).crossJoin(proof).select("source", "target", "n_before", "n_after", "others_unchanged", "same_count")


def attribute_flags(bits: Column, names: list[str], exactly_one: dict[str, list[str]] | None = None, at_least_one: dict[str, list[str]] | None = None) -> list[Column]:
    """A column for each name from a list of 0 and 1 by position, and one for each rule about a group of names.  A list of another length or with other numbers gives nulls."""
    fine = (F.size(bits) == len(names)) & ~F.exists(bits, lambda b: b.isNull() | ~b.isin(0, 1))
    flag = {n: F.when(fine, F.get(bits, i) == 1) for i, n in enumerate(names)}

    def said(group: list[str]) -> Column:
        total = F.lit(0)
        for n in group:
            total = total + flag[n].cast("int")
        return total

    out = [c.alias(n) for n, c in flag.items()]
    out += [(said(group) == 1).alias(rule) for rule, group in (exactly_one or {}).items()]
    return out + [(said(group) >= 1).alias(rule) for rule, group in (at_least_one or {}).items()]
