"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from airtrace.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` is safe on pure ASCII only."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str = SPACES) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def fresh(df: DataFrame, wanted: str, taken: Iterable[str] = ()) -> str:
    """A column name that no column of ``df`` has, letter case aside."""
    have = {c.lower() for c in df.columns} | {t.lower() for t in taken}
    name = wanted
    while name.lower() in have:
        name += "_"
    return name


def require(df: DataFrame, *names: str) -> None:
    """Fail early, with the column names, where a needed column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; the table has {df.columns}")


def digest_of(items: Column) -> Column:
    """SHA-256 of sorted strings joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def once(df: DataFrame, **computed: Column) -> DataFrame:
    """Add columns that are computed once, whatever is filtered on later.

    A filter on a plain projected column is pushed below it with the whole
    expression copied in, so that costly text work runs twice. A generated
    column holds such filters back.
    """
    fields = F.struct(*[c.alias(n) for n, c in computed.items()])
    held = fresh(df, "_held", computed)
    out = df.withColumn(held, F.explode(F.array(fields)))
    return out.withColumns({n: F.col(held)[n] for n in computed}).drop(held)


def indexed(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Number all rows from 0 in the given order.

    Rows are sorted over ranges of all order columns, so that a frequent first
    column is split; the sizes of the ranges, one number per partition, give
    each range its start. The sorted rows are written once, so that positions
    and sizes agree.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    placed = materialise(placed.withColumn("_nth", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "indexed")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    out = placed.join(F.broadcast(starts), "_part")  # a row per partition
    return out.withColumn(name, F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


REST = "_rest"


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns in one struct, whose names then clash with nothing."""
    require(docs, "doc_id", "text")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias(REST)] if rest else []))


def unpacked(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(REST)[c]
    return df.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])
