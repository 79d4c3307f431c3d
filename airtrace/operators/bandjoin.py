"""Joins on closeness (bands) and on time ranges, as shuffled equi-joins.

``abs(a - b) <= t`` has no equality, so Spark would compare every pair. Here
both sides get a bucket number: the left row one bucket, the right row each
bucket its band reaches (two per band). The join is then an equi-join on the
buckets with the exact test on top, and no pair can appear twice.

Buckets of very many rows are left to Spark's skew join, which cuts a partition
at run time by its real size. Where that is not enough, ``pieces`` spreads the
left rows of every bucket over a fixed number of pieces by a hash of the row and
copies the right rows to each. Neither depends on a size estimate, and the
result is the same with any number of pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.session import materialise


@dataclass(frozen=True)
class Band:
    """Whole-number columns of both sides that may differ by ``tolerance``."""

    left: str
    right: str
    tolerance: int


def _bucketed(df: DataFrame, on, bands: Sequence[Band], side: str) -> DataFrame:
    for i, band in enumerate(bands):
        width = 2 * band.tolerance
        if side == "left":
            df = df.withColumn(f"_b{i}", F.expr(f"`{band.left}` div {width}L"))
        else:
            low = F.expr(f"(`{band.right}` - {band.tolerance}L) div {width}L")
            high = F.expr(f"(`{band.right}` + {band.tolerance}L) div {width}L")
            df = df.withColumn(f"_b{i}", F.explode(F.sequence(low, high)))
    pick = 0 if side == "left" else 1
    return df.withColumns({f"_k{i}": F.col(pair[pick]) for i, pair in enumerate(on)})


def _spread(left: DataFrame, right: DataFrame, pieces: int) -> tuple[DataFrame, DataFrame]:
    """Spread the left rows over the pieces, copy the right ones to each."""
    piece = F.pmod(F.xxhash64(*left.columns), F.lit(pieces).cast("long")).cast("int")
    return left.withColumn("_piece", piece), right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))


def band_join(
    left: DataFrame,
    right: DataFrame,
    bands: Sequence[Band],
    on: Sequence[tuple[str, str]] = (),
    how: str = "inner",
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    pieces: int = 1,
) -> DataFrame:
    """Join rows whose ``on`` columns are equal and whose bands are close.

    ``how`` is ``inner`` or ``left_semi``. The two sides must not share column
    names for ``inner``. ``condition(l, r)`` adds a test over both sides.
    ``pieces`` spreads every bucket over that many tasks.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(how)
    kept = left.columns + (right.columns if how == "inner" else [])
    keys = [f"_k{i}" for i in range(len(on))] + [f"_b{i}" for i in range(len(bands))]
    left, right = _bucketed(left, on, bands, "left"), _bucketed(right, on, bands, "right")
    if pieces > 1:
        left, right = _spread(left, right, pieces)
        keys.append("_piece")

    def l(name: str) -> Column:
        return F.col(f"l.{name}")

    def r(name: str) -> Column:
        return F.col(f"r.{name}")

    test = F.lit(True)
    for key in keys:
        test = test & (l(key) == r(key))
    for band in bands:
        test = test & (F.abs(l(band.left) - r(band.right)) <= band.tolerance)
    if condition is not None:
        test = test & condition(l, r)
    joined = left.alias("l").join(right.alias("r"), test, how)
    own = set(left.columns)
    return joined.select(*[(l(c) if c in own else r(c)) for c in kept])


def within_span(df: DataFrame, time: str, spans: DataFrame, start: str, end: str | None, secs: int = 0) -> DataFrame:
    """Rows whose time lies between the first start and the last end of ``spans``, give or take ``secs``.

    The two bounds are scalar subqueries: they are found at run time and reach
    the scan as filters on its row groups. Without an ``end`` there is a lower
    bound only. No spans, no rows.

    The last end is a top-one and not a maximum, since Spark would merge two
    aggregates of one table into a struct, which is no bound for a scan.
    """
    slack = F.make_interval(secs=F.lit(secs))
    first = spans.agg(F.min(start).alias("_from")).select(F.col("_from") - slack)
    out = df.where(F.col(time) >= first.scalar())
    if end:
        last = spans.select((F.col(end) + slack).alias("_to")).orderBy(F.col("_to").desc_nulls_last()).limit(1)
        out = out.where(F.col(time) <= last.scalar())
    return out


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    start: str,
    end: str,
    on: Sequence[tuple[str, str]] = (),
    how: str = "inner",
    hours: int = 6,
) -> DataFrame:
    """Rows of ``points`` whose time lies in [start, end] of a range.

    The range is listed once per time slot it touches, the point has one slot,
    so the equi-join keys are the ``on`` columns and the slot. A key that holds
    very many rows is spread over its slots. ``how`` is ``inner`` or
    ``left_semi``; column names must differ for ``inner``.
    """
    width = hours * 3600
    kept = points.columns + (ranges.columns if how == "inner" else [])

    def slot(name: str) -> Column:
        return F.floor(F.unix_seconds(F.col(name).cast("timestamp")) / width)

    p = points.withColumn("_slot", slot(point))
    r = ranges.where(F.col(start) <= F.col(end)).withColumn(
        "_slot", F.explode(F.sequence(slot(start), slot(end)))
    )
    test = F.col("p._slot") == F.col("r._slot")
    for a, b in on:
        test = test & (F.col(f"p.{a}") == F.col(f"r.{b}"))
    test = test & F.col(f"p.{point}").between(F.col(f"r.{start}"), F.col(f"r.{end}"))
    own = set(points.columns)
    joined = p.alias("p").join(r.alias("r"), test, how)
    return joined.select(*[F.col(f"p.{c}" if c in own else f"r.{c}") for c in kept])


#: Points of one piece of a sweep.
PIECE_ROWS = 50_000


def swept(points: DataFrame, point: str, rows: int = PIECE_ROWS) -> DataFrame:
    """Points cut into pieces of at most so many rows that follow each other in time (``_piece``).

    Rows are dealt out over ranges of time and a hash of the row, so that a busy
    hour, or one instant with very many rows, is cut as well. They are written
    once, so that the pieces stay what they are.
    """
    dealt = points.withColumn("_tie", F.xxhash64(*points.columns))
    dealt = dealt.repartitionByRange(point, "_tie").sortWithinPartitions(point, "_tie").drop("_tie")
    # the number holds the partition in its upper and the row in its lower 33 bits
    number = dealt.withColumn("_n", F.monotonically_increasing_id())
    part, row = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(number.withColumn("_piece", F.struct(part.alias("part"), F.floor(row / rows).alias("nth"))).drop("_n"), "swept")


def sweep_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, hours: int = 6, rows: int = PIECE_ROWS) -> DataFrame:
    """Rows of ``points`` whose time lies in [start, end] of a range, without any key in common.

    A sweep over time in pieces of equal numbers of points: every piece is handed
    the ranges that are open at its lower border or begin inside it, and the join
    is on the piece. However many points one hour holds, no piece has more than
    others. Ranges and the few borders of pieces meet by time slots, in the first
    slot that both touch. Column names of the sides must differ.
    """
    width = hours * 3600

    def slots(first: str, last: str) -> Column:
        low, high = (F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width) for c in (first, last))
        return F.explode(F.sequence(low, high))

    kept = points.columns + ranges.columns
    cut = swept(points.where(F.col(point).isNotNull()), point, rows)
    borders = cut.groupBy("_piece").agg(F.min(point).alias("_from"), F.max(point).alias("_to"))
    borders = borders.withColumn("_slot", slots("_from", "_to"))
    spans = ranges.where(F.col(start) <= F.col(end)).withColumns({
        "_slot": slots(start, end), "_first": F.floor(F.unix_seconds(F.col(start).cast("timestamp")) / width)})
    first = F.greatest(F.col("_first"), F.floor(F.unix_seconds("_from") / width))
    handed = spans.join(borders, "_slot").where(
        (F.col("_from") <= F.col(end)) & (F.col("_to") >= F.col(start)) & (F.col("_slot") == first)
    ).select("_piece", *[F.col(c) for c in ranges.columns])
    return cut.join(handed, "_piece").where(F.col(point).between(F.col(start), F.col(end))).select(*kept)
