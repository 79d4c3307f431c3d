"""Exact top-k inner products on a bit-sliced index.

Components become integers, floor(scale * x). The index holds, per block of
rows, the rows' integers and, for every attribute, its values in steps of a
power of two as bit slices: bitmap j has bit j of each row's value. For a query
the slices are added up, each as often as its weight's bits ask for, by adders
that work on whole bitmaps; a negative weight takes the complements. The result
is every row's approximate score as bit slices. From the most significant slice
downward the rows are cut to those of the k best, which gives the k-th score.
What the steps have cut off is bounded by the norms of the remainders, so every
row that could still be among the k best is at most two bounds below: these
boundary rows, found by comparing the slices with that number, are scored on
their integers. Nothing rests on the bound being small; a loose one only makes
more boundary rows.

Every query is sent to every block of rows, by the block's number, and streams
past it; a block gives at most k rows a query, and the best k of those are the
result.

Nulls, empty and odd input: a vector that is null or holds null or non-finite
components takes no part. Shorter vectors, the empty one too, are filled up with
zeros. A row is a candidate for every query but itself, so repeated ids and rows
count as often as they are there; a null id is a row like any other, last among
ties, and never a query. Scores beyond the range of a long are the end of the
range. An empty table gives no rows. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from airtrace.llm.common import require
from airtrace.session import materialise

SCALE = 1024
TOP = 10
#: Rows of a block, fewer where vectors are long.
BLOCK_ROWS, BLOCK_VALUES = 16_384, 1 << 21
#: Bits of an attribute's value and of a weight without its sign.
VALUE_BITS, WEIGHT_BITS = 7, 5
LONG_MAX = (1 << 63) - 1
INDEX = "block string, ids binary, n long, width long, vectors binary"
FOUND = "query_id long, query_block string, query_at long, vec_id long, score long"
NO_ID = -(1 << 63)


def pack(values: np.ndarray) -> bytes:
    """Integers in float64, exact, in the narrowest type that holds them; one byte names the type."""
    for code, kind in ((b"h", "<i2"), (b"i", "<i4")):
        if not values.size or np.abs(values).max() <= np.iinfo(kind).max:
            return code + values.astype(kind).tobytes()
    return b"d" + values.astype("<f8").tobytes()


def unpack(data: bytes, width: int, rows: int) -> np.ndarray:
    kind = {b"h": "<i2", b"i": "<i4", b"d": "<f8"}[data[:1]]
    return np.frombuffer(data, dtype=kind, offset=1).astype(np.float64).reshape(rows, width)


def step_of(largest: float, bits: int) -> float:
    """The least power of two, 1 at least, in which ``largest`` has so many bits."""
    return 2.0 ** max(int(np.ceil(np.log2(max(largest, 1) / (2**bits - 1)))), 0)


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Bit arrays along the last axis as 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    room = -packed.shape[-1] % 8
    packed = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, room)])
    return np.ascontiguousarray(packed).view("<u8")


class Slices:
    """The bit slices of one block of integer vectors, their complements and what they leave out."""

    def __init__(self, vectors: np.ndarray):
        n, width = vectors.shape
        self.n = n
        self.low = vectors.min(axis=0)
        self.step = step_of(float((vectors.max(axis=0) - self.low).max(initial=0)), VALUE_BITS)
        value = np.floor((vectors - self.low) / self.step).astype(np.int64)
        rest = vectors - self.low - value * self.step - (self.step - 1) / 2
        self.rest = float(np.sqrt((rest * rest).sum(axis=1).max(initial=0)))
        self.norm = float(np.sqrt((vectors * vectors).sum(axis=1).max(initial=0)))
        flags = (value.T[:, None, :] >> np.arange(VALUE_BITS)[None, :, None]) & 1
        slices = bitmap(flags.astype(bool))
        self.all = bitmap(np.ones(n, dtype=bool))
        self.signed = np.stack((slices, slices ^ self.all))  # sign, attribute, bit, words

    def scores(self, weight: np.ndarray) -> list[np.ndarray]:
        """Bit slices, least first, of the sum of |weight| times value, or its complement for weight < 0."""
        sign, size = (weight < 0).astype(np.int64), np.abs(weight).astype(np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        for i in range(int(size.max(initial=0)).bit_length()):
            used = np.flatnonzero(size >> i & 1)
            for j in range(VALUE_BITS):
                if len(used):
                    waiting.setdefault(i + j, []).append(self.signed[sign[used], used, j])
        out: list[np.ndarray] = []
        place = 0
        while place <= max(waiting, default=-1):
            rows = np.concatenate(waiting.pop(place, [np.zeros((1, len(self.all)), dtype="<u8")]))
            while len(rows) > 1:
                # full adders take three bitmaps each; the last two take one with a zero
                rows = np.concatenate((rows, np.zeros((1, len(self.all)), dtype="<u8"))) if len(rows) == 2 else rows
                whole = len(rows) // 3 * 3
                a, b, c = rows[0:whole:3], rows[1:whole:3], rows[2:whole:3]
                half = a ^ b
                waiting.setdefault(place + 1, []).append((a & b) | (half & c))
                rows = np.concatenate((half ^ c, rows[whole:]))
            out.append(rows[0])
            place += 1
        return out

    def kth(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest score, read off the slices from the most significant down."""
        sure, open_rows, score = np.zeros_like(self.all), self.all.copy(), 0
        for i in range(len(slices) - 1, -1, -1):
            more = sure | (open_rows & slices[i])
            if int(np.bitwise_count(more).sum()) >= k:
                open_rows &= slices[i]
                score += 1 << i
            else:
                sure = more
                open_rows &= ~slices[i]
        return score

    def at_least(self, slices: list[np.ndarray], score: int) -> np.ndarray:
        """The places of the rows whose score is at least so much."""
        more, equal = np.zeros_like(self.all), self.all.copy()
        if score >> len(slices):
            equal = np.zeros_like(self.all)
        for i in range(len(slices) - 1, -1, -1):
            if score >> i & 1:
                equal &= slices[i]
            else:
                more |= equal & slices[i]
                equal &= ~slices[i]
        flags = np.unpackbits((more | equal).view(np.uint8), bitorder="little")[: self.n]
        return np.flatnonzero(flags)

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """The places of all rows that can be among the k best of a query."""
        if self.n <= k or self.norm * np.sqrt((query * query).sum()) >= 1 << 62:  # scores beyond a long are equal
            return np.arange(self.n)
        step = step_of(float(np.abs(query).max(initial=0)), WEIGHT_BITS)
        weight = np.rint(query / step)
        rest = query - weight * step
        bound = np.sqrt((rest * rest).sum()) * self.norm + step * np.sqrt((weight * weight).sum()) * self.rest
        slices = self.scores(weight)
        # the bound once for the k-th row and once for the other, in the steps of the slices, with room for rounding
        below = 2 * bound / (step * self.step)
        if not slices or not np.isfinite(below) or below >= 1 << 60:
            return np.arange(self.n)
        return self.at_least(slices, max(self.kth(slices, k) - int(below * (1 + 1e-9)) - 2, 0))


def exact(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Integer inner products, whatever their size."""
    reach = np.abs(vectors) @ np.abs(query)
    if not reach.size or reach.max() < 1 << 52:  # every partial sum is exact
        return (vectors @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in vectors)
    return [min(max(s, -LONG_MAX - 1), LONG_MAX) for s in sums]


def _index(width: int, scale: int):
    """Rows (id, vector) to blocks of ids and integer vectors."""
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(width, 1)))

    def block(name: str, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        vectors = np.concatenate(parts)
        return pa.RecordBatch.from_pydict({
            "block": [name], "ids": [np.array(ids, dtype="<i8").tobytes()], "n": [len(ids)], "width": [width],
            "vectors": [pack(vectors)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                piece = batch.slice(start, most)
                column = piece.column("v")
                filled = np.zeros((len(column), width))
                sizes = np.diff(column.offsets.to_numpy())
                values = column.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                filled[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * values)
                ids += [NO_ID if i is None else i for i in piece.column("id").to_pylist()]
                parts.append(filled)
                held += len(filled)
                if held >= most:
                    yield block(f"{part}-{done}", ids, parts)
                    done, ids, parts, held = done + 1, [], [], 0
        if ids:
            yield block(f"{part}-{done}", ids, parts)

    return run


def _queries(every: int):
    """Blocks of rows to the queries among them, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype="<i8")
                at = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                vectors = unpack(r["vectors"], r["width"], len(ids))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids[at], type=pa.int64()), "block": pa.array([r["block"]] * len(at), type=pa.string()),
                    "at": pa.array(at, type=pa.int64()), "v": pa.array([pack(vectors[i:i + 1]) for i in at], type=pa.binary())})

    return run


def _meet(k: int, width: int):
    """A block of rows, then its queries, and so on, to the k best rows of each query in each block."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, slices, vectors, ids, order = None, None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if r["ids"] is not None:
                    seen, ids = r["block"], np.frombuffer(r["ids"], dtype="<i8")
                    vectors = unpack(r["v"], width, len(ids))
                    slices = Slices(vectors)
                    # ties go to the smaller id, no id last
                    order = np.where(ids == NO_ID, LONG_MAX, ids)
                    continue
                query = unpack(r["v"], width, 1)[0]
                near = slices.boundary(query, k + 1)  # the query itself may be one
                if r["block"] == seen:
                    near = near[near != r["at"]]
                score = exact(vectors[near], query)
                best = sorted(range(len(near)), key=lambda x: (-score[x], order[near[x]], near[x]))[:k]
                out += [(r["id"], r["block"], r["at"], None if ids[near[x]] == NO_ID else int(ids[near[x]]), score[x]) for x in best]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], type=t) for j, t in enumerate(types)], names=names)

    return run


def usable(vector: Column) -> Column:
    """No null and no component that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def top_k(vectors: DataFrame, every: int, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """Per query, a row (vec_id, embedding) whose id ``every`` divides: its k best other rows.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller id.
    """
    require(vectors, "vec_id", "embedding")
    wide = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = wide.where(usable(F.col("v")))
    width = int(rows.agg(F.max(F.size("v")).alias("w")).first().w or 0)
    index = materialise(rows.mapInArrow(_index(width, scale), INDEX), "bit-sliced")
    names = materialise(index.select("block"), "blocks")

    asked = index.select("block", "ids", "width", "vectors").mapInArrow(_queries(every), "id long, block string, at long, v binary")
    # every query goes to every block of rows, by the number of the latter, and follows it there
    count = names.count()
    numbered = names.withColumn("to", F.row_number().over(Window.orderBy("block")) - 1)  # a short row per block
    blocks = index.join(numbered, "block").select(
        "to", F.lit(0).alias("turn"), "block", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("at"),
        "ids", F.col("vectors").alias("v"))
    sent = materialise(asked, "queries").select(
        F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0)))).alias("to"), F.lit(1).alias("turn"), "block", "id", "at",
        F.lit(None).cast("binary").alias("ids"), "v")
    met = blocks.unionByName(sent).repartition(max(count, 1), "to").sortWithinPartitions("to", "turn")
    best = met.mapInArrow(_meet(k, width), FOUND)

    place = Window.partitionBy("query_id", "query_block", "query_at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
