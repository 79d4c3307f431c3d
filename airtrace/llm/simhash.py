"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of the shingle hashes have it.
For radius r, every bit position gets a vector of r + 1 bits; table v keeps the
positions whose vector has an odd product with v. Any r positions leave some
v other than 0 orthogonal to all of their vectors, so two fingerprints that
differ there agree on all that table v keeps: every pair within the radius
meets in one of the 2^(r+1) - 1 tables, with certainty.

A bucket that is too large is split by a second covering over the positions its
table left out, and so on; every pair within the radius still meets. Within a
bucket only the links of a spanning forest are written.

Nulls, empty and odd input: a null or blank text has no shingle and the
fingerprint 0, linked like any other; a text with fewer words than a shingle is
one shingle. Equal texts share a fingerprint, and each fingerprint is compared
once, however many rows have it. A component without any non-null id has a null
one. Further columns do not matter.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from airtrace.llm.arrow import map_texts
from airtrace.llm.common import packed, require, unpacked
from airtrace.llm.components import components
from airtrace.session import materialise

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
#: Buckets beyond this are split further; a bucket's work is its square at most.
BUCKET = 2048
FINGERPRINT = StructType([StructField("fp", LongType())])
LINKS = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("path", LongType())])


def fingerprint(text: str, shingle: int = SHINGLE, distinct: bool = False) -> int:
    """The fingerprint as an unsigned number; ``distinct`` counts equal shingles once."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    rows = [words[i:] for i in range(shingle)] if len(words) >= shingle else [words]
    parts = map(b" ".join, zip(*rows)) if len(words) >= shingle else [b" ".join(words)]
    parts = set(parts) if distinct else parts
    return majority(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """A number with the bits that more than half of the hashes have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        some = hashes[start:start + 65_536].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed long."""
    require(docs, "text")

    def run(texts: list[str]) -> dict[str, list]:
        made = np.array([fingerprint(t, shingle, distinct) for t in texts], dtype=np.uint64)
        return {"fp": made.view(np.int64)}

    return map_texts(docs, "text", run, FINGERPRINT)


def covering(positions: list[int], radius: int, seed: int) -> list[int]:
    """The masks over ``positions``; each keeps about half of them.

    Of some ways to deal out the vectors, fixed by the seed, the one whose
    smallest mask keeps most positions is taken; any way covers every pair.
    """
    tables = range(1, 2 ** (radius + 1))
    best: list[int] = []
    for trial in range(64):
        deal = random.Random(1000 * seed + trial)
        vectors = [v for _ in range(0, len(positions), len(tables)) for v in deal.sample(tables, len(tables))]
        masks = [sum(1 << p for p, m in zip(positions, vectors) if (m & v).bit_count() & 1) for v in tables]
        best = max(best, masks, key=lambda ms: min((m.bit_count() for m in ms), default=-1))
    return best


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(points: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the points within the radius of each other."""
    left = np.ones(len(points), dtype=bool)
    for start in range(len(points)):
        if not left[start]:
            continue
        left[start] = False
        heap = [start]
        while heap:
            x = heap.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(points[rest] ^ points[x]) <= radius]
            left[near] = False
            heap.extend(near.tolist())
            for y in near:
                yield x, int(y)


def _bucket_links(radius: int, most: int):
    """Read rows (path, key, fp) in order of (path, key); write links, or large buckets as they are."""

    def batch(a, b, path) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x, dtype=np.int64)) for x in (a, b, path)], names=["a", "b", "path"])

    def of_bucket(points: np.ndarray, path: int) -> pa.RecordBatch:
        if len(points) > most:
            return batch(points.view(np.int64), points.view(np.int64), np.full(len(points), path))
        pairs = np.array(list(forest(points, radius)), dtype=np.int64).reshape(-1, 2)
        return batch(points[pairs[:, 0]].view(np.int64), points[pairs[:, 1]].view(np.int64), np.full(len(pairs), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        path, key, fp, large = none, none, none, None
        for b in batches:
            path = np.concatenate((path, b.column("path").to_numpy()))
            key = np.concatenate((key, b.column("key").to_numpy()))
            fp = np.concatenate((fp, b.column("fp").to_numpy()))
            if large is not None:  # the bucket that is being passed on goes on
                same = (path == large[0]) & (key == large[1])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield batch(fp[:n], fp[:n], path[:n])
                path, key, fp = path[n:], key[n:], fp[n:]
                if not len(fp):
                    continue
                large = None
            starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[starts, len(fp)])
            points = fp.view(np.uint64)
            two = starts[:-1][sizes[:-1] == 2]
            two = two[np.bitwise_count(points[two] ^ points[two + 1]) <= radius]
            if len(two):
                yield batch(fp[two], fp[two + 1], np.full(len(two), -1))
            for start, size in zip(starts[:-1], sizes[:-1]):
                if size > 2:
                    yield of_bucket(points[start:start + size], int(path[start]))
            last = starts[-1]
            path, key, fp = path[last:], key[last:], fp[last:]
            if len(fp) > most:
                yield batch(fp, fp, path)
                large = (path[0], key[0])
                path, key, fp = none, none, none
        if len(fp) > 1:
            yield of_bucket(fp.view(np.uint64), int(path[0]))

    return run


def links(points: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect every pair of distinct ``fp`` within the radius."""
    spark = points.sparkSession
    full = (1 << BITS) - 1
    tables = {0: 0}  # positions that a path keeps already
    rows = points.select("fp", F.lit(0).cast("long").alias("path"))
    found = None
    while True:
        # at most (2^(r+1) - 1)^depth rows, and positions halve with the depth
        steps, after = [], {}
        for path, kept in tables.items():
            open_at = [p for p in range(BITS) if not kept >> p & 1]
            for i, mask in enumerate(covering(open_at, radius, seed=len(open_at))):
                after[path * 2 ** (radius + 1) + i + 1] = kept | mask
                steps.append((path, path * 2 ** (radius + 1) + i + 1, signed((kept | mask) & full)))
        if list(tables) == [0]:
            keyed = rows.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("next"), F.lit(m).alias("mask")) for _, n, m in steps])).alias("c"))
            keyed = keyed.select("fp", "c.next", "c.mask")
        else:
            keyed = rows.join(F.broadcast(spark.createDataFrame(steps, "path long, next long, mask long")), "path")
        keyed = keyed.select(F.col("next").cast("long").alias("path"), F.col("mask").cast("long").alias("mask"), "fp")
        key = F.col("fp").bitwiseAND(F.col("mask"))
        # the key itself is not shuffled: path and mask repeat and pack well
        dealt = keyed.repartition("path", key).select("path", key.alias("key"), "fp")
        sorted_rows = dealt.sortWithinPartitions("path", "key")
        made = materialise(sorted_rows.mapInArrow(_bucket_links(radius, bucket), LINKS), "links")
        near = made.where("path = -1").select("a", "b")
        found = near if found is None else found.unionByName(near)
        rows = made.where("path >= 0").select(F.col("a").alias("fp"), "path")
        present = {r.path for r in rows.select("path").distinct().collect()}  # bounded by the number of tables
        if not present:
            return found.distinct()
        tables = {p: after[p] for p in present}
        rows = rows.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, distinct: bool = False) -> DataFrame:
    """Per row: doc_id, text_hash, fp and component_id, the least id that can be reached."""
    require(docs, "doc_id", "text")
    light = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    light = materialise(fingerprints(light, shingle, distinct).drop("text"), "fingerprints")
    points = light.groupBy("fp").agg(F.min("doc_id").alias("least"))
    points = materialise(points, "points")
    labels = components(links(points, radius)).withColumnRenamed("node", "fp")
    labelled = points.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_point = labelled.join(least, "label").select("fp", "component_id", "label")
    return light.join(of_point, "fp").select("doc_id", "text_hash", "fp", "component_id", "label")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, distinct: bool = False) -> DataFrame:
    """One document of each component, that with the least id, with its own columns.

    Null ids come last. Of rows that agree in id and text one stays.
    """
    return least_of_each(docs, near_duplicates(packed(docs), shingle, radius, distinct))


def least_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group; ``found`` has doc_id, text_hash and label."""
    docs, whole = packed(docs), docs
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    keep = found.groupBy("label").agg(F.min(place).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    rows = docs.withColumn("_same", F.xxhash64("text"))
    rows = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["_same"] == keep["_hash"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "_same").orderBy("_same"))
    return unpacked(rows.withColumn("_nth", first).where("_nth = 1"), whole)
