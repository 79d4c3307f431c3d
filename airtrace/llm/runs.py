"""Periodic runs of words by the dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least
max(12, 2q) words long, that no neighbouring word extends with that period.

The dictionary names the word sequences of each length 1, 2, 4, ...; a name of
length 2l is the pair of the names of its halves, and sequences that occur once
in a text are dropped, as nothing longer that starts there can occur twice.
Occurrences of one name no more than l/2 apart form an arithmetic progression,
whose difference is the sequence's own period. A run of period q, with l the
power of two in (q/2, q], begins with a sequence of length l that occurs again q
words later, in another progression: either as the first of it, or so that the
last occurrences of both are q apart (the two progressions lie in stretches of
the shorter period; if the left one ends before the second occurrence, the
period q carries its end to the end of the right one, otherwise the right one
starts less than one shorter period before it). So the first and last
occurrences of the next progressions within 2l propose every period. Each
proposal is extended both ways by the names, from the longest down, and equal
stretches are kept once with their smallest period.

Texts are dealt out by Spark; a text is worked on whole in one task, in time
n log n of its words, whatever repeats in it.

Nulls, empty and odd input: a null or blank text has no words and no run, its
collapsed text is empty. Blanks are the six ASCII ones; letter case counts. Rows
are independent, so repeated ids and rows are returned as often as they are
there; further columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from airtrace.llm.arrow import chunks
from airtrace.llm.common import require

LEAST_WORDS = 12
LEAST_PERIODS = 2
#: Words looked at together, whole texts of them.
TOGETHER = 250_000
#: The progressions of one name begin more than l/2 apart, so three lie within 2l.
AHEAD = 3

Words = list[bytes]


class Names:
    """The names of all sequences of one length; places without one get a name of their own."""

    def __init__(self, size: int, at: np.ndarray, name: np.ndarray):
        self.size, self.at, self.name = size, at, name
        self.whole = None
        if 4 * len(at) >= size:
            self.whole = -1 - np.arange(size, dtype=np.int64)
            self.whole[at] = name

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        if self.whole is not None:
            return self.whole[places]
        near = np.minimum(np.searchsorted(self.at, places), len(self.at) - 1)
        return np.where(self.at[near] == places, self.name[near], -1 - places)


def _repeated(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs more than once, and the number of their key."""
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[name] > 1
    return at[twice], name[twice].astype(np.int64)


def dictionary(words: np.ndarray) -> list[Names]:
    """Names of length 1, 2, 4, ... up to the longest that occurs twice.

    ``words`` are numbers that differ between texts, so that nothing across
    the end of a text has an equal.
    """
    size = len(words)
    at, name = _repeated(np.arange(size), words)
    levels: list[Names] = []
    while len(at):
        levels.append(Names(size, at, name))
        half = 1 << (len(levels) - 1)
        inside = at + half < size
        at, name = at[inside], name[inside]
        right = levels[-1][at + half]
        both = right >= 0
        at, name = _repeated(at[both], name[both] * size + right[both])
    return levels


def _common_after(levels: list[Names], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from ``a`` and from ``b`` on are equal."""
    size, a, b = levels[0].size, a.copy(), b.copy()
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(b < size)
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    return a - start


def _common_before(levels: list[Names], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before ``a`` and before ``b`` are equal."""
    a, b = a.copy(), b.copy()
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(a >= 1 << k)
        same = inside[levels[k][a[inside] - (1 << k)] == levels[k][b[inside] - (1 << k)]]
        a[same] -= 1 << k
        b[same] -= 1 << k
    return start - a


def proposals(levels: list[Names]) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods, among them the start or an inner place of every run with its period."""
    none = np.empty(0, dtype=np.int64)
    places, periods = [none], [none]
    word = levels[0]
    for k, level in enumerate(levels):
        length = 1 << k
        order = np.argsort(level.name, kind="stable")
        at, name = level.at[order], level.name[order]
        breaks = np.r_[True, (name[1:] != name[:-1]) | (2 * (at[1:] - at[:-1]) > length)]
        first = np.flatnonzero(breaks)
        chain = np.cumsum(breaks) - 1
        last = np.r_[first[1:], len(at)] - 1
        for ahead in range(1, AHEAD + 1):
            if ahead >= len(first):
                break
            # every place against the first of a later progression
            mine = np.flatnonzero(chain + ahead < len(first))
            other = first[chain[mine] + ahead]
            q = at[other] - at[mine]
            fit = (name[other] == name[mine]) & (q >= length) & (q < 2 * length)
            s, q = at[mine][fit], q[fit]
            # only where a run would start
            starts = (s == 0) | (word[np.maximum(s - 1, 0)] != word[np.maximum(s + q - 1, 0)])
            places.append(s[starts])
            periods.append(q[starts])
            # the last place of a progression against the last of a later one
            one, two = last[:-ahead], last[ahead:]
            q = at[two] - at[one]
            fit = (name[one] == name[two]) & (q >= length) & (q < 2 * length)
            places.append(at[one][fit])
            periods.append(q[fit])
    return np.concatenate(places), np.concatenate(periods)


def runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period."""
    levels = dictionary(words)
    if not levels:
        return np.empty((0, 3), dtype=np.int64)
    s, q = proposals(levels)
    start = s - _common_before(levels, s, s + q)
    end = s + q + _common_after(levels, s, s + q)
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(q) else np.empty(0, dtype=bool)
    found = np.stack((start, end, q), axis=1)[smallest]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(texts: list[Words]) -> list[np.ndarray]:
    """The runs of each text, looked for in all of them at once."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    ids = np.fromiter((numbers[w] for words in texts for w in words), dtype=np.int64, count=int(sizes.sum()))
    bounds = np.r_[0, np.cumsum(sizes)]
    found = runs(ids + np.repeat(np.arange(len(texts)), sizes) * max(len(numbers), 1))
    cuts = np.searchsorted(found[:, 0], bounds)
    return [found[cuts[i]:cuts[i + 1]] - [bounds[i], bounds[i], 0] for i in range(len(texts))]


def collapsed(words: Words, found: np.ndarray) -> str:
    """The words without those that a run repeats."""
    if len(found):
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(covered, found[:, 0] + found[:, 2], 1)
        np.add.at(covered, found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0)]
    return b" ".join(words).decode()


def planted(doc_id: int | None, words: Words) -> Words:
    """The words with a periodic end where the id's CRC-32 says so; a null id plants nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (1 + (n - a) // p))[: n - a]


def _together(words: list[Words]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, w in enumerate(words):
        size += len(w)
        if size > TOGETHER:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(words):
        yield start, len(words)


def collapse_runs(docs: DataFrame, prepare: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the shortened text.

    ``prepare`` may change the words of a row before its runs are looked for.
    """
    require(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    target = to_arrow_schema(schema)
    item = target.field("runs").type.value_type

    def made(ids: list, texts: list[Words]) -> pa.RecordBatch:
        found = runs_of(texts)
        rows = np.concatenate(found)
        runs_column = pa.StructArray.from_arrays(
            [pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(item))
        offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, type=target.field("doc_id").type), pa.array([len(w) for w in texts], type=pa.int64()),
            pa.ListArray.from_arrays(offsets, runs_column, type=target.field("runs").type),
            pa.array([collapsed(w, f) for w, f in zip(texts, found)], type=target.field("collapsed").type),
        ], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids = batch.column("doc_id").to_pylist()
                words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids, words)]
                for start, end in _together(words):
                    yield made(ids[start:end], words[start:end])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what ``collapse_runs`` returned."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("_best", F.array_min(order))
    length, period = -F.col("_best.less"), F.col("_best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
