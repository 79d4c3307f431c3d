"""Repeated passages: exact 100-byte repeats found by suffix sorting.

The corpus is cut so that equal strings of 100 bytes always come together, and
each part is suffix-sorted by the difference-cover method.

1. Cutting. Every 32-byte string has a hash; the least hash among those within a
   100-byte string is its key. Neighbouring strings with one key form a piece,
   about 35 strings long. Equal strings have equal keys. Of equal pieces in a
   batch only the first goes on; the rest repeat it.
2. Pieces meet by key. Equal pieces are settled by their order. Only where a key
   has different pieces, or a piece may repeat within itself, is text fetched.
3. Those pieces, in blocks that hold whole keys, are suffix-sorted: the triples
   at two of three positions are sorted and named, names are sorted again by the
   same method until they differ, the remaining suffixes are sorted by their
   first symbol and the rank behind it and merged in. Neighbours that share 100
   bytes form a class; all but its first member are repeats.

Removed are the bytes covered by a repeat. "First" is by doc_id, then by hash of
the text where ids are repeated, then by place in the text.

Nulls, empty and odd input: a null text is empty; texts below 100 bytes lose
nothing; a null id counts as larger than any other. Every row has a result: of
rows with equal id and text one is the first, and the others repeat it wholly;
rows without id are told apart by a 62-bit hash of their text. Further columns
do not matter. Kept bytes need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from airtrace.llm.arrow import chunks
from airtrace.llm.common import require
from airtrace.session import broadcast_if_few, materialise

LENGTH = 100
GRAM = 32
#: Strings of a piece at most; cuts runs in texts that repeat one short pattern.
RUN = 512
#: Symbols of a suffix-sorted block, whole keys apart.
BLOCK = 1 << 18
LAST_ID = (1 << 63) - 1
#: From here on ``sub`` belongs to rows without id.
NO_ID = 1 << 62
#: Copies of a row that are listed at once.
SPREAD = 65_536
BASE = 0x9E3779B97F4A7C15 | 1
WORD = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"][:n], _powers["down"][:n]


def string_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each string of LENGTH bytes, and the hashes of all grams."""
    n = len(data)
    up, down = powers(n)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    h = (sums[GRAM:] - sums[:-GRAM]) * down[:n - GRAM + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    grams, width, reach = h, LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        h = np.minimum(h[:len(h) - reach], h[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(h[:len(h) - rest], h[rest:]) if rest else h, grams


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and number of strings of each piece, and whether its key is in it twice.

    Two equal strings in one piece have its least gram in two places.
    """
    if len(data) < LENGTH:
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none
    keys, grams = string_keys(np.frombuffer(data, dtype=np.uint8))
    cut = np.concatenate(([True], keys[1:] != keys[:-1]))
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(keys)))
    if (sizes > RUN).any():
        parts = -(-sizes // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * RUN
        sizes = np.diff(np.append(starts, len(keys)))
    widths = sizes + (LENGTH - GRAM)
    ends = np.cumsum(widths)
    at = np.repeat(starts - (ends - widths), widths) + np.arange(ends[-1])
    hits = grams[at] == np.repeat(keys[starts], widths)
    twice = np.add.reduceat(hits, ends - widths, dtype=np.int64) > 1
    return keys[starts], starts, sizes, twice.astype(np.int64)


# ------------------------------------------------- difference-cover suffix sort


#: Symbols and ranks below this fit three into one number.
PACKED = 1 << 21


def _packed(columns: list[np.ndarray]) -> np.ndarray | None:
    """Columns as one number per row that sorts like them, if they fit."""
    if any(len(c) and c.max() >= PACKED for c in columns):
        return None
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key << 21 | c
    return key


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns."""
    key = _packed(columns)
    return np.lexsort(columns[::-1]) if key is None else np.argsort(key, kind="stable")


def _ranked(triples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of triples, their names (from 1) in that order, and whether all differ."""
    order = _sorted(triples)
    columns = [t[order] for t in triples]
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    names = np.cumsum(new) + 1
    return order, names, bool(len(order) == 0 or names[-1] == len(order))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Symbols are whole numbers from 1."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    s = np.concatenate((symbols.astype(np.int64), np.zeros(4, dtype=np.int64)))
    # the cover: positions 1 and 2 of every three; one past the end closes the first row
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    order, names, unique = _ranked([s[sample], s[sample + 1], s[sample + 2]])
    if unique:
        sample_order = order
    else:
        named = np.empty(len(sample), dtype=np.int64)
        named[order] = names
        sample_order = suffix_array(named)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[sample_order]] = np.arange(1, len(sample) + 1)
    sampled = sample[sample_order]
    sampled = sampled[sampled < n]
    others = np.arange(0, n, 3)
    others = others[_sorted([s[others], rank[others + 1]])]
    # merge: where each remaining suffix falls among the sampled ones of either kind
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before_ones = _count_before(
        [s[first], rank[first + 1]], [s[others], rank[others + 1]])
    before_twos = _count_before(
        [s[second], s[second + 1], rank[second + 2]], [s[others], s[others + 1], rank[others + 2]])
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(others)) + before_ones + before_twos
    taken = np.zeros(n, dtype=bool)
    taken[place] = True
    out[place] = others
    out[~taken] = sampled
    return out


def _count_before(sampled: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many sampled keys, which are in order, are below each other key; no two keys are equal."""
    low, high = _packed(sampled), _packed(others)
    if low is not None and high is not None:
        return np.searchsorted(low, high)
    m, k = len(sampled[0]), len(others[0])
    columns = [np.concatenate(pair) for pair in zip(sampled, others)]
    order = np.lexsort(columns[::-1])
    is_sampled = order < m
    seen = np.cumsum(is_sampled)
    out = np.empty(k, dtype=np.int64)
    out[order[~is_sampled] - m] = seen[~is_sampled]
    return out


def repeats(texts: list[bytes], sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each string of the pieces, in order, whether an equal one comes before.

    Pieces are ordered; ``sizes`` counts the strings of each. ``starts`` are
    their first strings' numbers. Pieces end in symbols of their own, so no
    match crosses an end.
    """
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    symbols = np.empty(len(data) + len(texts), dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inner = np.ones(len(symbols), dtype=bool)
    inner[ends] = False
    symbols[inner] = data + len(texts) + 1
    symbols[ends] = np.arange(1, len(texts) + 1)
    order = suffix_array(symbols)
    begins = ends - lengths
    number = np.full(len(symbols), -1, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    nth = np.arange(len(owner)) - np.repeat(starts, sizes)
    number[begins[owner] + nth] = np.arange(len(owner))
    order = order[number[order] >= 0]
    same = np.zeros(len(order), dtype=bool)
    left = np.flatnonzero(np.ones(max(len(order) - 1, 0), dtype=bool))
    for at in range(LENGTH):  # neighbours share a prefix: compare it, dropping pairs that differ
        left = left[symbols[order[left] + at] == symbols[order[left + 1] + at]]
        if not len(left):
            break
    same[left + 1] = True
    classes = np.cumsum(~same) - 1
    found = np.zeros(len(owner), dtype=bool)
    if len(order):
        numbers = number[order]
        least = np.full(classes[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes, numbers)
        found[numbers] = numbers != least[classes]
    return found


# ---------------------------------------------------------------------- Spark

PIECE = "key long, body long, id long, sub long, start long, n long, twice int"
RUNS = "key long, id long, sub long, start long, n long, kind int"
REPEAT, FETCH = 0, 1


def _table(names: str, *columns) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to pieces.

    All but the first of equal ones in a batch are known repeats. They carry a
    minus sign on n and a key of their own, so that a passage of very many
    documents sends a row per batch to its key, not one per document.
    """
    for whole in batches:
        for batch in chunks(whole, "text"):
            ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy()
            parts: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = (text or "").encode()
                keys, starts, sizes, twice = pieces(data)
                view = memoryview(data)
                body = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[a:a + n + LENGTH - 1]) for a, n in zip(starts.tolist(), sizes.tolist())),
                    dtype=np.uint64, count=len(starts))
                for part, values in zip(parts, (keys, body, np.full(len(keys), ids[i]), np.full(len(keys), subs[i]), starts, sizes, twice)):
                    part.append(values)
            key, body, id_, sub, start, n, twice = (np.concatenate(p) for p in parts)
            order = np.lexsort((start, sub, id_, body, key))
            key, body, id_, sub, start, n, twice = (x[order] for x in (key, body, id_, sub, start, n, twice))
            again = np.zeros(len(key), dtype=bool)
            again[1:] = (key[1:] == key[:-1]) & (body[1:] == body[:-1])
            spread = (id_.astype(np.uint64) * np.uint64(BASE) + start.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            key = np.where(again, spread ^ body, key)
            yield _table(PIECE, key.view(np.int64), body.view(np.int64), id_, sub, start, np.where(again, -n, n), twice)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key, body and place: repeats, and the first ones of keys with several bodies."""
    names = [f.split()[0] for f in PIECE.split(", ")]
    held = [np.empty(0, dtype=np.int64)] * len(names)

    def settled(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, body, id_, sub, start, n, twice = columns
        if not len(key):
            return
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_body = new_key | np.concatenate(([True], body[1:] != body[:-1]))
        new_body &= n > 0
        several = np.bincount(np.cumsum(new_key) - 1, weights=new_body)[np.cumsum(new_key) - 1] > 1
        for mask, kind in ((~new_body, REPEAT), (new_body & (several | (twice > 0)), FETCH)):
            if mask.any():
                yield _table(RUNS, key[mask], id_[mask], sub[mask], start[mask], np.abs(n[mask]), np.full(mask.sum(), kind))

    for batch in batches:
        columns = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, names)]
        key = columns[0]
        last = int(np.searchsorted(key, key[-1]))
        yield from settled([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    yield from settled(held)


TEXTS = "key long, id long, sub long, start long, n long, body binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted pieces out of the texts."""
    for whole in batches:
        for batch in chunks(whole, "text"):
            rows: list[list] = [[] for _ in range(6)]
            for text, id_, sub, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "id", "sub", "wanted"))):
                data = (text or "").encode()
                for w in wanted:
                    body = data[w["start"]:w["start"] + w["n"] + LENGTH - 1]
                    for part, value in zip(rows, (w["key"], id_, sub, w["start"], w["n"], body)):
                        part.append(value)
            yield _table(TEXTS, *rows)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key and place: suffix-sort them in blocks of whole keys."""
    held: list[tuple] = []
    size = 0

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[1], r[2], r[3]))
        n = np.array([r[4] for r in rows])
        first = np.cumsum(n) - n
        found = repeats([r[5] for r in rows], n, first)
        owner = np.repeat(np.arange(len(rows)), n)
        nth = np.arange(len(owner)) - np.repeat(first, n)
        start = np.array([r[3] for r in rows])[owner] + nth
        hits = np.flatnonzero(found)
        if not len(hits):
            return
        breaks = np.flatnonzero((owner[hits][1:] != owner[hits][:-1]) | (np.diff(hits) != 1)) + 1
        begin = np.concatenate(([0], breaks))
        length = np.diff(np.append(begin, len(hits)))
        at = hits[begin]
        who = owner[at]
        pick = lambda i: np.array([rows[w][i] for w in who])
        yield _table(RUNS, pick(0), pick(1), pick(2), start[at], length, np.full(len(at), REPEAT))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "id", "sub", "start", "n", "body")]
        for row in zip(*columns):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield from block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5]) + 1
    if held:
        yield from block(held)


def _placed(docs: DataFrame) -> DataFrame:
    """Rows (id, sub, text): ``sub`` orders texts of one id, and those without id after all others.

    It is 0 for ids that occur once, else a hash of the text.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id").isNull(), hashed + NO_ID).otherwise(hashed).alias("sub"))
    often = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).count().where("count > 1")
    often = materialise(often.select("id", F.lit(True).alias("often")), "repeated-ids")
    rows = rows.join(broadcast_if_few(often), "id", "left")
    sub = F.when(F.col("often") | (F.col("sub") >= NO_ID), F.col("sub")).otherwise(F.lit(0).cast("long"))
    return rows.select("id", sub.alias("sub"), "text")


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different rows (id, sub, text), and how often those occur that occur more than once (id, sub, copies)."""
    rows = _placed(docs)
    copies = materialise(rows.groupBy("id", "sub").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    if copies.isEmpty():
        return rows, copies
    some = broadcast_if_few(copies.select("id", "sub"))
    once = rows.join(some, ["id", "sub"], "left_anti")
    # one of each group, found before anything is shuffled
    one = rows.join(some, ["id", "sub"], "left_semi").groupBy("id", "sub").agg(F.first("text").alias("text"))
    return materialise(once.unionByName(one), "texts"), copies


def repeat_runs(rows: DataFrame) -> DataFrame:
    """Runs (id, sub, start, n) of strings that occur earlier, for rows (id, sub, text)."""
    cut = rows.select("id", "sub", "text").mapInArrow(_cut, PIECE)
    met = cut.repartition("key").sortWithinPartitions("key", "body", "id", "sub", "start").mapInArrow(_meet, RUNS)
    met = materialise(met, "runs")
    wanted = met.where(F.col("kind") == FETCH).groupBy("id", "sub").agg(
        F.collect_list(F.struct("key", "start", "n")).alias("wanted"))  # at most the length of a text
    texts = rows.join(wanted, ["id", "sub"]).select("id", "sub", "text", "wanted").mapInArrow(_fetch, TEXTS)
    sorted_runs = materialise(texts.repartition("key").sortWithinPartitions("key", "id", "sub", "start").mapInArrow(_sort, RUNS), "sorted-runs")
    return met.where(F.col("kind") == REPEAT).select("id", "sub", "start", "n").unionByName(sorted_runs.select("id", "sub", "start", "n"))


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest (or the bytes) of what stays."""
    require(docs, "doc_id", "text")
    rows, copies = _prepared(docs)
    runs = repeat_runs(rows).groupBy("id", "sub").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = rows.join(runs, ["id", "sub"], "left")
    schema = "id long, sub long, " + REMOVED + (", kept binary" if keep_bytes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                out: list[list] = [[] for _ in range(6 + keep_bytes)]
                for text, id_, sub, found in zip(*(batch.column(c).to_pylist() for c in ("text", "id", "sub", "runs"))):
                    data, parts, upto, removed, spans = text.encode(), [], 0, 0, 0
                    for a, b in sorted((r["start"], r["start"] + r["n"] + LENGTH - 1) for r in found or ()):
                        if a > upto or not spans:
                            spans += 1
                            parts.append(data[upto:a])
                            removed += b - a
                        elif b > upto:
                            removed += b - upto
                        upto = max(upto, b)
                    kept = b"".join(parts) + data[upto:]
                    row = [id_, sub, len(data), removed, spans, hashlib.sha256(kept).hexdigest()] + [kept] * keep_bytes
                    for part, value in zip(out, row):
                        part.append(value)
                yield _table(schema, *out)

    made = joined.select("id", "sub", "text", "runs").mapInArrow(run, schema)
    # copies of a row repeat it wholly; they are listed in two steps, so that no array holds very many
    made = made.join(copies, ["id", "sub"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    made = made.withColumn("_far", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SPREAD))))
    made = made.withColumn("_near", F.explode(F.sequence(
        F.lit(0).cast("long"), F.least(F.col("copies") - F.col("_far") * SPREAD, F.lit(SPREAD)) - 1)))
    whole = ((F.col("_far") > 0) | (F.col("_near") > 0)) & (F.col("n_bytes") >= LENGTH)
    empty = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(F.lit(""), 256)}
    if keep_bytes:
        empty["kept"] = F.lit(b"")
    made = made.withColumns({c: F.when(whole, v).otherwise(F.col(c)) for c, v in empty.items()})
    known = ~((F.col("id") == LAST_ID) & (F.col("sub") >= NO_ID))
    return made.withColumn("doc_id", F.when(known, F.col("id"))).drop("_far", "_near", "copies")
