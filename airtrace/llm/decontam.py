"""Benchmark decontamination by hashed word windows.

The windows of all benchmark items are normalised and hashed; each position of
a document is looked up in that table, and a hit counts only if the words
themselves agree. Hit words are then cut out as spans, or whole documents are
dropped. All work is done by DataFrame functions.

Nulls, empty and odd input: a null text has no words, so it is never hit and
no item comes from it; an item with fewer words than a window is one window;
items without words are left out; repeated items and windows count once. Rows
are told apart by ``doc_id`` and a hash of the text, so equal rows share one
(equal) result and a null ``doc_id`` is no obstacle. Other columns are carried
along and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.llm.common import digest_of, lower_ascii, once, packed, require, split_words, unpacked
from airtrace.session import materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: A table of windows up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of digits, letters and characters beyond ASCII."""
    return split_words(lower_ascii(text), SEPARATORS)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: hash, words and the items that have it."""
    require(benchmark, "item_id", "text")
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = items.select("item_id", "w", F.explode(starts).alias("at"))
    each = each.select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("window_words"))
    each = each.groupBy("window_words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return each.select(F.xxhash64("window_words").alias("h"), F.size("window_words").alias("n"), "window_words", "items")


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Every occurrence: doc_id, text hash, first word, number of words, items.

    The lengths that occur are at most ``window`` small numbers and are looked
    up at each position. The table of hashes is broadcast only after it has
    been counted.
    """
    windows = materialise(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most ``window`` rows
    small = windows.count() <= broadcast_rows
    side = F.broadcast if small else (lambda df: df)
    words = once(docs.select("doc_id", "text"), text_hash=F.xxhash64("text"), w=words_of(F.col("text"))).drop("text")
    found = None
    for n in lengths:
        at = words.where(F.size("w") >= n).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - n)))
        # spelled out, a window is hashed in compiled code; it equals the hash of the array
        hashed = F.xxhash64(*[F.get("w", F.col("at") + k) for k in range(n)])
        keys = windows.where(F.col("n") == n).select("h", "window_words", "items")
        hits = at.withColumn("h", hashed).join(side(keys), "h")
        # the words must agree as well; two bounds instead of an equality, which would become a join key
        here = F.slice("w", F.col("at") + 1, F.lit(n))
        hits = hits.where((here <= F.col("window_words")) & (here >= F.col("window_words")))
        hits = hits.select("doc_id", "text_hash", "at", F.lit(n).alias("n"), "items")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = words.where(F.lit(False)).select(
            "doc_id", "text_hash", F.lit(0).alias("at"), F.lit(0).alias("n"), F.array(F.lit("")).alias("items"))
    return found


def hit_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per hit document: its word spans, hit words and items.

    A document's occurrences are bounded by its own length.
    """
    hits = window_hits(docs, benchmark, window)
    by_doc = hits.distinct().groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.expr(
        "aggregate(spans, named_struct('upto', 0, 'total', 0L), (a, s) -> named_struct("
        "'upto', greatest(a.upto, s.end), 'total', a.total + greatest(0, s.end - greatest(a.upto, s.at))), a -> a.total)"
    )
    return by_doc.withColumn("n_hit", covered)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items found and whether any was hit."""
    require(docs, "doc_id", "text")
    found = hit_documents(docs, benchmark, window).withColumnsRenamed({"doc_id": "hit_doc", "text_hash": "hit_hash"})
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_hash") == F.col("hit_hash"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return all_docs.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), digest_of(items).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns."""
    hits = window_hits(docs, benchmark, window).select(
        F.col("doc_id").alias("_hit_doc"), F.col("text_hash").alias("_hit_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_hit_doc")) & (F.xxhash64("text") == F.col("_hit_hash"))
    return unpacked(packed(docs).join(hits, same, "left_anti"), docs)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents; hit words go, each with the separators before it."""
    found = hit_documents(docs, benchmark, window).select(
        F.col("doc_id").alias("_hit_doc"), F.col("text_hash").alias("_hit_hash"), F.col("spans").alias("_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_hit_doc")) & (F.xxhash64("text") == F.col("_hit_hash"))
    word = r"[\x30-\x39A-Za-z\x{80}-\x{10FFFF}]+"
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*{word}"), F.lit(0))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    left = F.filter(pieces, lambda p, k: ~F.exists("_spans", lambda s: (s["at"] <= k) & (k < s["end"])))
    cut = F.concat(F.array_join(left, ""), tail)
    out = packed(docs).join(found, same, "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)
    return unpacked(out, docs, text=text)
