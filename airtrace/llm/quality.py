"""Quality rules: hashed n-gram likelihood ratio of trusted text to the raw corpus.

Two multinomials over hashed unigrams and bigrams are counted: one over every
document, one over a trusted sample. A document's score is the mean log ratio
of the two over its n-grams, so it does not depend on the length. Documents
below a fixed threshold, and those that break the base rules, are rejected.
All work is done by DataFrame functions.

Nulls, empty and odd input: a null text has no words and fails the base rules;
a null or repeated ``doc_id`` is scored like any other row, since each row is
scored by itself; a null label counts as not trusted. With no trusted row all scores
are equal and near 0, and only the base rules decide. The filter keeps all
columns, whatever their names; ``score`` replaces columns that have the name of
one of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from airtrace.llm.common import once, packed, require, split_words, unpacked

SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class QualityModel:
    """Log ratios by bucket; their number is a parameter, not a matter of the data."""

    log_ratio: tuple[float, ...]

    def column(self) -> Column:
        """The ratios as a constant array."""
        return F.split(F.lit(",".join(f"{x:.6f}" for x in self.log_ratio)), ",").cast("array<double>")


def _rest(array: str, start: int) -> Column:
    """The array from its ``start``-th element on."""
    return F.slice(array, F.lit(start), F.greatest(F.size(array), F.lit(1)))


def base_rules(docs: DataFrame) -> DataFrame:
    """Add the base counts and ``base_failed``; ``_words`` holds the words.

    Repeated three-word windows are found by sorting hashes that carry their
    position in the low bits. Equal neighbours are compared word by word.
    """
    out = once(docs, _text=F.coalesce(F.col("text"), F.lit("")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))
    out = once(out, _words=split_words(F.col("_text")), _lines=lines, n_symbols=symbols.cast("long"))
    # each step is held by ``once``: a step used inside a lambda would otherwise be copied into it and run per word
    out = once(out, _h1=F.expr("transform(_words, w -> xxhash64(w))"), _bits=F.length(F.bin(F.size("_words").cast("long"))))
    # shifted copies instead of index sums: few steps per word inside the lambdas
    out = once(out, _h2=_rest("_h1", 2), _h3=_rest("_h1", 3))
    out = once(out, _sorted=F.expr(
        "sort_array(transform(_h3, (h, i) -> shiftleft(xxhash64(get(_h1, i), get(_h2, i), h), _bits) | i))"))
    out = once(out, _after=_rest("_sorted", 2))
    mask = "(shiftleft(1L, _bits) - 1)"
    words = "slice(_words, int({0} & " + mask + ") + 1, 3)"
    equal = "shiftright(x ^ get({0}, k), _bits) = 0 and " + words.format("x") + " = " + words.format("get({0}, k)")
    out = once(out, _twice=F.expr(
        f"array_union(filter(_sorted, (x, k) -> {equal.format('_after')}), filter(_after, (x, k) -> {equal.format('_sorted')}))"))
    out = once(out, _starts=F.expr(f"sort_array(transform(_twice, x -> x & {mask}))"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(
            "aggregate(transform(_starts, (p, k) -> "
            "least(3L, coalesce(get(_starts, k + 1), p + 3) - p)), 0L, (a, x) -> a + x)"
        ),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_text", "_lines", "_bits", "_sorted", "_after", "_twice", "_starts")


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """Ids of documents labelled good and not toxic, at most ``most`` of them.

    The bound makes the table fit a broadcast; the choice among more ids is by
    hash and does not change between runs.
    """
    require(labels, "doc_id", "quality", "toxic")
    good = labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)))
    ids = good.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 32768, pseudo: float = 5.0, most_trusted: int = 20000) -> QualityModel:
    """Count both multinomials and return the log ratio of every bucket.

    The raw counts cover every document. Both multinomials get the same
    pseudo-count after the raw one is scaled to the size of the trusted one, so
    that rare n-grams have a ratio near 1.
    """
    require(docs, "doc_id", "text")
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    ids = F.broadcast(trusted_ids(labels, most_trusted).withColumn("_trusted", F.lit(1)))
    words = once(docs.select("doc_id", "text"), w=split_words(F.col("text"))).select("doc_id", "w").where(F.size("w") > 0)
    grams = words.join(ids, "doc_id", "left").select(
        F.coalesce("_trusted", F.lit(0)).alias("trusted"), "w",
        F.explode(F.sequence(F.lit(0), 2 * F.size("w") - 2)).alias("i"),
    )
    word, after = "xxhash64(w[i div 2])", "xxhash64(w[i div 2 + 1])"
    bucket = F.expr(f"if(i % 2 = 0, {word}, xxhash64({word}, {after})) & {buckets - 1}L")
    counts = grams.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted"))
    counted = {int(r.bucket): (r.raw, r.trusted) for r in counts.collect()}  # at most ``buckets`` rows
    n_raw = sum(raw for raw, _ in counted.values())
    n_trusted = sum(trusted for _, trusted in counted.values())
    return QualityModel(tuple(_ratios(counted, buckets, n_trusted / max(n_raw, 1), pseudo)))


def _ratios(counted: dict[int, tuple[int, int]], buckets: int, scale: float, pseudo: float) -> list[float]:
    import math

    got = (counted.get(b, (0, 0)) for b in range(buckets))
    return [math.log((trusted + pseudo) / (raw * scale + pseudo)) for raw, trusted in got]


def score(docs: DataFrame, model: QualityModel, threshold: float = -0.075) -> DataFrame:
    """Add the base counts, ``base_failed``, ``score`` and ``kept`` to every row."""
    require(docs, "doc_id", "text")
    out = base_rules(docs)
    buckets = len(model.log_ratio)
    out = once(out, _pairs= F.expr(f"transform(_h2, (h, i) -> xxhash64(get(_h1, i), h) & {buckets - 1}L)"))
    one = F.aggregate("_h1", F.lit(0.0), lambda acc, h: acc + F.get(model.column(), h.bitwiseAND(buckets - 1).cast("int")))
    two = F.aggregate("_pairs", F.lit(0.0), lambda acc, h: acc + F.get(model.column(), h.cast("int")))
    total = one + two
    mean = F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0)
    out = out.withColumn("score", mean)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("_words", "_h1", "_h2", "_h3", "_pairs")
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    return once(out, **{c: F.col(c) for c in made})


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = -0.075) -> DataFrame:
    """The documents that are kept, with their own columns."""
    model = fit(docs, labels)
    return unpacked(score(packed(docs), model, threshold).where("kept"), docs)


__all__ = ["QualityModel", "base_rules", "filter_quality", "fit", "score", "trusted_ids"]
