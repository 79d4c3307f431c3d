"""Near-duplicates by SimHash and covering LSH, decided by exact Jaccard similarity of five-word shingles.

Two texts are near-duplicates if their sets of five-word shingles share at
least 4/5 of their union. Fingerprints of the sets go through the covering
tables of ``simhash``; every pair that these propose is confirmed on the whole
sets before it becomes an edge.

Similar sets whose fingerprints are further apart than the radius are found by a
prefix-filter join: in one fixed order of all shingles, two sets that are that
similar share a shingle among the first n - ceil(4n/5) + 1 of each. Rare
shingles come first in that order, so that a common line opens no large bucket;
the order is read off an eighth of the texts and decides about the work only,
never about a pair.

Places (shingle, set, size, position) go through one shuffle; sorted by shingle
and position they stream past, and those of a shingle that only one set has are
dropped. Equal sets are one throughout.

First every set meets at most two of the first sets of its buckets: the one that
has the fewest rarer shingles, which in a group of edited copies is next to what
they were copied from, and the one it shares most with. Then only sets of one
bucket that are not yet connected meet, and only where sizes and positions leave
room for the similarity: if the shingle is the first that both have, they share
no more than what follows it. For that the shorter set of a pair is keyed by its
length class, and the longer one by the classes that its position allows.

A large bucket is not paired. Its sets are compared with one of them, the pivot,
and from then on only what tells a set from the pivot counts. With D(x) the
shingles that only one of x and the pivot has, x and y differ in
|D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, so they are both similar to the pivot
or share a shingle of D; and for that the same prefix-filter join holds. Edits
that only one copy has come first in it, so copies that were edited apart do not
meet, however many there are.

Pairs are told apart by parity bitmaps before their sets are read: sets that
differ in d shingles have bitmaps that differ in d bits at most.

Nulls, empty and odd input: a text with fewer than five words is one shingle, a
null or blank text one empty shingle, so these are alike only if equal. Case is
A-Z only and blanks are the six ASCII ones, as for fingerprints. Shingles are
compared by 64-bit hashes. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from airtrace.llm import simhash
from airtrace.llm.arrow import chunks
from airtrace.llm.common import packed, require
from airtrace.llm.components import components
from airtrace.llm.simhash import SEED, least_of_each
from airtrace.session import broadcast_if_few, materialise, owned_files

SHINGLE = 5
#: The similarity as a fraction, so that the test is exact.
SHARE, OF = 4, 5
#: One text of so many is read for the order of the shingles.
ORDER_PART = 8
#: Shingles seen in so many of those texts come last in the order, at most so many of them.
COMMON, MOST_COMMON = 8, 1 << 18
#: Buckets of more sets are told apart by their differences from one of them.
PAIRED = 256
#: Sets of so many pivots at most are broadcast.
FEW_PIVOTS = 1000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    words = (text or "").encode().lower().split()
    parts = set(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) or {b" ".join(words)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=len(parts)))


def signature(shingles: np.ndarray) -> int:
    """A hash of a whole set as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _mapped(df: DataFrame, schema: str, row) -> DataFrame:
    """Rows (kept column, text) to ``row(kept, text)`` by Arrow batches, texts bounded."""
    spark_schema = StructType.fromDDL(schema)
    target = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                kept = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
                rows = [row(*r) for r in zip(*kept, batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(target)], schema=target)

    return df.mapInArrow(run, spark_schema)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in ascending order and in how many of the read texts each is."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(ORDER_PART)) == 0).select("text").distinct()
    seen = _mapped(part, "s array<long>", lambda text: (shingle_set(text).view(np.int64),))
    counts = seen.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "s").limit(MOST_COMMON).toArrow()
    tokens, n = found.column("s").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefix(shingles: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last, that any similar set shares one of."""
    n = len(shingles)
    seen = np.zeros(n, dtype=np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        seen = np.where(tokens[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, seen))[: n + (-n * SHARE // OF) + 1]]


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the rows that stand for the wanted sets (sig, doc_id, text_hash); a repeated row gives its text twice."""
    keys = broadcast_if_few(wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = rows.join(keys, rows["doc_id"].eqNullSafe(keys["_id"]) & (rows["text_hash"] == keys["_hash"]), "left_semi")
    return found.select("text_hash", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures whose whole sets are similar enough."""
    light = points.select("sig", "n", "bits")
    both = pairs.distinct().join(light.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    both = both.join(light.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    likely = both.where(may_be_similar(F.col("ba"), F.col("bb"), F.col("na"), F.col("nb")))
    pairs = materialise(likely.select("a", "b"), "pairs")
    sets = sets_of(docs, points, pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct())
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * OF >= (F.size("sa") + F.size("sb") - shared) * SHARE).select("a", "b")


def sets_of(docs: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sig`` and ``s``, the shingles, of some sets; one exchange by signature serves several joins."""
    texts = _texts_of(docs, points.join(nodes, "sig", "left_semi"))

    def row(_, text):
        shingles = shingle_set(text)
        return signature(shingles), shingles.view(np.int64)

    return _mapped(texts, "sig long, s array<long>", row).dropDuplicates(["sig"])


def fingerprint_pairs(points: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that the covering tables propose: they connect all sets whose fingerprints are within the radius."""
    first = materialise(points.groupBy("fp").agg(F.min("sig").alias("first")), "fingerprints")
    same = points.join(first, "fp").where("sig <> first").select(F.col("first").alias("a"), F.col("sig").alias("b"))

    def of(side: str) -> DataFrame:
        return first.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}"))

    apart = simhash.links(first.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(apart.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


MET = "token long, sig long, place long, hub long, hub_place long"
WIDE = "doc_id {kind}, text_hash long, sig long, n long, fp long, prefix array<long>, bits array<long>"
#: Longs of the smallest and the largest parity bitmap.
LEAST_BITS, MOST_BITS = 2, 1024


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of about a bit per shingle; a bit is set where an odd number of shingles fall."""
    longs = min(max(LEAST_BITS, 1 << (max(len(shingles) - 1, 1) // 64).bit_length()), MOST_BITS)
    odd = np.bincount((shingles % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def may_be_similar(bits_a: Column, bits_b: Column, n_a: Column, n_b: Column) -> Column:
    """False only for sets that differ in too many shingles; the larger bitmap is folded to the size of the other."""
    size = F.least(F.size(bits_a), F.size(bits_b))

    def folded(bits: Column) -> Column:
        turns = F.sequence(F.lit(0), (F.size(bits) / size).cast("int") - 1)
        return F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.aggregate(turns, F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(F.element_at(bits, t * size + i))))

    differ = F.aggregate(
        F.zip_with(folded(bits_a), folded(bits_b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return differ * (SHARE + OF) <= (n_a + n_b) * (OF - SHARE)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (token, place): those of tokens that several sets have, with the first set of the token.

    Of a token's rows only the first is held back, until a second set comes.
    """
    held = None  # the first row of the token under way, and whether it has been given out
    for b in batches:
        token, sig, place = (b.column(c).to_numpy() for c in ("token", "sig", "place"))
        if not len(token):
            continue
        start = np.r_[True, token[1:] != token[:-1]]
        goes_on = held is not None and token[0] == held[0]
        start[0] = not goes_on
        at = np.maximum.accumulate(np.where(start, np.arange(len(token)), -1))
        hub, hub_place = sig[np.maximum(at, 0)].copy(), place[np.maximum(at, 0)].copy()
        if goes_on:
            hub[at < 0], hub_place[at < 0] = held[1], held[2]
        other = sig != hub
        # a set that comes after the hub, once
        other &= np.r_[not (goes_on and held[4] == sig[0]), (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])]
        several = np.bincount(np.cumsum(start), weights=other, minlength=int(start.sum()) + 1)
        give = other | (start & (several[np.cumsum(start)] > 0))
        out = [token[give], sig[give], place[give], hub[give], hub_place[give]]
        if goes_on and not held[3] and several[0]:
            out = [np.r_[x, y] for x, y in zip(([v] for v in (held[0], held[1], held[2], held[1], held[2])), out)]
        if len(out[0]):
            names = ["token", "sig", "place", "hub", "hub_place"]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in out], names=names)
        last = int(start.sum())
        given = bool(several[last]) or (last == 0 and held[3])
        first = (hub[-1], hub_place[-1])
        held = (token[-1], *first, given, sig[-1])


def _n(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit((1 << 32) - 1))


def _left(place: str) -> Column:
    """How many shingles of a set there are from a place on."""
    return _n(place) - F.shiftright(place, 32)


def _class(n: Column) -> Column:
    """Length classes a twentieth apart."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05))).cast("int")


def roots(edges: DataFrame) -> DataFrame:
    """``sig`` and ``label`` of every ``b``, by going on from its least ``a`` to that one's, and so on.

    An ``a`` is less than its ``b``, so the steps end; each round doubles them.
    """
    state = materialise(edges.groupBy("b").agg(F.min("a").alias("label")).withColumnRenamed("b", "sig"), "roots")
    while True:
        above = state.select(F.col("sig").alias("label"), F.col("label").alias("next"))
        if state.join(above, "label", "left_semi").isEmpty():
            return state
        state = materialise(state.join(above, "label", "left").select("sig", F.coalesce("next", "label").alias("label")), "roots")


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after ``edges`` have joined their groups; a node without a label is one of its own.

    Only edges between different groups go into the rounds of components, each once.
    """

    def of(side: str) -> DataFrame:
        return labels.select(F.col("sig").alias(side), F.col("label").alias(f"_{side}"))

    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    groups = components(materialise(between, "between"))
    moved = groups.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(moved, "label", "left").select("sig", F.coalesce("to", "label").alias("label"))
    new = groups.withColumnRenamed("node", "sig").join(labels.select("sig"), "sig", "left_anti").select("sig", "label")
    return materialise(known.unionByName(new), "labels")


def groups_of(docs: DataFrame, points: DataFrame, met: DataFrame) -> DataFrame:
    """``sig`` and ``label`` of the sets of ``points`` (sig, doc_id, text_hash, n, fp, bits) that are similar to another."""

    def room(x: str, y: str) -> Column:
        """Whether two sets can still be similar if this is the first shingle that both have."""
        return (F.least(_n(x), _n(y)) * OF >= F.greatest(_n(x), _n(y)) * SHARE) & (
            F.least(_left(x), _left(y)) * (SHARE + OF) >= (_n(x) + _n(y)) * SHARE)

    shared = met.where((F.col("sig") != F.col("hub")) & room("place", "hub_place")).groupBy("sig", "hub").agg(
        F.count("*").alias("count"), F.min("hub_place").alias("front"))
    hubs = shared.groupBy("sig").agg(
        F.min_by("hub", F.struct("front", "hub")).alias("central"), F.max_by("hub", F.struct("count", "hub")).alias("most"))
    stars = hubs.select("sig", F.explode(F.array("central", "most")).alias("hub")).select(
        F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))
    near = materialise(confirmed(fingerprint_pairs(points).unionByName(stars), docs, points), "similar")

    labels = joined(roots(near), near)
    labelled = met.join(labels, "sig", "left").select("token", "sig", "place", "hub", F.coalesce("label", "sig").alias("label"))
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("sets"), F.first("hub").alias("hub"))
    mixed = materialise(mixed.where("low <> high").select("token", "sets", "hub"), "mixed")
    open_rows = labelled.join(mixed.where(F.col("sets") <= PAIRED).select("token"), "token", "left_semi")
    # the longer set looks for shorter ones, down to 4/5 and up to what its place leaves room for
    n, left = _n("place"), _left("place")
    most = F.least(n, F.floor(left * (SHARE + OF) / SHARE) - n)
    least = F.ceil(n * SHARE / OF)
    x = open_rows.where(most >= least).select(
        "token", F.explode(F.sequence(_class(least), _class(most))).alias("class"), *[F.col(c).alias(f"{c}_x") for c in ("sig", "place", "label")])
    y = open_rows.where(left * (SHARE + OF) >= n * 2 * SHARE).select(
        "token", _class(n).alias("class"), *[F.col(c).alias(f"{c}_y") for c in ("sig", "place", "label")])
    longer = (_n("place_x") > _n("place_y")) | ((_n("place_x") == _n("place_y")) & (F.col("sig_x") < F.col("sig_y")))
    pairs = x.join(y, ["token", "class"]).where(
        longer & (F.col("label_x") != F.col("label_y")) & room("place_x", "place_y"))
    pairs = pairs.select(F.least("sig_x", "sig_y").alias("a"), F.greatest("sig_x", "sig_y").alias("b"))
    large = mixed.where(F.col("sets") > PAIRED)
    if not large.isEmpty():
        told = differences(docs, points, labelled, large, labels)
        by_pivot = told.where("near and sig <> pivot").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))
        labels = joined(labels, by_pivot)
        pairs = pairs.unionByName(differing_pairs(told, labels))
    return joined(labels, confirmed(pairs, docs, points))


def differences(docs: DataFrame, points: DataFrame, labelled: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets of large buckets (token, hub) by what tells them from a pivot, one for the buckets whose hubs are connected.

    Gives pivot, sig, n, differ (the differing shingles) and near (similar to the pivot).
    """
    known = labels.select(F.col("sig").alias("hub"), F.col("label").alias("group"))
    grouped = large.join(known, "hub", "left").select("token", "hub", F.coalesce("group", "hub").alias("group"))
    pivots = grouped.groupBy("group", "hub").count().groupBy("group").agg(F.max_by("hub", F.struct("count", "hub")).alias("pivot"))
    pivots = materialise(grouped.join(pivots, "group").select("token", "pivot"), "pivots")
    members = materialise(labelled.select("token", "sig").join(pivots, "token").select("pivot", "sig").distinct(), "members")
    # every pivot is a set of its own buckets
    sets = materialise(sets_of(docs, points, members.select("sig").distinct()), "sets")
    alone = pivots.select("pivot").distinct()
    few = alone.limit(FEW_PIVOTS + 1).count() <= FEW_PIVOTS
    of_pivot = sets.join(alone, F.col("sig") == F.col("pivot")).select("pivot", F.col("s").alias("p"))
    both = members.join(sets, "sig").join(F.broadcast(of_pivot) if few else of_pivot, "pivot")
    told = both.select(
        "pivot", "sig", F.size("s").cast("long").alias("n"), F.size("p").alias("of"),
        F.concat(F.array_except("s", "p"), F.array_except("p", "s")).alias("differ"))
    near = F.size("differ") * (SHARE + OF) <= (F.col("n") + F.col("of")) * (OF - SHARE)
    return materialise(told.select("pivot", "sig", "n", "differ", near.alias("near")), "differences")


def differing_pairs(told: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of one pivot, not connected yet, that may share enough of their differences from it.

    The rarest differences of a pivot's sets come first; those that one set has meet none and are only counted.
    """
    rows = told.select("pivot", "sig", "n", F.size("differ").cast("long").alias("d"), F.explode("differ").alias("token"))
    several = rows.groupBy("pivot", "token").agg(F.count("*").alias("sets")).where("sets > 1")
    own = Window.partitionBy("pivot", "sig")
    rows = rows.join(several, ["pivot", "token"])
    rows = rows.withColumn("at", F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "token")) - 1)
    # a similar set is at most n * OF / SHARE long, so all but n / 4 differences of a set are shared, or the other has fewer
    rows = rows.where(F.col("at") <= F.floor(F.col("n") * (OF - SHARE) / SHARE))
    places = rows.join(labels, "sig", "left").select("pivot", "token", "sig", "n", "d", "at", F.coalesce("label", "sig").alias("label"))
    places = materialise(places, "places")
    mixed = places.groupBy("pivot", "token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    places = places.join(mixed.select("pivot", "token"), ["pivot", "token"], "left_semi")

    def side(name: str) -> DataFrame:
        return places.select("pivot", "token", *[F.col(c).alias(f"{c}_{name}") for c in ("sig", "n", "d", "at", "label")])

    both = F.col("n_x") + F.col("n_y")
    shared = F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y"))
    room = (F.least("n_x", "n_y") * OF >= F.greatest("n_x", "n_y") * SHARE) & (
        (F.col("d_x") + F.col("d_y") - 2 * shared) * (SHARE + OF) <= both * (OF - SHARE))
    pairs = side("x").join(side("y"), ["pivot", "token"]).where((F.col("sig_x") < F.col("sig_y")) & (F.col("label_x") != F.col("label_y")) & room)
    return pairs.select(F.col("sig_x").alias("a"), F.col("sig_y").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, sig and label, the least signature of its component."""
    require(docs, "doc_id", "text")
    tokens, counts = common_shingles(docs)

    def row(doc_id, text_hash, text):
        shingles = shingle_set(text)
        first = prefix(shingles, tokens, counts)
        fp = simhash.signed(simhash.majority(shingles))
        return doc_id, text_hash, signature(shingles), len(shingles), fp, first.view(np.int64), parities(shingles)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    with owned_files(docs.sparkSession) as keep:
        schema = WIDE.format(kind=docs.schema["doc_id"].dataType.simpleString())
        with owned_files(docs.sparkSession) as hold:
            wide = materialise(_mapped(rows, schema, row), "shingles")
            light = keep(wide.select("doc_id", "text_hash", "sig"), "signatures")
            # of equal sets the row with the least id stands for all
            first = F.min(F.struct("doc_id", "text_hash")).alias("row")
            points = wide.groupBy("sig").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"))
            points = hold(points.select("sig", "row.doc_id", "row.text_hash", "n", "fp", "bits"), "points")
            places = wide.dropDuplicates(["sig"]).select("sig", "n", F.posexplode("prefix").alias("at", "token")).select(
                "token", "sig", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")).alias("place"))
            met = hold(places.repartition("token").sortWithinPartitions("token", "place", "sig").mapInArrow(_met, MET), "met")
        labels = keep(groups_of(docs, points, met), "labels")
    found = light.join(labels, "sig", "left")
    return found.withColumn("label", F.coalesce("label", "sig"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component of similar texts, that with the least id, with its own columns."""
    return least_of_each(docs, near_duplicates(packed(docs)))
