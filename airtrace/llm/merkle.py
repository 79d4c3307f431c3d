"""Merkle manifest of a data set by slot pivots.

Every row is a leaf. The leaves of one source, in order of their ids, are
hashed in runs of three, level by level, to the source's subroot; the subroots,
in order of the sources, are hashed in the same way to the root. Three levels
are one aggregation: the 27 nodes below a node are spread by conditional
aggregates into one column per slot. Slots joined and hashed in runs of three
are their parents, and those again; all of a run but a node's own are its
siblings. Ways from the leaves to the root are then handed down the same rows,
three levels at once, so the plan has few joins and the driver little to plan.

Rows are keyed by (tree, group), so a source that holds a third of the rows is
spread like any other, and each step has a 27th of the rows of the one below.
Positions come from one sort over ranges. What reaches the driver is the number
of rows of the largest source and the root.

Nulls, empty and odd input: a null field counts as ``-`` and any other as its
UTF-8 byte count, ``:`` and its value, so nothing clashes with it. A null source
is a source of its own, the first. Null ids come first within their source;
rows of one id are ordered by their leaves, and equal rows are leaves of their
own. An empty table has no rows and no root. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from airtrace.llm.common import indexed, require
from airtrace.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Rows that look up their tree together, so that a large tree is many keys.
PIECE = 65_536
#: Levels that one aggregation makes, so that a large tree is few plans and few joins.
STEP = 3
SLOTS = [f"c{i}" for i in range(FANOUT**STEP)]
PATH = "array<struct<left: string, right: string>>"


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of the inputs joined; nulls are left out."""
    return F.sha2(F.concat_ws("", *inputs), 256)


def record(fields: Mapping[str, Column]) -> Column:
    """The leaf of a row: each field with its length in bytes."""

    def written(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*[written(c) for c in fields.values()])


def _parents(nodes: Column) -> Column:
    """Digests of the parents of consecutive nodes."""
    first = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(first, lambda at: digest(F.slice(nodes, at, FANOUT)))


def _levels(nodes: DataFrame, most: int, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Groups of ``nodes`` (tree, n, place, digest), groups of those, and so on, and each tree's root.

    A group has a row: tree, n (nodes in the tree), place, ``kids`` (its nodes
    in order), ``l1`` and so on (the digests of the levels above them, null
    where the tree has ended) and digest, the uppermost. ``carried`` columns of
    the nodes are in the kids of the first groups only.
    """
    groups: list[DataFrame] = []
    roots = None
    while not groups or most > 1:
        kid = F.struct("digest", *(carried if not groups else ()))
        slot = F.pmod("place", F.lit(len(SLOTS)))
        spread = [F.max(F.when(slot == i, kid)).alias(c) for i, c in enumerate(SLOTS)]
        found = nodes.groupBy("tree", "n", F.floor(F.col("place") / len(SLOTS)).alias("place")).agg(*spread)
        found = found.select("tree", "n", "place", F.array_compact(F.array(*SLOTS)).alias("kids"))
        below = F.col("kids.digest")
        for k in range(STEP):
            found = found.withColumn(f"l{k + 1}", F.when(F.col("n") > FANOUT**k, _parents(below)))
            below = F.col(f"l{k + 1}")
        top = F.coalesce(*[F.col(f"l{k}") for k in range(STEP, 0, -1)], F.col("kids.digest"))
        found = materialise(found.withColumn("digest", top[0]), "merkle")
        groups.append(found)
        nodes = found.select("tree", F.ceil(F.col("n") / len(SLOTS)).alias("n"), "place", "digest")
        ended = nodes.where("n = 1").select("tree", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = nodes.where("n > 1")
        most = -(-most // len(SLOTS))
    return groups, roots


def _siblings(level: Column, own: Column) -> Column:
    """The nodes of a level that share a parent with one of them, to its left and to its right."""
    nth = F.pmod(own, F.lit(FANOUT)).cast("int")
    return F.struct(
        F.array_join(F.slice(level, own - nth + 1, nth), "").alias("left"),
        F.array_join(F.slice(level, own + 2, F.lit(FANOUT - 1) - nth), "").alias("right"))


def _ways(groups: list[DataFrame], carried: tuple[str, ...] = ()) -> DataFrame:
    """Every node with its path to the root of its tree: tree, place, path, digest and the carried columns."""
    paths = None
    for k in range(len(groups) - 1, -1, -1):
        # a group that is the whole of its tree has no way above it
        above = F.array().cast(PATH)
        met = groups[k].withColumn("path", above)
        if paths is not None:
            met = groups[k].join(paths.select("tree", "place", "path"), ["tree", "place"], "left")
            met = met.withColumn("path", F.coalesce("path", above))
        met = met.select("*", F.col("kids.digest").alias("l0"), F.posexplode("kids").alias("slot", "kid"))
        own = [F.floor(F.col("slot") / FANOUT**j).cast("int") for j in range(STEP)]
        within = F.array_compact(F.array(*[
            F.when(F.col("n") > FANOUT**j, _siblings(F.col(f"l{j}"), own[j])) for j in range(STEP)]))
        paths = met.select(
            "tree", (F.col("place") * len(SLOTS) + F.col("slot")).alias("place"), F.concat(within, "path").alias("path"),
            *[F.col(f"kid.{c}") for c in ("digest", *(carried if k == 0 else ()))])
    return paths


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree, n and place, and one row (tree, n) per source; trees are numbered in order of the sources."""
    rows = indexed(leaves, "source", "doc_id", "digest", name="place")
    rows = rows.withColumn("_piece", F.floor(F.col("place") / PIECE))
    pieces = rows.groupBy("source", "_piece").agg(F.min("place").alias("_first"), F.count("*").alias("_rows"))
    sources = pieces.groupBy("source").agg(F.min("_first").alias("_first"), F.sum("_rows").alias("n"))
    sources = materialise(indexed(sources, "source", name="tree"), "sources")
    # a large source is looked up by its pieces, not by its rows
    of_piece = pieces.select("source", "_piece").alias("p").join(
        sources.alias("s"), F.expr("p.source <=> s.source")).select("p.source", "p._piece", "s.tree", "s.n", "s._first")
    same = F.expr("r.source <=> q.source and r._piece = q._piece")
    placed = rows.alias("r").join(of_piece.alias("q"), same).select(
        "q.tree", "q.n", (F.col("r.place") - F.col("q._first")).alias("place"),
        *[F.col(f"r.`{c}`") for c in leaves.columns])
    return placed, sources.select("tree", "n")


def manifest(docs: DataFrame, received: Mapping[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, path (left and right siblings per level), subroot, root and received_leaf.

    ``received`` replaces fields of the row as they came back from elsewhere;
    ``received_leaf`` is the leaf of that row, to be folded along the path.
    """
    require(docs, *FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    leaf, other = record(fields), record(fields | dict(received or {}))
    leaves = materialise(docs.select("doc_id", "source", leaf.alias("digest"), other.alias("received")), "leaves")
    leaves = leaves.withColumn("received", F.when(F.col("received") != F.col("digest"), F.col("received")))
    placed, trees = _placed(leaves)
    placed = materialise(placed, "placed")
    carried = ("doc_id", "source", "received")
    most = int(trees.agg(F.max("n").alias("n")).first().n or 0)
    levels, subroots = _levels(placed.select("tree", "n", "place", "digest", *carried), most, carried)

    subroots = materialise(subroots, "subroots")
    count = subroots.count()
    upper = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("place"), "digest")
    top, roots = _levels(upper, count)
    root = next((r.digest for r in roots.collect()), None)  # one row
    tops = _ways(top).select(F.col("place").alias("tree"), F.col("path").alias("to_root"), F.col("digest").alias("subroot"))
    tops = materialise(tops, "tops")
    found = _ways(levels, carried).join(tops, "tree").withColumn("path", F.concat("path", "to_root"))
    return found.select(
        "doc_id", "source", F.col("digest").alias("leaf"), "path", "subroot", F.lit(root).cast("string").alias("root"),
        F.coalesce("received", "digest").alias("received_leaf"))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"]))), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda up, p: F.sha2(F.concat(p["left"], up, p["right"]), 256))


def verify_received(docs: DataFrame) -> DataFrame:
    """The manifest, and a check of rows of which every other one has lost its line breaks on the way.

    The CRC-32 of the decimal id decides which; a null id's row is left alone.
    """
    changed = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    sent = F.when(changed, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(docs, {"text": sent})
    checked = found.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        fold(F.col("received_leaf"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
