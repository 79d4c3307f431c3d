"""Tables that change as a whole: staged partitions, published by one manifest.

Parquet has no transaction over several tables. Here a run first stages its
partitions under its own run id, where no reader looks, and then publishes them
by writing one small manifest file: the list of partition folders that make up
every table. Readers take the newest whole manifest, so they see all of a run
or none of it, and a snapshot they hold stays readable until it is vacuumed.

Folders are ``table/date=.../[more keys=.../]run=ID``. A run that is repeated
overwrites its own staged partitions (dynamic partition overwrite); one that
died leaves folders that no manifest names. Each kind of run leaves a mark in
the manifest, by which a repeated run is known to be done already.

A run names the entries it replaces. Publishing takes them out of the newest
manifest and fails if one is not there any more, so two runs that change the
same partitions cannot both win, while runs that only add do not disturb others.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from airtrace.session import at_once, folders, remove, sortable_times

# Threads that list and delete folders.
VACUUMS = 8
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
MANIFEST = (
    "table string, part string, run string, rows long, first long, last long, mark string, made_by string, columns string"
)


@dataclass(frozen=True, order=True)
class Entry:
    """One folder of a table: its partition, as in ``date=2024-01-01``, and the run that wrote it."""

    table: str
    part: str
    run: str
    # rows, and the first and last time in them in microseconds since 1970
    rows: int = field(default=0, compare=False)
    first: int | None = field(default=None, compare=False)
    last: int | None = field(default=None, compare=False)

    @property
    def folder(self) -> str:
        return f"{self.table}/{self.part}/run={self.run}"

    @property
    def date(self) -> str:
        return self.part.split("/")[0].removeprefix("date=")


@dataclass(frozen=True)
class Version:
    """What one manifest says."""

    number: int
    entries: frozenset[Entry] = frozenset()
    marks: Mapping[str, str] = field(default_factory=dict)
    schemas: Mapping[str, StructType] = field(default_factory=dict)

    def of(self, table: str) -> list[Entry]:
        return sorted(e for e in self.entries if e.table == table)


@dataclass(frozen=True)
class Change:
    """A staged run: what it adds and replaces, and the mark it leaves."""

    kind: str
    run: str
    added: tuple[Entry, ...] = ()
    removed: tuple[Entry, ...] = ()
    schemas: Mapping[str, StructType] = field(default_factory=dict)


def _numbers(spark: SparkSession, store: str) -> list[int]:
    return sorted(int(n.removeprefix("v=")) for n in folders(spark, f"{store}/manifest") if n.startswith("v="))


def latest(spark: SparkSession, store: str) -> Version:
    """The newest whole manifest. Its file appears by one rename, so it is there whole or not at all."""
    for number in reversed(_numbers(spark, store)):
        # one row per partition folder, mark and table
        rows = spark.read.schema(MANIFEST).json(f"{store}/manifest/v={number}").collect()
        if rows:
            return Version(
                number,
                frozenset(Entry(r.table, r.part, r.run, r.rows, r.first, r.last) for r in rows if r.part is not None),
                {r.mark: r.made_by for r in rows if r.mark is not None},
                {r.table: StructType.fromJson(json.loads(r.columns)) for r in rows if r.columns is not None},
            )
    return Version(0)


def _part(row, by: Sequence[str]) -> str:
    return "/".join(f"{c}={NULL_PARTITION if row[c] is None else row[c]}" for c in by)


def stage(
    df: DataFrame, store: str, table: str, run: str, time: str, by: Sequence[str] = (), ordered: bool = False,
    grain: str = "day",
) -> tuple[list[Entry], int]:
    """Write rows as partitions of a run, by the date of ``time`` and further columns; give the folders and the rows.

    The partitions and their rows are counted while they are written. Rows are
    brought together by partition and rebalanced by size, or, ``ordered``, dealt
    out by ranges of time and sorted, so that row groups can be skipped. A small
    table takes one partition per ``grain`` (month, year), named by its first day.
    """
    keys = ["date", *by]
    out = df.withColumns({"date": F.to_date(F.date_trunc(grain, time)), "run": F.lit(run)})
    seen = Observation()
    # a date and a few kinds: as many values as folders are written
    names = out.observe(seen, F.collect_set(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])).alias("parts"),
                        F.count(F.lit(1)).alias("rows"))
    if ordered:
        names = names.repartitionByRange(*keys, time).sortWithinPartitions(*keys, "run", time)
    else:
        names = names.hint("rebalance", *keys)
    with sortable_times(df.sparkSession):
        writer = names.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*keys, "run").parquet(f"{store}/{table}")
    try:
        counted = seen.get
    except Py4JJavaError:
        # a frame that the optimizer knows to be empty is not observed
        if df.isEmpty():
            return [], 0
        raise
    entries = sorted(Entry(table, _part(p, keys), run) for p in counted["parts"])
    return _measured(df.sparkSession, store, entries, keys, df.schema[time], time), int(counted["rows"])


def _measured(spark: SparkSession, store: str, entries: list[Entry], keys: list[str], kind, time: str) -> list[Entry]:
    """The entries with their rows and times, from a second look at one column of what was just written."""
    if not entries:
        return []
    schema = StructType([kind, *[StructField(k, DateType() if k == "date" else StringType()) for k in keys]])
    rows = spark.read.schema(schema).option("basePath", f"{store}/{entries[0].table}").parquet(*[f"{store}/{e.folder}" for e in entries])
    us = F.unix_micros(F.col(time).cast("timestamp"))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("a"), F.max(us).alias("b")).collect()
    by = {_part(r, keys): r for r in found}
    return [replace(e, rows=by[e.part].n, first=by[e.part].a, last=by[e.part].b) for e in entries]


def publish(spark: SparkSession, store: str, change: Change) -> Version:
    """Write the next manifest. A change whose mark is there already is not applied again."""
    now = latest(spark, store)
    if now.marks.get(change.kind) == change.run:
        return now
    gone = set(change.removed) - now.entries
    if gone:
        raise RuntimeError(f"partitions were changed meanwhile, run again: {sorted(e.folder for e in gone)[:5]}")
    columns = dict(now.schemas)
    for table, schema in change.schemas.items():
        columns[table] = _widened(columns.get(table), schema)
    number = max(_numbers(spark, store), default=0) + 1
    after = Version(
        number, (now.entries - set(change.removed)) | set(change.added), {**now.marks, change.kind: change.run}, columns)
    blank = dict.fromkeys(("part", "run", "rows", "first", "last", "mark", "made_by", "columns"))
    rows = [{**blank, "table": e.table, "part": e.part, "run": e.run, "rows": e.rows, "first": e.first, "last": e.last} for e in sorted(after.entries)]
    rows += [{**blank, "table": "", "mark": k, "made_by": v} for k, v in sorted(after.marks.items())]
    rows += [{**blank, "table": t, "columns": s.json()} for t, s in sorted(columns.items())]
    order = [f.strip().split()[0] for f in MANIFEST.split(",")]
    made = spark.createDataFrame([tuple(r[c] for c in order) for r in rows], MANIFEST)
    made.coalesce(1).write.mode("error").json(f"{store}/manifest/v={number}")
    return after


def _widened(old: StructType | None, new: StructType) -> StructType:
    """The old columns and then those that are new; a column keeps its type."""
    if old is None:
        return new
    kinds = {f.name: f.dataType for f in old}
    for f in new:
        if f.name in kinds and kinds[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return StructType([*old.fields, *[f for f in new if f.name not in kinds]])


def read(
    spark: SparkSession, store: str, table: str, version: Version | None = None, entries: Iterable[Entry] | None = None,
    since: str | None = None, until: str | None = None, partitions: bool = False,
) -> DataFrame:
    """The rows of a table in one version, or of some of its entries.

    ``since`` and ``until`` are dates of partitions; folders outside are not listed at all.
    Columns that a partition lacks are null. ``partitions`` keeps the partition columns.
    """
    version = version or latest(spark, store)
    schema = version.schemas[table]
    chosen = [
        e for e in (version.of(table) if entries is None else sorted(entries))
        if (since is None or e.date >= since) and (until is None or e.date <= until)]
    if not chosen:
        return spark.createDataFrame([], schema)
    names = [k.split("=")[0] for k in chosen[0].part.split("/")]
    extra = [n for n in names if n not in schema.names]
    wide = StructType(list(schema.fields))
    for n in extra:
        wide = wide.add(n, "date" if n == "date" else "string")
    rows = spark.read.schema(wide).option("basePath", f"{store}/{table}").parquet(*[f"{store}/{e.folder}" for e in chosen])
    return rows if partitions else rows.select(*schema.names)


def upsert_newest(df: DataFrame, store: str, table: str, key: str, time: str, run: str) -> Version:
    """Keep the newest row per key in a table, by time and then id; rows that come late change nothing.

    A row lies in the partition of its date. Only partitions that hold a key of
    the new rows, and those the new rows go to, are written again, so keys that
    have not been seen for long cost nothing.
    """
    spark = df.sparkSession
    now = latest(spark, store)
    if now.marks.get(f"newest-{table}") == run:
        return now

    def newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        found = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, "id")).alias("_n"))
        return found.select(*[F.col(key) if c == key else F.col(f"_n.{c}") for c in rows.columns])

    fresh = newest(df.where(F.col(key).isNotNull() & F.col(time).isNotNull()))
    old: list[Entry] = []
    if now.of(table):
        held = read(spark, store, table, now).join(fresh.select(key), key, "left_semi")
        dates = held.select(F.to_date(time).alias("d")).unionByName(fresh.select(F.to_date(time).alias("d"))).distinct()
        touched = {str(r.d) for r in dates.collect()}  # a row per date
        old = [e for e in now.of(table) if e.date in touched]
        if old:
            fresh = newest(read(spark, store, table, now, old).unionByName(fresh))
    entries, _ = stage(fresh, store, table, run, time)
    return publish(spark, store, Change(f"newest-{table}", run, tuple(entries), tuple(old), {table: df.schema}))


def statistics(spark: SparkSession, store: str) -> DataFrame:
    """Rows and first and last time per partition folder, from the manifest alone."""
    rows = [(e.table, e.part, e.run, e.rows, e.first, e.last) for e in sorted(latest(spark, store).entries)]
    found = spark.createDataFrame(rows, "table string, part string, run string, rows long, first long, last long")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})


def load(df: DataFrame, store: str, table: str, time: str, run: str = "load", by: Sequence[str] = (), grain: str = "day") -> Version:
    """Put rows into a table as a run of their own."""
    entries, _ = stage(df, store, table, run, time, by, grain=grain)
    return publish(df.sparkSession, store, Change(f"load-{table}", run, tuple(entries), (), {table: df.schema}))


def compact(spark: SparkSession, store: str, table: str, time: str, by: Sequence[str] = (), least: int = 2, grain: str = "day") -> Version:
    """Merge partitions that several runs have added to, in one published step.

    Readers of the version before go on with the old folders; those of the new
    one see the merged ones only. The run is named after the version it starts
    from, so one that is repeated overwrites its own files.
    """
    now = latest(spark, store)
    change = staged_compaction(spark, store, table, time, now, by, least, grain)
    return now if change is None else publish(spark, store, change)


def staged_compaction(
    spark: SparkSession, store: str, table: str, time: str, now: Version, by: Sequence[str] = (), least: int = 2,
    grain: str = "day",
) -> Change | None:
    """Merge partitions of a version as ``compact`` does, without publishing; nothing where there is nothing to merge."""
    held: dict[str, list[Entry]] = {}
    for e in now.of(table):
        held.setdefault(e.part, []).append(e)
    old = [e for part in held.values() if len(part) >= least for e in part]
    if not old:
        return None
    run = f"compact-{now.number}"
    entries, _ = stage(read(spark, store, table, now, old), store, table, run, time, by, ordered=True, grain=grain)
    return Change(f"compact-{table}", run, tuple(entries), tuple(old))


def vacuum(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Delete folders that the ``keep`` newest manifests do not name, and older manifests.

    For a time when no run is staging and no reader holds an older version.
    """
    numbers = _numbers(spark, store)
    kept, recent = set(), numbers[-keep:]
    for number in recent:
        rows = spark.read.schema(MANIFEST).json(f"{store}/manifest/v={number}").where("part is not null")
        kept |= {(r.table, f"{r.part}/run={r.run}") for r in rows.collect()}
    # a folder per date, kind and run: listed and deleted many at a time
    held = [(table, name) for table in folders(spark, store) if table != "manifest" for name in folders(spark, f"{store}/{table}")]

    def clean(part: list[tuple[str, str]]) -> int:
        gone = [(t, path) for t, name in part for path in _run_folders(spark, f"{store}/{t}", name) if (t, path) not in kept]
        for table, path in gone:
            remove(spark, f"{store}/{table}/{path}")
        return len(gone)

    gone = sum(at_once(spark, [lambda part=held[i::VACUUMS]: clean(part) for i in range(VACUUMS)]))
    for number in numbers[:-keep]:
        remove(spark, f"{store}/manifest/v={number}")
    return gone


def _run_folders(spark: SparkSession, base: str, name: str) -> list[str]:
    """Folders of runs at or below a folder of a table."""
    last = name.rsplit("/", 1)[-1]
    if last.startswith("run="):
        return [name]
    if last.startswith(("_", ".")):
        return []
    return [path for below in folders(spark, f"{base}/{name}") for path in _run_folders(spark, base, f"{name}/{below}")]
