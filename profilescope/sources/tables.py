"""Stored tables: an append-only change log per table, and compacted snapshots in buckets of the key beside it.

Layout under a table's folder on the shared file system::

    changes/<name>/               decoded changes of one batch, under a name that is never used again
    snapshots/<name>/_bucket=<n>/ the latest change per key of one bucket, tombstones included
    log/                          numbered commits (see ``commitlog.py``)

A write goes to a fresh folder and becomes visible with its commit, so readers see all of it or nothing. Any number
of writers, streams and compactions work on a table at a time: each writes folders of its own, and they meet only in the
commit log, where each gets a number. A batch is known by its writer and its number; a batch that was committed
before is not written again. Compaction reads and rewrites only the buckets that the changes since the last one name; a
commit tells which buckets they are. Readers see the buckets of the last snapshot and every committed batch after
it. Snapshots keep tombstones, so a late change stays hidden by a delete after compaction. Of changes of one key
the one with the highest sequence counts, then the later commit, then the later place in its batch.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilescope.operators.changelog import DELETE, OP, SEQUENCE, UPSERT, latest_changes, merge_snapshot
from profilescope.operators.joins import BROADCAST_ROWS
from profilescope.schema import TableSpec
from profilescope.session import COMPRESSION
from profilescope.sources.commitlog import CommitLog, State

DEFAULT_WRITER = "batch"
#: Order of changes with one sequence: the batch's commit, and the row's place in the batch.
ORDER, POSITION = "_order", "_position"
BUCKET = "_bucket"
BUCKETS = 32
#: Seconds after which a folder without a commit counts as left by a writer that died.
ABANDONED = 7 * 24 * 3600.0


class StoredTable:
    """One table of a ``TableSpec``: index, delete, reset, compact and read.

    ``buckets`` says how many buckets the key is hashed to; the first commit fixes it for the table.
    """

    def __init__(self, spark: SparkSession, spec: TableSpec, folder: str, buckets: int = BUCKETS):
        self.spark, self.spec, self.folder, self.buckets = spark, spec, folder, buckets
        self.log = CommitLog(spark, folder)

    def _path(self, part: str) -> str:
        return os.path.join(self.folder, part)

    @property
    def _written(self) -> list[T.StructField]:
        return [
            *self.spec.schema.fields,
            T.StructField(SEQUENCE, T.LongType()),
            T.StructField(OP, T.StringType()),
            T.StructField(POSITION, T.LongType()),
        ]

    @property
    def change_schema(self) -> T.StructType:
        return T.StructType([*self._written, T.StructField(ORDER, T.LongType())])

    def state(self) -> State:
        return self.log.state()

    def _bucket(self, of: int) -> Column:
        return F.pmod(F.hash(self.spec.key), F.lit(of))

    def _named(self, folder: str, of: int) -> dict[int, int]:
        """The buckets in which a batch's keys lie, with their changes: one column is read, a row for each bucket comes back."""
        keys = self.spark.read.schema(T.StructType(self._written)).parquet(self._path(folder))
        return {r[0]: r[1] for r in keys.groupBy(self._bucket(of)).count().collect()}

    def write_changes(self, changes: DataFrame, batch: int, writer: str = DEFAULT_WRITER) -> bool:
        """Publish one batch; whether it was new. A batch that its writer committed before is left as it is, so
        replays are harmless."""
        if self.state().holds(writer, batch):
            return False
        folder = f"changes/{uuid.uuid4().hex}"
        if POSITION not in changes.columns:
            changes = changes.withColumn(POSITION, F.monotonically_increasing_id())
        changes.select(*(f.name for f in self._written)).write.parquet(self._path(folder), compression=COMPRESSION)
        named: dict[int, dict[int, int]] = {}

        def entry(state: State) -> dict | None:
            if state.holds(writer, batch):
                return None
            of = state.buckets or self.buckets
            if of not in named:
                named[of] = self._named(folder, of)
            buckets, rows = sorted(named[of]), sum(named[of].values())
            return {"kind": "changes", "folder": folder, "writer": writer, "batch": batch, "of": of, "buckets": buckets, "rows": rows}

        if self.log.commit(entry) is None:
            self.log.files.delete(folder)
            return False
        return True

    def index(self, lines: DataFrame, batch: int, sequence: str = SEQUENCE, writer: str = DEFAULT_WRITER) -> None:
        """Decode raw documents and publish them as upserts, in their order."""
        sequenced = lines if sequence in lines.columns else lines.withColumn(sequence, F.lit(batch).cast("long"))
        placed = sequenced.withColumnRenamed(sequence, SEQUENCE).withColumn(POSITION, F.monotonically_increasing_id())
        self.write_changes(self.spec.decode(placed).withColumn(OP, F.lit(UPSERT)), batch, writer)

    def delete(self, keys: DataFrame, batch: int, sequence: Column | None = None, writer: str = DEFAULT_WRITER) -> None:
        """Publish tombstones for the keys.

        With a ``sequence`` (of the keys' rows), or a column ``_seq`` of theirs, they hide older changes,
        come when they may. Without one they delete what is there: each takes its document's sequence.
        """
        key = self.spec.key
        if sequence is None and SEQUENCE in keys.columns:
            sequence = F.col(SEQUENCE)
        if sequence is not None:
            named = keys.select(key, sequence.cast("long").alias(SEQUENCE))
        else:
            named = self._merged(self.state()).select(key, SEQUENCE).join(keys.select(key).distinct(), key, "left_semi")
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.spec.schema.fields if f.name != key]
        self.write_changes(named.select(key, *missing, SEQUENCE, F.lit(DELETE).alias(OP)), batch, writer)

    def reset(self, batch: int | None = None) -> None:
        """Drop all documents that are committed before it."""
        self.log.commit(lambda state: {"kind": "reset", "batch": batch, "of": state.buckets or self.buckets})

    def compact(self) -> int:
        """Rewrite the buckets that committed changes name, as a new snapshot; returns the highest batch number.

        If another compaction or a reset is committed meanwhile, that one stands and this one's work goes.
        """
        state = self.state()
        if not state.tail:
            return state.last_batch
        named = _named_buckets(state)
        folder = f"snapshots/{uuid.uuid4().hex}"
        rows = self._changed(state, named).withColumn(BUCKET, self._bucket(state.buckets))
        rows.write.partitionBy(BUCKET).parquet(self._path(folder), compression=COMPRESSION)

        def entry(now: State) -> dict | None:
            if now.base != state.base:
                return None
            return {"kind": "snapshot", "folder": folder, "buckets": sorted(named), "through": state.number}

        if self.log.commit(entry) is None:
            self.log.files.delete(folder)
        return state.last_batch

    def _base(self, state: State, buckets: Iterable[int]) -> DataFrame | None:
        """The snapshot's rows of the buckets."""
        paths = [self._path(f"{state.snapshot[b]}/{BUCKET}={b}") for b in sorted(buckets) if b in state.snapshot]
        return self.spark.read.schema(self.change_schema).parquet(*paths) if paths else None

    def _tail(self, state: State) -> DataFrame:
        """The changes after the snapshot, each with the number of its commit."""
        numbers = F.create_map(*(F.lit(x) for c in state.tail for x in (os.path.basename(c["folder"]), c["number"])))
        found = self.spark.read.schema(T.StructType(self._written)).parquet(*(self._path(c["folder"]) for c in state.tail))
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        return found.withColumn(ORDER, F.element_at(numbers, folder).cast("long"))

    def _changed(self, state: State, named: set[int]) -> DataFrame:
        """The latest change of each key in the named buckets, tombstones included."""
        order = F.struct(SEQUENCE, ORDER, POSITION)
        base, tail = self._base(state, named), self._tail(state)
        if base is None:
            return latest_changes(tail, self.spec.key, order)
        few = sum(c["rows"] for c in state.tail) <= BROADCAST_ROWS
        return merge_snapshot(base, tail, self.spec.key, order, keep_deleted=True, few=few)

    def _current(self, state: State, buckets: set[int]) -> DataFrame:
        """The latest change of each key in some buckets, tombstones included. Buckets without changes after the
        snapshot are passed on as they are."""
        named = _named_buckets(state) & buckets
        parts = [self._base(state, (set(state.snapshot) & buckets) - named)]
        if named:
            changed = self._changed(state, named)
            inside = self._bucket(state.buckets).isin(sorted(named))
            parts.append(changed if named == _named_buckets(state) else changed.where(inside))
        found = [p for p in parts if p is not None] or [self.spark.createDataFrame([], self.change_schema)]
        return found[0] if len(found) == 1 else found[0].unionAll(found[1])

    def _merged(self, state: State) -> DataFrame:
        """The current documents, with what their changes carry."""
        return self._current(state, set(range(state.buckets))).where(F.col(OP) == UPSERT)

    def keys_of(self, folders: list[str]) -> DataFrame:
        """The distinct keys that batches name."""
        found = self.spark.read.schema(T.StructType(self._written)).parquet(*map(self._path, folders))
        return found.select(self.spec.key).distinct()

    def read(self) -> DataFrame:
        """The current documents."""
        return self._merged(self.state()).select(*self.spec.schema.fieldNames())

    def search(self, *request: object) -> DataFrame:
        """What a request finds in the current documents, as the table's type says."""
        return self.spec.search(self.read(), *request)

    def vacuum(self, abandoned: float = ABANDONED) -> int:
        """Remove folders that nothing visible needs any more; returns their number.

        Those are batches and buckets that a later snapshot covers, and folders without a commit that were made more than
        ``abandoned`` seconds ago. Reads made before it may still need them. Old commits go too.
        """
        files, before = self.log.files, int((time.time() - abandoned) * 1000)
        state = self.state()
        removed = sum(files.delete(folder) for folder in state.garbage)
        if state.garbage:
            self.log.commit(lambda _: {"kind": "vacuum", "removed": list(state.garbage)}, checkpoint=True)
        state = self.state()
        needed = {c["folder"] for c in state.tail} | set(state.snapshot.values()) | {f.split(f"/{BUCKET}=")[0] for f in state.garbage}
        for part in ("changes", "snapshots"):
            for name, made in files.names(part):
                if made < before and f"{part}/{name}" not in needed:
                    removed += files.delete(f"{part}/{name}")
        self.log.trim(before)
        return removed


def _named_buckets(state: State) -> set[int]:
    return {b for commit in state.tail for b in commit["buckets"]}


def reset_table(spark: SparkSession, spec: TableSpec, path: str) -> None:
    """Overwrite a plain Parquet table with an empty one of the declared schema."""
    spec.empty(spark).write.mode("overwrite").parquet(path)
