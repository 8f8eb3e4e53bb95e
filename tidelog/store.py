"""A versioned, ordered key-value table in a directory: Parquet data below ``data/``, a commit log below ``_commits/``.

Every write is one commit of immutable files. Data files keep each record's place in its batch; its sequence is that plus the file's base, which a
write learns when it wins a commit, so a retry renames a directory and rewrites nothing. ``base=<n>`` is part of a file's
path and so a partition column: a read as of S prunes whole commits above S, and the files' key ranges prune the rest on the driver.
Compacted files hold absolute sequences (base 0).
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.batch import WriteBatch, validate
from tidelog.functions.scalar import prefix_end
from tidelog.operators import compaction as gc
from tidelog.operators import cursor
from tidelog.operators import files as policy
from tidelog.operators import visibility as vis
from tidelog.plans import picking
from tidelog.schema import PUT, Corruption, InvalidArgument, NotFound, StoreIOError, log_schema, sort_key
from tidelog.snapshot import Pin, Snapshot, SnapshotRegistry
from tidelog.sources.commits import CommitLog, DataFile, Folder, State

log = logging.getLogger("tidelog")

#: Bytes of a data file that compaction aims at.
FILE_BYTES = 128 << 20
RETRIES = 20


@dataclass(frozen=True)
class Options:
    """What a handle does, beside what the table itself remembers."""

    max_file_size: int = FILE_BYTES  # of a compaction's files
    filter_policy: bool = True  # bloom filters on keys
    paranoid_checks: bool = False  # every read verifies page checksums
    auto_compaction: bool = False  # writers compact a level whose score reaches 1, and wait for it where too many files have gathered
    snapshot_lease: float = 3600.0  # seconds for which other handles respect a snapshot that isn't used


def key_hex(key) -> str:
    return (bytes(key) if isinstance(key, (bytes, bytearray, memoryview)) else str(key).encode()).hex()


class Database:
    """An open table. Handles are cheap and may be shared by threads; snapshots belong to the handle that made them and end with it, but other handles respect them."""

    def __init__(self, spark: SparkSession, path: str, folder: Folder, commits: CommitLog, state: State, options: Options | None = None):
        self.spark, self.path, self.folder, self.commits, self.state = spark, path, folder, commits, state
        self.options = options or Options()
        self._lock = threading.RLock()  # held while a commit is made and its state taken over
        self.instance = uuid.uuid4().hex
        self.snapshots = SnapshotRegistry()
        self.key_type = T._parse_datatype_json_string(json.dumps(state.key_type))
        self.value_type = T._parse_datatype_json_string(state.value_type)
        self.schema = log_schema(self.key_type, self.value_type)
        self.metrics: Counter[str] = Counter()  # of this handle, since it was opened
        self.compactions = {"done": 0, "moved": 0, "rows_in": 0, "rows_out": 0}
        self._held: dict[int, Pin] = {}  # marks of the snapshots made here
        self._unused: list[Pin] = []  # of snapshots that were dropped without release

    # ---- lifecycle

    @classmethod
    def open(cls, spark: SparkSession, path: str, create_if_missing: bool = False, error_if_exists: bool = False, comparator: str = "bytewise", key_type: str = "binary", value_type: T.DataType | None = None, options: Options | None = None) -> Database:
        """Opens a table, or creates it. The key order's name must be the one it was created with."""
        sort_key(comparator)
        folder = Folder(spark, path)
        commits = CommitLog(folder)
        if not commits.exists():
            if not create_if_missing:
                raise InvalidArgument(f"{path} does not exist (create_if_missing is false)")
            if key_type not in ("binary", "string"):
                raise InvalidArgument("keys are binary or string")
            folder.make("data")
            folder.make(CommitLog.DIR)
            edit = {"comparator": comparator, "key_type": key_type, "value_type": (value_type or T.BinaryType()).json(), "last_sequence": 0}
            state = commits.commit(State(), edit)
            if state is None:
                state = commits.load()
        elif error_if_exists:
            raise InvalidArgument(f"{path} exists (error_if_exists is true)")
        else:
            state = commits.load()
        if state.comparator != comparator:
            raise InvalidArgument(f"{path} has the key order {state.comparator}, not {comparator}")
        log.info("opened %s at commit %d", path, state.commit)
        return cls(spark, path, folder, commits, state, options)

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Removes a table's files; others in the directory stay."""
        folder = Folder(spark, path)
        if not folder.exists():
            return
        for name in ("data", CommitLog.DIR, Pin.DIR):
            if folder.exists(name):
                folder.delete(name, True)
        if not folder.names():
            folder.delete()

    def close(self) -> None:
        """Ends all snapshots; what was made of this handle so far is foreign to it from now on."""
        for sequence in self.snapshots.live():
            self.snapshots.release(sequence)
        with self._lock:
            held, self._held = self._held, {}
        for pin in held.values():
            pin.remove()
        self.instance = uuid.uuid4().hex

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def refresh(self) -> State:
        """Takes in commits of other writers."""
        with self._lock:
            self.state = self.commits.load()
            return self.state

    # ---- writes

    def put(self, key, value) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key) -> int:
        return self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch) -> int:
        """Commits a batch as a whole; the sequence of its last record. An empty one takes no sequence."""
        if not len(batch):
            return self.state.last_sequence
        last = self._append(batch.to_frame(self.spark, self.key_type, self.value_type).coalesce(1), keys=len(batch))
        batch.sequence = last - len(batch) + 1
        return last

    def write_frame(self, rows: DataFrame, stream: tuple[str, int] | None = None, check: bool = True) -> int:
        """Commits rows ``ord, op, key, value`` as one batch, written in parallel. ``ord`` gives the order: distinct and from 0 on, gaps allowed.

        ``stream``: a name and batch number; a batch that the table already took in is left out. The rows are computed once; ``check`` then verifies
        what has been written, before it is committed, which shuffles its ``ord``.
        """
        if stream is not None and self.refresh().streams.get(stream[0], -1) >= stream[1]:
            return self.state.last_sequence
        rows = rows.select(F.col("ord").cast("bigint").alias("ord"), F.col("op").cast("tinyint").alias("op"), F.col("key").cast(self.key_type).alias("key"), F.col("value").cast(self.value_type).alias("value"))
        return self._append(rows, stream=stream, check=check)

    def bulk_load(self, rows: DataFrame) -> int:
        """Commits ``key, value`` rows with keys that don't repeat; sequences follow no order that matters, so none is computed."""
        spread = 1 << (4 * max(1, rows.rdd.getNumPartitions()) - 1).bit_length()
        numbered = rows.select("key", "value").withColumn("op", F.lit(PUT)).withColumn("_id", F.monotonically_increasing_id())
        part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)  # partition, and place in it
        ord_ = F.when(part < spread, place * spread + part).otherwise(F.raise_error(F.lit("more partitions than the plan had")).cast("bigint"))
        return self.write_frame(numbered.withColumn("ord", ord_), check=False)

    def _append(self, rows: DataFrame, keys: int | None = None, stream: tuple[str, int] | None = None, check: bool = False) -> int:
        """Writes a batch's files and commits them. All that the commit says of the batch, its width too, is read back from the files: rows that are computed
        anew need not come out the same."""
        self._make_room()
        temporary = f"data/pending-{uuid.uuid4().hex}"
        ordered = rows.select("key", F.col("ord").cast("bigint").alias("seq"), "op", "value").sortWithinPartitions("key", F.col("seq").desc())
        self._write(ordered, temporary, keys)
        if check:
            try:
                validate(self.spark.read.parquet(f"{self.path}/{temporary}").withColumnRenamed("seq", "ord"))
            except Corruption:
                self.folder.delete(temporary, True)
                raise
        found = self._stats(temporary)
        if not found:
            self.folder.delete(temporary, True)
            return self.state.last_sequence
        width = max(f.last for f in found) + 1
        for _ in range(RETRIES):
            with self._lock:
                base = self.state.last_sequence + 1
                name = f"data/base={base}/{uuid.uuid4().hex}"
                self.folder.make(f"data/base={base}")
                self.folder.rename(temporary, name)
                added = [self._file(f, name, 0, self.state.next_file + i, base) for i, f in enumerate(found)]
                edit = {"add": [asdict(f) for f in added], "last_sequence": base + width - 1, "next_file": self.state.next_file + len(added)}
                if stream is not None:
                    edit["streams"] = {stream[0]: stream[1]}
                after = self.commits.commit(self.state, edit)
                if after is not None:
                    self.state = after
                    self.metrics.update({"commits": 1, "rows_written": sum(f.rows for f in found), "bytes_written": sum(f.size for f in found)})
                    break
                self.metrics["lost_races"] += 1
                temporary = name
                self.refresh()
                if stream is not None and self.state.streams.get(stream[0], -1) >= stream[1]:
                    return self.state.last_sequence
        else:
            raise StoreIOError(f"{RETRIES} other writers came first")
        if self.options.auto_compaction and picking.score(after)[0] >= 1:
            self.compact()
        return after.last_sequence

    def _make_room(self) -> None:
        """Admission of a write, where this handle compacts by itself: it waits a moment while files gather, and for a compaction where there are too many."""
        if not self.options.auto_compaction:
            return
        if len(self.state.at_level(0)) >= policy.L0_SLOWDOWN:
            time.sleep(0.001)
        while len(self.state.at_level(0)) >= policy.L0_STOP and self.compact(level=0):
            pass

    def _write(self, rows: DataFrame, where: str, keys: int | None) -> None:
        """``keys``: about how many a file will hold; its bloom filter is sized by that (else every small commit would carry one of a megabyte). Where it isn't known, the writer
        picks the size by the keys that it meets."""
        blooms = {"parquet.bloom.filter.enabled#key": str(self.options.filter_policy).lower()}
        blooms |= {"parquet.bloom.filter.adaptive.enabled": "true"} if keys is None else {"parquet.bloom.filter.expected.ndv#key": str(max(1, keys))}
        try:
            rows.write.options(**blooms).parquet(f"{self.path}/{where}")
        except Exception as e:
            raise StoreIOError(f"writing {where} failed: {e}") from e

    def _stats(self, where: str) -> list:
        """One row for each file written: what a commit records; read back from the files, which also verifies them."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{where}").select("key", "seq", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
        return rows.groupBy("file", "size").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("seq").alias("first"), F.max("seq").alias("last")).orderBy("low", "file").collect()

    def _file(self, f, where: str, level: int, number: int, base: int) -> DataFile:
        return DataFile(f"{where}/{f.file}", level, number, f.size, f.rows, base, key_hex(f.low), key_hex(f.high), base + f.first, base + f.last)

    # ---- reads

    def _seen(self, snapshot: Snapshot | None) -> tuple[State, int]:
        """The files and the sequence that a read goes by. A snapshot has its own, whatever has been compacted since; using it renews its lease."""
        if snapshot is None:
            state = self.state
            return state, state.last_sequence
        sequence = snapshot.check(self.instance)
        snapshot.pin.renew()
        return snapshot.state, sequence

    def log(self, snapshot: Snapshot | None = None, low=None, high=None, files: Iterable[DataFile] | None = None, verify_checksums: bool = False) -> DataFrame:
        """The versions a read needs: of files whose keys may meet ``[low, high]`` and whose sequences start in time."""
        state, sequence = self._seen(snapshot)
        chosen = picking.pruned(state.files.values() if files is None else files, sequence, key_hex(low) if low is not None else None, key_hex(high) if high is not None else None)
        with self._lock:
            self.metrics.update({"reads": 1, "files_read": len(chosen), "files_pruned": (len(state.files) if files is None else len(chosen)) - len(chosen)})
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("base", T.LongType())])
        reader = self.spark.read.schema(stored).option("basePath", f"{self.path}/data")
        if verify_checksums or self.options.paranoid_checks:
            reader = reader.option("parquet.page.verify-checksum.enabled", "true")
        rows = reader.parquet(*[f"{self.path}/{f.path}" for f in chosen])
        rows = rows.select("key", (F.col("seq") + F.col("base")).alias("seq"), "op", "value")
        return rows.where(F.col("seq") <= sequence) if any(f.largest_seq > sequence for f in chosen) else rows

    def changes(self, since: int, snapshot: Snapshot | None = None) -> DataFrame:
        """Versions above sequence ``since``, tombstones included, of files that may hold any; versions that a compaction dropped are gone."""
        rows = self.log(snapshot, files=[f for f in self._seen(snapshot)[0].files.values() if f.largest_seq > since])
        return rows.where(F.col("seq") > since)

    def scan(self, snapshot: Snapshot | None = None, low=None, high=None, fill_cache: bool = False, verify_checksums: bool = False) -> DataFrame:
        """Live rows ``key, seq, value`` with keys in ``[low, high)``; with ``fill_cache`` Spark keeps them for later reads."""
        rows = cursor.scan_range(self.log(snapshot, low, high, verify_checksums=verify_checksums), low, high)
        return rows.persist() if fill_cache else rows

    def iterate(self, snapshot: Snapshot | None = None, low=None, high=None, reverse: bool = False):
        """Live rows in key order, one after another; partitions come to the driver one at a time."""
        by = sort_key(self.state.comparator)
        return self.scan(snapshot, low, high).orderBy(by.desc() if reverse else by).toLocalIterator()

    def get(self, key, snapshot: Snapshot | None = None, verify_checksums: bool = False):
        """The value; raises NotFound when the key is absent or deleted."""
        row = vis.get(self.log(snapshot, key, key, verify_checksums=verify_checksums), key).first()
        if row is None:
            raise NotFound(f"{key!r}")
        return bytes(row.value) if isinstance(row.value, bytearray) else row.value

    def multi_get(self, keys: DataFrame | Sequence, snapshot: Snapshot | None = None, verify_checksums: bool = False) -> DataFrame:
        if isinstance(keys, DataFrame):
            return vis.multi_get(self.log(snapshot, verify_checksums=verify_checksums), keys)
        if not keys:
            return vis.visible(self.log(snapshot).limit(0))
        rows = self.log(snapshot, min(keys), max(keys), verify_checksums=verify_checksums)
        return vis.visible(rows.where(F.col("key").isin(list(keys))))

    def page(self, n: int, start=None, inclusive: bool = True, reverse: bool = False, snapshot: Snapshot | None = None) -> list[Row]:
        """The first ``n`` live rows ``key, seq, value`` from ``start`` on, or downwards from it.

        Files are taken in key order, some more each time, until they hold that many rows; so a position doesn't read the table.
        """
        order = self.state.comparator
        by = sort_key(order)
        files, edge = self._seen(snapshot)[0].files.values(), None if start is None else key_hex(start)
        if order != "bytewise":
            ends: list[str] = []
        elif reverse:
            ends = sorted({f.smallest for f in files if edge is None or f.smallest <= edge}, reverse=True)
        else:
            ends = sorted({f.largest for f in files if edge is None or f.largest >= edge})
        many = 1
        while True:
            last = many >= len(ends)
            far = None if last else self._key(ends[many - 1])
            low, high = (far, start) if reverse else (start, far)
            rows = self.log(snapshot, *((low, high) if order == "bytewise" else (None, None)))
            if start is not None:
                here, at = by, sort_key(order, F.lit(start))
                rows = rows.where((here <= at if inclusive else here < at) if reverse else (here >= at if inclusive else here > at))
            if far is not None:
                rows = rows.where(F.col("key") >= F.lit(far) if reverse else F.col("key") <= F.lit(far))
            found = vis.visible(rows).orderBy(by.desc() if reverse else by).limit(n).collect()
            if len(found) >= n or last:
                return found
            many *= 4

    def _key(self, hexed: str):
        raw = bytes.fromhex(hexed)
        return raw.decode() if isinstance(self.key_type, T.StringType) else raw

    def _one(self, rows: list[Row]) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(c, kinds[c]) for c in ("key", "seq", "value")]))

    def seek(self, target, snapshot: Snapshot | None = None) -> DataFrame:
        """The first live row at or after ``target``."""
        return self._one(self.page(1, target, snapshot=snapshot))

    def seek_first(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self._one(self.page(1, snapshot=snapshot))

    def seek_last(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self._one(self.page(1, reverse=True, snapshot=snapshot))

    def next_after(self, key, snapshot: Snapshot | None = None) -> DataFrame:
        return self._one(self.page(1, key, inclusive=False, snapshot=snapshot))

    def prev_before(self, key, snapshot: Snapshot | None = None) -> DataFrame:
        return self._one(self.page(1, key, inclusive=False, reverse=True, snapshot=snapshot))

    def prefix(self, prefix, snapshot: Snapshot | None = None) -> DataFrame:
        end = prefix_end(prefix if isinstance(prefix, bytes) else prefix.encode())
        return cursor.scan_prefix(self.log(snapshot, prefix, end), prefix)

    def view(self, name: str, snapshot: Snapshot | None = None) -> None:
        """Registers the live rows for SQL."""
        self.scan(snapshot).createOrReplaceTempView(name)

    # ---- snapshots

    def snapshot(self) -> Snapshot:
        """The table as it is now. Its mark in the table's directory keeps compactions and vacuums of all handles from its rows."""
        self._tidy()
        for _ in range(RETRIES):
            state = self.state
            pin = Pin(self.folder, state.last_sequence, state.commit, self.options.snapshot_lease)
            if self.commits.head() == state.commit:
                break
            pin.remove()  # another handle may have removed files of an older version before it saw the mark
            self.refresh()
        else:
            raise StoreIOError(f"{RETRIES} other writers came first")
        with self._lock:
            self._held[id(pin)] = pin
        return Snapshot(self.snapshots, self.instance, state.last_sequence, state, pin, self._unused.append)

    def _tidy(self) -> None:
        while self._unused:
            self._unused.pop().remove()
        with self._lock:
            self._held = {k: p for k, p in self._held.items() if p.name}

    def watermark(self) -> int:
        """Versions above this sequence are kept as they are: the oldest live snapshot of any handle, else the head."""
        self._tidy()
        return gc.gc_watermark([*self.snapshots.live(), *(sequence for sequence, _ in Pin.live(self.folder))], self.state.last_sequence)

    def oldest_snapshot(self) -> int | None:
        return self.snapshots.oldest()

    def state_row(self) -> DataFrame:
        """One row on compaction and admission."""
        l0 = len(self.state.at_level(0))
        row = self.spark.createDataFrame([(self.state.commit, self.state.last_sequence, len(self.state.files), l0, self.snapshots.oldest(), *self.compactions.values())], "commit bigint, last_sequence bigint, files bigint, l0_files bigint, oldest_snapshot bigint, compactions bigint, moves bigint, rows_in bigint, rows_out bigint")
        return row.withColumn("stall", policy.stall_state(F.col("l0_files")))

    def metrics_rows(self) -> DataFrame:
        """``name, value``: commits, races lost, reads planned, files read and pruned, rows and bytes written and compacted by this handle."""
        return self.spark.createDataFrame(sorted(self.metrics.items()), "name string, value bigint")

    def files(self) -> DataFrame:
        """Live files with their key ranges (keys as they are for string keys, else as bytes)."""
        rows = [(f.level, f.number, f.size, f.rows, f.smallest, f.largest, f.smallest_seq, f.largest_seq, f.path) for f in self.state.files.values()]
        raw = self.spark.createDataFrame(rows, "level int, number bigint, size bigint, rows bigint, smallest string, largest string, smallest_seq bigint, largest_seq bigint, path string")
        return raw.withColumns({c: F.unhex(c).cast(self.key_type) for c in ("smallest", "largest")})

    # ---- maintenance

    def compact(self, level: int | None = None, full: bool = False) -> bool:
        """One compaction: of the level with the highest score (or ``level``), or of everything. Whole keys move together: all files that share one with the
        inputs at the level come along, so newer versions never sink below older ones. False when there is nothing to do.
        """
        context, tag = self.spark.sparkContext, self._tag
        context.addJobTag(tag)
        try:
            return self._compact(level, full)
        finally:
            context.removeJobTag(tag)

    def cancel_compactions(self) -> None:
        """Ends compactions of this handle that are under way; their callers get an error, the table stays as it was."""
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    @property
    def _tag(self) -> str:
        return f"tidelog-compaction-{self.instance}"

    def _compact(self, level: int | None, full: bool) -> bool:
        state = self.state
        watermark = self.watermark()  # frozen before files are listed
        plan = picking.everything(state) if full else picking.pick(state, level, self.spark)
        if plan is None:
            return False
        if plan.trivial and not full:
            moved = plan.inputs[0]
            edit = {"remove": [], "add": [asdict(DataFile(**{**asdict(moved), "level": plan.target}))], "pointers": plan.pointers}
            with self._lock:
                after = self.commits.commit(state, edit)
                self.compactions["moved"] += after is not None
                self.state = after or self.refresh()
            return after is not None
        inputs = self.log(files=plan.inputs)
        deeper = [f for f in state.files.values() if f.level > plan.target]
        kwargs = {}
        if deeper:
            ranges = self.spark.createDataFrame([(f.smallest, f.largest) for f in deeper], "smallest string, largest string").withColumns({c: F.unhex(c).cast(self.key_type) for c in ("smallest", "largest")})
            kwargs = {"deeper": ranges, "deeper_keys": self.log(files=deeper).select("key").distinct(), "n_deeper": len(deeper)}
        kept = gc.compact(inputs, watermark, **kwargs)
        size = sum(f.size for f in plan.inputs)
        low, high = min(f.smallest for f in plan.inputs), max(f.largest for f in plan.inputs)
        beyond = sum(f.size for f in state.at_level(plan.target + 1) if f.largest >= low and f.smallest <= high)
        # Enough files that none meets much more of the level beyond than a later compaction should take in.
        parts = max(1, -(-size // self.options.max_file_size), -(-beyond // (policy.GRANDPARENT_FACTOR * self.options.max_file_size)))
        dealt = kept.repartitionByRange(parts, "key").sortWithinPartitions("key", F.col("seq").desc())
        name = f"data/base=0/{uuid.uuid4().hex}"
        try:
            self._write(dealt, name, -(-sum(f.rows for f in plan.inputs) // parts))
        except StoreIOError:
            self.folder.delete(name, True)  # failed or cancelled
            raise
        found = self._stats(name)
        for _ in range(RETRIES):
            with self._lock:
                added = [self._file(f, name, plan.target, self.state.next_file + i, 0) for i, f in enumerate(found)]
                edit = {"remove": [f.path for f in plan.inputs], "add": [asdict(f) for f in added], "next_file": self.state.next_file + len(added), "pointers": plan.pointers}
                after = self.commits.commit(self.state, edit)
                if after is not None:
                    self.state = after
                    self.compactions["done"] += 1
                    self.compactions["rows_in"] += sum(f.rows for f in plan.inputs)
                    self.compactions["rows_out"] += sum(f.rows for f in found)
                    self.metrics.update({"bytes_compacted": size, "bytes_written": sum(f.size for f in found)})
                    return True
                self.refresh()
                if any(f.path not in self.state.files for f in plan.inputs):
                    return False  # another compaction took them; what was written here is an orphan
        raise StoreIOError(f"{RETRIES} other writers came first")

    def vacuum(self, retain_commits: int = 1) -> list[str]:
        """Deletes data files that neither the last ``retain_commits`` versions nor a version pinned by a live snapshot of any handle names; their paths.

        Files of commits that failed are among them; writes under way in other processes must be over.
        """
        self._tidy()
        head = self.refresh().commit
        keep = {*range(max(0, head - max(1, retain_commits) + 1), head + 1), *(commit for _, commit in Pin.live(self.folder, clear=True) if commit <= head)}
        live = {path for c in keep for path in (self.state if c == head else self.commits.load(c)).files}
        gone = [path for path, _ in self.folder.files("data") if path not in live and not path.rsplit("/", 1)[-1].startswith(".")]
        for path in gone:
            self.folder.delete(path)
        return sorted(g for g in gone if g.endswith(".parquet"))

    def import_parquet(self, path: str, key: str = "key", value: str = "value") -> int:
        """Takes in a foreign Parquet directory as one commit of puts."""
        rows = self.spark.read.parquet(path)
        return self.bulk_load(rows.select(F.col(key).alias("key"), F.col(value).alias("value")))

