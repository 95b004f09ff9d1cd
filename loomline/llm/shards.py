"""Shard store with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards, cut where their rows pass a number of bytes. A shard's tier is how
often its size has to be multiplied by ``fan`` from the smallest size on; once a tier holds ``fan`` shards or more they are
merged, in order, into runs that are as near to the target size as whole shards allow. Merging neither shuffles nor sorts:
each run is read as one partition and written as one file, and a job writes many runs at once. Shards at or above the target
are left alone.

A version is one manifest file: the shards that came and went since the version before, or, every ``FULL`` versions, all of
them. It is written under a temporary name and gets its own by a rename, so a reader takes the newest version and sees all of
it or none. Before that a writer claims the version by creating a file that must not exist; of two writers one has to start
again from the newer version, and does. A claim without a manifest that is older than ``LEASE`` is a dead writer's: the next
writer claims the version anew, under the next attempt, and the manifest of the highest attempt counts. Writers look once more
before the rename, so that a writer who was only slow gives up; what is left is the moment between this look and the rename.

Arrivals may have different columns. The manifest holds the columns of all of them, by name; a shard that lacks one reads as
null, and compaction keeps every one. A column that comes back with another type is an error, and nothing is appended.

Rows are carried whole, repeated, null and empty ones too; an empty arrival adds no shard; a row larger than the cut closes
its shard. ``vacuum`` lists the folder, so it finds files of failed writers as well; those younger than it is told are spared.
The driver holds a line for each live shard: at 64 MB each, some 1.6 million for 100 TB.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import work_path

TARGET = 64 << 20
SMALLEST = 1 << 20
FAN = 4
#: Bytes of rows, before they are encoded, behind which a shard of an arrival ends.
CUT = 4 << 20
#: Runs that one merge job writes.
JOB = 200
#: Versions from one full manifest to the next, seconds after which a claim is void, and how often a writer starts again.
FULL, LEASE, RETRIES = 10, 600.0, 20
#: Lines of a manifest that are broadcast at most.
FEW = 100_000


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    size: int


@dataclass
class Manifest:
    version: int = 0
    shards: list[Shard] = field(default_factory=list)
    schema: T.StructType | None = None


class Conflict(RuntimeError):
    """Another writer has taken the version that this one wanted."""


def tier_of(size: int, smallest: int = SMALLEST, fan: int = FAN) -> int:
    tier = 0
    while size > smallest:
        size, tier = size / fan, tier + 1
    return tier


def runs_of(shards: list[Shard], target: int) -> list[list[Shard]]:
    """Consecutive shards in runs: a run is closed where the next shard would take it further from the target."""
    runs: list[list[Shard]] = []
    held: list[Shard] = []
    size = 0
    for shard in shards:
        if held and abs(size + shard.size - target) > abs(size - target):
            runs.append(held)
            held, size = [], 0
        held.append(shard)
        size += shard.size
    return [*runs, held] if held else runs


def merged_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """All columns of both, nullable; a name keeps its type."""
    fields = {f.name: f.dataType for f in old.fields} if old else {}
    spelled = {n.lower(): n for n in fields}
    for f in new.fields:
        known = spelled.setdefault(f.name.lower(), f.name)
        if known != f.name or fields.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} was {known} {fields[known].simpleString()} and comes as {f.dataType.simpleString()}")
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def cut_by_bytes(frame: DataFrame, name: str, cut: int) -> DataFrame:
    """``frame`` with a column that counts, in each partition, how often its rows so far have passed ``cut`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = held = 0
        for batch in batches:
            sizes = np.zeros(batch.num_rows)
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                    sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                else:
                    sizes += column.nbytes / max(1, batch.num_rows)
            pieces = np.empty(batch.num_rows, np.int32)
            ends = np.cumsum(sizes) + held
            start = 0
            while start < batch.num_rows:
                # the row that passes the cut closes the piece
                end = min(batch.num_rows, int(np.searchsorted(ends, cut)) + 1)
                end = max(end, start + 1)
                pieces[start:end] = piece
                if ends[end - 1] >= cut:
                    ends -= ends[end - 1]
                    piece += 1
                start = end
            held = ends[-1] if batch.num_rows else held
            yield pa.record_batch([*batch.columns, pa.array(pieces)], [*batch.schema.names, name])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(name, T.IntegerType())]))


def _exactly(path: str) -> str:
    """A path that Spark takes as it is written, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


class ShardStore:
    """A folder of shards and manifests in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = SMALLEST, fan: int = FAN, cut: int = CUT, lease: float = LEASE):
        self.spark, self.root, self.target, self.smallest, self.fan, self.cut, self.lease = spark, root.rstrip("/"), target, smallest, fan, cut, lease
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    # -- manifests

    def _files(self, kind: str) -> dict[int, tuple[int, object]]:
        """For each version the highest attempt that has a file of the kind, and its status."""
        folder, out = self._path(f"{self.root}/manifests"), {}
        for status in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            name = status.getPath().getName()
            if name.startswith(f"{kind}-"):
                version, attempt = map(int, name.removeprefix(f"{kind}-").split("."))
                if version not in out or out[version][0] < attempt:
                    out[version] = attempt, status
        return out

    def _lines(self, status) -> list[dict]:
        stream = self.fs.open(status.getPath())
        try:
            return [json.loads(x) for x in self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")]
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or another one."""
        files = self._files("manifest")
        if version is None:
            version = max(files, default=0)
        if not version:
            return Manifest()
        changes: list[list[dict]] = []
        for k in range(version, 0, -1):
            changes.append(self._lines(files[k][1]))
            if changes[-1][0]["full"]:
                break
        live: dict[str, Shard] = {}
        for head, *lines in reversed(changes):
            for path in head["gone"]:
                del live[path]
            live |= {x["path"]: Shard(**x) for x in lines}
        return Manifest(version, list(live.values()), T.StructType.fromJson(changes[0][0]["schema"]))

    def commit(self, base: Manifest, came: list[Shard], gone: list[str] | None = None, schema: T.StructType | None = None) -> Manifest:
        """The version after ``base``, without the shards that are gone and with those that came, or ``Conflict``."""
        gone = set(gone or [])
        new = Manifest(base.version + 1, [*(s for s in base.shards if s.path not in gone), *came], merged_schema(base.schema, schema) if schema else base.schema)
        full = new.version % FULL == 1
        head = {"version": new.version, "full": full, "gone": [] if full else sorted(gone), "schema": new.schema.jsonValue()}
        folder = f"{self.root}/manifests"
        self.fs.mkdirs(self._path(folder))
        draft = self._path(f"{folder}/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray("\n".join(map(json.dumps, [head, *(asdict(s) for s in (new.shards if full else came))])).encode()))
        out.close()
        try:
            attempt, claims = 0, self._files("claim")
            if new.version in claims:
                # both times are the file system's
                attempt, age = claims[new.version][0] + 1, self.fs.getFileStatus(draft).getModificationTime() - claims[new.version][1].getModificationTime()
                if age < 1000 * self.lease:
                    raise Conflict(f"version {new.version} is taken")
            claim = self._path(f"{folder}/claim-{new.version:010d}.{attempt:04d}")
            try:
                self.fs.create(claim, False).close()
            except Exception as error:
                raise Conflict(f"version {new.version} is taken") from error
            if new.version in self._files("manifest") or self._files("claim")[new.version][0] != attempt:
                raise Conflict(f"version {new.version} is there")
            if not self.fs.rename(draft, self._path(f"{folder}/manifest-{new.version:010d}.{attempt:04d}")):
                raise Conflict(f"version {new.version} could not be named")
        except Conflict:
            self.fs.delete(draft, False)
            raise
        return new

    # -- shards

    def _listed(self, folder: str) -> list[Shard]:
        """The files below a folder of the store."""
        base = self.fs.makeQualified(self._path(self.root)).toString()
        files = self.spark.read.option("recursiveFileLookup", "true").schema("a int").parquet(_exactly(f"{self.root}/{folder}"))
        # a file's path comes percent-encoded, the root does not
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        found = files.groupBy(path.alias("path"), F.col("_metadata.file_size").alias("size")).count().collect()
        plain = lambda p: p.split(":", 1)[-1].lstrip("/")
        return [Shard(plain(r["path"])[len(plain(base)) + 1 :], r["count"], r["size"]) for r in sorted(found, key=lambda r: r["path"]) if r["count"]]

    def _drop(self, folder: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{folder}"), True)

    def _again(self, shards: list[Shard], schema: T.StructType) -> Manifest:
        """Commit shards that came, on top of whatever is newest."""
        for k in range(RETRIES):
            with contextlib.suppress(Conflict):
                return self.commit(self.manifest(), shards, schema=schema)
            time.sleep(min(1.0, 0.05 * 2**k))
        raise Conflict(f"no version was free in {RETRIES} attempts")

    def append_each(self, arrivals: DataFrame, by: Column) -> list[Manifest]:
        """Add the arrivals that ``by`` (an int) tells apart, each as a version of its own; rows are read and written once."""
        folder, names = f"shards/{uuid.uuid4().hex}", []
        for name in ("arrival", "piece"):
            while name in map(str.lower, [*arrivals.columns, *names]):
                name = f"_{name}"
            names.append(name)
        schema = merged_schema(self.manifest().schema, arrivals.schema)
        made = []
        try:
            cut_by_bytes(arrivals.withColumn(names[0], by), names[1], self.cut).write.partitionBy(*names).parquet(f"{self.root}/{folder}")
            groups: dict[str, list[Shard]] = {}
            for shard in self._listed(folder):
                groups.setdefault(shard.path.split("/")[2], []).append(shard)
            for key in sorted(groups):
                made.append(self._again(groups[key], arrivals.schema))
        except BaseException:
            if not made:
                self._drop(folder)
            raise
        return made or [Manifest(schema=schema)]

    def append(self, arrivals: DataFrame) -> Manifest:
        """Add an arrival."""
        self.append_each(arrivals, F.lit(0))
        return self.manifest()

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The runs that a compaction merges: of each tier below the target that is full, those of several shards."""
        tiers: dict[int, list[Shard]] = {}
        for shard in shards:
            if shard.size < self.target:
                tiers.setdefault(tier_of(shard.size, self.smallest, self.fan), []).append(shard)
        full = [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan]
        return [run for group in full for run in runs_of(group, self.target) if len(run) > 1]

    def _read(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[_exactly(f"{self.root}/{s.path}") for s in shards])

    @contextlib.contextmanager
    def _apart(self) -> Iterator[None]:
        """Spark would take a union of single partitions for a single one, and write all runs as one file."""
        name = "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(name, "true")
        self.spark.conf.set(name, "false")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def compact(self) -> Manifest:
        """Merge until no tier is full; each round is one version. A round whose shards another writer has merged
        meanwhile is dropped."""
        current = self.manifest()
        while runs := self.plan(current.shards):
            folders, made = [], []
            for at in range(0, len(runs), JOB):
                frame = None
                for run in runs[at : at + JOB]:
                    part = self._read(run, current.schema).coalesce(1)
                    frame = part if frame is None else frame.union(part)
                folders.append(f"shards/{uuid.uuid4().hex}")
                with self._apart():
                    frame.write.parquet(f"{self.root}/{folders[-1]}")
                made += self._listed(folders[-1])
            if sum(s.rows for s in made) != sum(s.rows for run in runs for s in run):
                raise RuntimeError("a merge has not carried every row")
            gone = {s.path for run in runs for s in run}
            for _ in range(RETRIES):
                try:
                    current = self.commit(current, made, sorted(gone))
                    break
                except Conflict:
                    time.sleep(0.1)
                    current = self.manifest()
                    if not gone <= {s.path for s in current.shards}:
                        for folder in folders:
                            self._drop(folder)
                        break
            else:
                raise Conflict("no version was free for a merge")
        return current

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the columns of all its arrivals; raises where the store has no version."""
        manifest = self.manifest(version)
        if manifest.schema is None:
            raise ValueError("the store is empty")
        return self._read(manifest.shards, manifest.schema) if manifest.shards else self.spark.createDataFrame([], manifest.schema)

    def vacuum(self, young: float = 3600.0) -> int:
        """Delete files that the newest version does not list and that are older than ``young`` seconds; how many went.
        Readers of older versions, and writers slower than that, lose theirs. Nothing is deleted where a shard that the version
        lists is not found: its name may be read wrongly, and then it is among those that seem to be listed nowhere."""
        live, now = {s.path for s in self.manifest().shards}, time.time()
        base = len(self.fs.makeQualified(self._path(self.root)).toString()) + 1
        found = {}
        if self.fs.exists(self._path(f"{self.root}/shards")):
            files = self.fs.listFiles(self._path(f"{self.root}/shards"), True)
            while files.hasNext():
                status = files.next()
                found[self.fs.makeQualified(status.getPath()).toString()[base:]] = status
        if lost := live - set(found):
            raise FileNotFoundError(f"{len(lost)} shards of the newest version are not there, {min(lost)} among them")
        gone = 0
        for name, status in found.items():
            if name not in live and now - status.getModificationTime() / 1000 >= young:
                gone += self.fs.delete(status.getPath(), False) and name.endswith(".parquet")
        return gone


def shard_documents(spark: SparkSession, docs: DataFrame, arrivals: int = 4, **sizes: int) -> DataFrame:
    """Append ``docs`` in ``arrivals`` parts, compact, and read the last version back.

    Returns per row doc_id, text_sha256 (of an empty text where it is null), shard (its file), shard_rows, shard_bytes and
    tier; every row of ``docs`` comes back once.
    """
    store = ShardStore(spark, work_path(spark, "shards"), **sizes)
    store.append_each(docs, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(arrivals)), F.lit(0)).cast("int"))
    manifest = store.compact()
    if not manifest.shards:
        return spark.createDataFrame([], "doc_id long, text_sha256 string, shard string, shard_rows long, shard_bytes long, tier int")
    facts = spark.createDataFrame([(s.path.rsplit("/", 1)[1], s.rows, s.size, tier_of(s.size, store.smallest, store.fan)) for s in manifest.shards], "shard string, shard_rows long, shard_bytes long, tier int")
    rows = store.read().select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text_sha256"), F.col("_metadata.file_name").alias("shard"))
    # a line a shard; only a manifest of very many is joined by a shuffle
    side = F.broadcast(facts) if len(manifest.shards) <= FEW else facts
    return rows.join(side, "shard").select("doc_id", "text_sha256", "shard", "shard_rows", "shard_bytes", "tier")
