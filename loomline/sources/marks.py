"""High-water marks that last: loads in versions, each committed together with the mark that it reached.

A store is a folder with a sub-folder a name. A load reads, once, what lies past the last mark, writes it to a folder of its own
and then creates the version's manifest, a small JSON file that names the folder, the mark and the rows. The manifest alone
makes the load visible and moves the mark, so both happen or neither: after a crash before it the next load reads the same again,
and what the dead one has written is never read. Of two loads at once one creates the manifest; the other fails with ``Conflict``.

The mark is the largest value among the rows written, not among those in the source by then, which may have grown in between.
In the mode ``>=`` rows at the last mark are read again, less those of them that have been loaded (they are kept beside the
load, as a multiset: of three equal rows where two have been loaded one is new); in the mode ``>`` rows that arrive at the mark
after it has been reached are not seen, by its meaning. Rows without a value are loaded by the first load only. Columns of map
type cannot be compared and are refused in the mode ``>=``.

The commit needs a file system that renames to a name only where there is none yet (HDFS does so atomically).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.predicates import quoted


class Conflict(RuntimeError):
    """Another load has committed this version."""


@dataclass(frozen=True)
class Load:
    """A committed load: ``mark`` as text of the type ``kind``, the rows' folder and that of the rows at the mark."""

    version: int
    field: str
    mark: str | None
    kind: str
    rows: int
    folder: str
    edge: str

    def value(self) -> Column:
        """The mark as a literal of its type."""
        if self.kind.startswith("timestamp"):
            return F.timestamp_micros(F.lit(int(self.mark))).cast(self.kind)
        return F.lit(self.mark).cast(self.kind)


class Marks:
    """Loads of any number of names below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def loads(self, name: str) -> list[Load]:
        """The committed loads, oldest first."""
        folder, system = self._path(name, "_loads"), self._system()
        if not system.exists(folder):
            return []
        found = []
        for status in system.listStatus(folder):
            file = status.getPath()
            if file.getName().endswith(".json"):
                stream = system.open(file)
                try:
                    found.append(Load(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
                finally:
                    stream.close()
        return sorted(found, key=lambda x: x.version)

    def latest(self, name: str) -> Load | None:
        return next(iter(self.loads(name)[::-1]), None)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """All rows of the committed loads, or of one of them, with their ``version``; None where there are none."""
        frames = [self.spark.read.parquet(x.folder).withColumn("version", F.lit(x.version).cast("long")) for x in self.loads(name) if version in (None, x.version)]
        if not frames:
            return None
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame, allowMissingColumns=True)
        return whole

    def _commit(self, name: str, load: Load) -> None:
        jvm, system = self.spark._jvm, self._system()
        draft, final = self._path(name, "_loads", f"{load.version:012d}.{uuid.uuid4().hex}.draft"), self._path(name, "_loads", f"{load.version:012d}.json")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(asdict(load)).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else system.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as error:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {load.version} of {name} has been committed by another load") from error
            raise

    def load(self, name: str, source: DataFrame, field: str, mode: str = ">", transform: Callable[[DataFrame], DataFrame] | None = None, write: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
        """Load what ``source`` has past the last mark of ``field``; the rows of the load, None where nothing is new.

        ``transform`` is applied to the new rows; ``write`` (rows, version) brings them to another place, before the commit: it has
        to replace what an earlier, uncommitted try of the same version has left there."""
        if mode not in (">", ">="):
            raise ValueError(f"unknown mode {mode}")
        last, kind = self.latest(name), dict(source.dtypes)[field]
        version = 0 if last is None else last.version + 1
        column = F.col(quoted(field))
        new = source
        if last is not None:
            if last.field != field:
                raise ValueError(f"{name} is loaded by {last.field}")
            new = source.filter(column > last.value())
            if mode == ">=":
                known = self.spark.read.schema(source.schema).parquet(last.edge)
                new = new.unionByName(source.filter(column == last.value()).exceptAll(known))
        folder = f"{self.root}/{name}/{version:012d}-{uuid.uuid4().hex}"
        new.write.parquet(f"{folder}/raw")
        staged = self.spark.read.schema(source.schema).parquet(f"{folder}/raw")
        said = F.unix_micros(F.max(column).cast("timestamp")).cast("string") if kind.startswith("timestamp") else F.max(column).cast("string")
        high, count = staged.agg(said, F.count("*")).first()
        if not count:
            self._system().delete(self._path(name, folder.rsplit("/", 1)[-1]), True)
            return None
        mark = Load(version, field, high if high is not None or last is None else last.mark, kind, count, f"{folder}/raw", f"{folder}/edge")
        at = staged.filter(column == mark.value()) if mark.mark is not None else staged.limit(0)
        if last is not None and last.mark == mark.mark:
            at = at.unionByName(self.spark.read.schema(source.schema).parquet(last.edge))
        at.write.parquet(f"{folder}/edge")
        if transform is not None:
            transform(staged).write.parquet(f"{folder}/data")
            mark = Load(**(asdict(mark) | {"folder": f"{folder}/data"}))
        result = self.spark.read.parquet(mark.folder)
        if write is not None:
            write(result, version)
        self._commit(name, mark)
        if transform is not None:
            self._system().delete(self._path(name, folder.rsplit("/", 1)[-1], "raw"), True)
        return result

    def vacuum(self, name: str) -> int:
        """Delete folders that no manifest names, left by loads that failed; how many. Not while a load runs."""
        system, folder = self._system(), self._path(name)
        if not system.exists(folder):
            return 0
        live = {x.folder.rsplit("/", 2)[-2] for x in self.loads(name)}
        gone = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName() not in live | {"_loads"}]
        gone += [s.getPath() for s in system.listStatus(self._path(name, "_loads")) if s.getPath().getName().endswith(".draft")] if system.exists(self._path(name, "_loads")) else []
        return sum(system.delete(p, True) for p in gone)
