"""Scans: JSON views, JSONL, CSV, Parquet, binary files, archives, tables, all by Spark's own readers."""

from __future__ import annotations

import bz2
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, ge, gt, le, lt, or_

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.predicates import limit_offset, numbered, order_by, quoted, since, where
from loomline.plans.templates import render
from loomline.sources.writers import _file_system

FILENAME = "__filename__"


@dataclass(frozen=True)
class JsonView:
    """A folder of JSON files as a view."""

    alias: str
    path: str = ""
    path_glob_filter: str | None = None
    compress_type: str | None = None
    file_type: str = "json"
    filename_field: str | None = FILENAME
    recursive_file_lookup: bool = False
    schema: str | None = None

    def __post_init__(self):
        if self.file_type != "json":
            raise ValueError("a view reads JSON files")
        if self.compress_type not in (None, "bzip2"):
            raise ValueError(f"unknown compression {self.compress_type}")


def read_view(spark: SparkSession, folder: str, view: JsonView) -> DataFrame | None:
    """The view's rows with their file's path; None where the folder does not exist. Other errors are raised."""
    reader = spark.read.option("recursiveFileLookup", str(view.recursive_file_lookup).lower())
    if view.path_glob_filter:
        reader = reader.option("pathGlobFilter", view.path_glob_filter)
    if view.schema:
        reader = reader.schema(view.schema)
    try:
        frame = reader.json(f"{folder.rstrip('/')}/{view.path}".rstrip("/"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return frame.withColumn(view.filename_field, F.col("_metadata.file_path")) if view.filename_field else frame


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, tag: str | None = None) -> DataFrame:
    """CSV with a header; every column is text. ``tag``: a column for the file's name."""
    reader = spark.read.option("header", "true").option("inferSchema", "false").option("multiLine", "true").option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    frame = reader.csv(path)
    return frame.withColumn(tag, F.col("_metadata.file_name")) if tag else frame


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, skip_blank: bool = True) -> DataFrame:
    """Typed rows where a schema is given, else lines as ``value`` with their ``file``."""
    if schema:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    return lines.filter(F.trim("value") != "") if skip_blank else lines


def _key(spark: SparkSession, root: str, path) -> F.Column:
    """What stands behind ``root`` in a file's path."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    return F.regexp_replace(path, f"^(?:\\w+:/*)?/?{re.escape(base.strip('/'))}/", "")


def read_table_files(spark: SparkSession, root: str, file_type: str = "parquet", prefix: str = "", glob: str | None = None, compress_type: str | None = None, recursive: bool = True, schema: str | None = None) -> DataFrame:
    """Rows of the files below ``root``/``prefix`` whose key, prefix and all, matches; the filter on the path prunes files.

    Without ``recursive`` ``**`` stands for one folder. Compressed JSON whose names don't tell is decompressed first."""
    if file_type not in ("parquet", "json"):
        raise ValueError(f"unknown file type {file_type}")
    if compress_type not in (None, "bzip2"):
        raise ValueError(f"unknown compression {compress_type}")
    glob = glob if glob is None or recursive else glob.replace("**", "*")
    if compress_type:
        if file_type != "json":
            raise ValueError("only JSON files are decompressed")
        content = read_blocks(spark, root, prefix, glob or "**", compress_type=compress_type).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value"))
        lines = content.filter(F.trim("value") != "")
        return lines.select(F.from_json("value", schema).alias("row")).select("row.*") if schema else spark.read.json(lines.rdd.map(lambda r: r.value))
    folder, name = listed(root, prefix, glob or "**")
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", name) if name else reader
    reader = reader.schema(schema) if schema else reader
    frame = getattr(reader, file_type)(folder)
    return frame.filter(_key(spark, root, F.col("_metadata.file_path")).rlike(glob_pattern(prefix, glob))) if glob else frame


def glob_pattern(prefix: str, glob: str) -> str:
    """A regular expression for ``prefix/glob``: ``**`` crosses folders, ``*`` and ``?`` do not; hidden files match."""
    out, at, text = [], 0, f"{prefix.rstrip('/')}/{glob}" if prefix else glob
    while at < len(text):
        if text.startswith("**/", at):
            out.append("(?:[^/]+/)*")
            at += 3
        elif text.startswith("**", at):
            out.append(".*")
            at += 2
        else:
            char = text[at]
            if char == "[" and "]" in text[at + 2 :]:
                end = text.index("]", at + 2)
                body = text[at + 1 : end]
                out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
                at = end
            else:
                out.append({"*": "[^/]*", "?": "[^/]"}.get(char, re.escape(char)))
            at += 1
    return "^" + "".join(out) + "$"


def listed(root: str, prefix: str, glob: str) -> tuple[str, str | None]:
    """(path, name): what has to be listed for ``prefix/glob``, and the pattern of a file's own name.

    Folders up to the first ``**`` are part of the path, wild cards and all, so that folders that don't match are never listed;
    below it everything is, and files whose names don't match are passed over."""
    parts = [p for p in f"{prefix}/{glob}".split("/") if p]
    head = parts[: next((k for k, p in enumerate(parts) if "**" in p), len(parts))]
    known = lambda p: re.sub(r"[{}\\]", lambda m: "\\" + m[0], p).replace("[!", "[^")
    path = "/".join([root.rstrip("/"), *map(known, head)])
    return path, known(parts[-1]) if len(head) < len(parts) and "**" not in parts[-1] else None


def list_blocks(spark: SparkSession, root: str, prefix: str = "", glob: str = "**") -> DataFrame:
    """Files below ``root`` whose key, the path behind it, matches: path, key, length and content. A file is opened for its content
    only, and only after its key has matched. None match: no rows."""
    folder, name = listed(root, prefix, glob)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        files = (reader.option("pathGlobFilter", name) if name else reader).load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, key string, length long, content binary")
    key = _key(spark, root, F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    # a condition on the file's path is decided before any file is read
    return files.filter(key.rlike(glob_pattern(prefix, glob))).select("path", key.alias("key"), "length", "content")


def read_blocks(spark: SparkSession, root: str, prefix: str = "", glob: str = "**", remove_prefix: str | None = None, compress_type: str | None = None) -> DataFrame:
    """Files below ``root`` whose key, the path behind it, matches: path, key, content (decompressed where asked)."""
    found = list_blocks(spark, root, prefix, glob).select("path", "key", "content")
    if remove_prefix:
        found = found.withColumn("key", F.replace("key", F.lit(f"{remove_prefix}/"), F.lit("")))
    if compress_type == "bzip2":
        found = found.withColumn("content", _bunzip("content"))
    return found


@F.pandas_udf(T.BinaryType())
def _bunzip(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else bz2.decompress(x))


def read_json_of_zips(changes: DataFrame, files: DataFrame, members: str | list[str], path: str = "path") -> DataFrame:
    """(path, member, text) of the JSON members, by pattern or list, of the archives that change rows name."""
    joined = files.join(changes.select(path).distinct(), path, "left_semi").select(path, "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame[path], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if re.search(members, member) if isinstance(members, str) else member in members:
                            rows.append((name, member, archive.read(member).decode()))
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return joined.mapInPandas(run, "path string, member string, text string")


class _Counted(io.RawIOBase):
    """A file that counts the bytes that are read from it."""

    def __init__(self, file):
        self.file, self.count = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        self.count += len(data)
        return len(data)


def read_members(changes: DataFrame, root: str, members: str | list[str], path: str = "path", missing: str = "fail") -> DataFrame:
    """The rows of ``changes`` with each JSON member, by pattern or list, of the archive that they name: member, text, and
    ``archive_read``, the bytes read of the archive so far. An archive is opened once, however many rows name it; of it its
    directory is read, and then the members that are wanted. ``missing``: ``skip`` passes over archives that are not there."""
    if missing not in ("fail", "skip"):
        raise ValueError(f"unknown way {missing}")
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, place = _file_system(f"{base}/{name.lstrip('/')}")
                try:
                    file = _Counted(system.open_input_file(place))
                except FileNotFoundError:
                    if missing == "skip":
                        continue
                    raise
                with zipfile.ZipFile(file) as archive:
                    for member in archive.namelist():
                        if re.search(members, member) if isinstance(members, str) else member in members:
                            text = archive.read(member).decode()
                            yield pa.record_batch([pa.array([v], t) for v, t in ((name, pa.string()), (member, pa.string()), (text, pa.string()), (file.count, pa.int64()))], ["of", "member", "text", "archive_read"])

    paths = changes.select(F.col(f"`{path}`").alias("path")).filter("path is not null").distinct()
    read = paths.mapInArrow(run, "of string, member string, text string, archive_read long")
    return changes.join(read, F.col(f"`{path}`") == F.col("of")).drop("of")


def zip_members(rows: DataFrame) -> DataFrame:
    """(path, content): an archive of the (member, text) rows of each path; a path's members are one archive's worth."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, text in sorted(zip(frame["member"], frame["text"], strict=True)):
                archive.writestr(member, text)
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [data.getvalue()]})

    return rows.groupBy("path").applyInPandas(run, "path string, content binary")


def scan_table(table: DataFrame, select: list[str] | None = None, incremental: str | None = None, mark=None, mode: str = ">", filters: dict | None = None, order: list | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Select, filter, order and page a table; the incremental column stays selected, the rest is pruned by the scan."""
    frame = table.filter(since(incremental, mark, mode)) if incremental else table
    frame = frame.filter(where(filters)) if filters else frame
    frame = frame.orderBy(*order_by(order)) if order else frame
    frame = limit_offset(frame, limit, offset)
    if select:
        frame = frame.select(*dict.fromkeys([*select, *([incremental] if incremental else [])]))
    return frame


#: What a filter of a document store calls a comparison.
MATCHES = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$not", "$regex", "$size", "$all", "$elemMatch")
Test = Callable[[Column, T.DataType], Column]


def _along(value: Column, kind: T.DataType, path: list[str], test: Test) -> Column:
    """Whether what lies at a dotted path passes a test: through arrays any element may, at its end the array itself, too."""
    if isinstance(kind, T.ArrayType):
        found = F.exists(value, lambda x: F.coalesce(_along(x, kind.elementType, path, test), F.lit(False)))
        if not path:
            return found | F.coalesce(test(value, kind), F.lit(False))
        if path[0].isdigit():
            found = found | F.coalesce(_along(F.get(value, F.lit(int(path[0]))), kind.elementType, path[1:], test), F.lit(False))
        return found
    if not path:
        return test(value, kind)
    if isinstance(kind, T.StructType) and path[0] in kind.names:
        return _along(value.getField(path[0]), kind[path[0]].dataType, path[1:], test)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _along(F.try_element_at(value, F.lit(path[0])), kind.valueType, path[1:], test)
    return test(F.lit(None), T.NullType())


def _comparable(kind: T.DataType, value) -> bool:
    """Values of other types are not compared, and so never match."""
    if isinstance(value, bool) or isinstance(kind, T.BooleanType):
        return isinstance(value, bool) and isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float, Decimal)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, (date, datetime)):
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return isinstance(value, str) and isinstance(kind, T.StringType) or isinstance(value, (bytes, bytearray)) and isinstance(kind, T.BinaryType)


def _equals(value: Column, kind: T.DataType, wanted) -> Column:
    if wanted is None:
        return value.isNull()
    if isinstance(wanted, (list, tuple)):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        each = [F.coalesce(_equals(F.get(value, F.lit(k)), kind.elementType, w), F.lit(False)) for k, w in enumerate(wanted)]
        return reduce(and_, each, F.size(value) == len(wanted))
    if isinstance(wanted, dict):
        if not isinstance(kind, T.StructType) or set(wanted) - set(kind.names):
            return F.lit(False)
        return reduce(and_, [F.coalesce(_equals(value.getField(f.name), f.dataType, wanted.get(f.name)), F.lit(False)) for f in kind], value.isNotNull())
    return value == F.lit(wanted) if _comparable(kind, wanted) else F.lit(False)


def _compares(sign: str, wanted) -> Test:
    call = {"$gt": gt, "$gte": ge, "$lt": lt, "$lte": le}[sign]
    return lambda value, kind: call(value, F.lit(wanted)) if _comparable(kind, wanted) else F.lit(False)


def _no(found: Column) -> Column:
    return ~F.coalesce(found, F.lit(False))


def _operator(value: Column, kind: T.DataType, path: list[str], name: str, wanted) -> Column:
    """One comparison of a document store at a path."""
    at = lambda test: _along(value, kind, path, test)
    any_of = lambda values, join=or_: reduce(join, [at(lambda v, k, w=w: _equals(v, k, w)) for w in values], F.lit(join is and_))
    whole = lambda test: lambda v, k: test(v, k) if isinstance(k, T.ArrayType) else F.lit(False)
    if name in ("$eq", "$ne"):
        return any_of([wanted]) if name == "$eq" else _no(any_of([wanted]))
    if name in ("$in", "$nin"):
        return any_of(wanted) if name == "$in" else _no(any_of(wanted))
    if name == "$all":
        return any_of(wanted, and_) if wanted else F.lit(False)
    if name == "$exists":
        there = at(lambda v, k: v.isNotNull())
        return there if wanted else _no(there)
    if name == "$not":
        return _no(reduce(and_, [_operator(value, kind, path, n, w) for n, w in wanted.items()]))
    if name == "$regex":
        return at(lambda v, k: v.rlike(wanted) if isinstance(k, T.StringType) else F.lit(False))
    if name == "$size":
        return at(whole(lambda v, k: F.size(v) == wanted))
    if name == "$elemMatch":
        if any(n.startswith("$") and n not in ("$and", "$or", "$nor") for n in wanted):
            inside = lambda x, k: reduce(and_, [_operator(x, k, [], n, w) for n, w in wanted.items()])
        else:
            inside = lambda x, k: _document(x, k, wanted)
        return at(whole(lambda v, k: F.exists(v, lambda x: F.coalesce(inside(x, k.elementType), F.lit(False)))))
    if name not in MATCHES:
        raise ValueError(f"unknown comparison {name}")
    return at(_compares(name, wanted))


def _document(value: Column | None, kind: T.DataType, match: dict) -> Column:
    conditions = []
    for name, wanted in match.items():
        if name in ("$and", "$or", "$nor"):
            parts = [_document(value, kind, x) for x in wanted]
            conditions.append(reduce(and_, parts) if name == "$and" else reduce(or_, parts) if name == "$or" else _no(reduce(or_, parts)))
            continue
        if name.startswith("$"):
            raise ValueError(f"unknown comparison {name}")
        path = name.split(".")
        if value is not None:
            start, inner, rest = value, kind, path
        elif path[0] in kind.names:
            start, inner, rest = F.col(quoted(path[0])), kind[path[0]].dataType, path[1:]
        else:
            start, inner, rest = F.lit(None), T.NullType(), []
        tests = wanted if isinstance(wanted, dict) and wanted and all(k.startswith("$") for k in wanted) else {"$eq": wanted}
        conditions += [_operator(start, inner, rest, n, w) for n, w in tests.items()]
    return reduce(and_, conditions, F.lit(True)) if len(conditions) != 1 else conditions[0]


def match_filter(match: dict, schema: T.StructType) -> Column:
    """A document store's filter over rows of ``schema`` as a Column.

    ``$and``, ``$or``, ``$nor``, ``$not``, the comparisons of ``MATCHES``, dotted paths through structs, maps and arrays, of which any
    element may match, and whole arrays and documents. A field that is null is one that is not there. Values of different types
    never match. Comparisons of plain columns stay what the optimizer pushes down to the scan."""
    return _document(None, schema, match)


def scan_documents(table: DataFrame, config: dict, mark=None, mode: str = ">") -> DataFrame:
    """A collection by its extractor's ``project``, ``sort`` ([field, 1 or -1] each) and ``match``, from a mark on."""
    select = [k for k, on in config["project"].items() if on] if config.get("project") else None
    order = [{"field": f, "direction": "DESC" if way < 0 else "ASC"} for f, way in config.get("sort") or []]
    frame = table.filter(match_filter(config["match"], table.schema)) if config.get("match") else table
    return scan_table(frame, select, config.get("incrementalField"), mark, mode, None, order)


def literal(value) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return "'" + str(value).replace("'", "''") + "'"
    return repr(value)


def jdbc_query(config: dict, mark=None, mode: str = ">") -> str:
    """The query of a database extractor: its columns and the incremental one, past the mark and by its own filter."""
    name = f"{config['schema']}.{config['table']}" if config.get("schema") else config["table"]
    fields = config.get("selectedFields")
    columns = ", ".join(dict.fromkeys([*fields, *([config["incrementalField"]] if config.get("incrementalField") else [])])) if fields else "*"
    conditions = [f"{config['incrementalField']} {'>=' if mode == '>=' else '>'} {literal(mark)}"] if mark is not None and config.get("incrementalField") else []
    conditions += [f"({config['filterSql']})"] if config.get("filterSql") else []
    return f"SELECT {columns} FROM {name}" + (f" WHERE {' AND '.join(conditions)}" if conditions else "")


def jdbc_source(url: str, query: str, partition: tuple[str, int, int, int] | None = None, batch: int | None = None, **options: str) -> dict[str, str]:
    """Options of a database read; ``partition``: column, lower, upper bound and number of partitions. Pages of the database
    are what its driver fetches at once, so rows need no order."""
    out = {"url": url, **({"fetchsize": str(batch)} if batch else {}), **options}
    if partition:
        column, low, high, n = partition
        return out | {"dbtable": f"({query}) q", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
    return out | {"query": query}


def jdbc_table(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, batch: int | None = None, **options: str) -> DataFrame:
    """A database table or query."""
    return spark.read.format("jdbc").options(**jdbc_source(url, query, partition, batch, **options)).load()


def jdbc_pages(spark: SparkSession, url: str, query: str, order: str, size: int, **options: str) -> DataFrame:
    """A database query in pages of about ``size`` rows, each a partition that a task of its own reads.

    Pages are ranges of the first column that ``order`` names. Its values alone are read first, and every ``size``-th becomes a
    bound; rows of one value stay together, and those without a value are in the first page. Unlike pages by offset, ranges
    need no sort in the database for each page, and rows that come in between shift none."""
    key = re.split(r"[,\s]", order.strip(), maxsplit=1)[0]
    keys = jdbc_table(spark, url, f"SELECT {key} FROM ({query}) k WHERE {key} IS NOT NULL", batch=size, **options)
    name = keys.columns[0]
    bounds = [r[0] for r in numbered(keys, [F.col(f"`{name}`")], "__at").filter((F.col("__at") > 0) & (F.col("__at") % size == 0)).select(name).distinct().orderBy(name).collect()]
    if not bounds:
        return jdbc_table(spark, url, query, batch=size, **options)
    edges = [f"({key} < {literal(bounds[0])} OR {key} IS NULL)"]
    edges += [f"{key} >= {literal(a)} AND {key} < {literal(b)}" for a, b in zip(bounds, bounds[1:])]
    return spark.read.jdbc(url, f"({query}) q", predicates=[*edges, f"{key} >= {literal(bounds[-1])}"], properties={"fetchsize": str(size), **options})


def run_of_file(name) -> dict:
    """Model, shuffle and run columns of a run file's name, ``<model>__sf<shuffle>__run<run>``."""
    pattern = r"^(.*)__sf(\d+)__run(\d+)"
    return {"model": F.regexp_extract(name, pattern, 1), "shuffle": F.regexp_extract(name, pattern, 2).try_cast("int"), "run": F.regexp_extract(name, pattern, 3).try_cast("int")}


def high_water_mark(frame: DataFrame, field: str):
    """The largest value, to start from next time; None of no rows."""
    return frame.agg(F.max(field)).first()[0]


def source_folder(template: str, execution_time=None) -> str:
    return render(template, execution_time)
