"""Running pipelines and transformers: extract, transform by SQL, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.registry import Pipeline, Registry, Transformer
from loomline.plans.templates import render
from loomline.sources import readers, writers
from loomline.sources.marks import Marks


def private_columns(frame: DataFrame, prefix: str, fields: dict) -> DataFrame:
    """Constant lineage columns ``<prefix>-<field>``."""
    return frame.withColumns({f"{prefix}-{name}": value if hasattr(value, "_jc") else F.lit(value) for name, value in fields.items()})


def transform(spark: SparkSession, data: DataFrame, sql: str | None) -> DataFrame:
    """SQL over the whole input, which it knows as ``data``."""
    if not sql:
        return data
    data.createOrReplaceTempView("data")
    try:
        return spark.sql(sql)
    finally:
        spark.catalog.dropTempView("data")


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def intersection(frames: list[DataFrame]) -> DataFrame:
    """Rows that every frame has, each once: one shuffle of what is left of each frame's own different rows."""
    first, *rest = frames
    names = [F.col(f"`{c}`") for c in first.columns]
    tagged = first.distinct().withColumn("__of", F.lit(0))
    for k, frame in enumerate(rest, 1):
        tagged = tagged.unionByName(frame.distinct().withColumn("__of", F.lit(k)))
    return tagged.groupBy(*names).agg(F.count("*").alias("__n")).filter(F.col("__n") == len(frames)).drop("__n")


def run_transformer(spark: SparkSession, transformer: Transformer, execution_time=None) -> DataFrame | None:
    """Read the views, run the SQL, overwrite the destination; None, and nothing written, where a folder is missing."""
    folder = render(transformer.src_folder, execution_time)
    frames = {v.alias: readers.read_view(spark, folder, v) for v in transformer.views}
    if any(f is None for f in frames.values()):
        return None
    for alias, frame in frames.items():
        frame.createOrReplaceTempView(alias)
    destination = render(transformer.dst_folder, execution_time)
    result = spark.sql(transformer.transform_sql)
    writers.overwrite_parquet(result, destination)
    return spark.read.schema(result.schema).parquet(destination)


def _rendered(config: dict, name: str, execution_time, default=None):
    return render(config[name], execution_time) if config.get(name) else default


def named_members(changes: DataFrame, config: dict) -> DataFrame:
    """The members of the archives that rows of a change table name."""
    return readers.read_members(changes, config["root"], config["members"], config["pathField"], config.get("missing", "fail"))


def extract(spark: SparkSession, registry: Registry, name: str, execution_time=None, mark=None, mode: str = ">") -> DataFrame:
    """Rows of an extractor: storage files as a table, a database's table by JDBC where the extractor has a ``url`` or its
    connection a ``dsn``, or a table or view that the session knows by name. Of a change table, its rows."""
    ext = registry.get("extractors", name)
    config = ext.config
    if ext.kind == "awsStorage":
        return readers.read_table_files(spark, config.get("root", "").rstrip("/") or "/", config.get("fileType", "parquet"), render(config["prefix"], execution_time), _rendered(config, "pathGlobFilter", execution_time), config.get("compressType"), config.get("recursive", True))
    dsn = config.get("url") or next((c.config["dsn"] for c in registry.dependencies("extractors", name) if "dsn" in c.config), None)
    if ext.kind != "mongo" and dsn:
        query, options = readers.jdbc_query(config, mark, mode), config.get("options", {})
        if ext.kind == "sqlServer" and not config.get("partition"):
            return readers.jdbc_pages(spark, dsn, query, config["orderSql"], config["batchSize"], **options)
        return readers.jdbc_table(spark, dsn, query, config.get("partition"), config.get("batchSize"), **options)
    if ext.kind == "mongo":
        return readers.scan_documents(spark.table(config["collection"]), config, mark, mode)
    frame = readers.scan_table(spark.table(config["table"]), None, config.get("incrementalField"), mark, mode)
    frame = frame.filter(config["filterSql"]) if config.get("filterSql") else frame
    return readers.scan_table(frame, config.get("selectedFields"), config.get("incrementalField"))


def _place(config: dict, name: str, execution_time) -> str:
    """A loader's folder, below its root where it has one."""
    folder = render(config[name], execution_time)
    return f"{config['root'].rstrip('/')}/{folder}" if "root" in config else folder


def deliver(spark: SparkSession, registry: Registry, pipeline: Pipeline, data: DataFrame, execution_time=None, mark=None, version: int | None = None, field: str | None = None) -> None:
    """Bring rows to where the pipeline's loader says: a table by JDBC, named files of ``batchSize`` rows, or a folder.

    With a ``version`` only that version's rows are replaced, so that a load that runs again repeats nothing."""
    loader = registry.get("loaders", pipeline.loader)
    config = loader.config
    if "table" in config:
        dsn = config.get("url") or next((c.config["dsn"] for c in registry.dependencies("loaders", loader.name) if "dsn" in c.config), None)
        if dsn is None:
            raise ValueError(f"loader {loader.name} has a table but neither a url nor a connection with a dsn")
        if version is None:
            writers.write_jdbc(data, dsn, config["table"], config.get("batchSize", 10_000), **config.get("options", {}))
        else:
            writers.replace_jdbc(data, dsn, config["table"], "etl_version", version, config.get("batchSize", 10_000), **config.get("options", {}))
    elif "batchSize" in config:
        order = field if field in data.columns else data.columns[0]
        writers.write_named_batches(data, _place(config, "folder", execution_time), pipeline.name, order, config.get("fileType", "json"), config["batchSize"], None if mark is None else str(mark), version is None, version)
    elif version is None:
        writers.overwrite_parquet(data, _place(config, "folder", execution_time))
    else:
        writers.overwrite_parquet(data, f"{_place(config, 'folder', execution_time)}/version={version}")


def run_pipeline(spark: SparkSession, registry: Registry, name: str, execution_time=None, mark=None, marks: Marks | None = None) -> DataFrame | int | None:
    """Run a registered pipeline: rows written, or the number of files copied.

    ``marks``: where the pipeline's loads and their marks are kept. What lies past the last mark is read, and the mark moves when,
    and only if, the rows have been delivered; None where nothing is new."""
    pipeline: Pipeline = registry.get("pipelines", name)
    if pipeline.mode == "copyFile":
        config = registry.get("extractors", pipeline.extractor).config
        remove = _rendered(config, "removePrefixPath", execution_time) or _rendered(config, "removePrefix", execution_time)
        blocks = readers.read_blocks(spark, config["root"], render(config["prefix"], execution_time), _rendered(config, "pathGlobFilter", execution_time, "**"), remove)
        return writers.copy_files(blocks, _place(registry.get("loaders", pipeline.loader).config, "folder", execution_time))
    field = registry.get("extractors", pipeline.extractor).config.get("incrementalField")

    source_of = registry.get("extractors", pipeline.extractor)
    changes = source_of.kind == "gcpStorageCdc"

    def shaped(data: DataFrame, since) -> DataFrame:
        data = transform(spark, named_members(data, source_of.config) if changes else data, pipeline.transform_sql)
        if pipeline.include_private_fields:
            data = private_columns(data, pipeline.private_field_prefix, {"incrementalValue": None if since is None else str(since), "extNameValue": pipeline.extractor, "pipelineNameValue": pipeline.name})
        if pipeline.tag:
            data = private_columns(data, pipeline.private_field_prefix, {"tagNameValue": pipeline.tag})
        return data.select([F.col(f"`{n}`").cast("string").alias(n) if t == "void" else F.col(f"`{n}`") for n, t in data.dtypes])

    if marks is not None:
        if not field:
            raise ValueError(f"the extractor of {name} has no incrementalField, which marks need")
        last = marks.latest(name)
        since = None if last is None else last.mark
        changed = changes or pipeline.transform_sql or pipeline.include_private_fields or pipeline.tag
        source = extract(spark, registry, pipeline.extractor, execution_time)
        return marks.load(name, source, field, pipeline.incremental_mode, (lambda d: shaped(d, since)) if changed else None, lambda d, version: deliver(spark, registry, pipeline, d, execution_time, since, version, field))
    data = shaped(extract(spark, registry, pipeline.extractor, execution_time, mark, pipeline.incremental_mode), mark)
    deliver(spark, registry, pipeline, data, execution_time, mark, field=field)
    config = registry.get("loaders", pipeline.loader).config
    return data if "table" in config or "batchSize" in config else spark.read.parquet(_place(config, "folder", execution_time))
