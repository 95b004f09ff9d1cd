"""Named configurations of connections, extractors, loaders, pipelines and transformers, checked when they are added."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from loomline.sources.readers import JsonView


class ConfigError(ValueError):
    """A configuration that cannot be accepted: ``errors`` maps its fields to what is wrong with them."""

    def __init__(self, errors: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in errors.items()))
        self.errors = errors


#: Kinds of each configuration and the fields that each has to have.
CONNECTIONS = {"aws": ["accessKey", "secretKey"], "gcp": ["serviceAccount"], "huggingFace": ["token"], "spark": ["dns"], "sqlServer": ["dsn"], "clickHouse": ["dsn"], "postgres": ["dsn"], "local": []}
EXTRACTORS = {"awsStorage": ["prefix"], "sqlServer": ["table", "batchSize", "orderSql"], "postgres": ["table"], "mongo": ["collection"], "gcpStorageCdc": ["table", "pathField", "members", "root"]}
LOADERS = {"huggingFace": ["folder"], "clickHouse": ["table"], "local": ["folder"]}
OPTIONAL = {"gcpStorageCdc": ["incrementalField", "filterSql", "missing", "url", "options", "schema", "batchSize", "selectedFields"], "awsStorage": ["bucketName", "pathGlobFilter", "removePrefix", "removePrefixPath", "recursive", "fileType", "compressType", "root"], "sqlServer": ["schema", "filterSql", "incrementalField", "selectedFields", "url", "partition", "options"], "postgres": ["schema", "filterSql", "batchSize", "incrementalField", "selectedFields", "url", "partition", "options"], "mongo": ["match", "sort", "project", "incrementalField"], "huggingFace": ["repoId", "root", "batchSize", "fileType"], "clickHouse": ["batchSize", "url", "options"], "local": ["root", "batchSize", "fileType"], "aws": ["endpoint", "region"], "gcp": [], "spark": []}
MODES = ("copyFile", "transform")
INCREMENTAL_MODES = (">", ">=")


@dataclass(frozen=True)
class Config:
    name: str
    kind: str
    config: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ()

    def __repr__(self) -> str:
        """Secrets stay out of logs."""
        return f"Config({self.name!r}, {self.kind!r}, fields={sorted(self.config)}, needs={self.needs})"


@dataclass(frozen=True)
class Pipeline:
    name: str
    extractor: str
    loader: str
    mode: str = "transform"
    transform_sql: str | None = None
    include_private_fields: bool = False
    private_field_prefix: str = "__etl_private_field__"
    tag: str | None = None
    incremental_mode: str = ">"


@dataclass(frozen=True)
class Transformer:
    name: str
    src_folder: str
    dst_folder: str
    views: tuple[JsonView, ...]
    transform_sql: str
    connection: str | None = None


def tidy_sql(sql: str) -> str:
    """Trimmed, without blank lines or a closing semicolon."""
    return "\n".join(x.rstrip() for x in sql.strip().rstrip(";").splitlines() if x.strip())


class Registry:
    """Configurations by name. Names are unique, and whatever a configuration needs has to be there before it."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark
        self.connections: dict[str, Config] = {}
        self.extractors: dict[str, Config] = {}
        self.loaders: dict[str, Config] = {}
        self.pipelines: dict[str, Pipeline] = {}
        self.transformers: dict[str, Transformer] = {}

    @staticmethod
    def _new(table: dict, name: str, what: str) -> None:
        if not name or not name.strip():
            raise ConfigError({"name": "a name is needed"})
        if name in table:
            raise ConfigError({"name": f"{what} {name} exists already"})

    @staticmethod
    def _shape(kind: str, config: dict, kinds: dict[str, list[str]]) -> None:
        if kind not in kinds:
            raise ConfigError({"kind": f"unknown kind {kind}"})
        errors = {f: "is needed" for f in kinds[kind] if f not in config}
        errors |= {f: "is not known" for f in config if f not in kinds[kind] and f not in OPTIONAL.get(kind, [])}
        if errors:
            raise ConfigError(errors)

    def _add(self, table: dict, kinds: dict, what: str, name: str, kind: str, config: dict, needs: list[str]) -> Config:
        self._new(table, name, what)
        self._shape(kind, config, kinds)
        if missing := {n: "no such connection" for n in needs if n not in self.connections}:
            raise ConfigError(missing)
        table[name] = Config(name, kind, dict(config), tuple(needs))
        return table[name]

    def add_conn(self, name: str, kind: str, config: dict | None = None) -> Config:
        return self._add(self.connections, CONNECTIONS, "connection", name, kind, config or {}, [])

    def add_ext(self, name: str, kind: str, config: dict, needs: list[str] | None = None) -> Config:
        return self._add(self.extractors, EXTRACTORS, "extractor", name, kind, config, needs or [])

    def add_loader(self, name: str, kind: str, config: dict, needs: list[str] | None = None) -> Config:
        return self._add(self.loaders, LOADERS, "loader", name, kind, config, needs or [])

    def _sql(self, sql: str | None) -> str | None:
        if sql is None:
            return None
        sql = tidy_sql(sql)
        if self.spark is not None:
            try:
                self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
            except Exception as error:
                raise ConfigError({"transformSql": str(error).split("\n")[0]}) from error
        return sql

    def add_pipeline(self, pipeline: Pipeline) -> Pipeline:
        self._new(self.pipelines, pipeline.name, "pipeline")
        errors = {}
        if pipeline.extractor not in self.extractors:
            errors["extractor"] = f"no extractor {pipeline.extractor}"
        if pipeline.loader not in self.loaders:
            errors["loader"] = f"no loader {pipeline.loader}"
        if pipeline.mode not in MODES:
            errors["mode"] = f"unknown mode {pipeline.mode}"
        if pipeline.incremental_mode not in INCREMENTAL_MODES:
            errors["incrementalMode"] = f"unknown mode {pipeline.incremental_mode}"
        if pipeline.mode == "copyFile" and not errors and (pipeline.transform_sql or self.extractors[pipeline.extractor].kind != "awsStorage"):
            errors["mode"] = "files can only be copied from storage, and without SQL"
        if errors:
            raise ConfigError(errors)
        made = Pipeline(**{**pipeline.__dict__, "transform_sql": self._sql(pipeline.transform_sql)})
        self.pipelines[made.name] = made
        return made

    def add_transformer(self, transformer: Transformer) -> Transformer:
        self._new(self.transformers, transformer.name, "transformer")
        names = [v.alias for v in transformer.views]
        if not names or len(set(names)) < len(names):
            raise ConfigError({"views": "each view needs a name of its own"})
        if transformer.connection and transformer.connection not in self.connections:
            raise ConfigError({"connection": f"no connection {transformer.connection}"})
        made = Transformer(**{**transformer.__dict__, "transform_sql": self._sql(transformer.transform_sql)})
        self.transformers[made.name] = made
        return made

    def all(self, table: str, **wanted) -> list:
        """Configurations of a table, by name; with ``wanted``, those whose fields have these values."""
        return [c for _, c in sorted(getattr(self, table).items()) if all(getattr(c, k) == v for k, v in wanted.items())]

    def exists(self, table: str, name: str) -> bool:
        return name in getattr(self, table)

    def get(self, table: str, name: str):
        found = getattr(self, table).get(name)
        if found is None:
            raise ConfigError({"name": f"no such name: {name}"})
        return found

    def dependencies(self, table: str, name: str) -> list[Config]:
        return [self.connections[n] for n in self.get(table, name).needs]
