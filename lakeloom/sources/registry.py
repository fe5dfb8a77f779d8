"""Source types and how Spark reads them. Every reader is lazy; options go to Spark as configured."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ntriples import read_ntriples

Options = dict[str, str]
Reader = Callable[[SparkSession, str, Options], DataFrame]


class SourceError(ValueError):
    pass


class SourceRegistry:
    def __init__(self, readers: dict[str, Reader] | None = None):
        self.readers = dict(readers or {})

    def register(self, store: str, reader: Reader) -> None:
        self.readers[store.lower()] = reader

    def read(self, spark: SparkSession, store: str, source: str, options: Options) -> DataFrame:
        if store.lower() not in self.readers:
            raise SourceError(f"no reader for sources of type {store!r}; known: {', '.join(sorted(self.readers))}")
        return self.readers[store.lower()](spark, source, options)


def read_csv(spark: SparkSession, source: str, options: Options) -> DataFrame:
    """Under DROPMALFORMED whole lines are parsed: with pruned columns, malformed lines would come and go with the columns asked for."""
    reader = spark.read.options(**options)
    if options.get("mode", "").upper() == "DROPMALFORMED":
        reader = reader.option("columnPruning", "false")
    return reader.csv(source)


def file_reader(fmt: str) -> Reader:
    return lambda spark, source, options: spark.read.options(**options).format(fmt).load(source)


def stream_reader(spark: SparkSession, source: str, options: Options) -> DataFrame:
    """A folder of growing files: option format (parquet), and schema as DDL."""
    rest = {k: v for k, v in options.items() if k not in ("format", "schema")}
    reader = spark.readStream.options(**rest).format(options.get("format", "parquet"))
    return (reader.schema(options["schema"]) if "schema" in options else reader).load(source)


def connector_options(store: str, source: str, options: Options) -> tuple[str, Options]:
    """(Spark format, its options) of the stores that need a connector on the class path."""
    if store == "cassandra":
        return "org.apache.spark.sql.cassandra", options
    if store == "elasticsearch":
        return "org.elasticsearch.spark.sql", {"es.resource": source, **options}
    if store == "mongodb":
        rest = {k: v for k, v in options.items() if k not in ("url", "database", "collection", "options")}
        address = options.get("url", "")
        address = address if address.startswith("mongodb") else f"mongodb://{address}"
        if options.get("options"):
            address += ("&" if "?" in address else "/?") + options["options"].lstrip("?")
        return "mongodb", {"connection.uri": address, "database": options.get("database", ""), "collection": options.get("collection", source), **rest}
    if store == "neo4j":
        rest = {k: v for k, v in options.items() if k not in ("nodes", "database")}
        label = options.get("nodes") or source
        return "org.neo4j.spark.DataSource", {"labels": label if label.startswith(":") else f":{label}", **({"database": options["database"]} if options.get("database") else {}), **rest}
    if store == "jdbc":
        parts = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        given = [p for p in parts if p in options]
        if given and len(given) != len(parts):
            raise SourceError(f"a partitioned JDBC source needs {', '.join(parts)}")
        return "jdbc", {"dbtable": source, **options} if "query" not in options else options
    raise SourceError(f"{store} needs no connector")


def connector(store: str) -> Reader:
    def read(spark: SparkSession, source: str, options: Options) -> DataFrame:
        fmt, given = connector_options(store, source, options)
        return spark.read.format(fmt).options(**given).load()

    return read


def default_registry() -> SourceRegistry:
    out = SourceRegistry({"csv": read_csv, "rdf": read_ntriples, "ntriples": read_ntriples, "stream": stream_reader})
    for fmt in ("parquet", "orc", "json"):
        out.register(fmt, file_reader(fmt))
    for store in ("cassandra", "elasticsearch", "mongodb", "neo4j", "jdbc"):
        out.register(store, connector(store))
    return out
