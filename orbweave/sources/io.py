"""Loading and saving by extension: lazy readers, no data through the driver."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column pairs that hold coordinates, in order of preference.
COORDINATES = (("lng", "lat"), ("lon", "lat"), ("longitude", "latitude"), ("x", "y"))


def coordinates(df: DataFrame) -> tuple[str, str] | None:
    by = {c.lower(): c for c in df.columns}
    return next(((by[x], by[y]) for x, y in COORDINATES if x in by and y in by), None)


def with_point(df: DataFrame) -> DataFrame:
    """A ``geometry`` struct (x, y) from the first coordinate pair; its CRS goes to the column's metadata."""
    pair = coordinates(df)
    if pair is None:
        raise ValueError(f"no coordinate columns among {df.columns}")
    crs = "EPSG:4326" if "lat" in pair[1].lower() else None
    return df.withColumn("geometry", F.struct(F.col(pair[0]).cast("double").alias("x"), F.col(pair[1]).cast("double").alias("y")).alias("geometry", metadata={"crs": crs} if crs else {}))


def materialized(df: DataFrame) -> DataFrame:
    """df written once to the folder that the cluster shares (spark.checkpoint.dir) and read again, for plans that use it in rounds."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not held.isDefined() and master != "local" and not master.startswith(("local[", "local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    out = f"{root.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def load(spark: SparkSession, uri: str, schema: str | None = None) -> DataFrame:
    """A table name without extension, or a file or folder of parquet, orc, csv, json lines, geojson or text."""
    kind = PurePosixPath(uri).suffix.lower().lstrip(".")
    read = spark.read.schema(schema) if schema else spark.read
    if not kind:
        return spark.table(uri)
    if kind == "csv":
        return read.option("header", True).option("inferSchema", schema is None).csv(uri)
    if kind == "geojson":
        return features(spark, uri)
    if kind in ("txt", "md"):
        return spark.read.option("wholetext", True).text(uri)
    return read.format({"json": "json", "jsonl": "json"}.get(kind, kind)).load(uri)


def features(spark: SparkSession, uri: str) -> DataFrame:
    """The features of a GeoJSON collection: geometry type, coordinates as JSON text, properties as a map."""
    raw = spark.read.option("wholetext", True).text(uri)
    one = F.from_json("value", "struct<features: array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>>")
    return raw.select(F.explode(one["features"]).alias("f")).select(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def as_features(df: DataFrame, x: str, y: str) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    rest = F.struct(*(c for c in df.columns if c not in (x, y)))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), rest.alias("properties"))).alias("feature"))


def save(df: DataFrame, uri: str, mode: str = "errorifexists") -> None:
    kind = PurePosixPath(uri).suffix.lower().lstrip(".")
    writer = df.write.mode(mode)
    if not kind:
        writer.saveAsTable(uri)
    elif kind == "csv":
        writer.option("header", True).csv(uri)
    else:
        writer.format(kind).save(uri)


def tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """table, kind, temporary of the tables and views that the session sees, whose name matches a pattern with * and | ; only names come to the driver."""
    found = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(pattern=pattern)]
    return spark.createDataFrame(found, "table string, kind string, temporary boolean").orderBy("table")


def columns(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """table, position (from 1), column, type, nullable, description of every column of ``tables``, read from the catalog alone."""
    found = [(t.name, i, c.name, c.dataType, c.nullable, c.description) for t in spark.catalog.listTables(pattern=pattern) for i, c in enumerate(spark.catalog.listColumns(f"`{t.name.replace('`', '``')}`"), 1)]
    return spark.createDataFrame(found, "table string, position int, column string, type string, nullable boolean, description string").orderBy("table", "position")


def query_to(spark: SparkSession, sql: str, uri: str, mode: str = "errorifexists", **args: object) -> None:
    """The whole result of a query that only reads (``read_only``, without a limit) written by ``save``."""
    save(read_only(spark, sql, None, **args), uri, mode)


#: Nodes of a parsed plan that only read.
READING = frozenset(
    "Project Filter Aggregate Join AsOfJoin LateralJoin Sort GlobalLimit LocalLimit LimitAll Limit Offset Tail Distinct Union Except Intersect SubqueryAlias UnresolvedRelation "
    "UnresolvedWith UnresolvedHaving UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases UnresolvedHint OneRowRelation LocalRelation Range "
    "Generate Window WithWindowDefinition Pivot Unpivot Sample RepartitionByExpression Repartition Expand NamedParametersPlaceholder "
    "NameParameterizedQuery Values ResolvedInlineTable RelationTimeTravel".split()
)


#: Functions that Spark ships but that reach beyond the query: they call classes of the driver or end a task.
REACHING = frozenset("reflect java_method try_reflect raise_error assert_true".split())


def _each(seq: object):
    for k in range(seq.size()):
        yield seq.apply(k)


def _kind(node: object) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _expressions(expression: object):
    yield expression
    for child in _each(expression.children()):
        yield from _expressions(child)


def _nodes(plan: object):
    yield plan
    for part in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for node in _each(part):
            if hasattr(node, "innerChildren"):
                yield from _nodes(node)


def _calls(node: object):
    """Names of the functions that a node's expressions call."""
    if _kind(node) == "UnresolvedTableValuedFunction":
        yield ".".join(_each(node.name()))
    for top in _each(node.expressions()):
        for e in _expressions(top):
            if _kind(e) == "UnresolvedFunction":
                yield ".".join(_each(e.nameParts()))
            elif _kind(e) == "UnresolvedGenerator":
                yield e.name().funcName()


def read_only(spark: SparkSession, sql: str, limit: int | None = 1000, **args: object) -> DataFrame:
    """A query with named parameters. No words of its text decide, but its parsed plan.

    Every node must be one that only reads (READING), every function one that Spark ships and that does not reach
    beyond the query (REACHING), so neither user-defined functions nor reflection run; every relation must be a table,
    a view or a name of the query's own WITH, so no path is opened.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    shipped = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    tables = spark._jvm.org.apache.spark.sql.catalyst.analysis.TableFunctionRegistry.builtin()
    name_of = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for node in _nodes(plan):
        if _kind(node) not in READING:
            raise PermissionError(f"only queries are allowed, not {_kind(node)}")
        for name in _calls(node):
            plain = name_of(name.lower())
            if name.lower() in REACHING or not (shipped.functionExists(plain) or tables.functionExists(plain)):
                raise PermissionError(f"the function {name} is not allowed")
        if _kind(node) == "UnresolvedRelation" and (parts := list(_each(node.multipartIdentifier()))) and len(parts) > 1:
            quoted = ".".join(f"`{p.replace('`', '``')}`" for p in parts)
            if not spark.catalog.tableExists(quoted):
                raise PermissionError(f"{quoted} is no table")
    df = spark.sql(sql, args=args)
    return df if limit is None else df.limit(limit)
