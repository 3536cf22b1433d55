"""All registered queries of the engine, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbweave.plans import analysis, effects, extras, fields, lookups, more, networks, places, polygons, reports, shapes, shelves, streams, tables, terrain
from orbweave.plans.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]

_CATALOGS: list[Catalog] = [m.FOUND for m in (tables, places, analysis, more, shapes, shelves, extras, polygons, terrain, fields, networks, lookups, streams, reports, effects)]
QUERIES: dict[str, Query] = {name: q for c in _CATALOGS for name, q in c.queries.items()}
ORACLES: dict[str, str] = {name: sql for c in _CATALOGS for name, sql in c.oracles.items()}
FLAGSHIP = "d05_summarize_within"
