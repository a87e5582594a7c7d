"""Fields of agent records that the declared schema does not have, by path.

Records are kept as VARIANT next to the flat columns. A path is looked up in the binary form, so the
text is parsed once, when it is stored, and a new field needs no new schema.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.columns import computed_once
from tracewarden.operators.agent_events import agent_events_flattened

RECORD = "open_record"


def with_open_record(events: DataFrame) -> DataFrame:
    """Flattened events with their record as VARIANT (NULL if it is not JSON) in place of its text."""
    opened = computed_once(events, F.try_parse_json("raw_record").alias(RECORD))
    return opened.drop("raw_record")


def open_agent_events(raw_events: DataFrame) -> DataFrame:
    return with_open_record(agent_events_flattened(raw_events))


def at_paths(events: DataFrame, paths: Mapping[str, str | tuple[str, str]], strict: bool = False) -> DataFrame:
    """Adds a column per name, the value of the record at a path.

    A path is ``$.field``, ``$.list[0].field`` or ``$['odd name']``, alone (text) or with a Spark SQL
    type. A path that is not there gives NULL, and so does a value that is not of its type, unless ``strict``
    (then Spark raises an error). Names must be new.
    """
    get = F.variant_get if strict else F.try_variant_get
    columns = {}
    for name, path in paths.items():
        if name in events.columns:
            raise ValueError(f"there is a column {name!r} already")
        where, kind = (path, "string") if isinstance(path, str) else path
        columns[name] = get(RECORD, where, kind)
    return events.withColumns(columns)


def paths_in(events: DataFrame) -> DataFrame:
    """(path, type, events): the top-level fields that records have, to see what could be asked for."""
    fields = events.select(F.explode(F.expr(f"try_variant_get({RECORD}, '$', 'map<string, variant>')")).alias("field", "value"))
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0)
    found = fields.groupBy(F.concat(F.lit("$."), "field").alias("path"), kind.alias("type"))
    return found.agg(F.count(F.lit(1)).alias("events"))
