"""Entity-attribute-value rows to one wide, typed row per entity.

The entity-by-attribute grid is completed by exploding the attribute positions of each entity, the winning value of every
cell is left-joined, the values are collected in the order of their positions, and fixed indices of that array are projected
through a try-cast of each attribute's type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import pin


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: the key it comes from, the attribute source it is bound to (None: any), its type and reader.

    ``read`` turns a trimmed raw value into the text that is cast, or null where it can't be read.
    """

    name: str
    key: str
    type: str
    read: Callable[[Column], Column]
    source: str | None = None


def snake_key(key: Column) -> Column:
    """Any spelling of a key in lower snake case: trimmed, camel case split, spaces and hyphens as underscores."""
    split = F.regexp_replace(F.trim(key), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(split), r"[\s\-]+", "_")


def _matched(value: Column, pattern: str, text: Column | None = None) -> Column:
    return F.when(value.rlike(pattern), value if text is None else text)


def read_path(v: Column) -> Column:
    return _matched(v, r"^/\S+$")


def read_integer(v: Column) -> Column:
    """Digits with an optional sign, thousands marks (',', '.' or a space before three digits) or a zero fraction."""
    plain = _matched(v, r"^[+-]?\d+(\.0+)?$", F.regexp_replace(F.regexp_replace(v, r"\.0+$", ""), r"^\+", ""))
    grouped = _matched(v, r"^\+?\d{1,3}([,. \x{a0}\x{202f}']\d{3})+$", F.regexp_replace(v, r"[^0-9]", ""))
    return F.coalesce(plain, grouped)


def read_double(v: Column) -> Column:
    """A number with point or comma, perhaps out of ten."""
    bare = F.regexp_replace(F.regexp_replace(v, r"\s*/\s*10$", ""), ",", ".")
    return _matched(bare, r"^[+-]?\d+(\.\d+)?$")


def read_boolean(v: Column) -> Column:
    low = F.lower(v)
    return F.when(low.isin("true", "t", "yes", "y", "1"), "true").when(low.isin("false", "f", "no", "n", "0"), "false")


def read_minutes(v: Column) -> Column:
    """Minutes: a number, a number with 'min', hours and minutes, or an ISO duration."""
    low = F.lower(v)
    clock = r"^(?:pt)?(?:(\d+)\s*h(?:ours?|rs?)?)?\s*(?:(\d+)\s*m(?:in(?:ute)?s?)?\.?)?$"
    number = lambda g: F.coalesce(F.regexp_extract(low, clock, g).try_cast("int"), F.lit(0))
    return F.coalesce(_matched(low, r"^\d+$"), F.when(low.rlike(clock) & low.rlike(r"\d"), (number(1) * 60 + number(2)).cast("string")))


def read_date(v: Column) -> Column:
    """ISO dates with or without time, day.month.year, eight digits, and dates with an English month name."""
    iso = F.regexp_extract(v, r"^(\d{4}-\d{1,2}-\d{1,2})(?:[T ].*)?$", 1)
    dotted = F.regexp_replace(_matched(v, r"^\d{1,2}[./]\d{1,2}[./]\d{4}$"), r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", "$3-$2-$1")
    digits = F.regexp_replace(_matched(v, r"^\d{8}$"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    month = lambda w: (F.floor((F.position(F.lower(F.substring(w, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3)).cast("string")
    us = r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$"
    eu = r"^(\d{1,2})\.? ([A-Za-z]{3,9})\.?,? (\d{4})$"
    named = F.when(v.rlike(us), F.concat_ws("-", F.regexp_extract(v, us, 3), month(F.regexp_extract(v, us, 1)), F.regexp_extract(v, us, 2)))
    named = F.coalesce(named, F.when(v.rlike(eu), F.concat_ws("-", F.regexp_extract(v, eu, 3), month(F.regexp_extract(v, eu, 2)), F.regexp_extract(v, eu, 1))))
    text = F.coalesce(F.when(iso != "", iso), dotted, digits, named)
    return text.try_cast("date").cast("string")


CONTENT_ATTRIBUTES = [
    Attribute("imdb_id", "id", "string", lambda v: _matched(F.lower(v), r"^tt\d+$"), "imdb"),
    Attribute("tvdb_id", "id", "bigint", lambda v: _matched(v, r"^\d+$"), "tvdb"),
    Attribute("poster_path", "poster_path", "string", read_path),
    Attribute("backdrop_path", "backdrop_path", "string", read_path),
    Attribute("runtime", "runtime", "int", read_minutes),
    Attribute("vote_average", "vote_average", "double", read_double),
    Attribute("vote_count", "vote_count", "bigint", read_integer),
    Attribute("adult", "adult", "boolean", read_boolean),
    Attribute("season_count", "season_count", "int", read_integer),
    Attribute("release_date", "release_date", "date", read_date),
]
CONTENT_KEY = ["content_type", "content_source", "content_id"]


def attributes_to_wide(rows: DataFrame, attributes: list[Attribute] = CONTENT_ATTRIBUTES, entity: list[str] = CONTENT_KEY) -> DataFrame:
    """One row per entity with the typed columns of ``attributes``; ``rows``: entity columns, attr_source, attr_key, attr_value, created_at, updated_at.

    A cell takes the latest of its readable values (by updated_at, then created_at, then the greater text); it is null if no
    row of it can be read. Unknown attributes are ignored, but their entities are kept. Null entity columns form entities of
    their own. An entity that holds most rows is reduced before the shuffle by partial aggregation.
    """
    rows = rows.select(*entity, "attr_source", "attr_key", "attr_value", "created_at", "updated_at")
    bare = pin(rows, _key=snake_key(F.col("attr_key")), _source=F.lower(F.trim("attr_source")), _value=F.regexp_replace("attr_value", r"^\s+|\s+$", ""))
    position = F.lit(None).cast("int")
    for i, a in enumerate(attributes):
        here = (F.col("_key") == a.key) if a.source is None else (F.col("_key") == a.key) & (F.col("_source") == a.source)
        position = F.when(here, i).otherwise(position)
    placed = pin(bare, position=position).filter(F.col("position").isNotNull())
    text, castable = F.lit(None).cast("string"), F.lit(False)
    for read in dict.fromkeys(a.read for a in attributes):
        text = F.when(F.col("position").isin(*[i for i, a in enumerate(attributes) if a.read is read]), read(F.col("_value"))).otherwise(text)
    for kind in dict.fromkeys(a.type for a in attributes):
        castable = F.when(F.col("position").isin(*[i for i, a in enumerate(attributes) if a.type == kind]), F.col("text").try_cast(kind).isNotNull()).otherwise(castable)
    read_rows = pin(placed, text=text).filter(castable).select(*entity, "position", "text", "updated_at", "created_at")
    cells = (
        read_rows.groupBy(*entity, "position")
        .agg(F.max(F.struct("updated_at", "created_at", "text"))["text"].alias("text"))
    )
    grid = rows.select(*entity).distinct().withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(len(attributes) - 1))))
    same = [grid[c].eqNullSafe(cells[c]) for c in entity] + [grid["position"] == cells["position"]]
    filled = grid.join(cells, same, "left").select(*[grid[c] for c in entity], grid["position"], cells["text"])
    arrays = filled.groupBy(*entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("row"))
    return arrays.select(*entity, *[F.get("row", F.lit(i)).try_cast(a.type).alias(a.name) for i, a in enumerate(attributes)])


def wide_cells(wide: DataFrame, attributes: list[Attribute] = CONTENT_ATTRIBUTES, entity: list[str] = CONTENT_KEY) -> DataFrame:
    """(entity columns, attribute) of the non-null cells of a wide table."""
    names = F.array_compact(F.array(*[F.when(F.col(a.name).isNotNull(), F.lit(a.name)) for a in attributes]))
    return wide.select(*entity, F.explode(names).alias("attribute"))
