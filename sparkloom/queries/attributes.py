"""Queries of problem 6: attribute rows to wide tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.wide import attributes_to_wide, wide_cells
from sparkloom.session import table

_CELLS = r"""
WITH raw AS (
  SELECT content_type, content_source, content_id, updated_at, created_at, lower(trim(attr_source)) AS src,
         regexp_replace(lower(regexp_replace(trim(attr_key), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[\s\-]+', '_', 'g') AS k,
         regexp_replace(attr_value, '^\s+|\s+$', '', 'g') AS v
  FROM content_attributes),
named AS (
  SELECT *, CASE WHEN k = 'id' AND src = 'imdb' THEN 'imdb_id' WHEN k = 'id' AND src = 'tvdb' THEN 'tvdb_id'
                 WHEN k IN ('poster_path','backdrop_path','runtime','vote_average','vote_count','adult','season_count','release_date') THEN k END AS a,
         regexp_replace(regexp_replace(v, '\s*/\s*10$', ''), ',', '.', 'g') AS num,
         regexp_extract(lower(v), '^(?:pt)?(?:(\d+)\s*h(?:ours?|rs?)?)?\s*(?:(\d+)\s*m(?:in(?:ute)?s?)?\.?)?$', ['h','m']) AS clock
  FROM raw),
readable AS (
  SELECT *, CASE a
    WHEN 'imdb_id' THEN CASE WHEN regexp_full_match(lower(v), 'tt\d+') THEN lower(v) END
    WHEN 'tvdb_id' THEN CASE WHEN regexp_full_match(v, '\d+') THEN TRY_CAST(v AS BIGINT)::VARCHAR END
    WHEN 'poster_path' THEN CASE WHEN regexp_full_match(v, '/\S+') THEN v END
    WHEN 'backdrop_path' THEN CASE WHEN regexp_full_match(v, '/\S+') THEN v END
    WHEN 'runtime' THEN CASE WHEN regexp_full_match(v, '\d+') THEN TRY_CAST(v AS INTEGER)::VARCHAR
                             WHEN clock.h <> '' OR clock.m <> '' THEN (coalesce(TRY_CAST(clock.h AS INTEGER), 0) * 60 + coalesce(TRY_CAST(clock.m AS INTEGER), 0))::VARCHAR END
    WHEN 'vote_average' THEN CASE WHEN regexp_full_match(num, '[+-]?\d+(\.\d+)?') THEN num END
    WHEN 'adult' THEN CASE WHEN lower(v) IN ('true','t','yes','y','1') THEN 'true' WHEN lower(v) IN ('false','f','no','n','0') THEN 'false' END
    WHEN 'release_date' THEN coalesce(
        TRY_CAST(CASE WHEN regexp_full_match(v, '\d{4}-\d{1,2}-\d{1,2}([T ].*)?') THEN regexp_extract(v, '^\d{4}-\d{1,2}-\d{1,2}') END AS DATE),
        TRY_CAST(CASE WHEN regexp_full_match(v, '\d{1,2}[./]\d{1,2}[./]\d{4}') THEN regexp_replace(v, '(\d{1,2})[./](\d{1,2})[./](\d{4})', '\3-\2-\1') END AS DATE),
        TRY_CAST(CASE WHEN regexp_full_match(v, '\d{8}') THEN regexp_replace(v, '(\d{4})(\d{2})(\d{2})', '\1-\2-\3') END AS DATE),
        try_strptime(v, ['%B %d, %Y', '%b %d, %Y', '%d %b %Y', '%d %B %Y'])::DATE)::VARCHAR
    ELSE CASE WHEN regexp_full_match(v, '[+-]?\d+(\.0+)?') THEN TRY_CAST(regexp_replace(regexp_replace(v, '\.0+$', ''), '^\+', '') AS BIGINT)::VARCHAR
              WHEN regexp_full_match(v, '\+?\d{1,3}([,. ]\d{3})+') THEN TRY_CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT)::VARCHAR END
    END AS t
  FROM named WHERE a IS NOT NULL),
cells AS (
  SELECT content_type, content_source, content_id, a, arg_max(t, row(updated_at, created_at, t)) AS t
  FROM readable WHERE t IS NOT NULL GROUP BY ALL)
"""


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return wide_cells(attributes_to_wide(table(spark, sf, "content_attributes")))


def p6_wide(spark: SparkSession, sf: str) -> DataFrame:
    return attributes_to_wide(table(spark, sf, "content_attributes"))


QUERIES = {"p6_found": p6_found, "p6_wide": p6_wide}
ORACLE = {
    "p6_found": _CELLS + "SELECT content_type, content_source, content_id, a AS attribute FROM cells",
    "p6_wide": _CELLS
    + """SELECT e.*, max(t) FILTER (a = 'imdb_id') AS imdb_id, max(t) FILTER (a = 'tvdb_id')::BIGINT AS tvdb_id,
  max(t) FILTER (a = 'poster_path') AS poster_path, max(t) FILTER (a = 'backdrop_path') AS backdrop_path,
  max(t) FILTER (a = 'runtime')::INTEGER AS runtime, max(t) FILTER (a = 'vote_average')::DOUBLE AS vote_average,
  max(t) FILTER (a = 'vote_count')::BIGINT AS vote_count, max(t) FILTER (a = 'adult')::BOOLEAN AS adult,
  max(t) FILTER (a = 'season_count')::INTEGER AS season_count, max(t) FILTER (a = 'release_date')::DATE AS release_date
FROM (SELECT DISTINCT content_type, content_source, content_id FROM content_attributes) e
LEFT JOIN cells c USING (content_type, content_source, content_id) GROUP BY ALL""",
}
