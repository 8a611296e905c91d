"""Queries of the training-data problems over the domain's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.formatting import collapse_formatting, formatting_pairs
from sparkloom.llm.golomb import SeenBefore, full_hash
from sparkloom.llm.linkage import link_names
from sparkloom.llm.lookalike import same_look_classes, same_look_forms, same_look_pairs
from sparkloom.llm.mixing import mix, mix_report
from sparkloom.llm.mojibake import garbled_records
from sparkloom.llm.quality import not_prose, text_statistics
from sparkloom.llm.winnowing import leaked_passages
from sparkloom.session import cut, pin, table


def _titles(spark: SparkSession, sf: str) -> list[DataFrame]:
    content = table(spark, sf, "content")
    return [content.select(F.col(c).alias("text")) for c in ("title", "original_title")]


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "torrents").select("info_hash", F.col("name").alias("text"))


def _garbled_names(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled torrent names; titles and file paths only add clean words."""
    paths = table(spark, sf, "torrent_files").select(F.col("path").alias("text"))
    return garbled_records(_names(spark, sf), [*_titles(spark, sf), paths])


def _unsound(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    """Those of some distinct names (text, copies) that are garbled; all other names, titles and file paths add clean words."""

    def garbled(names: DataFrame) -> DataFrame:
        others = table(spark, sf, "torrents").select(F.col("name").alias("text")).join(names.select("text"), "text", "left_anti")
        paths = table(spark, sf, "torrent_files").select(F.col("path").alias("text"))
        return cut(garbled_records(names, [*_titles(spark, sf), paths, others]).select("text"))

    return garbled


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting_pairs(table(spark, sf, "torrents").select("info_hash", "name"), unsound=_unsound(spark, sf))


def p1_copies(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_formatting(table(spark, sf, "torrents").select("info_hash", "name"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_look_pairs(table(spark, sf, "torrents").select("info_hash", "name"), unsound=_unsound(spark, sf))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return same_look_classes(table(spark, sf, "torrents").select("info_hash", "name"))


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf)
    return names.join(same_look_forms(names), "text").select("info_hash", F.col("text").alias("name"), F.col("form").alias("same_look_name"))


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    fixed = cut(_garbled_names(spark, sf).filter(F.col("restored").isNotNull()).groupBy("info_hash").agg(F.min("restored").alias("restored")))
    names = _names(spark, sf).join(fixed, "info_hash", "left").select("info_hash", F.coalesce("restored", "text").alias("text"))
    return link_names(cut(names), table(spark, sf, "content"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_links(spark, sf).select("info_hash", "content_type", "content_source", "content_id")


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "torrents").select(F.lit("torrents").alias("table_name"), "info_hash", F.lit(-1).cast("long").alias("file_index"), F.col("name").alias("text"))
    paths = table(spark, sf, "torrent_files").select(F.lit("torrent_files").alias("table_name"), "info_hash", "file_index", F.col("path").alias("text"))
    return garbled_records(names.unionByName(paths), _titles(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_restored(spark, sf).select("table_name", "info_hash", "file_index")


def _seen(spark: SparkSession, sf: str) -> SeenBefore:
    rows = pin(table(spark, sf, "hash_sightings").select(F.col("sighting_id").alias("id"), "hash_text"), hash=full_hash(F.col("hash_text"))).drop("hash_text")
    return SeenBefore(rows, table(spark, sf, "known_hashes").select(full_hash(F.col("info_hash")).alias("hash")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _seen(spark, sf).seen().select(F.col("id").alias("sighting_id"))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _seen(spark, sf).rates()


def p7_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_passages(spark, sf).select("doc_id", "item_id")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(table(spark, sf, "documents"), table(spark, sf, "labels"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_scores(spark, sf).filter("outlier > threshold").select("doc_id")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_statistics(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_copies, p2_found, p2_forms, p2_classes, p3_found, p3_links, p4_found, p4_restored, p5_found, p5_rates, p7_found, p7_passages, p8_mix, p8_shares, p9_found, p9_scores, p9_statistics)
}

_HASH = r"upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(hash_text, '[\s]+', '', 'g'), '^.*(btih:|sha1:|xt=)', '', 'i'), '^0x', '', 'i'), '[&?;#].*$', ''))"
_B32 = " || ".join(f"printf('%010x', {' + '.join(f'(strpos(\'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567\', b[{c + i}]) - 1)::BIGINT * {32 ** (7 - i)}' for i in range(8))})" for c in (1, 9, 17, 25))

ORACLE = {
    "p5_found": f"""WITH bare AS (SELECT sighting_id, {_HASH} AS b FROM hash_sightings),
keyed AS (SELECT sighting_id, CASE WHEN regexp_full_match(b, '[0-9A-F]{{40}}') THEN lower(b) WHEN regexp_full_match(b, '[A-Z2-7]{{32}}') THEN {_B32} END AS h FROM bare),
firsts AS (SELECT h, min(sighting_id) AS first FROM keyed WHERE h IS NOT NULL GROUP BY h)
SELECT sighting_id FROM keyed JOIN firsts USING (h) WHERE sighting_id > first OR h IN (SELECT lower(info_hash) FROM known_hashes)""",
}
