"""Rule, source, sink and streaming queries with their SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.release import keyword_pattern, magnet_uri
from sparkloom.functions.titles import fold_title
from sparkloom.plans.rules import Scope, Workflow
from sparkloom.queries.registry import Registry
from sparkloom.sources.readers import alias_table, feed_item, import_items, read_hash_feed, read_ndjson, work_path, write_ndjson
from sparkloom.session import table
from sparkloom.streaming.pipelines import EVENTS, as_files, failure_runs, first_seen, newest_per_window, run_to_table, stream_files, tumbling_counts

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

WORKFLOW = {
    "default": [
        {"if_else": {"condition": {"or": ["torrent.name.matches(keywords.banned)", "torrent.size == 0"]}, "if_action": "delete"}},
        {"find_match": [
            [{"if_else": {"condition": "torrent.extensions.filter(e, e in ['flac', 'mp3']).size() > 0", "if_action": {"set_content_type": "music"}, "else_action": "unmatched"}}],
            [{"if_else": {"condition": {"and": ["torrent.sizes.sum() > 100 mb", "torrent.extensions.exists(e, e in extensions.video)"]}, "if_action": {"run_workflow": "video"}, "else_action": "unmatched"}}],
            [{"if_else": {"condition": "torrent.extensions.size() > 0 && torrent.extensions.all(e, e in ['pdf', 'epub', 'cbz'])", "if_action": {"set_content_type": "ebook"}, "else_action": "unmatched"}}],
        ]},
        {"if_else": {"condition": "result.content_type == null", "else_action": {"add_tag": "classified"}}},
    ],
    "video": [{"if_else": {"condition": "torrent.name.matches(keywords.series)", "if_action": {"set_content_type": "tv_show"}, "else_action": {"set_content_type": "movie"}}}, {"add_tag": "video"}],
}
VIDEO = ["mkv", "mp4", "avi", "ts"]


@query(r"""WITH f AS (SELECT info_hash, list(coalesce(extension, '')) AS e, sum(size) AS s FROM torrent_files GROUP BY 1),
t AS (SELECT info_hash, name, size, coalesce(e, []) AS e, coalesce(s, 0) AS s FROM torrents LEFT JOIN f USING (info_hash)),
c AS (SELECT *, regexp_matches(name, '(?i)(?:^|[^A-Za-z0-9_]+)((?:readnfo)|(?:uncut))(?:$|[^A-Za-z0-9_]+)') OR size = 0 AS d, len(list_filter(e, lambda x: x IN ('flac','mp3'))) > 0 AS music,
  s > 100000000 AND len(list_filter(e, lambda x: x IN ('mkv','mp4','avi','ts'))) > 0 AS video, regexp_matches(name, '(?i)(?:^|[^A-Za-z0-9_]+)((?:season))(?:$|[^A-Za-z0-9_]+)') AS series,
  len(e) > 0 AND len(list_filter(e, lambda x: x IN ('pdf','epub','cbz'))) = len(e) AS book FROM t)
SELECT info_hash, CASE WHEN d THEN NULL WHEN music THEN 'music' WHEN video AND series THEN 'tv_show' WHEN video THEN 'movie' WHEN book THEN 'ebook' END AS content_type,
array_to_string(CASE WHEN d THEN [] WHEN music THEN ['classified'] WHEN video THEN ['video', 'classified'] WHEN book THEN ['classified'] ELSE [] END, ',') AS tags, d AS deleted FROM c""")
def rule_workflow(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "torrent_files").groupBy("info_hash").agg(F.collect_list(F.coalesce("extension", F.lit(""))).alias("e"), F.collect_list("size").alias("s"))
    t = table(spark, sf, "torrents").join(files, "info_hash", "left").withColumn("e", F.coalesce("e", F.array().cast("array<string>"))).withColumn("s", F.coalesce("s", F.array().cast("array<bigint>")))
    scope = Scope(
        {"torrent.name": F.col("name"), "torrent.size": F.col("size"), "torrent.extensions": F.col("e"), "torrent.sizes": F.col("s")},
        {"extensions.video": VIDEO},
        {"keywords.banned": keyword_pattern("readnfo", "uncut"), "keywords.series": keyword_pattern("season")},
    )
    return Workflow(WORKFLOW, scope).apply(t.select("info_hash", "name", "size", "e", "s")).select("info_hash", "content_type", F.array_join("tags", ",").alias("tags"), "deleted")


@query("SELECT info_hash, name, size, private, source, seeders, leechers, 'run-1' AS import_id FROM torrents_torrent_sources JOIN torrents USING (info_hash)")
def ndjson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Write an import file and read its items back with an import id; a malformed line would be a row of nulls."""
    path = work_path(spark, f"ndjson-{uuid.uuid4().hex}")
    rows = table(spark, sf, "torrents_torrent_sources").join(table(spark, sf, "torrents").select("info_hash", "name", "size", "private"), "info_hash")
    write_ndjson(rows.select(F.col("info_hash").alias("infoHash"), "name", "size", "private", "source", "seeders", "leechers"), path)
    return read_ndjson(spark, path, "run-1").select(F.col("infoHash").alias("info_hash"), "name", "size", "private", "source", "seeders", "leechers", "import_id")


@query("""SELECT 'torrent' AS kind, info_hash, name AS value, size AS number FROM torrents UNION ALL SELECT 'torrent', info_hash, 'imported', 7 FROM known_hashes WHERE info_hash NOT IN (SELECT info_hash FROM torrents)
UNION ALL SELECT 'link', info_hash, source, seeders FROM (SELECT *, row_number() OVER (PARTITION BY source, info_hash ORDER BY updated_at DESC, seeders DESC NULLS LAST, leechers DESC NULLS LAST) AS r FROM torrents_torrent_sources) WHERE r = 1 AND NOT (source = 'import' AND info_hash IN (SELECT info_hash FROM known_hashes))
UNION ALL SELECT 'link', info_hash, 'import', 1 FROM known_hashes""")
def import_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All torrents and source links after an import: known torrents stay, links of the same source are overwritten."""
    items = table(spark, sf, "known_hashes").select(F.col("info_hash").alias("infoHash"), F.lit("imported").alias("name"), F.lit(7).cast("long").alias("size"), F.lit("import").alias("source"), F.lit(1).alias("seeders"), F.lit(0).alias("leechers"))
    links = table(spark, sf, "torrents_torrent_sources").groupBy("source", "info_hash").agg(F.max_by(F.struct("seeders", "leechers"), F.struct("updated_at", "seeders", "leechers")).alias("x"), F.max("updated_at").alias("updated_at")).select("source", "info_hash", "x.*", "updated_at")
    torrents, after = import_items(table(spark, sf, "torrents"), links, items)
    rows = torrents.select(F.lit("torrent").alias("kind"), "info_hash", F.col("name").alias("value"), F.col("size").alias("number"))
    return rows.unionByName(after.select(F.lit("link").alias("kind"), "info_hash", F.col("source").alias("value"), F.col("seeders").cast("long").alias("number")))


@query("SELECT t.info_hash FROM torrents t JOIN (SELECT DISTINCT sha256(unhex(info_hash)) AS h FROM documents WHERE info_hash IS NOT NULL) b ON sha256(unhex(t.info_hash)) = b.h")
def blocklist_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Torrents whose double hash is in a line feed."""
    path = work_path(spark, f"feed-{uuid.uuid4().hex}")
    table(spark, sf, "documents").filter("info_hash is not null").select(F.concat(F.sha2(F.unhex("info_hash"), 256), F.lit("  # seen")).alias("value")).write.mode("overwrite").text(path)
    feed = read_hash_feed(spark, path)
    return table(spark, sf, "torrents").select("info_hash", F.sha2(F.unhex("info_hash"), 256).alias("hash")).join(feed, "hash", "left_semi").select("info_hash")


@query(r"SELECT trim(regexp_replace(lower(attr_value), '[^a-z0-9]+', ' ', 'g')) AS normalized, min(content_type || ':' || content_source || ':' || content_id) AS ref FROM content_attributes WHERE attr_key LIKE 'alt%' AND trim(regexp_replace(lower(attr_value), '[^a-z0-9]+', ' ', 'g')) <> '' GROUP BY 1")
def alias_dump(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.concat_ws(":", "content_type", "content_source", "content_id")
    a = table(spark, sf, "content_attributes").filter(F.col("attr_key").like("alt%"))
    return alias_table(a.select(ref.alias("work_id"), F.col("attr_value").alias("title")), a.select(ref.alias("work_id"), ref.alias("ref")).distinct(), fold_title)


@query("""SELECT info_hash, '<item><title>' || replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '</title><enclosure url="magnet:?xt=urn:btih:' || info_hash || '&amp;dn=' || replace(url_encode(name), '%20', '+') || '&amp;xl=' || size || '" length="' || size || '"/><pubDate>'
|| strftime(created_at, '%Y-%m-%d %H:%M:%S') || '</pubDate><torznab:attr name="size" value="' || size || '"/>' || coalesce('<torznab:attr name="files" value="' || files_count || '"/>', '') || '</item>' AS item FROM torrents""")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "torrents")
    link = magnet_uri(F.col("info_hash"), F.col("name"), F.col("size"))
    return t.select("info_hash", feed_item(F.col("name"), link, F.col("size"), F.col("created_at"), {"size": F.col("size"), "files": F.col("files_count")}).alias("item"))


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """The events as four files that arrive one after the other, a micro-batch each."""
    return stream_files(spark, as_files(table(spark, sf, "events"), "ts"), EVENTS)


@query("SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_to_table(tumbling_counts(_arrivals(spark, sf)), "update")
    out = newest_per_window(rows)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_to_table(first_seen(_arrivals(spark, sf), ["user_id", "event_type"], "400 days"), "append")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN r ELSE 0 END) AS last, count(*) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1),
e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, count(*) FILTER (event_type = 'error' AND r > last) AS failures, any_value(events) AS events FROM e JOIN l USING (user_id) GROUP BY 1""")
def stream_failure_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_to_table(failure_runs(_arrivals(spark, sf)), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("failures", "events"), "batch_id").alias("x")).select("user_id", "x.*")
