"""Serving, request, facet and routing queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import release as R
from sparkloom.functions.episodes import episode_numbers
from sparkloom.functions.release import keyword_pattern
from sparkloom.operators import serving as S
from sparkloom.operators.jobs import watermark
from sparkloom.plans.request import Profile, Request, plan_request, release_attribute, with_file_types
from sparkloom.plans.search import Facet, SearchPlan
from sparkloom.queries.registry import Registry
from sparkloom.queries.scalars import _ALIASES, _alias_sql
from sparkloom.queries.scalars import ORACLE as _SCALARS
from sparkloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_NOW = "(SELECT max(updated_at) FROM torrents_torrent_sources)"


def _with_now(df: DataFrame, sources: DataFrame) -> DataFrame:
    """The latest update of any source as the present: one row."""
    return df.crossJoin(F.broadcast(watermark(sources, "updated_at").withColumnRenamed("watermark", "_now")))


@query("SELECT max(updated_at) AS watermark FROM torrents_torrent_sources")
def source_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return watermark(table(spark, sf, "torrents_torrent_sources"), "updated_at")


_FLAGS = "SELECT info_hash, max(CASE WHEN source = 'tracker' THEN seeders END) AS tracker, max(CASE WHEN source <> 'tracker' THEN seeders END) AS other, max(greatest(updated_at, coalesce(published_at, updated_at))) AS seen FROM torrents_torrent_sources GROUP BY 1"


@query(f"""WITH f AS ({_FLAGS}) SELECT info_hash, name FROM torrents LEFT JOIN f USING (info_hash) WHERE NOT coalesce(tracker = 0, false)
AND NOT (tracker IS NULL AND coalesce(other, 0) = 0 AND (seen IS NULL OR seen <= {_NOW} - INTERVAL 200 DAY))""")
def serving_freshness(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "torrents_torrent_sources")
    return S.drop_dead_confidence(_with_now(table(spark, sf, "torrents"), s), s, F.col("_now"), hide_unknown_days=200).select("info_hash", "name")


@query(f"""WITH f AS ({_FLAGS}) SELECT info_hash, name FROM torrents LEFT JOIN f USING (info_hash) WHERE NOT coalesce(coalesce(tracker, other) = 0, false)
AND NOT (coalesce(tracker, other) IS NULL AND (seen IS NULL OR seen <= {_NOW} - INTERVAL 200 DAY))""")
def serving_freshness_any_zero(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "torrents_torrent_sources")
    return S.drop_dead_confidence(_with_now(table(spark, sf, "torrents"), s), s, F.col("_now"), hide_unknown_days=200, authoritative=False).select("info_hash", "name")


@query("""WITH v AS (SELECT info_hash, arg_max(CASE source WHEN 'manual' THEN 'quarantined' WHEN 'import' THEN 'tombstoned' ELSE 'fine' END, row(updated_at, source)) AS verdict FROM torrents_torrent_sources GROUP BY 1),
d AS (SELECT info_hash FROM torrents_torrent_sources GROUP BY 1 HAVING max(seeders) = 0)
SELECT info_hash FROM torrents WHERE info_hash NOT IN (SELECT info_hash FROM d) AND info_hash NOT IN (SELECT info_hash FROM v WHERE verdict IN ('quarantined', 'blacklisted', 'tombstoned'))""")
def serving_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "torrents_torrent_sources")
    verdicts = s.withColumn("verdict", F.when(F.col("source") == "manual", "quarantined").when(F.col("source") == "import", "tombstoned").otherwise("fine"))
    dead = s.groupBy("info_hash").agg(F.max("seeders").alias("most")).filter("most = 0")
    return S.exclude_judged(table(spark, sf, "torrents"), dead, S.blocked_set(verdicts, "info_hash", ["updated_at", "source"]), live=True).select("info_hash")


@query(r"""WITH lab AS (SELECT info_hash FROM documents WHERE info_hash IS NOT NULL AND lang = 'de'), tag AS (SELECT info_hash FROM documents WHERE info_hash IS NOT NULL AND source = 'wiki'),
f AS (SELECT info_hash, sum(CASE WHEN extension IN ('flac', 'mp3') THEN size ELSE -size END) AS signed, bool_or(regexp_matches(CASE WHEN extension IS NOT NULL THEN left(path, greatest(length(path) - length(extension) - 1, 0)) ELSE path END, '(?i)live|flac')) AS hit FROM torrent_files GROUP BY 1)
SELECT t.info_hash FROM torrents t LEFT JOIN f USING (info_hash) WHERE NOT private AND files_status <> 'over_threshold' AND t.info_hash NOT IN (SELECT info_hash FROM lab) AND t.info_hash NOT IN (SELECT info_hash FROM tag)
AND NOT coalesce((CASE WHEN files_status = 'single' THEN size > 0 AND extension IN ('flac', 'mp3') ELSE coalesce(signed, 0) > 0 END)
 AND (regexp_matches(CASE WHEN files_status = 'single' AND extension IS NOT NULL THEN left(name, greatest(length(name) - length(extension) - 1, 0)) ELSE name END, '(?i)live|flac') OR coalesce(hit, false)), false)""")
def serving_scope_torrents(spark: SparkSession, sf: str) -> DataFrame:
    t, d = table(spark, sf, "torrents"), table(spark, sf, "documents").filter("info_hash is not null")
    snapshot = F.to_json(F.struct("info_hash", "name", F.lit(False).alias("private")))
    sources = F.to_json(F.array(F.struct("info_hash", F.lit("dht").alias("source"), F.lit("dht").alias("source_key"))))
    held = t.filter("files_status = 'over_threshold'").select("info_hash", F.col("name").alias("torrent_name"), snapshot.alias("torrent_snapshot"), sources.alias("sources_snapshot"), F.lit(None).cast("string").alias("files_snapshot"))
    broken = t.filter("files_status = 'single'").select("info_hash", F.lit("other name").alias("torrent_name"), snapshot.alias("torrent_snapshot"), sources.alias("sources_snapshot"), F.lit(None).cast("string").alias("files_snapshot"))
    labels = d.select("info_hash", F.when(F.col("lang") == "de", " Private").otherwise("public").alias("category"))
    tags = d.select("info_hash", F.when(F.col("source") == "wiki", "bitgrab").otherwise("fine").alias("name"))
    return S.serving_scope(t, held.unionByName(broken), labels, tags, None, table(spark, sf, "torrent_files"), ["flac", "mp3"], "(?i)live|flac").select("info_hash")


@query(f"""WITH a AS (SELECT DISTINCT hash_text AS info_hash FROM hash_sightings WHERE hash_text IS NOT NULL AND regexp_full_match(hash_text, '[0-9a-f]{{40}}')),
d AS (SELECT info_hash, arg_max(row(seeders, leechers, updated_at), row(updated_at, coalesce(seeders, -1), coalesce(leechers, -1))) AS r FROM torrents_torrent_sources WHERE source = 'dht' GROUP BY 1),
j AS (SELECT a.info_hash, a.info_hash IN (SELECT info_hash FROM known_hashes) AS listed, a.info_hash IN (SELECT info_hash FROM documents WHERE info_hash IS NOT NULL) AND a.info_hash NOT IN (SELECT info_hash FROM documents WHERE info_hash IS NOT NULL AND lang = 'en') AS blocked,
 t.info_hash IS NOT NULL AND t.private AS judged, t.name, t.info_hash IS NOT NULL AS known, files_status AS st, files_count AS fc, d.info_hash IS NOT NULL AS has, r[1] AS s, r[2] AS l, r[3] AS u FROM a LEFT JOIN torrents t USING (info_hash) LEFT JOIN d USING (info_hash))
SELECT info_hash, CASE WHEN listed THEN 'listed' WHEN blocked THEN 'blocked' WHEN judged THEN 'judged' WHEN name <> '' AND regexp_matches(name, '(?i)readnfo') THEN 'name'
WHEN NOT known OR st = 'no_info' OR (st <> 'single' AND fc IS NULL) OR (st = 'over_threshold' AND fc <= 100) THEN 'get_peers' WHEN s IS NULL OR l IS NULL OR u < {_NOW} - INTERVAL 300 DAY THEN 'scrape' ELSE 'known' END AS route FROM j""")
def triage_routes(spark: SparkSession, sf: str) -> DataFrame:
    t, d, s = table(spark, sf, "torrents"), table(spark, sf, "documents").filter("info_hash is not null"), table(spark, sf, "torrents_torrent_sources")
    asked = table(spark, sf, "hash_sightings").select(F.col("hash_text").alias("info_hash")).filter(F.col("info_hash").rlike(r"\A[0-9a-f]{40}\z"))
    listed = table(spark, sf, "known_hashes").select(F.sha2(F.unhex("info_hash"), 256).alias("hash"))

    now = s.agg(F.max("updated_at")).first()[0]  # one value
    return S.triage(asked, t, s, F.lit(now), listed, d, d.filter("lang = 'en'"), t.filter("private"), ~F.col("name").rlike("(?i)readnfo"), rescrape_days=300)


@query("""WITH l AS (SELECT info_hash, max(row(CASE lang WHEN 'en' THEN 'movie' WHEN 'fr' THEN 'tv' WHEN 'de' THEN 'book' ELSE 'other' END, CASE WHEN source = 'wiki' THEN 'radarr:' || doc_id ELSE 'tmdb:' || doc_id END)) AS x FROM documents WHERE info_hash IS NOT NULL GROUP BY 1),
j AS (SELECT t.info_hash, l.info_hash IS NULL AS missing, x[1] AS m, x[2] AS i FROM torrents t LEFT JOIN l USING (info_hash))
SELECT info_hash, CASE m WHEN 'movie' THEN 'movie' WHEN 'tv' THEN 'tv_show' WHEN 'book' THEN 'ebook' END AS content_type, CASE WHEN m IN ('movie', 'tv') AND NOT starts_with(i, 'radarr:') THEN i END AS hint_id,
CASE WHEN missing THEN 'miss' WHEN m = 'other' THEN 'unknown_type' WHEN m IN ('movie', 'tv') THEN 'constrained' ELSE 'preempted' END AS outcome FROM j""")
def canonical_preempts(spark: SparkSession, sf: str) -> DataFrame:
    lang, ident = F.col("lang"), F.col("doc_id").cast("string")
    media = F.when(lang == "en", "movie").when(lang == "fr", "tv").when(lang == "de", "book").otherwise("other")
    labels = table(spark, sf, "documents").filter("info_hash is not null").select("info_hash", media.alias("media_type"), F.when(F.col("source") == "wiki", F.concat(F.lit("radarr:"), ident)).otherwise(F.concat(F.lit("tmdb:"), ident)).alias("media_id"))
    return S.canonical_preempt(table(spark, sf, "torrents").select("info_hash"), labels)


def releases(spark: SparkSession, sf: str) -> DataFrame:
    """One row per torrent with the attributes of its name."""
    n = F.col("name")
    t = table(spark, sf, "torrents").select("info_hash", "name", "extension", "created_at")
    e = episode_numbers(n)
    return t.select(
        "info_hash", "name", "extension", F.col("created_at").alias("published_at"), F.when(e["season"].isNotNull(), "tv_show").otherwise("movie").alias("content_type"), R.video_resolution(n).alias("video_resolution"), R.video_source(n).alias("video_source"),
        R.infer_alias(n, R.MODIFIERS).alias("video_modifier"), R.infer_alias(n, R.KINDS_3D).alias("video_3d"), F.when(e["season"].isNotNull(), F.create_map(e["season"], F.array(e["episode"]))).alias("episodes"), n.rlike(r"^\[").alias("is_anime"),
    )


_SEASON = r"(?i)(?:^|[^A-Za-z0-9])s(\d{1,2})e\d{1,4}(?:$|[^A-Za-z0-9])"
_EPISODE = r"(?i)(?:^|[^A-Za-z0-9])s\d{1,2}e(\d{1,4})(?:$|[^A-Za-z0-9])"
_RELEASES = f"""SELECT info_hash, name, extension, created_at, CASE WHEN regexp_matches(name, '{_SEASON}') THEN 'tv_show' ELSE 'movie' END AS content_type, {_alias_sql(_ALIASES['resolution'])} AS r, {_alias_sql(_ALIASES['video_source'])} AS vs,
{_alias_sql(_ALIASES['modifier'])} AS vm, {_alias_sql(_ALIASES['kind_3d'])} AS v3, TRY_CAST(regexp_extract(name, '{_SEASON}', 1) AS INTEGER) AS s, TRY_CAST(regexp_extract(name, '{_EPISODE}', 1) AS INTEGER) AS e, regexp_matches(name, '^\\[') AS anime FROM torrents"""


@query(f"SELECT info_hash FROM ({_RELEASES}) WHERE content_type = 'movie' AND (r IN ('720p', '1080p', '1440p', '2160p') OR v3 IS NOT NULL) AND info_hash IN (SELECT info_hash FROM documents WHERE lang = 'en') ORDER BY created_at DESC, info_hash LIMIT 100 OFFSET 3")
def request_hd_films(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "documents").filter("info_hash is not null").select("info_hash", F.col("lang").alias("name"))
    ask = Request("movie", "any", (2040, 2060), limit=500, offset=3, profile=Profile(tags=("en",)))
    return plan_request(SearchPlan(releases(spark, sf)), ask, tags=tags).items().select("info_hash")


@query(f"SELECT info_hash FROM ({_RELEASES}) WHERE content_type = 'tv_show' AND s = 1 AND (e IS NULL OR e = 2) AND (content_type = 'tv_show' OR anime)")
def request_episode(spark: SparkSession, sf: str) -> DataFrame:
    return plan_request(SearchPlan(releases(spark, sf)), Request("tvsearch", categories=(5000, 5070), season=1, episode=2)).matches().select("info_hash")


@query("SELECT DISTINCT content_type, content_source, content_id FROM content WHERE content_type = 'movie' AND (content_type, content_source, content_id) IN (SELECT (content_type, content_source, content_id) FROM content_attributes WHERE attr_source = 'imdb' AND attr_key = 'id' AND attr_value = (SELECT min(attr_value) FROM content_attributes WHERE content_type = 'movie' AND attr_source = 'imdb' AND attr_key = 'id' AND regexp_full_match(attr_value, 'tt\\d+')))".replace("\\\\", "\\"))
def request_by_alternative_id(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "content_attributes").filter("attr_key = 'id'").select("content_type", "content_source", "content_id", F.col("attr_source").alias("source"), F.col("attr_value").alias("value"))
    one = a.filter((F.col("content_type") == "movie") & (F.col("source") == "imdb") & F.col("value").rlike(r"^tt\d+$")).agg(F.min("value")).first()[0]  # one value
    works = table(spark, sf, "content").select("content_type", "content_source", "content_id").distinct()
    return plan_request(SearchPlan(works), Request("search", imdb_id=(one or "tt0")[2:]), alternatives=a).matches()


@query(f"SELECT info_hash FROM ({_SCALARS['scalar_codec_and_group']}) WHERE list_contains(audio_formats, 'FLAC') OR encoder = 'x265'")
def release_attribute_claims(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "torrents").select("info_hash", R.release_attributes(F.col("name")).alias("attributes"))
    one, two = (SearchPlan(t).with_where(release_attribute(f, v)).matches().select("info_hash") for f, v in (("audio_formats", "FLAC"), ("encoder", "x265")))
    return one.union(two).distinct()


_IMAGES = "('bmp', 'dds', 'gif', 'ico', 'jpeg', 'jpg', 'png', 'psd', 'svg', 'tif', 'tiff', 'srt', 'sub', 'vtt')"


@query(f"SELECT info_hash FROM torrents t WHERE extension IN {_IMAGES} OR EXISTS (SELECT 1 FROM torrent_files f WHERE f.info_hash = t.info_hash AND f.extension IN {_IMAGES})")
def search_by_file_type(spark: SparkSession, sf: str) -> DataFrame:
    return with_file_types(table(spark, sf, "torrents"), table(spark, sf, "torrent_files"), ["image", "subtitles"]).select("info_hash")


def _release_facets(spark: SparkSession, sf: str) -> SearchPlan:
    src = table(spark, sf, "torrents_torrent_sources").groupBy("info_hash").agg(F.collect_set("source").alias("sources"))
    types = table(spark, sf, "torrent_files").select("info_hash", R.file_type(F.col("extension")).alias("t")).groupBy("info_hash").agg(F.collect_set("t").alias("types"))
    docs = table(spark, sf, "documents").filter("info_hash is not null").groupBy("info_hash").agg(F.collect_set("lang").alias("languages"), F.collect_set("source").alias("tags"))
    rows = releases(spark, sf)
    for df in (src, types, docs):
        rows = rows.join(df, "info_hash", "left")
    return SearchPlan(rows).with_facets(
        Facet("content_type", F.col("content_type")), Facet("torrent_source", F.col("sources"), selected=("dht", "rss"), many=True), Facet("torrent_tag", F.col("tags"), logic="and", many=True),
        Facet("file_type", F.col("types"), selected=("video", "audio"), many=True), Facet("language", F.col("languages"), many=True), Facet("video_resolution", F.col("video_resolution"), selected=("1080p", None, "720p")),
        Facet("video_source", F.col("video_source")), Facet("video_modifier", F.col("video_modifier")), Facet("video_3d", F.col("video_3d")),
    )


_TYPE_SQL = _TYPE = "CASE " + " ".join(f"WHEN lower(extension) IN ({e}) THEN '{t}'" for t, e in (("archive", "'7z','bz2','gz','iso','rar','tar','zip'"), ("audio", "'aac','dsf','flac','m4a','m4b','mid','mp3','ogg','wav'"), ("data", "'csv','json','xls','xlsx','xml'"), ("document", "'azw','azw3','djvu','doc','docx','epub','htm','html','md','mobi','nfo','otf','pdf','ppt','pptx','rtf','txt'"), ("image", "'bmp','dds','gif','ico','jpeg','jpg','png','psd','svg','tif','tiff'"), ("software", "'apk','bat','bin','deb','dll','dmg','exe','jar','lua','msi','package','pkg','rpm','sh'"), ("subtitles", "'srt','sub','vtt'"), ("video", "'avi','flv','m4v','mkv','mov','mp4','mpeg','mpg','ts','vob','wmv'"))) + " END"
_SRC_FIT, _TYPE_FIT, _RES_FIT = "coalesce(list_has_any(ss, ['dht', 'rss']), false)", "coalesce(list_has_any(ts, ['video', 'audio']), false)", "(r IN ('1080p', '720p') OR r IS NULL)"


def _one(name: str, value: str, *fits: str) -> str:
    return f"SELECT '{name}' AS facet, {value} AS value, count(*) AS n FROM x WHERE {' AND '.join(fits)} GROUP BY 2"


@query(f"""WITH s AS (SELECT info_hash, list(DISTINCT source) AS ss FROM torrents_torrent_sources GROUP BY 1), f AS (SELECT info_hash, list(DISTINCT t) FILTER (t IS NOT NULL) AS ts FROM (SELECT info_hash, {_TYPE_SQL} AS t FROM torrent_files) GROUP BY 1),
d AS (SELECT info_hash, list(DISTINCT lang) FILTER (lang IS NOT NULL) AS ls, list(DISTINCT source) FILTER (source IS NOT NULL) AS gs FROM documents WHERE info_hash IS NOT NULL GROUP BY 1),
x AS (SELECT * FROM ({_RELEASES}) LEFT JOIN s USING (info_hash) LEFT JOIN f USING (info_hash) LEFT JOIN d USING (info_hash)),
c AS ({_one('content_type', 'content_type', _SRC_FIT, _TYPE_FIT, _RES_FIT)} UNION ALL {_one('torrent_source', 'unnest(ss)', _TYPE_FIT, _RES_FIT)} UNION ALL {_one('torrent_tag', 'unnest(gs)', _SRC_FIT, _TYPE_FIT, _RES_FIT)} UNION ALL {_one('file_type', 'unnest(ts)', _SRC_FIT, _RES_FIT)}
UNION ALL {_one('language', 'unnest(ls)', _SRC_FIT, _TYPE_FIT, _RES_FIT)} UNION ALL {_one('video_resolution', 'r', _SRC_FIT, _TYPE_FIT)} UNION ALL {_one('video_source', 'vs', _SRC_FIT, _TYPE_FIT, _RES_FIT)} UNION ALL {_one('video_modifier', 'vm', _SRC_FIT, _TYPE_FIT, _RES_FIT)} UNION ALL {_one('video_3d', 'v3', _SRC_FIT, _TYPE_FIT, _RES_FIT)}),
w(facet, value) AS (VALUES ('torrent_source', 'dht'), ('torrent_source', 'rss'), ('file_type', 'video'), ('file_type', 'audio'), ('video_resolution', '1080p'), ('video_resolution', NULL), ('video_resolution', '720p'))
SELECT coalesce(c.facet, w.facet) AS facet, CASE WHEN c.facet IS NULL THEN w.value ELSE c.value END AS value, coalesce(n, 0) AS n, w.facet IS NOT NULL AS selected FROM c FULL JOIN w ON c.facet = w.facet AND c.value IS NOT DISTINCT FROM w.value""")
def facets_of_releases(spark: SparkSession, sf: str) -> DataFrame:
    """Nine facets, three of them with a selection, from one scan of the releases."""
    return _release_facets(spark, sf).facet_counts()


@query("SELECT count(*) AS total_count, false AS is_estimate FROM documents WHERE lang = 'en'")
def search_total_in_budget(spark: SparkSession, sf: str) -> DataFrame:
    return SearchPlan(table(spark, sf, "documents").filter("lang = 'en'")).budgeted_total(None)


#: Orders of releases: column, null value, and whether the hash breaks ties in the same direction.
RELEASE_ORDERS = {"published_at": None, "updated_at": None, "size": None, "files_count": 0, "seeders": -1, "leechers": -1}


def release_order(name: str, descending: bool = False, key: str = "info_hash") -> list[F.Column]:
    """Columns of an order; names and hashes stand alone, all others end in the hash in the same direction."""
    way = lambda c: c.desc_nulls_last() if descending else c.asc_nulls_last()
    if name in ("name", key):
        return [way(F.col(name))]
    value = F.col(name) if RELEASE_ORDERS[name] is None else F.coalesce(F.col(name), F.lit(RELEASE_ORDERS[name]))
    return [way(value), way(F.col(key))]


@query("SELECT 'files_count' AS by, info_hash FROM (SELECT info_hash FROM torrents ORDER BY coalesce(files_count, 0) DESC, info_hash DESC LIMIT 30) UNION ALL SELECT 'size', info_hash FROM (SELECT info_hash FROM torrents ORDER BY size, info_hash LIMIT 30) UNION ALL SELECT 'updated_at', info_hash FROM (SELECT info_hash FROM torrents ORDER BY updated_at DESC, info_hash DESC LIMIT 30)")
def release_orders(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "torrents")
    top = lambda n, d: t.orderBy(*release_order(n, d)).limit(30).select(F.lit(n).alias("by"), "info_hash")
    return top("files_count", True).unionByName(top("size", False)).unionByName(top("updated_at", True))
