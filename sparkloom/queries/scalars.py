"""Scalar-function and full-text queries with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fts
from sparkloom.functions import release as R
from sparkloom.functions.episodes import episode_numbers, episodes_of, episodes_text, has_episodes
from sparkloom.functions.titles import date_in, normalized_title, title_and_year, title_family, token_jaccard
from sparkloom.queries.registry import Registry
from sparkloom.session import micros, pin, table, widen

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


# The SQL below states the expected values on its own; it shares no table or pattern with the functions it checks.

_ALIASES = {
    "resolution": [("4320p", "4320p 8k"), ("2160p", "3840x2160 2160p uhd 4k"), ("1440p", "1440p"), ("1080p", "1920x1080 1080i 1080p fhd 2k"), ("720p", "720p hd"), ("576p", "576p"), ("540p", "540p"), ("480p", "480p sd"), ("360p", "360p")],
    "video_source": [("WORKPRINT", "workprint"), ("TELESYNC", "telesync"), ("TELECINE", "telecine"), ("CAM", "camrip cam"), ("BluRay", "bdremux blu-ray bluray bdrip brrip"), ("TV", "iptvrip satrip hdtv tv"), ("WEBRip", "web-rip webrip web"), ("WEBDL", "web-dl web.dl webdl"), ("DVD", "dvdrip dvd5 dvd9 dvd")],
    "modifier": [("BRDISK", "remux brdisk"), ("REGIONAL", "regional"), ("RAWHD", "rawhd"), ("SCREENER", "screener")],
    "kind_3d": [("V3DOU", "3d_hou 3d.hou"), ("V3DSBS", "3d_hsbs 3d.hsbs"), ("V3D", "3d")],
}


def _alias_sql(values: list[tuple[str, str]]) -> str:
    spelt = sorted(((w.replace("_", " "), v) for v, ws in values for w in ws.split()), key=lambda x: -len(x[0]))
    found = f"lower(regexp_extract(name, '(?i)(?:^|[^A-Za-z0-9_]+)({'|'.join(w.replace('.', '[.]') for w, _ in spelt)})(?:$|[^A-Za-z0-9_]+)', 1))"
    return f"CASE {found} {' '.join(f'WHEN {w!r} THEN {v!r}' for w, v in spelt)} END"


@query("SELECT info_hash, " + ", ".join(f"{_alias_sql(v)} AS {k}" for k, v in _ALIASES.items()) + " FROM torrents")
def scalar_release_aliases(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return table(spark, sf, "torrents").select("info_hash", R.video_resolution(n).alias("resolution"), R.video_source(n).alias("video_source"), R.infer_alias(n, R.MODIFIERS).alias("modifier"), R.infer_alias(n, R.KINDS_3D).alias("kind_3d"))


_SEP = r"[ ._-]?"
_DTS = rf"dts(?:{_SEP}(?:hres|hd|ma|es|x))*"
_AUDIO_SQL = {"AAC": "aac", "DTS": _DTS, "EAC3": rf"e{_SEP}ac{_SEP}3|ddp|dd[+]", "FLAC": "flac", "OPUS": "opus", "TRUEHD": rf"true{_SEP}hd"}
_CODEC_SQL = r"x26[45]|hevc|avc|av1|xvid|divx|mpeg[24]|h(?:[.][.]|--|__|  )?26[45]"


def _said(words: str) -> str:
    return rf"regexp_matches(x, '(?i)(?:^|[^\pL\pN])(?:{words})(?:$|[^\pL\pN])')"


def _heard(words: str) -> str:
    return _said(rf"(?:{words})(?:{_SEP}[1-9](?:[ ._][01])?(?:[ ._]?ch)?)?")


def _listed(*claims: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{v}' END" for v, test in claims) + "], lambda e: e IS NOT NULL)"


_PLUS, _TEN = _said("hdr10(?:[+]|[ ._-]?plus)"), _said("hdr10")
_EAC3 = _heard(_AUDIO_SQL["EAC3"])


@query(rf"""WITH t AS (SELECT info_hash, name, regexp_replace(name, '([^\pL\pN])', '\1\1', 'g') AS wide,
  coalesce(nullif(regexp_extract(name, '(?is)[ ._(\[-]((?:(?:19|20)\d\d|s\d{{1,2}}(?:e\d{{1,4}})?|\d{{3,4}}[pi]|web{_SEP}dl|web{_SEP}rip|web|blu{_SEP}ray|bdremux|bdrip|brrip|dvdrip|dvd|hdtv|remux)(?:[^\pL\pN].*)?)$', 1), ''), name) AS x,
  regexp_replace(regexp_replace(trim(name), '(?i)[.](?:mkv|mp4|avi|mov|m4v|wmv|ts|mpg|mpeg|vob|iso|torrent)$', ''), '(?i)(?:[ ._]+(?:proper|repack|internal|readnfo)){{1,3}}$', '') AS bare FROM torrents),
c AS (SELECT *, list_transform(regexp_extract_all(wide, '(?i)(?:^|[^\pL\pN])({_CODEC_SQL})(?:$|[^\pL\pN])', 1), lambda k: regexp_replace(lower(k), '[^a-z0-9]', '', 'g')) AS codecs,
  regexp_extract(bare, '-([\pL\pN][\pL\pN_]{{0,63}})$', 1) AS g, regexp_extract(bare, '(?s)^(.*)-[\pL\pN][\pL\pN_]{{0,63}}$', 1) AS b,
  list_distinct(list_transform(regexp_extract_all(regexp_replace(x, '([^\pL\pN])', '\1\1', 'g'), '(?i)(?:^|[^\pL\pN])(?:true(?:[ ._-]{{2}})?hd|dts(?:(?:[ ._-]{{2}})?(?:hd|ma|hres|es|x))*|e?(?:[ ._-]{{2}})?ac(?:[ ._-]{{2}})?3|ddp?|aac|flac|opus)[ ._-]*([1-9](?:\.\.|__|  )[01]|[1-9]ch)(?:$|[^\pL\pN])', 1), lambda k: lower(regexp_replace(k, '[._ ][._ ]', '.')))) AS channels FROM t),
f AS (SELECT *, list_distinct(list_transform(codecs, lambda k: CASE WHEN k IN ('x264', 'h264', 'avc') THEN 'a' WHEN k IN ('x265', 'h265', 'hevc') THEN 'b' WHEN k IN ('xvid', 'divx', 'mpeg4') THEN 'c' ELSE k END)) AS families,
  {_listed(("DOLBY_VISION", _said("dv|dovi|dolby[ ._-]?vision")), ("HDR", f"{_said('hdr')} AND NOT {_TEN} AND NOT {_PLUS}"), ("HDR10", f"{_TEN} AND NOT {_PLUS}"), ("HDR10_PLUS", _PLUS))} AS hdr,
  {_listed(("AAC", _heard("aac")), ("AC3", f"{_heard(f'ac{_SEP}3|dd')} AND NOT {_EAC3}"), *[(k, _heard(v)) for k, v in _AUDIO_SQL.items() if k != "AAC"])} AS audio,
  {_listed(("ATMOS", _said("atmos")), ("DTS_X", _said("dts[ ._-]?x")))} AS features, {_listed(*[(k.upper(), _said(k)) for k in ("internal", "proper", "readnfo", "repack")])} AS revisions,
  CASE WHEN {_said("x264")} AND NOT {_said("x265")} THEN 'x264' WHEN {_said("x265")} AND NOT {_said("x264")} THEN 'x265' END AS encoder, CASE WHEN len(channels) = 1 THEN channels[1] END AS channel FROM c),
o AS (SELECT *, len(hdr) + len(audio) + len(features) + len(revisions) > 0 OR channel IS NOT NULL OR encoder IS NOT NULL AS any_claim FROM f)
SELECT info_hash, CASE WHEN len(families) = 1 THEN CASE codecs[1] WHEN 'h264' THEN 'H264' WHEN 'avc' THEN 'H264' WHEN 'h265' THEN 'HEVC' WHEN 'hevc' THEN 'HEVC' WHEN 'mpeg2' THEN 'MPEG2' WHEN 'mpeg4' THEN 'MPEG4' WHEN 'xvid' THEN 'XviD' WHEN 'divx' THEN 'DivX' WHEN 'av1' THEN 'AV1' ELSE codecs[1] END END AS codec,
CASE WHEN g <> '' AND NOT regexp_full_match(g, '(?i)v?\d+|\d{{3,4}}[pi]') AND NOT regexp_full_match(lower(g), 'dl|rip|web|webrip|webdl|bluray|bdremux|remux|proper|repack|internal|readnfo|remastered|extended|unrated|uncut|limited|complete|multi|dubbed|subbed|hdr|hdr10|dv|atmos|truehd|dts|hd|ma|aac|ac3|dd|ddp|flac|opus|avc|h264|h265|hevc|av1|x264|x265|xvid|divx')
 AND regexp_matches(b, '(?i)(?:^|[^\pL\pN])(?:x26[45]|hevc|avc|av1|xvid|divx|mpeg[24]|h[ ._-]?26[45]|{_DTS}|true{_SEP}hd|atmos|e{_SEP}ac{_SEP}3|ac{_SEP}3|ddp|dd|aac|flac|opus|\d{{3,4}}p|web{_SEP}dl|web{_SEP}rip|web|blu{_SEP}ray|bdrip|brrip|bdremux|dvdrip|dvd|hdtv|remux|proper|repack)(?:[ ._]?\d(?:[ ._]\d)?(?:[ ._]?ch)?)?$') THEN g END AS release_group,
CASE WHEN any_claim THEN 1 END AS version, CASE WHEN any_claim THEN sha256(name) END AS source_name_sha256, CASE WHEN any_claim THEN hdr END AS hdr_formats, CASE WHEN any_claim THEN audio END AS audio_formats,
channel AS audio_channels, CASE WHEN any_claim THEN features END AS audio_features, CASE WHEN any_claim THEN revisions END AS revisions, encoder FROM o""")
def scalar_codec_and_group(spark: SparkSession, sf: str) -> DataFrame:
    t = pin(table(spark, sf, "torrents").select("info_hash", "name"), suffix=R.technical_suffix(F.col("name")))
    n = F.col("name")
    return t.select("info_hash", R.video_codec(n).alias("codec"), R.release_group(n).alias("release_group"), R.release_attributes(n, F.col("suffix")).alias("a")).select("info_hash", "codec", "release_group", "a.*")


@query(r"""WITH s AS (SELECT info_hash, list_sort(list(DISTINCT source)) AS sources FROM torrents_torrent_sources GROUP BY 1),
t AS (SELECT t.info_hash, name, coalesce(sources, []) AS sources, regexp_replace(lower(trim(extension)), '^[.]', '') AS e,
  lower(regexp_extract(regexp_replace(trim(name), '[.][^./]{0,4}$', ''), '-([A-Za-z0-9]{2,16})(?:[.][A-Za-z0-9]{1,4})?$', 1)) AS g,
  lower(regexp_extract(name, '(?i)(?:^|[^A-Za-z0-9_])(web-dl|webrip|web|bluray|bdrip|brrip|hdtv|dvdrip|remux|hdrip|hdcam|cam|ts|tc)(?:$|[^A-Za-z0-9_])', 1)) AS q,
  lower(regexp_extract(name, '(?i)(?:^|[^A-Za-z0-9_])((?:2160|1440|1080|720|480|360)p)(?:$|[^A-Za-z0-9_])', 1)) AS r,
  replace(lower(regexp_extract(name, '(?i)(?:^|[^A-Za-z0-9_])(x26[45]|h[.]?26[45]|hevc|av1|avc|xvid|divx)(?:$|[^A-Za-z0-9_])', 1)), '.', '') AS c FROM torrents t LEFT JOIN s USING (info_hash))
SELECT info_hash, CASE WHEN g NOT IN ('', '1080p', '720p', '2160p', '480p', 'x264', 'x265', 'h264', 'h265', 'av1', 'hevc') THEN g END AS grp, nullif(replace(q, '-', ''), '') AS quality, nullif(r, '') AS resolution,
CASE WHEN c IN ('h265', 'hevc') THEN 'x265' WHEN c IN ('h264', 'avc') THEN 'x264' ELSE nullif(c, '') END AS codec, CASE WHEN e <> '' AND length(e) <= 8 THEN e END AS extension, array_to_string(list_filter(sources, lambda x: x <> ''), ',') AS sources FROM t""")
def scalar_release_features(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "torrents_torrent_sources").groupBy("info_hash").agg(F.collect_set("source").alias("sources"))
    t = table(spark, sf, "torrents").join(src, "info_hash", "left").select("info_hash", R.release_features(F.col("name"), F.col("sources"), F.col("extension")).alias("f"))
    value = lambda k: F.get(F.filter("f", lambda x: x["type"] == k), F.lit(0))["value"]
    named = [value(k).alias(a) for k, a in (("release_group", "grp"), ("quality_tag", "quality"), ("resolution", "resolution"), ("codec", "codec"), ("extension", "extension"))]
    sources = F.array_join(F.transform(F.filter("f", lambda x: x["type"] == "source"), lambda x: x["value"]), ",")
    return t.select("info_hash", *named, sources.alias("sources"))


@query("""SELECT info_hash, file_index, CASE WHEN lower(extension) IN ('7z', 'bz2', 'gz', 'iso', 'rar', 'tar', 'zip') THEN 'archive' WHEN lower(extension) IN ('aac', 'dsf', 'flac', 'm4a', 'm4b', 'mid', 'mp3', 'ogg', 'wav') THEN 'audio'
WHEN lower(extension) IN ('csv', 'json', 'xls', 'xlsx', 'xml') THEN 'data' WHEN lower(extension) IN ('azw', 'azw3', 'djvu', 'doc', 'docx', 'epub', 'htm', 'html', 'md', 'mobi', 'nfo', 'otf', 'pdf', 'ppt', 'pptx', 'rtf', 'txt') THEN 'document'
WHEN lower(extension) IN ('bmp', 'dds', 'gif', 'ico', 'jpeg', 'jpg', 'png', 'psd', 'svg', 'tif', 'tiff') THEN 'image' WHEN lower(extension) IN ('apk', 'bat', 'bin', 'deb', 'dll', 'dmg', 'exe', 'jar', 'lua', 'msi', 'package', 'pkg', 'rpm', 'sh') THEN 'software'
WHEN lower(extension) IN ('srt', 'sub', 'vtt') THEN 'subtitles' WHEN lower(extension) IN ('avi', 'flv', 'm4v', 'mkv', 'mov', 'mp4', 'mpeg', 'mpg', 'ts', 'vob', 'wmv') THEN 'video' END AS file_type FROM torrent_files""")
def scalar_file_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "torrent_files").select("info_hash", "file_index", R.file_type(F.col("extension")).alias("file_type"))


@query("SELECT l_orderkey, l_linenumber, power(l_linenumber, 4)::BIGINT + 15 + (l_orderkey % 30) * l_linenumber + 1 AS wait FROM lineitem")
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds until the next attempt, with a jitter below thirty taken from the key."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.backoff_seconds(F.col("l_linenumber"), F.col("l_orderkey") % 30).alias("wait"))


@query(r"""SELECT info_hash, nullif(regexp_extract(name, '(?i)(?:^|[^A-Za-z0-9])s(\d{1,2})e\d{1,4}(?:$|[^A-Za-z0-9])', 1), '')::INTEGER AS season,
nullif(regexp_extract(name, '(?i)(?:^|[^A-Za-z0-9])s\d{1,2}e(\d{1,4})(?:$|[^A-Za-z0-9])', 1), '')::INTEGER AS episode FROM torrents""")
def scalar_episode_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "torrents").select("info_hash", episode_numbers(F.col("name")).alias("e")).select("info_hash", "e.season", "e.episode")


@query()
def scalar_episodes_map(spark: SparkSession, sf: str) -> DataFrame:
    t = widen(table(spark, sf, "torrents").select("info_hash", "name")).withColumn("episodes", episodes_of("name"))
    series = F.col("episodes").isNotNull()
    n_eps = F.size(F.element_at(F.map_values("episodes"), 1))
    return t.select("info_hash", episodes_text("name").alias("text"), R.granularity(series, F.size("episodes"), n_eps, F.col("name")).alias("granularity"), has_episodes(F.col("episodes"), 1, [1, 2]).alias("has_s01e01_02"))


@query()
def scalar_titles(spark: SparkSession, sf: str) -> DataFrame:
    c = widen(table(spark, sf, "content").select("content_type", "content_source", "content_id", "updated_at", F.coalesce("original_title", "title").alias("t")))
    return c.select("content_type", "content_source", "content_id", "updated_at", normalized_title("t").alias("normalized"), title_family("t").alias("family"))


@query()
def scalar_title_year(spark: SparkSession, sf: str) -> DataFrame:
    t = widen(table(spark, sf, "torrents").select("info_hash", "name"))
    return t.select("info_hash", title_and_year("name").alias("p"), date_in("name").alias("air_date")).select("info_hash", "p.*", "air_date")


@query("SELECT info_hash, 'magnet:?xt=urn:btih:' || info_hash || '&dn=' || replace(url_encode(name), '%20', '+') || '&xl=' || size AS magnet FROM torrents")
def scalar_magnet_all(spark: SparkSession, sf: str) -> DataFrame:
    return _magnets(table(spark, sf, "torrents"))


def _magnets(t: DataFrame) -> DataFrame:
    return t.select("info_hash", R.magnet_uri(F.col("info_hash"), F.col("name"), F.col("size")).alias("magnet"))


@query("SELECT info_hash, sha256(unhex(info_hash)) AS blocked_key, (('0x' || substr(sha256('v1' || chr(0) || 'seed' || chr(0) || info_hash), 1, 16))::UBIGINT % 10000)::INTEGER AS bucket FROM torrents")
def hash_bucket_admission(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "torrents").select("info_hash", R.double_hash(F.col("info_hash")).alias("blocked_key"), R.admission_bucket(F.col("info_hash"), "v1", "seed").alias("bucket"))


@query("""SELECT info_hash, (regexp_matches(name, '(?i)(?:^|[^A-Za-z0-9_])meadow(?:$|[^A-Za-z0-9_])'))::INTEGER + (regexp_matches(name, '(?i)(?:^|[^A-Za-z0-9_])silent(?:$|[^A-Za-z0-9_])'))::INTEGER AS terms,
CASE WHEN regexp_matches(name, '\\p{Han}') THEN 'han' WHEN regexp_matches(name, '\\p{Cyrillic}') THEN 'cyrillic' ELSE 'other' END AS script FROM torrents""".replace("\\\\", "\\"))
def name_policy_tally(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    script = F.when(n.rlike(r"\p{IsHan}"), "han").when(n.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("other")
    return table(spark, sf, "torrents").select("info_hash", R.term_tally(n, ["meadow", "silent"]).alias("terms"), script.alias("script"))


_KEYWORD = R.keyword_pattern("sound(track|s)?", "ost", "original score")


@query(f"SELECT info_hash, regexp_matches(name, '{_KEYWORD}') AS hit FROM torrents".replace("original\\ score", "original score"))
def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "torrents").select("info_hash", F.col("name").rlike(_KEYWORD).alias("hit"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' ')))::DOUBLE / greatest(1, len(list_distinct(string_split(p_name, ' ') || string_split(p_type, ' ')))), 6) AS overlap FROM part")
def levenshtein_and_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), F.round(token_jaccard(F.col("p_name"), F.col("p_type")), 6).alias("overlap"))


@query("SELECT l_orderkey, list_sum(q) AS total, list_min(q) AS least, list_max(q) AS most, coalesce(list_position(q, 10.0), 0) - 1 AS index_of_ten, q::VARCHAR = list_sort(q)::VARCHAR AS sorted FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1)")
def list_functions(spark: SparkSession, sf: str) -> DataFrame:
    packed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))
    return packed.select("l_orderkey", F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_min("q").alias("least"), F.array_max("q").alias("most"), (F.array_position("q", 10.0) - 1).cast("int").alias("index_of_ten"), (F.col("q") == F.array_sort("q")).alias("sorted"))


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("chunk"), F.lit("D").alias("weight"), "text")
    return fts.postings(widen(d))


# the documents' languages use Latin letters only, which SQL can fold
_POSTS = """p AS MATERIALIZED (SELECT doc_id, unnest(w) AS lexeme, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL))"""


@query(f"WITH {_POSTS} SELECT lexeme, count(DISTINCT doc_id) AS documents, count(*) AS postings, sum(pos)::BIGINT AS positions FROM p GROUP BY 1")
def tokenize_postings_all(spark: SparkSession, sf: str) -> DataFrame:
    posts = _posts(spark, sf)
    return posts.groupBy("lexeme").agg(F.countDistinct("id").alias("documents"), F.count("*").alias("postings"), F.sum("pos").alias("positions"))


def _fts(name: str, text: str, sql: str) -> None:
    node = fts.parse_query(text)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fts.match(_posts(spark, sf), node).select(F.col("id").alias("doc_id"))

    run.__name__ = name
    query(f"WITH {_POSTS} {sql}")(run)


_fts("fts_boolean_all", "station (bridge | market) !quarry", "SELECT doc_id FROM p GROUP BY 1 HAVING bool_or(lexeme = 'station') AND bool_or(lexeme IN ('bridge', 'market')) AND NOT bool_or(lexeme = 'quarry')")
_fts("fts_phrase_all", '"under the" . bridge', "SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN p c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.lexeme = 'under' AND b.lexeme = 'the' AND c.lexeme = 'bridge'")
_fts("fts_prefix_all", "comp* lantern", "SELECT doc_id FROM p GROUP BY 1 HAVING bool_or(lexeme LIKE 'comp%') AND bool_or(lexeme = 'lantern')")


@query()
def fts_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """All matches with their cover-density rank, over weighted chunks of title, original title and overview."""
    c = table(spark, sf, "content").withColumn("id", F.concat_ws(":", "content_type", "content_source", "content_id", micros("updated_at").cast("string")))
    chunks = F.array(*[F.struct(F.lit(i).alias("chunk"), F.lit(w).alias("weight"), F.col(t).cast("string").alias("text")) for i, (t, w) in enumerate((("title", "A"), ("original_title", "A"), ("release_year", "B"), ("overview", "D")))])
    posts = fts.postings(widen(c.select("id", F.explode(chunks).alias("c")).select("id", "c.*")).distinct())
    return fts.cover_density(fts.match(posts, fts.parse_query("meadow | (silent . anchor*) | бел*")))
