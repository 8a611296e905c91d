"""Evidence, liveness, job, tag and name queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.anime import clean_titles, is_batch, is_film
from sparkloom.functions.language import audio_signal, english_audio, foreign_audio_only, languages_in, subtitle_signal
from sparkloom.functions.naming import bracket_marks
from sparkloom.operators import jobs as J
from sparkloom.operators import liveness as L
from sparkloom.operators.matching import candidates
from sparkloom.queries.registry import Registry
from sparkloom.session import micros, table, widen
from sparkloom.sources import evidence as E

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_APP = "CASE event_type WHEN 'view' THEN 'sonarr' WHEN 'click' THEN 'radarr' WHEN 'signup' THEN 'lidarr' WHEN 'purchase' THEN 'readarr' ELSE 'other' END"
_HASH = "lpad(to_hex(event_id), 40, '0')"


def _app() -> F.Column:
    t = F.col("event_type")
    return F.when(t == "view", "sonarr").when(t == "click", "radarr").when(t == "signup", "lidarr").when(t == "purchase", "readarr").otherwise("other")


def _hex40(c: str) -> F.Column:
    return F.lpad(F.lower(F.hex(c)), 40, "0")


@query(f"""WITH e AS (SELECT *, {_APP} AS app, CASE user_id % 4 WHEN 0 THEN 'Grab' WHEN 1 THEN 'Download' WHEN 2 THEN 'DownloadFolderImported' ELSE 'Test' END AS ev FROM events)
SELECT app AS source, CASE ev WHEN 'Grab' THEN 'webhook_grab' ELSE 'webhook_import' END AS kind, lower({_HASH}) AS info_hash, CASE app WHEN 'sonarr' THEN 'tv' WHEN 'radarr' THEN 'movie' WHEN 'lidarr' THEN 'music' ELSE 'book' END AS media_type,
CASE WHEN user_id <> 0 AND app <> 'lidarr' THEN app || ':' || user_id END AS media_id, CASE ev WHEN 'Grab' THEN 60 ELSE 100 END AS strength FROM e WHERE app <> 'other' AND ev <> 'Test'""")
def evidence_webhooks(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries made of events; an artist's id is missing in all of them."""
    event = F.element_at(F.array(*[F.lit(x) for x in ("Grab", "Download", "DownloadFolderImported", "Test")]), (F.col("user_id") % 4 + 1).cast("int"))
    ident = [F.col("user_id").alias(k) for k in ("seriesId", "movieId", "authorId")]
    body = F.to_json(F.struct(event.alias("eventType"), F.upper(_hex40("event_id")).alias("downloadId"), *ident))
    d = table(spark, sf, "events").select(F.lit("one").alias("instance"), _app().alias("app"), F.col("ts").alias("received_at"), body.alias("body"))
    return E.webhook_evidence(d).select("source", "kind", "info_hash", "media_type", "media_id", "strength")


@query(f"""WITH e AS (SELECT *, {_APP} AS app FROM events WHERE ts > TIMESTAMP '2024-01-15')
SELECT app AS source, CASE user_id % 4 WHEN 1 THEN 'grabbed:' ELSE 'downloadFolderImported:' END || event_id AS object_id, CASE WHEN event_id % 3 = 0 THEN lower({_HASH}) END AS info_hash, CASE user_id % 4 WHEN 1 THEN 60 ELSE 80 END AS strength FROM e WHERE app <> 'other' AND user_id % 4 IN (1, 3)""")
def evidence_history(spark: SparkSession, sf: str) -> DataFrame:
    """History entries made of events, read on from a watermark; two thirds have a download id that is no hash."""
    download = F.when(F.col("event_id") % 3 == 0, _hex40("event_id")).otherwise("nzb-1")
    entry = F.to_json(F.struct(F.col("event_id").alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"), download.alias("downloadId")))
    rows = table(spark, sf, "events").select(F.lit("one").alias("instance"), _app().alias("app"), (F.col("user_id") % 4).alias("event_code"), entry.alias("entry"))
    return E.history_evidence(rows, F.lit("2024-01-15").cast("timestamp")).select("source", "object_id", "info_hash", "strength")


@query("""WITH t AS (SELECT info_hash, CASE extension WHEN 'mkv' THEN ' Private ' WHEN 'mp4' THEN 'tv' ELSE '' END AS c, CASE files_status WHEN 'single' THEN 'StalledDL' WHEN 'multi' THEN 'uploading' WHEN 'no_info' THEN 'moving' ELSE 'whatever' END AS s, updated_at AS u FROM torrents)
SELECT 'poll_categories' AS kind, info_hash, lower(trim(c)) AS category, NULL AS state, CASE WHEN trim(c) = 'Private' THEN 40 ELSE 30 END AS strength FROM t WHERE trim(c) <> ''
UNION ALL SELECT 'qb_state', info_hash, nullif(lower(trim(c)), ''), lower(s), CASE WHEN s = 'uploading' THEN 50 ELSE 35 END FROM t WHERE s <> 'moving'""")
def evidence_clients(spark: SparkSession, sf: str) -> DataFrame:
    x, s = F.col("extension"), F.col("files_status")
    rows = table(spark, sf, "torrents").select(
        F.lit("qb").alias("instance"), F.upper("info_hash").alias("hash"), "name", F.when(x == "mkv", " Private ").when(x == "mp4", "tv").otherwise("").alias("category"),
        F.when(s == "single", "StalledDL").when(s == "multi", "uploading").when(s == "no_info", "moving").otherwise("whatever").alias("state"), F.col("updated_at").alias("polled_at"),
    )
    return E.client_evidence(rows).select("kind", "info_hash", "category", "state", "strength")


@query("SELECT source, hash_text AS info_hash, min(observed_at) AS observed_at FROM hash_sightings WHERE hash_text IS NOT NULL AND regexp_full_match(hash_text, '[0-9a-f]{40}') GROUP BY 1, 2")
def evidence_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Sightings as evidence: rows without a hash are rejected, repeats keep the earliest; half are inserted after the others."""
    s = table(spark, sf, "hash_sightings").withColumn("h", F.when(F.col("hash_text").rlike(r"\A[0-9a-f]{40}\z"), F.col("hash_text")))
    rows = E._evidence(s, source=F.col("source"), kind=F.lit("sighting"), instance=F.lit("one"), object_id=F.lit("x"), info_hash=F.col("h"), observed_at=F.col("observed_at").cast("timestamp"))
    first = E.insert_evidence(None, rows.filter("source = 'dht'"))
    return E.insert_evidence(first, rows.filter("source <> 'dht'")).select("source", "info_hash", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


_SCRAPE = """m AS (SELECT info_hash, max(greatest(s, 0)) AS seeders, max(greatest(l, 0)) AS leechers, max(c) AS completed, arg_min(source, row(-s, source)) AS best FROM (SELECT *, coalesce(seeders, 0) AS s, coalesce(leechers, 0) AS l, 0 AS c FROM torrents_torrent_sources) WHERE s > 0 OR l > 0 GROUP BY 1)"""


@query(f"WITH {_SCRAPE} SELECT info_hash, m.info_hash IS NOT NULL AS tracker_known, seeders, leechers, completed, CASE WHEN seeders > 0 THEN best END AS best_tracker, CASE WHEN seeders > 0 OR leechers > 0 THEN 'positive' ELSE 'unknown' END AS class FROM torrents LEFT JOIN m USING (info_hash)")
def scrape_merge(spark: SparkSession, sf: str) -> DataFrame:
    return E.merge_scrapes(_answers(spark, sf), table(spark, sf, "torrents"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "torrents_torrent_sources")
    return s.select("info_hash", F.col("source").alias("tracker"), F.coalesce("seeders", F.lit(0)).alias("seeders"), F.coalesce("leechers", F.lit(0)).alias("leechers"), F.lit(0).alias("completed"))


@query(f"WITH {_SCRAPE} SELECT source, info_hash, seeders, leechers FROM torrents_torrent_sources WHERE NOT (source = 'tracker' AND info_hash IN (SELECT info_hash FROM torrents)) UNION ALL SELECT 'tracker', info_hash, seeders, leechers FROM m JOIN torrents USING (info_hash)")
def scrape_mirror(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows after a scrape: the tracker's rows are those of the answers, all others stay."""
    merged = E.merge_scrapes(_answers(spark, sf), table(spark, sf, "torrents"))
    return E.mirror_scrapes(table(spark, sf, "torrents_torrent_sources"), merged, F.lit("2025-12-01").cast("timestamp_ntz")).select("source", "info_hash", "seeders", "leechers")


_STATES = "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'downloading' WHEN 'O' THEN 'stalledUP' ELSE 'odd' END AS state FROM orders WHERE o_custkey % 5 <> 0"


@query(f"""WITH c AS ({_STATES}), i AS (SELECT l_orderkey, arg_min(row(CASE WHEN l_returnflag = 'R' THEN 'sonarr' ELSE 'radarr' END, CASE l_linestatus WHEN 'F' THEN 'downloadFolderImported' ELSE 'downloadFailed' END), l_linenumber) AS x FROM (SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_returnflag, l_linenumber * 1000000 + l_partkey) AS l_returnflag, arg_min(l_linestatus, l_linenumber * 1000000 + l_partkey) AS l_linestatus FROM lineitem GROUP BY l_orderkey) GROUP BY 1),
j AS (SELECT o.o_orderkey, CASE WHEN o.o_orderpriority LIKE '1%' THEN 'sonarr' WHEN o.o_orderpriority LIKE '2%' THEN '' ELSE 'radarr' END AS src, c.o_orderkey IS NOT NULL AS held, c.state, x[1] AS isrc, x[2] AS ev FROM orders o LEFT JOIN c USING (o_orderkey) LEFT JOIN i ON l_orderkey = o.o_orderkey),
k AS (SELECT *, CASE WHEN isrc = src OR src = '' THEN ev END AS event FROM j)
SELECT o_orderkey, CASE WHEN event = 'downloadFolderImported' THEN 'imported_ok' WHEN event = 'downloadFailed' THEN 'import_failed' WHEN NOT held THEN 'missing_in_qb' WHEN state = 'downloading' THEN 'downloading' WHEN state = 'stalledUP' THEN 'completed_pending_import' ELSE 'unknown' END AS verdict FROM k""")
def attribution_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    o, p = table(spark, sf, "orders"), F.col("o_orderpriority")
    grabs = o.select("o_orderkey", F.when(p.like("1%"), "sonarr").when(p.like("2%"), "").otherwise("radarr").alias("source"))
    st = F.col("o_orderstatus")
    clients = o.filter("o_custkey % 5 <> 0").select("o_orderkey", F.when(st == "F", "downloading").when(st == "O", "stalledUP").otherwise("odd").alias("state"))
    imports = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "sonarr").otherwise("radarr").alias("source"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rank"), F.when(F.col("l_linestatus") == "F", "downloadFolderImported").otherwise("downloadFailed").alias("event_type"))
    return E.attribution(grabs, clients, imports, "o_orderkey").select("o_orderkey", "verdict")


def _liveness(spark: SparkSession, sf: str) -> DataFrame:
    s, ts = F.col("files_status"), F.col("updated_at").cast("timestamp")
    return table(spark, sf, "torrents").select(
        "info_hash", F.when(s == "single", "alive").when(s == "multi", "suspect").otherwise("dead").alias("status"), F.when(F.col("private"), "error").alias("last_qb_state"), F.when(s == "multi", ts).alias("suspect_first_seen_at"), F.when(s == "multi", 3).otherwise(0).alias("suspect_observations"),
        ts.alias("last_observed_at"), F.lit(None).cast("timestamp").alias("blacklisted_at"), F.when(s == "no_info", ts + F.expr("INTERVAL 30 DAYS")).alias("next_revalidate_at"), F.when(F.col("extension") == "mkv", "qb_state").alias("alive_source"),
    )


@query("SELECT info_hash FROM torrents WHERE files_status = 'no_info' AND updated_at + INTERVAL 30 DAY <= TIMESTAMP '2025-06-01' ORDER BY updated_at, info_hash LIMIT 25")
def liveness_due(spark: SparkSession, sf: str) -> DataFrame:
    return L.due_for_revalidation(_liveness(spark, sf), F.lit("2025-06-01").cast("timestamp"), 25)


@query("""WITH h AS (SELECT DISTINCT info_hash FROM documents WHERE info_hash IS NOT NULL UNION SELECT info_hash FROM known_hashes),
l AS (SELECT *, CASE files_status WHEN 'single' THEN 'alive' WHEN 'multi' THEN 'suspect' ELSE 'dead' END AS st, CASE WHEN extension = 'mkv' THEN 'qb_state' END AS src FROM torrents),
a AS (SELECT info_hash, private, CASE WHEN info_hash IN (SELECT info_hash FROM torrents_torrent_sources WHERE seeders > 0) AND (st = 'suspect' OR files_status = 'no_info') THEN 'alive' ELSE st END AS st, CASE WHEN info_hash IN (SELECT info_hash FROM torrents_torrent_sources WHERE seeders > 0) AND (st = 'suspect' OR files_status = 'no_info') THEN 'seeds' ELSE src END AS src,
 CASE WHEN files_status = 'multi' AND info_hash NOT IN (SELECT info_hash FROM torrents_torrent_sources WHERE seeders > 0) THEN 3 ELSE 0 END AS n FROM l),
b AS (SELECT coalesce(a.info_hash, h.info_hash) AS info_hash, a.*, h.info_hash IS NOT NULL AND (a.info_hash IS NULL OR (NOT private AND NOT (st = 'alive' AND coalesce(src, '') = 'qb_state'))) AS turn, a.info_hash IS NULL AS fresh FROM a FULL JOIN h ON a.info_hash = h.info_hash)
SELECT info_hash, CASE WHEN turn AND coalesce(st, '') <> 'dead' THEN 'suspect' ELSE st END AS status, CASE WHEN NOT turn THEN n WHEN fresh OR st = 'alive' THEN 1 ELSE n + 1 END AS suspect_observations FROM b""")
def liveness_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of live hashes, then one of suspect hashes, over a state."""
    live = table(spark, sf, "torrents_torrent_sources").filter("seeders > 0")
    suspects = table(spark, sf, "documents").filter("info_hash is not null").select("info_hash").unionByName(table(spark, sf, "known_hashes").select("info_hash"))
    at = F.lit("2025-12-01").cast("timestamp")
    state = L.mark_alive_batch(_liveness(spark, sf), live, at, "seeds")
    return L.record_suspect_batch(state, suspects, at).select("info_hash", "status", "suspect_observations")


@query()
def availability_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of hashes at a fixed time from their source rows; SQL has no fold with a gap, the tests have one."""
    s = table(spark, sf, "torrents_torrent_sources")
    at, n = F.col("updated_at").cast("timestamp"), F.col("seeders")
    o = s.select("info_hash", F.concat_ws(":", "source", micros("updated_at").cast("string")).alias("id"), "source", F.when(n.isNull(), "unknown").when(n == 0, "zero").otherwise("positive").alias("class"), at.alias("observed_at"), (at + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), F.lit(True).alias("qualified"), F.lit(False).alias("private"))
    return L.availability(o, F.lit("2025-06-01").cast("timestamp"), fresh_hours=24 * 300, protect_hours=24 * 30).select("info_hash", "state", "reason", F.size("observations").alias("n"))


@query("""WITH m AS (SELECT info_hash, CASE lang WHEN 'en' THEN 'eligible_audio' WHEN 'fr' THEN 'ineligible_review' WHEN 'es' THEN 'conflicting' ELSE 'unknown' END AS s, n_chars < 60 AS short FROM documents WHERE info_hash IS NOT NULL),
g AS (SELECT info_hash, list(DISTINCT s) AS ss, bool_or(short) AS short FROM m GROUP BY 1)
SELECT info_hash, CASE WHEN short THEN 'unknown' WHEN list_contains(ss, 'conflicting') THEN 'conflicting' WHEN len(ss) > 1 THEN 'mixed_review' ELSE ss[1] END AS state FROM g""")
def english_track_states(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    members = table(spark, sf, "documents").filter("info_hash is not null").select("info_hash", F.when(lang == "en", "yes").when(lang == "fr", "no").when(lang == "es", "conflicting").otherwise("unknown").alias("audio"), F.lit("unknown").alias("subtitles"), (F.col("n_chars") < 60).alias("incomplete"))
    return L.english_tracks(members).select("info_hash", "state")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    s, at = F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("classify").alias("queue"), F.col("o_orderkey").cast("string").alias("fingerprint"), F.when(s == "F", "retry").when(s == "O", "pending").otherwise("processed").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 4).cast("int").alias("retries"), F.lit(3).alias("max_retries"),
        at.alias("created_at"), at.alias("run_after"), F.when(s == "P", at).alias("ran_at"), F.when(F.col("o_custkey") % 7 == 0, F.lit("2000-01-01").cast("timestamp")).alias("deadline"), (F.col("o_custkey") % 3 * 86400 * 400).alias("archival_seconds"), F.lit(None).cast("string").alias("error"),
    )


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate <= TIMESTAMP '2030-01-01' ORDER BY o_orderstatus = 'F', substr(o_orderpriority, 1, 1)::INT, o_orderdate, o_orderkey LIMIT 200")
def job_picks(spark: SparkSession, sf: str) -> DataFrame:
    return J.due_jobs(_jobs(spark, sf), F.lit("2030-01-01").cast("timestamp"), 200).select("id")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 4 AS tries, o_orderstatus = 'F' AS again, o_custkey % 7 = 0 AS late, o_totalprice < 100000 AS bad FROM orders WHERE o_orderstatus IN ('F', 'O')),
x AS (SELECT *, tries + (again AND NOT late)::INT AS n, late OR bad AS failed FROM r)
SELECT o_orderkey AS id, CASE WHEN NOT failed THEN 'processed' WHEN n < 3 THEN 'retry' ELSE 'failed' END AS status, n AS retries, CASE WHEN failed AND n < 3 THEN n ** 4 + 16 + 7 * n END::BIGINT AS wait, CASE WHEN late THEN 'the job did not complete before its deadline' WHEN bad THEN 'broken' END AS error FROM x""")
def job_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs after a run of each that waits; every job's jitter is seven."""
    now = F.lit("2030-01-01").cast("timestamp")
    runs = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") < 100000, "broken").alias("error"))
    out = J.finish_jobs(_jobs(spark, sf), runs, now, F.lit(7)).filter(F.col("ran_at") == now)
    wait = F.when(F.col("status") == "retry", F.col("run_after").cast("double").cast("long") - now.cast("double").cast("long"))
    return out.select("id", "status", "retries", wait.alias("wait"), "error")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderdate + to_seconds((o_custkey % 3 * 86400 * 400)::BIGINT) < TIMESTAMP '1998-06-01')")
def job_garbage(spark: SparkSession, sf: str) -> DataFrame:
    return J.collect_garbage(_jobs(spark, sf), F.lit("1998-06-01").cast("timestamp")).select("id")


@query("""WITH t AS (SELECT DISTINCT info_hash, CASE lang WHEN 'en' THEN 'one' ELSE 'two' END AS name FROM documents WHERE info_hash IS NOT NULL), p AS (SELECT * FROM t UNION SELECT info_hash, unnest(['one', 'three']) FROM torrents WHERE private),
s AS (SELECT * FROM p WHERE info_hash NOT IN (SELECT info_hash FROM torrents WHERE files_status = 'no_info') UNION ALL SELECT info_hash, 'only' FROM torrents WHERE files_status = 'no_info') SELECT info_hash, name FROM s WHERE NOT (name = 'two' AND info_hash IN (SELECT info_hash FROM torrents WHERE extension = 'mkv'))""")
def tag_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Tags put, then set, then deleted."""
    t = table(spark, sf, "torrents")
    tags = table(spark, sf, "documents").filter("info_hash is not null").select("info_hash", F.when(F.col("lang") == "en", "one").otherwise("two").alias("name")).distinct()
    after = J.set_tags(J.put_tags(tags, t.filter("private"), ["three", "one"]), t.filter("files_status = 'no_info'"), ["only"])
    return J.delete_tags(after, t.filter("extension = 'mkv'"), ["two"])


@query()
def learnt_rule_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Adjustments of rules from outcomes in order; SQL has no walk within bounds, the tests have one."""
    e = F.col("event_type")
    outcome = F.when(e == "purchase", "applied").when(e == "error", "import_failed").otherwise("ignored")
    none = F.lit(None)
    f = table(spark, sf, "events").select(F.array(F.concat(F.lit("r"), (F.col("user_id") % 9).cast("string"))).alias("matched_rules"), J.reward(outcome, none.cast("string"), none.cast("string"), none.cast("boolean"), none.cast("boolean")).alias("reward"), "ts", "event_id")
    return J.learnt_weights(f, ["ts", "event_id"])


@query()
def languages_of_names(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "torrents").select(F.explode(languages_in(spark, F.col("name"))).alias("language"))
    return t.groupBy("language").agg(F.count("*").alias("n"))


@query()
def anime_names(spark: SparkSession, sf: str) -> DataFrame:
    """Clean titles of bracketed names, with what their marks say."""
    t = widen(table(spark, sf, "torrents").filter(F.col("name").startswith("[")).select("info_hash", "name"))
    n = F.col("name")
    m = bracket_marks(n)
    return t.select("info_hash", clean_titles(n, m["absolute_episode"]).alias("title"), is_batch(n).alias("batch"), is_film(n).alias("film"), english_audio(F.lit(True), audio_signal(n), subtitle_signal(n)).alias("english"))


_FOREIGN = "hindi|tamil|telugu|kannada|malayalam|bengali|french|german|spanish|castellano|italian|portuguese|russian|polish|arabic|latino"


@query(rf"""SELECT info_hash FROM torrents WHERE (regexp_matches(name, '(?i)(?:^|[^a-z])(?:dublado|lektor|dubbing[.]pl|pl-?dub|truefrench|vff|vfq|vfi|vf2|castellano|dublaj)(?:[^a-z]|$)') OR regexp_matches(name, '(?i)(?:{_FOREIGN}|turkish)[ ._-]{{0,2}}dub(?:bed)?s?\b'))
AND NOT regexp_matches(name, '(?i)(?:dual|multi)[ ._-]?audio|\[dual\]') AND NOT regexp_matches(name, '(?i)(?:^|[^a-z])(?:eng|english|en|multi)(?:[^a-z]|$)') AND NOT regexp_matches(name, '(?i)eng(?:lish)?[ ._-]?dub|\[(?:eng)?dub\]|(?:eng(?:lish)?|multi|soft)[ ._-]?subs?|multiple[ ._-]?subtitle|[\[(](?:eng)?subs?[\])]')
AND NOT (regexp_matches(name, '(?i)\b(?:dubbed|subbed)\b') AND NOT regexp_matches(name, '(?i)(?:{_FOREIGN})[ ._-]{{0,2}}(?:dub|sub)(?:bed)?s?\b'))""")
def foreign_audio_releases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "torrents").filter(foreign_audio_only(F.col("name"))).select("info_hash")


@query()
def content_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Works retrieved for every work's title, in passes."""
    c = table(spark, sf, "content")
    ref = F.concat_ws(":", "content_type", "content_source", "content_id")
    works = c.select(ref.alias("w_id"), F.col("content_type").alias("kind"), "title", F.col("release_year").alias("year")).dropDuplicates(["w_id"])
    return candidates(works.withColumnRenamed("w_id", "q_id"), works)


@query("""WITH g AS (SELECT user_id, ts, hour(ts) AS h, event_type AS t FROM events WHERE event_type IN ('signup', 'view')), i AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, h, (SELECT min(i.ts) FROM i WHERE i.user_id = g.user_id AND i.ts >= g.ts) AS done, ts, t FROM g), d AS (SELECT * FROM r WHERE done IS NOT NULL OR ts + INTERVAL 2 DAY < TIMESTAMP '2024-01-31'),
f AS (SELECT DISTINCT user_id, done, 'hour' AS type, h::VARCHAR AS value FROM d UNION SELECT DISTINCT user_id, done, 'kind', t FROM d) SELECT type, value, count(*) FILTER (done IS NOT NULL) + 1 AS alpha, count(*) FILTER (done IS NULL) + 1 AS beta FROM f GROUP BY 1, 2""")
def prior_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Priors of features of attempts that a later purchase decides, or that expire after two days."""
    from sparkloom.operators.folds import beta_priors, resolve_attempts

    e = table(spark, sf, "events")
    pair = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("value"))
    grabs = e.filter(F.col("event_type").isin("signup", "view")).select("user_id", F.col("ts").alias("at"), F.array(pair("hour", F.hour("ts").cast("string")), pair("kind", F.col("event_type"))).alias("features"))
    imports = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    return beta_priors(resolve_attempts(grabs, imports, F.lit("2024-01-31").cast("timestamp_ntz"), 2, "user_id"), "features", F.col("success"))


@query("""WITH p AS (SELECT user_id, sha1(event_id::VARCHAR) AS s FROM events), b AS (SELECT user_id, (('0x' || substr(s, 1, 2))::INT + 256 * ('0x' || substr(s, 3, 2))::INT) % 2048 AS b FROM p UNION SELECT user_id, (('0x' || substr(s, 5, 2))::INT + 256 * ('0x' || substr(s, 7, 2))::INT) % 2048 FROM p)
SELECT user_id, count(*) AS bits, round(ln(greatest(1, 2048 - count(*)) / 2048) / (2 * ln(1 - 1 / 2048)), 4) AS size FROM b GROUP BY 1""")
def swarm_size_estimates(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.operators.analytics import swarm_sizes

    return swarm_sizes(table(spark, sf, "events"), "user_id", F.col("event_id").cast("string"))


@query("""WITH f AS (SELECT info_hash, list(path) AS ps, list(regexp_extract(path, '[.]([^.]*)$', 1)) AS es FROM torrent_files GROUP BY 1), t AS (SELECT t.*, coalesce(ps, []) AS ps, coalesce(es, []) AS es FROM torrents t LEFT JOIN f USING (info_hash))
SELECT info_hash, CASE WHEN regexp_matches(name, '(?i)proper') THEN NULL WHEN size > 0 AND size < 5000000 THEN 'below_min_size' WHEN size > 20000000000 THEN 'above_max_size' WHEN lower(coalesce(extension, '')) IN ('exe', 'iso') OR len(list_filter(es, lambda e: lower(e) IN ('exe', 'iso'))) > 0 THEN 'blocked_extension'
WHEN regexp_matches(name, '(?i)cam|readnfo') THEN 'block_pattern_matched' WHEN len(list_filter(ps, lambda p: regexp_matches(p, '(?i)cam|readnfo'))) > 0 THEN 'block_file_pattern_matched' END AS reason FROM t""")
def filter_list_reasons(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.operators.evaluation import filter_list

    files = table(spark, sf, "torrent_files").groupBy("info_hash").agg(F.collect_list("path").alias("ps"))
    t = table(spark, sf, "torrents").join(files, "info_hash", "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<string>")))
    extensions = F.array_append(F.transform("ps", lambda p: F.regexp_extract(p, r"[.]([^.]*)$", 1)), F.coalesce("extension", F.lit("")))
    reason = filter_list(t, F.col("name"), F.col("size"), extensions, F.col("ps"), F.lit(None).cast("string"), ["(?i)proper"], 5_000_000, 20_000_000_000, [".exe", "ISO"], [], ["(?i)cam", "(?i)readnfo"])
    return t.select("info_hash", reason.alias("reason"))
