"""State, matching and policy queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.release import release_features
from sparkloom.operators import folds
from sparkloom.operators.matching import best_matches
from sparkloom.queries.registry import Registry
from sparkloom.queries.scalars import ORACLE as _SCALARS
from sparkloom.session import micros, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_FEATURES = _SCALARS["scalar_release_features"]
_STRENGTH = "CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 80 WHEN 'click' THEN 60 WHEN 'view' THEN 40 ELSE 30 END"
_SUSPECT = "event_type = 'error'"
_ALIVE = "event_type IN ('click','purchase')"


def _strength() -> F.Column:
    t = F.col("event_type")
    return F.when(t == "purchase", 100).when(t == "signup", 80).when(t == "click", 60).when(t == "view", 40).otherwise(30)


@query(f"SELECT user_id, event_type AS label, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_STRENGTH} DESC, ts DESC, event_id) AS r FROM events) WHERE r = 1")
def canonical_label_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("strength", _strength()).withColumn("label", F.col("event_type"))
    return folds.strongest(e, "user_id", "strength", "ts", "event_id", ["label", "value", "ts"])


@query("SELECT user_id, event_type AS verdict, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def verdict_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("verdict", F.col("event_type"))
    return folds.latest(e, ["user_id"], ["ts", "event_id"], ["verdict", "event_id", "ts"])


@query("""SELECT user_id, event_id, lag(value) OVER w AS previous, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak,
max(CASE WHEN value > 0 THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_positive_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def swarm_history(spark: SparkSession, sf: str) -> DataFrame:
    return folds.previous_and_peak(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", "ts").select("user_id", "event_id", "previous", "peak", "last_positive_at")


@query(f"""WITH e AS (SELECT *, {_SUSPECT} AS s, sum(CASE WHEN {_ALIVE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events WHERE {_SUSPECT} OR {_ALIVE}),
r AS (SELECT *, sum(s::INT) OVER w AS n, min(CASE WHEN s THEN ts END) OVER w AS first FROM e WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, max((s AND n >= 2 AND ts >= first + INTERVAL 4 HOUR)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS dead, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last FROM r)
SELECT user_id, CASE WHEN dead = 1 THEN 'dead' WHEN n > 0 THEN 'suspect' ELSE 'alive' END AS status, n::BIGINT AS suspect_observations, first AS first_suspect_at, ts AS last_event_at FROM d WHERE last = 1""")
def liveness_fold(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    return folds.suspicion_runs(table(spark, sf, "events"), "user_id", "ts", ["ts", "event_id"], t.isin("click", "purchase"), t == "error")


@query("""SELECT f.type, f.value, count(*) FILTER (ok) + 1 AS alpha, count(*) FILTER (NOT ok) + 1 AS beta FROM (
SELECT l_returnflag = 'R' AS ok, unnest([{'type': 'status', 'value': l_linestatus}, {'type': 'line', 'value': l_linenumber::VARCHAR}]) AS f FROM lineitem) GROUP BY 1, 2""")
def beta_priors(spark: SparkSession, sf: str) -> DataFrame:
    return folds.beta_priors(_outcomes(spark, sf), "features", F.col("l_returnflag") == "R")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    features = F.array(F.struct(F.lit("status").alias("type"), F.col("l_linestatus").alias("value")), F.struct(F.lit("line").alias("type"), F.col("l_linenumber").cast("string").alias("value")))
    return table(spark, sf, "lineitem").withColumn("features", features)


@query("""WITH p AS (SELECT f.type, f.value, count(*) FILTER (ok) + 1 AS a, count(*) FILTER (NOT ok) + 1 AS b FROM (SELECT l_returnflag = 'R' AS ok, unnest([{'type': 'status', 'value': l_linestatus}, {'type': 'line', 'value': l_linenumber::VARCHAR}]) AS f FROM lineitem) GROUP BY 1, 2),
i AS (SELECT l_orderkey, l_quantity, unnest([{'type': 'status', 'value': l_linestatus}, {'type': 'line', 'value': l_linenumber::VARCHAR}]) AS f FROM lineitem)
SELECT l_orderkey, round(exp(avg(ln(greatest(CASE WHEN a + b - 2 >= 10 THEN a / (a + b) ELSE (SELECT sum(a) / sum(a + b) FROM p) END, 0.01)))) * (1 + ln(1 + max(l_quantity))), 6) AS score FROM i LEFT JOIN p ON i.f.type = p.type AND i.f.value = p.value GROUP BY 1""")
def geomean_rerank_all(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf)
    return folds.rerank(o, "l_orderkey", "features", F.col("l_quantity"), folds.beta_priors(o, "features", F.col("l_returnflag") == "R"))


@query("""WITH c AS (SELECT info_hash, lang, count(*) AS n FROM documents WHERE info_hash IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY info_hash) AS t, row_number() OVER (PARTITION BY info_hash ORDER BY n DESC, lang) AS k FROM c)
SELECT info_hash, lang, n AS votes, t::BIGINT AS total FROM r WHERE k = 1 AND n >= 2 AND n * 3 >= t * 2""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return folds.majority(table(spark, sf, "documents").filter("info_hash is not null"), "info_hash", "lang")


@query("""WITH v AS (SELECT doc_id, info_hash, lang FROM documents WHERE info_hash IS NOT NULL), c AS (SELECT info_hash, lang, count(*) AS n FROM v WHERE lang IS NOT NULL GROUP BY 1, 2),
x AS (SELECT v.doc_id, c.lang AS elected, c.n - (v.lang IS NOT DISTINCT FROM c.lang)::INT AS n FROM v JOIN c USING (info_hash)),
y AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, elected) AS k FROM x)
SELECT doc_id, elected FROM y WHERE k = 1 AND n >= 2 AND n * 3 >= t * 2""")
def majority_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "documents").filter("info_hash is not null").select("doc_id", "info_hash", "lang")
    return folds.leave_one_out(v, "doc_id", "info_hash", "lang")


@query("""SELECT source, info_hash, seeders, leechers, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY source, info_hash ORDER BY updated_at DESC NULLS LAST, created_at DESC, seeders DESC NULLS LAST, leechers DESC NULLS LAST) AS r FROM torrents_torrent_sources) WHERE r = 1""")
def upsert_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "torrents_torrent_sources")
    return folds.latest(r, ["source", "info_hash"], ["updated_at", "created_at", "seeders", "leechers"], ["seeders", "leechers", "updated_at"])


@query("""SELECT min(sighting_id) AS sighting_id, hash_text, source FROM hash_sightings WHERE hash_text IS NOT NULL GROUP BY hash_text, source""")
def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hash_sightings").filter("hash_text is not null").groupBy("hash_text", "source").agg(F.min("sighting_id").alias("sighting_id"))


@query("""WITH e AS (SELECT *, first_value(event_type) OVER w AS last, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
b AS (SELECT user_id, any_value(last) AS last, coalesce(min(r) FILTER (event_type = 'purchase' OR event_type <> last), max(r) + 1) - 1 AS n FROM e GROUP BY 1)
SELECT user_id, CASE WHEN last = 'purchase' THEN 0 ELSE n END AS failures, CASE WHEN last <> 'purchase' THEN last END AS last_reason, CASE WHEN last = 'purchase' THEN 0 WHEN n = 1 THEN 60 WHEN n = 2 THEN 300 WHEN n = 3 THEN 1800 ELSE 7200 END AS wait_seconds FROM b""")
def peer_backoff_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("reason"))
    return folds.backoff_fold(e, "user_id", ["ts", "event_id"], "ok", "reason")


@query("SELECT info_hash FROM torrents ORDER BY xor(('0x' || substr(info_hash, 1, 15))::BIGINT, ('0x0123456789abcde')::BIGINT), xor(('0x' || substr(info_hash, 16, 15))::BIGINT, ('0xf0123456789abcd')::BIGINT), xor(('0x' || substr(info_hash, 31, 10))::BIGINT, ('0xef01234567')::BIGINT) LIMIT 20")
def xor_nearest_k(spark: SparkSession, sf: str) -> DataFrame:
    return folds.xor_nearest(table(spark, sf, "torrents"), "info_hash", "0123456789abcdef0123456789abcdef01234567", 20)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 500")
def purge_oldest_batch(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")))
    return folds.keep_with_budget(o, [F.col("o_orderdate"), F.col("o_orderkey")], 500).select("o_orderkey")


@query("""SELECT info_hash FROM torrents t WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.info_hash = t.info_hash) AND EXISTS (SELECT 1 FROM torrents_torrent_sources s WHERE s.info_hash = t.info_hash AND s.seeders = 0)
AND NOT EXISTS (SELECT 1 FROM torrents_torrent_sources s WHERE s.info_hash = t.info_hash AND (s.seeders IS NULL OR s.seeders > 0))""")
def retention_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without evidence whose every source says zero: one grouped flag set instead of three joins."""
    s = table(spark, sf, "torrents_torrent_sources").groupBy("info_hash").agg(F.bool_or(F.col("seeders") == 0).alias("zero"), F.bool_or(F.col("seeders").isNull() | (F.col("seeders") > 0)).alias("other"))
    t = table(spark, sf, "torrents").select("info_hash").join(s.filter("zero and not other"), "info_hash", "left_semi")
    return t.join(table(spark, sf, "documents").filter("info_hash is not null").select("info_hash"), "info_hash", "left_anti")


@query("""SELECT doc_id, CASE WHEN source = 'nfo_texts' THEN 'blocked_source' WHEN n_chars < 200 THEN 'short' WHEN regexp_matches(text, '\\p{Cyrillic}|\\p{Han}') THEN 'script' WHEN lang NOT IN ('en','fr') THEN 'language' ELSE 'none' END AS decision FROM documents""".replace("\\\\", "\\"))
def content_filter_ladder(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", folds.decision_ladder((F.col("source") == "nfo_texts", "blocked_source"), (F.col("n_chars") < 200, "short"), (F.col("text").rlike(r"\p{IsCyrillic}|\p{IsHan}"), "script"), (~F.col("lang").isin("en", "fr"), "language"), otherwise="none").alias("decision"))


@query("""WITH g AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), i AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, arg_min(l_returnflag, row(l_shipdate, l_linenumber, l_returnflag)) AS flag FROM lineitem GROUP BY 1)
SELECT coalesce(CASE WHEN i.l_orderkey IS NULL THEN 'never' WHEN flag = 'R' THEN 'returned' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END, '?') AS verdict, count(*) AS n, count(first_ship) AS shipped FROM g LEFT JOIN i ON o_orderkey = l_orderkey GROUP BY 1""")
def attribution_chain(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"), F.min_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("flag"))
    j = table(spark, sf, "orders").join(first, "o_orderkey", "left")
    verdict = folds.decision_ladder((F.col("first_ship").isNull(), "never"), (F.col("flag") == "R", "returned"), (F.col("o_orderstatus") == "F", "done"), otherwise="open")
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.count("first_ship").alias("shipped"))


@query()
def fuzzy_best_match(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "content")
    left = c.select(F.concat_ws(":", "content_type", "content_source", "content_id", micros("updated_at").cast("string")).alias("l_id"), F.coalesce("original_title", "title").alias("title"), F.col("release_year").alias("year"))
    right = c.select(F.concat_ws(":", "content_type", "content_source", "content_id").alias("r_id"), "title", F.col("release_year").alias("year"))
    return best_matches(left, right)


@query(f"""WITH f AS ({_FEATURES}), s AS (SELECT info_hash, unnest(list_distinct(list(source))) AS source FROM torrents_torrent_sources GROUP BY 1),
u AS (SELECT 'release_group' AS type, grp AS value FROM f UNION ALL SELECT 'quality_tag', quality FROM f UNION ALL SELECT 'resolution', resolution FROM f UNION ALL SELECT 'codec', codec FROM f UNION ALL SELECT 'extension', extension FROM f UNION ALL SELECT 'source', source FROM s JOIN torrents USING (info_hash))
SELECT type, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2""")
def release_feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each feature of names, sources and extensions occurs."""
    src = table(spark, sf, "torrents_torrent_sources").groupBy("info_hash").agg(F.collect_set("source").alias("sources"))
    t = table(spark, sf, "torrents").join(src, "info_hash", "left")
    f = t.select(F.explode(release_features(F.col("name"), F.col("sources"), F.col("extension"))).alias("f"))
    return f.groupBy(F.col("f.type").alias("type"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))
