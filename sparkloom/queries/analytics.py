"""Analytics queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.analytics import bucketed, counts_where, first_over_threshold, geometric_mean, nearest_rank, newest_per_key, preferred_max, safe_ratio, wilson
from sparkloom.queries.registry import Registry
from sparkloom.session import micros, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""SELECT source, count(*) FILTER (seeders IS NULL) AS unknown, count(*) FILTER (seeders = 0) AS zero, count(*) FILTER (seeders > 0) AS alive, count(*) FILTER (published_at < TIMESTAMP '2000-01-01') AS placeholder
FROM torrents_torrent_sources GROUP BY source""")
def filtered_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("seeders")
    return counts_where(table(spark, sf, "torrents_torrent_sources"), ["source"], unknown=s.isNull(), zero=s == 0, alive=s > 0, placeholder=F.col("published_at") < F.lit("2000-01-01").cast("timestamp"))


@query("""SELECT count(*) AS works, count(*) FILTER (EXISTS (SELECT 1 FROM content_attributes a WHERE a.content_type = c.content_type AND a.content_source = c.content_source AND a.content_id = c.content_id AND a.attr_key LIKE 'alt\\_title:%' ESCAPE '\\')) AS with_alternative FROM content c""")
def filtered_exists_count(spark: SparkSession, sf: str) -> DataFrame:
    key = ["content_type", "content_source", "content_id"]
    alt = table(spark, sf, "content_attributes").filter(F.col("attr_key").startswith("alt_title:")).select(*key).distinct().withColumn("_alt", F.lit(True))
    return table(spark, sf, "content").join(alt, key, "left").agg(F.count("*").alias("works"), F.count_if("_alt").alias("with_alternative"))


@query("""SELECT coalesce(nullif(json_extract_string(props, '$.k'), ''), '(unknown)') AS page, count(*) AS n FROM events GROUP BY 1""")
def group_by_json_path(spark: SparkSession, sf: str) -> DataFrame:
    page = F.coalesce(F.nullif(F.get_json_object("props", "$.k"), F.lit("")), F.lit("(unknown)"))
    return table(spark, sf, "events").groupBy(page.alias("page")).agg(F.count("*").alias("n"))


def _bucket(unit: str):
    sql = f"SELECT date_trunc('{unit}', ts) AS bucket, event_type, count(*) AS n, count(*) FILTER (event_type ILIKE '%click%') AS clicks, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = table(spark, sf, "events")
        return bucketed(e, "ts", unit, ["event_type"], n=F.count("*"), clicks=F.count_if(F.col("event_type").ilike("%click%")), total=F.round(F.sum("value"), 4))

    run.__name__ = f"bucketed_metrics_{unit}"
    query(sql)(run)


for _unit in ("minute", "hour", "day"):
    _bucket(_unit)


@query("""SELECT source, date_trunc('day', created_at) AS bucket, updated_at > created_at + INTERVAL 1 HOUR AS updated, count(*) AS n, sum(epoch_us(updated_at) - epoch_us(created_at))::BIGINT AS latency_us
FROM torrents_torrent_sources GROUP BY ALL""")
def source_time_buckets(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "torrents_torrent_sources").withColumn("updated", F.col("updated_at") > F.col("created_at") + F.expr("interval 1 hour"))
    return bucketed(r, "created_at", "day", ["source", "updated"], n=F.count("*"), latency_us=F.sum(micros("updated_at") - micros("created_at")))


@query("SELECT source AS name, count(DISTINCT info_hash) AS n FROM torrents_torrent_sources WHERE source LIKE 't%' AND source NOT IN ('tv') GROUP BY source ORDER BY n, name LIMIT 10")
def tag_suggestion(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a prefix, without those excluded, rarest first: a top-10 report."""
    r = table(spark, sf, "torrents_torrent_sources").filter(F.col("source").startswith("t") & ~F.col("source").isin("tv"))
    return r.groupBy(F.col("source").alias("name")).agg(F.countDistinct("info_hash").alias("n")).orderBy("n", "name").limit(10)


@query("""SELECT info_hash, coalesce(max(seeders) FILTER (source = 'tracker'), max(seeders) FILTER (source <> 'tracker')) AS seeders, coalesce(max(leechers) FILTER (source = 'tracker'), max(leechers) FILTER (source <> 'tracker')) AS leechers,
min(published_at) FILTER (published_at > TIMESTAMP '2000-01-01') AS published_at FROM torrents_torrent_sources GROUP BY info_hash""")
def coalesced_source_max(spark: SparkSession, sf: str) -> DataFrame:
    tracker = F.col("source") == "tracker"
    p = F.col("published_at")
    return table(spark, sf, "torrents_torrent_sources").groupBy("info_hash").agg(
        preferred_max(F.col("seeders"), tracker).alias("seeders"), preferred_max(F.col("leechers"), tracker).alias("leechers"), F.min(F.when(p > F.lit("2000-01-01").cast("timestamp"), p)).alias("published_at")
    )


@query("""SELECT l_returnflag, round(CASE WHEN sum(l_quantity + l_tax) > 0 THEN sum(l_quantity) / sum(l_quantity + l_tax) ELSE 0.5 END, 6) AS ratio, round(exp(avg(ln(greatest(l_discount, 0.01)))), 6) AS geomean FROM lineitem GROUP BY 1""")
def global_ratio(spark: SparkSession, sf: str) -> DataFrame:
    q = F.sum("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(safe_ratio(q, F.sum(F.col("l_quantity") + F.col("l_tax")), 0.5), 6).alias("ratio"), F.round(geometric_mean(F.col("l_discount")), 6).alias("geomean"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 4) AS mean_price, bool_or(o_totalprice > 400000) AS any_large, max(o_orderdate) AS watermark FROM orders GROUP BY 1")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"), F.max("o_orderdate").alias("watermark")
    )


@query("""SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1, 2""")
def latest_n_window_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    newest = newest_per_key(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5)
    return newest.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""SELECT info_hash, list({'file_index': file_index, 'size': size} ORDER BY file_index) AS files FROM torrent_files GROUP BY 1""")
def ordered_struct_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "torrent_files").groupBy("info_hash").agg(F.array_sort(F.collect_list(F.struct("file_index", "size"))).alias("files"))


@query("""SELECT info_hash, sum(CASE WHEN lower(extension) IN ('mkv','mp4','avi','ts') THEN size ELSE -size END)::BIGINT AS signed_video, sum(CASE WHEN lower(extension) IN ('flac','mp3') THEN size ELSE -size END)::BIGINT AS signed_audio FROM torrent_files GROUP BY 1""")
def size_weighted_signed_sum(spark: SparkSession, sf: str) -> DataFrame:
    def signed(*ext: str):
        return F.sum(F.when(F.lower("extension").isin(*ext), F.col("size")).otherwise(-F.col("size")))

    return table(spark, sf, "torrent_files").groupBy("info_hash").agg(signed("mkv", "mp4", "avi", "ts").alias("signed_video"), signed("flac", "mp3").alias("signed_audio"))


@query("SELECT s.source_name, count(r.info_hash) AS observations, count(DISTINCT r.info_hash) AS torrents FROM torrent_sources s LEFT JOIN torrents_torrent_sources r ON s.source_key = r.source GROUP BY 1")
def source_histogram(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "torrents_torrent_sources").groupBy(F.col("source").alias("source_key")).agg(F.count("info_hash").alias("observations"), F.countDistinct("info_hash").alias("torrents"))
    return table(spark, sf, "torrent_sources").join(r, "source_key", "left").select("source_name", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("torrents", F.lit(0)).alias("torrents"))


@query("""SELECT l_shipdate, l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem""")
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))


@query("""WITH g AS (SELECT text_kind, d.source, count(*) AS n, count(*) FILTER (text_kind = 'prose') AS k FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2),
s AS (SELECT source, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM g GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM s)
SELECT source, n::BIGINT AS n, round(p, 6) AS rate, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS low,
round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS high FROM z""")
def rate_with_wilson(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    g = j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text_kind") == "prose").cast("double").alias("k"))
    low, high = wilson(F.col("k"), F.col("n").cast("double"))
    return g.select("source", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS at_rank, count(l_extendedprice) AS n FROM lineitem GROUP BY 1")
def nearest_rank_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.95)


@query("""SELECT d.source, count(*) FILTER (text_kind = 'prose' AND n_chars >= 400) AS tp, count(*) FILTER (text_kind <> 'prose' AND n_chars >= 400) AS fp, count(*) FILTER (text_kind = 'prose' AND n_chars < 400) AS fn,
count(*) FILTER (text_kind <> 'prose' AND n_chars < 400) AS tn FROM labels JOIN documents d USING (doc_id) GROUP BY 1""")
def confusion_by_group(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    truth, said = F.col("text_kind") == "prose", F.col("n_chars") >= 400
    return counts_where(j, ["source"], tp=truth & said, fp=~truth & said, fn=truth & ~said, tn=~truth & ~said)


@query("""SELECT user_id, min(ts) AS first_at FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS c FROM events) WHERE c >= 5 GROUP BY 1""")
def sliding_rule_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return first_over_threshold(table(spark, sf, "events"), ["user_id"], "ts", 7, 5)


@query("""SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("p"))  # partial before the joins
    j = o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("p"), 2).alias("revenue"))
