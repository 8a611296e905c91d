"""Search, facet, join, order and set-operation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.plans.search import (
    Facet,
    JoinSpec,
    SearchPlan,
    all_of,
    any_of,
    exists_flag,
    exists_in,
    found_and_missing,
    hydrate_many,
    hydrate_one,
    keyset_page,
    negate,
    one_of,
    where,
)
from sparkloom.operators.analytics import fair_batch
from sparkloom.operators.matching import top_by_dot_product
from sparkloom.queries.registry import Registry
from sparkloom.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""WITH m AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en','fr') AND source IS NOT NULL AND NOT (source = 'nfo_texts')),
p AS (SELECT * FROM m ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 21 OFFSET 20)
SELECT doc_id, lang, source, n_chars, (SELECT count(*) FROM p) > 20 AS has_next_page FROM p ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20""")
def search_page_documents(spark: SparkSession, sf: str) -> DataFrame:
    plan = SearchPlan(table(spark, sf, "documents")).with_where(one_of("lang", ["en", "fr"]), all_of(where(F.col("source").isNotNull()), negate(where(F.col("source") == "nfo_texts"))))
    return plan.with_order(F.col("n_chars").desc_nulls_last(), tie=("doc_id",)).with_page(20, page=2).with_select("doc_id", "lang", "source", "n_chars").items()


@query("SELECT count(*) AS total_count FROM documents WHERE lang = 'en' OR n_chars < 300")
def search_total(spark: SparkSession, sf: str) -> DataFrame:
    return SearchPlan(table(spark, sf, "documents")).with_where(any_of(where(F.col("lang") == "en"), where(F.col("n_chars") < 300))).total()


def _facets(spark: SparkSession, sf: str) -> SearchPlan:
    return SearchPlan(table(spark, sf, "torrents")).with_facets(
        Facet("files_status", F.col("files_status"), selected=("single", "over_threshold", "no_such_status")),
        Facet("extension", F.col("extension"), selected=("mkv", None)),
        Facet("private", F.col("private")),
    )


_STATUS, _EXT = "files_status IN ('single','over_threshold','no_such_status')", "(extension = 'mkv' OR extension IS NULL)"


@query(f"""SELECT 'files_status' AS facet, v AS value, coalesce(n, 0) AS n, s AS selected FROM (
  SELECT coalesce(a.v, b.v) AS v, a.n, b.v IS NOT NULL AS s FROM (SELECT files_status AS v, count(*) AS n FROM torrents WHERE {_EXT} GROUP BY 1) a
  FULL JOIN (VALUES ('single'), ('over_threshold'), ('no_such_status')) b(v) ON a.v = b.v)
UNION ALL SELECT 'extension', extension, count(*), coalesce(extension = 'mkv', true) FROM torrents WHERE {_STATUS} GROUP BY extension
UNION ALL SELECT 'private', private::VARCHAR, count(*), false FROM torrents WHERE {_STATUS} AND {_EXT} GROUP BY private""")
def facet_counts_or(spark: SparkSession, sf: str) -> DataFrame:
    return _facets(spark, sf).facet_counts()


@query("""WITH t AS (SELECT info_hash, list(DISTINCT source) AS ss FROM torrents_torrent_sources GROUP BY 1)
SELECT 'source' AS facet, s AS value, count(*) AS n, s IN ('dht','tracker') AS selected FROM (SELECT unnest(ss) AS s FROM t WHERE list_has_all(ss, ['dht','tracker'])) GROUP BY s""")
def facet_counts_and_many(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "torrents_torrent_sources").groupBy("info_hash").agg(F.collect_set("source").alias("sources"))
    return SearchPlan(per).with_facets(Facet("source", F.col("sources"), logic="and", selected=("dht", "tracker"), many=True)).facet_counts()


@query("""SELECT 'release_year' AS facet, release_year::VARCHAR AS value, count(*) AS n, false AS selected FROM content WHERE content_type = 'movie' AND (release_year BETWEEN 1000 AND 9999 OR release_year IS NULL) GROUP BY release_year""")
def facet_release_year(spark: SparkSession, sf: str) -> DataFrame:
    year = F.col("release_year")
    return SearchPlan(table(spark, sf, "content")).with_where(where(F.col("content_type") == "movie"), where(year.isNull() | year.between(1000, 9999))).with_facets(Facet("release_year", year)).facet_counts()


@query("""SELECT t.info_hash, t.name, t.size FROM torrents t JOIN (SELECT DISTINCT info_hash FROM torrent_files WHERE extension = 'srt') f USING (info_hash)
ORDER BY t.size DESC, t.info_hash LIMIT 50""")
def search_by_file_extension(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "torrent_files").filter(F.col("extension") == "srt")
    plan = SearchPlan(table(spark, sf, "torrents")).with_where(exists_in(files, "info_hash")).with_order(F.col("size").desc(), tie=("info_hash",)).with_page(50)
    return plan.items().select("info_hash", "name", "size")


@query("SELECT info_hash, name FROM torrents t WHERE extension = 'mkv' OR EXISTS (SELECT 1 FROM torrent_files f WHERE f.info_hash = t.info_hash AND f.extension = 'mkv')")
def exists_or_column(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "torrent_files").filter(F.col("extension") == "mkv")
    return exists_flag(table(spark, sf, "torrents"), files, "info_hash", "_has").filter((F.col("extension") == "mkv") | F.col("_has")).select("info_hash", "name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join_exists(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return SearchPlan(table(spark, sf, "customer")).with_where(exists_in(big, "c_custkey")).with_page(None).matches().select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return SearchPlan(table(spark, sf, "customer")).with_where(negate(exists_in(some, "c_custkey"))).matches().select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_name = 'FRANCE' OR n_name LIKE '%1%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def join_closure(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    plan = (
        SearchPlan(orders)
        .with_join("customer", JoinSpec(table(spark, sf, "customer"), ("c_custkey",)))
        .with_join("nation", JoinSpec(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), ("c_nationkey",), needs=("customer",)))
        .with_join("never_needed", JoinSpec(table(spark, sf, "part"), ("p_partkey",)))
        .with_where(where((F.col("n_name") == "FRANCE") | F.col("n_name").like("%1%"), "nation"))
    )
    return plan.with_order(F.col("o_totalprice").desc(), tie=("o_orderkey",)).with_page(25).with_select("o_orderkey", "o_totalprice", "c_name", "n_name").items().drop("has_next_page")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def grouped_representative(spark: SparkSession, sf: str) -> DataFrame:
    plan = SearchPlan(table(spark, sf, "orders")).with_page(100).with_select("o_custkey", "o_orderkey", "o_totalprice")
    by = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return plan.grouped(["o_custkey"], by, by)


@query("""SELECT t.content_type, t.content_source, t.content_id, t.title, t.popularity FROM (SELECT *, row_number() OVER (PARTITION BY content_type, content_source, content_id ORDER BY updated_at DESC, popularity DESC, title) AS r FROM content) t
WHERE r = 1 AND NOT coalesce(adult, false) ORDER BY popularity DESC, content_type, content_source, content_id LIMIT 30""")
def search_content_latest(spark: SparkSession, sf: str) -> DataFrame:
    key = ["content_type", "content_source", "content_id"]
    latest = SearchPlan(table(spark, sf, "content")).with_page(None).grouped(key, [F.col("updated_at").desc(), F.col("popularity").desc(), F.col("title")])
    plan = SearchPlan(latest).with_scope(where(~F.coalesce("adult", F.lit(False)))).with_order(F.col("popularity").desc(), tie=tuple(key)).with_page(30)
    return plan.with_select(*key, "title", "popularity").items().drop("has_next_page")


@query("""SELECT DISTINCT c.content_type, c.content_source, c.content_id FROM content c WHERE (content_source = 'tmdb' AND content_id LIKE '1%') OR EXISTS
(SELECT 1 FROM content_attributes a WHERE a.content_type = c.content_type AND a.content_source = c.content_source AND a.content_id = c.content_id AND a.attr_source = 'imdb' AND a.attr_key = 'id' AND a.attr_value LIKE 'tt%1')""")
def either_identifier(spark: SparkSession, sf: str) -> DataFrame:
    key = ["content_type", "content_source", "content_id"]
    alt = table(spark, sf, "content_attributes").filter((F.col("attr_source") == "imdb") & (F.col("attr_key") == "id") & F.col("attr_value").like("tt%1")).select(*key).distinct().withColumn("_alt", F.lit(True))
    c = table(spark, sf, "content").select(*key).distinct().join(alt, key, "left")
    return c.filter(((F.col("content_source") == "tmdb") & F.col("content_id").like("1%")) | F.coalesce("_alt", F.lit(False))).select(*key)


@query("SELECT content_type, content_source, content_id, release_date FROM content WHERE release_date >= DATE '1990-01-01' AND release_date < DATE '2000-01-01' AND content_type IN ('movie','tv_show')")
def release_date_window(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("release_date")
    plan = SearchPlan(table(spark, sf, "content")).with_where(where((d >= F.lit("1990-01-01").cast("date")) & (d < F.lit("2000-01-01").cast("date"))), one_of("content_type", ["movie", "tv_show"]))
    return plan.matches().select("content_type", "content_source", "content_id", "release_date")


@query("SELECT info_hash FROM torrents WHERE 1 = 0")
def empty_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return SearchPlan(table(spark, sf, "torrents")).with_where(one_of("info_hash", [])).matches().select("info_hash")


@query("""SELECT o.o_orderkey, {'c_name': c.c_name, 'c_mktsegment': c.c_mktsegment} AS customer FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def hydrate_has_one(spark: SparkSession, sf: str) -> DataFrame:
    subs = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return hydrate_one(table(spark, sf, "orders"), subs, "o_custkey", "customer").filter(F.col("customer").isNotNull()).select("o_orderkey", "customer")


@query("""SELECT t.info_hash, coalesce(f.paths, []) AS paths FROM torrents t LEFT JOIN (SELECT info_hash, list(path ORDER BY file_index) AS paths FROM torrent_files GROUP BY 1) f USING (info_hash)""")
def hydrate_has_many(spark: SparkSession, sf: str) -> DataFrame:
    out = hydrate_many(table(spark, sf, "torrents").select("info_hash"), table(spark, sf, "torrent_files"), "info_hash", "files", ["file_index", "path"])
    return out.select("info_hash", F.transform("files", lambda x: x["path"]).alias("paths"))


@query("""SELECT min(position) AS position, k AS info_hash, bool_or(EXISTS (SELECT 1 FROM torrents t WHERE t.info_hash = k)) AS found FROM (
SELECT sighting_id AS position, hash_text AS k FROM hash_sightings WHERE hash_text IS NOT NULL) GROUP BY k""")
def found_missing_partition(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "hash_sightings").filter("hash_text is not null").select(F.col("sighting_id").alias("position"), F.col("hash_text").alias("info_hash"))
    return found_and_missing(wanted, table(spark, sf, "torrents"), "info_hash")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def keyset_page_orders(spark: SparkSession, sf: str) -> DataFrame:
    return keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 1000, 100)


@query("SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 12 UNION SELECT r_regionkey FROM region")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").filter("n_nationkey < 12").select(F.col("n_regionkey").alias("k"))
    return n.union(table(spark, sf, "region").select("r_regionkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_orderpriority").like("1%")).select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").filter("o_totalprice > 100000").select("o_custkey"))


@query("SELECT event_type AS k, 'event' AS kind FROM events UNION ALL SELECT o_orderstatus, 'order' FROM orders")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("k"), F.lit("event").alias("kind"))
    return e.unionByName(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("k"), F.lit("order").alias("kind")))


@query("WITH RECURSIVE w(n, k) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n + 5, k FROM w WHERE n < 20) SELECT n, k FROM w")
def recursive_cte(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("_recursive_nation")
    return spark.sql("WITH RECURSIVE w(n, k) AS (SELECT n_nationkey, n_regionkey FROM _recursive_nation WHERE n_nationkey < 5 UNION ALL SELECT n + 5, k FROM w WHERE n < 20) SELECT n, k FROM w")


@query("""SELECT info_hash, name, coalesce(s, -1) AS seeders FROM torrents LEFT JOIN (SELECT info_hash, max(seeders) AS s FROM torrents_torrent_sources GROUP BY 1) USING (info_hash)
ORDER BY coalesce(s, -1) DESC, info_hash DESC LIMIT 40""")
def order_by_seeders(spark: SparkSession, sf: str) -> DataFrame:
    best = table(spark, sf, "torrents_torrent_sources").groupBy("info_hash").agg(F.max("seeders").alias("s"))
    t = table(spark, sf, "torrents").join(best, "info_hash", "left").select("info_hash", "name", F.coalesce("s", F.lit(-1)).alias("seeders"))
    return t.orderBy(F.col("seeders").desc(), F.col("info_hash").desc()).limit(40)


_STALE = "2025-09-01"


@query(f"""WITH c AS (SELECT info_hash, max(updated_at) AS seen FROM torrents_torrent_sources WHERE seeders IS NOT NULL GROUP BY 1), re AS (SELECT info_hash, seen FROM c JOIN torrents USING (info_hash) WHERE seen < TIMESTAMP '{_STALE}' ORDER BY seen, info_hash LIMIT 400),
rest AS (SELECT t.info_hash, seen FROM torrents t LEFT JOIN c USING (info_hash) WHERE (seen IS NULL OR seen < TIMESTAMP '{_STALE}') AND t.info_hash NOT IN (SELECT info_hash FROM re) ORDER BY seen ASC NULLS FIRST, t.info_hash LIMIT (SELECT greatest(0, 800 - count(*)) FROM re))
SELECT info_hash, seen IS NULL AS never FROM (SELECT * FROM re UNION ALL SELECT * FROM rest) ORDER BY seen ASC NULLS FIRST, info_hash LIMIT 800""")
def fair_stale_selection(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of 800: half for the oldest rechecks, what is left for rows never checked first and then for more rechecks."""
    return fair_batch(table(spark, sf, "torrents").select("info_hash"), table(spark, sf, "torrents_torrent_sources").filter("seeders is not null").groupBy("info_hash").agg(F.max("updated_at").alias("at")), F.lit(_STALE).cast("timestamp_ntz"), 800)


@query("""SELECT query_id, vec_id, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(greatest(-1, least(1, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 5) AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0)) WHERE rank <= 20""")
def cosine_shortlist_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 20 as a query, against all rows: the 20 best by clamped and rounded dot product."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return top_by_dot_product(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), e, 20)
