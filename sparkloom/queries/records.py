"""Evaluation, snapshot and naming queries with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.naming import bracket_marks, file_search_strings, wanted_keys
from sparkloom.operators.evaluation import cluster_bootstrap, paired_comparison, scores, weighted_rules
from sparkloom.operators.snapshots import apply_changes, plan_changes, remove_with_snapshot, restore, restore_children, union_of_removed
from sparkloom.queries.registry import Registry
from sparkloom.session import table, widen

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text", "info_hash"), "doc_id")


@query("""SELECT lang, count(*) FILTER (p AND q) AS tp, count(*) FILTER (NOT p AND q) AS fp, count(*) FILTER (p AND NOT q) AS fn, count(*) FILTER (NOT p AND NOT q) AS tn,
round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (q), 0), 6) AS precision, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p), 0), 6) AS recall FROM (SELECT lang, text_kind = 'prose' AS p, n_chars >= 500 AS q FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def scores_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return scores(_judged(spark, sf), ["lang"], F.col("text_kind") == "prose", F.col("n_chars") >= 500)


@query(r"""WITH j AS (SELECT lang, (n_chars >= 400) = (text_kind = 'prose') AS a, regexp_matches(text, '[.!?]\s*$') = (text_kind = 'prose') AS b FROM labels JOIN documents USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM j GROUP BY 1)
SELECT lang, only_a, only_b, round(least(1, coalesce(2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)))), 1)), 8) AS p_value FROM g""".replace("\\\\", "\\"))
def paired_systems(spark: SparkSession, sf: str) -> DataFrame:
    truth = F.col("text_kind") == "prose"
    return paired_comparison(_judged(spark, sf), ["lang"], (F.col("n_chars") >= 400) == truth, F.col("text").rlike(r"[.!?]\s*$") == truth)


@query()
def bootstrap_rate(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_bootstrap(_judged(spark, sf), "info_hash", (F.col("text_kind") == "prose").cast("double"))


@query("SELECT info_hash, (CASE WHEN regexp_matches(name, '1080p') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(name, '(?i)web') THEN 0.25 ELSE 0 END)::DOUBLE AS quality, (CASE WHEN regexp_matches(name, '(?i)readnfo') THEN -1 ELSE 0 END)::DOUBLE AS trust FROM torrents")
def weighted_rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("quality", "1080p", 0.5), ("quality", "(?i)web", 0.25), ("trust", "(?i)readnfo", -1.0)]
    return weighted_rules(table(spark, sf, "torrents"), F.col("name"), rules).select("info_hash", "quality", "trust")


@query("SELECT info_hash, 'extension' AS field, extension AS old, nullif(regexp_extract(lower(name), '[^/.]\\.([a-z0-9]+)$', 1), '') AS new FROM torrents WHERE extension IS DISTINCT FROM nullif(regexp_extract(lower(name), '[^/.]\\.([a-z0-9]+)$', 1), '')".replace("\\\\", "\\"))
def planned_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return plan_changes(table(spark, sf, "torrents"), "info_hash", extension=F.nullif(F.regexp_extract(F.lower("name"), r"[^/.]\.([a-z0-9]+)$", 1), F.lit("")))


@query("""SELECT 'applied' AS step, info_hash, coalesce(files_count, 1) AS files_count, upper(extension) AS extension FROM torrents UNION ALL SELECT 'back', info_hash, CASE WHEN private THEN 77 ELSE files_count END, extension FROM torrents""")
def repair_and_roll_back(spark: SparkSession, sf: str) -> DataFrame:
    """Rows after a journal, and after it is taken back: cells that changed in between keep their new value."""
    t = table(spark, sf, "torrents").select("info_hash", "files_count", "extension", "private")
    journal = plan_changes(t, "info_hash", files_count=F.coalesce("files_count", F.lit(1)), extension=F.upper("extension"))
    fields = ["files_count", "extension"]
    applied = apply_changes(t, "info_hash", journal, fields=fields)
    moved = applied.withColumn("files_count", F.when(F.col("private"), 77).otherwise(F.col("files_count")).cast("int"))
    back = apply_changes(moved, "info_hash", journal, back=True, fields=fields)
    step = lambda df, name: df.select(F.lit(name).alias("step"), "info_hash", *fields)
    return step(applied, "applied").unionByName(step(back, "back"))


@query("""SELECT 'stay' AS step, info_hash, size, NULL::BIGINT AS files FROM torrents WHERE files_status <> 'multi' UNION ALL SELECT 'restored', t.info_hash, size, n FROM torrents t LEFT JOIN (SELECT info_hash, count(*) AS n FROM torrent_files GROUP BY 1) USING (info_hash)""")
def remove_and_restore(spark: SparkSession, sf: str) -> DataFrame:
    """What stays after a removal with its files, and everything once it is restored."""
    t, files = table(spark, sf, "torrents"), table(spark, sf, "torrent_files")
    stay, snap = remove_with_snapshot(t, "info_hash", t.filter("files_status = 'multi'"), "gone", {"files": files})
    left = files.join(t.filter("files_status = 'multi'").select("info_hash"), "info_hash", "left_anti")
    back = restore(stay, "info_hash", snap)
    counts = restore_children(left, "info_hash", snap, "files", back).groupBy("info_hash").agg(F.count("*").alias("files"))
    whole = back.join(counts, "info_hash", "left").select(F.lit("restored").alias("step"), "info_hash", "size", "files")
    return stay.select(F.lit("stay").alias("step"), "info_hash", "size", F.lit(None).cast("long").alias("files")).unionByName(whole)


@query("SELECT place, count(*) AS n FROM (SELECT DISTINCT info_hash, 'live' AS place FROM documents WHERE info_hash IS NOT NULL UNION SELECT info_hash, 'snapshot' FROM torrents WHERE private) GROUP BY 1")
def removed_places(spark: SparkSession, sf: str) -> DataFrame:
    live = table(spark, sf, "documents").filter("info_hash is not null").select("info_hash")
    return union_of_removed(live, table(spark, sf, "torrents").filter("private"), "info_hash").groupBy("place").agg(F.count("*").alias("n"))


@query()
def wanted_item_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = widen(table(spark, sf, "torrents").select("info_hash", "name")).select("info_hash", wanted_keys("name").alias("key"))
    return t.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"), F.min("info_hash").alias("first"))


@query(r"""WITH t AS (SELECT *, nullif(regexp_extract(name, ' - (\d{1,4})(?:v\d)?(?: |\[|\(|[.]|$)', 1), '')::INTEGER AS n FROM torrents)
SELECT info_hash, nullif(regexp_extract(name, '^\s*\[([A-Za-z][A-Za-z0-9 _-]{1,30})\]', 1), '') AS grp, CASE WHEN n NOT BETWEEN 1900 AND 2099 AND n NOT IN (480, 576, 720, 1080, 2160) THEN n END AS absolute_episode,
regexp_matches(name, '(?i)dual[ ._-]?audio|multi[ ._-]?audio') AS dual_audio, regexp_matches(name, '(?i)[\[(]batch[\])]') AS batch FROM t""")
def fansub_marks(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "torrents").select("info_hash", bracket_marks(F.col("name")).alias("m"))
    return m.select("info_hash", F.col("m.group").alias("grp"), "m.absolute_episode", "m.dual_audio", "m.batch")


@query()
def file_strings(spark: SparkSession, sf: str) -> DataFrame:
    return file_search_strings(table(spark, sf, "torrent_files"), "info_hash", "file_index", "path")
