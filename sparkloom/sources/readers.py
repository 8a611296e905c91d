"""Sources and sinks: NDJSON import and export, hash feeds, alias dumps, merges by key, syndication rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.folds import merge_latest
from sparkloom.session import ensure_checkpoint_dir

IMPORT_SCHEMA = "infoHash string, name string, size long, private boolean, source string, seeders int, leechers int, publishedAt timestamp"


def read_ndjson(spark: SparkSession, path: str, import_id: str) -> DataFrame:
    """One JSON item a line; malformed lines are kept in ``_corrupt`` and left to the caller."""
    rows = spark.read.schema(IMPORT_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("import_id", F.lit(import_id))


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line with keys in alphabetical order, so equal rows make equal bytes."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def read_hash_feed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case 64-digit hashes of a line feed; comments and anything else are skipped."""
    line = F.lower(F.trim(F.regexp_replace("value", r"[#;].*$", "")))
    return spark.read.text(path).select(line.alias("hash")).filter(F.col("hash").rlike("^[0-9a-f]{64}$")).distinct()


def alias_table(titles: DataFrame, mappings: DataFrame, normalize) -> DataFrame:
    """(normalized, ref): aliases of mapped works; an alias of several works goes to the smallest ref.

    ``titles``: work_id, title; ``mappings``: work_id, ref. ``normalize`` is a Column function.
    """
    j = titles.join(mappings, "work_id").select(normalize(F.col("title")).alias("normalized"), "ref").filter(F.col("normalized") != "")
    return j.groupBy("normalized").agg(F.min("ref").alias("ref"))


def import_items(torrents: DataFrame, links: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables after an import: unknown torrents are inserted and known ones kept; source links are overwritten by key."""
    fresh = items.groupBy(F.col("infoHash").alias("info_hash")).agg(F.max_by(F.struct("name", "size"), F.struct("name", "size")).alias("i")).select("info_hash", "i.name", "i.size")
    added = fresh.join(torrents.select("info_hash"), "info_hash", "left_anti")
    new_links = items.groupBy("source", F.col("infoHash").alias("info_hash")).agg(F.max("seeders").alias("seeders"), F.max("leechers").alias("leechers"), F.current_timestamp().alias("updated_at"))
    return torrents.select("info_hash", "name", "size").unionByName(added), merge_latest(links.select("source", "info_hash", "seeders", "leechers", F.col("updated_at").cast("timestamp").alias("updated_at")), new_links, ["source", "info_hash"], "updated_at")


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder of the session's checkpoints, for frames that have to be written and read again; it goes with the
    application."""
    ensure_checkpoint_dir(spark)
    made = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return made


def feed_item(title, link, size, published, attributes: dict[str, F.Column] | None = None) -> F.Column:
    """An XML feed item as text, with markup escaped; an attribute whose value is null is left out."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    told = [F.coalesce(F.concat(F.lit(f'<torznab:attr name="{n}" value="'), esc(v.cast("string")), F.lit('"/>')), F.lit("")) for n, v in (attributes or {}).items()]
    return F.concat(F.lit("<item><title>"), esc(title), F.lit('</title><enclosure url="'), esc(link), F.lit('" length="'), size.cast("string"), F.lit('"/><pubDate>'), F.date_format(published, "yyyy-MM-dd HH:mm:ss"), F.lit("</pubDate>"), *told, F.lit("</item>"))
