"""Batch jobs over a folder of tables: ``python -m sparkloom.jobs NAME --tables DIR [--out DIR --apply] [--after KEY] [--limit N]``.

A job plans a journal (key, field, old, new). Without ``--apply`` it only counts what it would change; with it the journal and the
changed table go to ``--out``. ``--after`` goes on behind a key and ``--limit`` bounds the keys of a run, so a long job can be done
in steps: every run reports its last key. Reports only count.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.anime import clean_titles, is_batch, with_anime_type
from sparkloom.functions.episodes import episodes_of, episodes_text
from sparkloom.functions.language import audio_signal, english_audio, subtitle_signal
from sparkloom.functions.naming import bracket_marks
from sparkloom.functions.release import granularity, keyword_pattern, name_extension, release_group, video_codec, video_resolution, video_source
from sparkloom.functions.titles import title_family
from sparkloom.operators.liveness import availability
from sparkloom.operators.serving import source_flags
from sparkloom.operators.snapshots import apply_changes, plan_changes, remove_with_snapshot
from sparkloom.plans.rules import Scope, Workflow, read_source
from sparkloom.session import build_session, micros, table, widen
from sparkloom.sources.evidence import merge_scrapes
from sparkloom.sources.readers import alias_table

KEY = "info_hash"


@dataclass(frozen=True)
class Options:
    """Settings of a run; ``source`` is a workflow source, ``types`` are content types, ``now`` a time in ISO form."""

    after: str | None = None
    limit: int | None = None
    apply: bool = False
    source: str | None = None
    types: tuple[str, ...] = ()
    now: str | None = None


def _torrents(spark: SparkSession, root: str) -> DataFrame:
    return widen(table(spark, root, "torrents"))


def _plan(rows: DataFrame, **fresh: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, journal) where columns that are not there yet begin as null."""
    kinds = rows.select(*[c.alias(n) for n, c in fresh.items()]).schema
    rows = rows.withColumns({n: F.lit(None).cast(kinds[n].dataType) for n in fresh if n not in rows.columns})
    return rows, plan_changes(rows, KEY, **fresh)


def _extension_repair(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame]:
    t, n = _torrents(spark, root), F.col("name")
    return _plan(t, extension=F.when(F.col("files_status") == "single", name_extension(n)), video_resolution=video_resolution(n), video_source=video_source(n), video_codec=video_codec(n), release_group=release_group(n))


def _episodes(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame]:
    return _plan(_torrents(spark, root), episodes=episodes_text("name"))


def _derived(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame]:
    t = _torrents(spark, root).withColumn("_e", episodes_of("name"))
    series, n = F.col("_e").isNotNull(), F.col("name")
    label = granularity(series, F.size("_e"), F.size(F.try_element_at(F.map_values("_e"), F.lit(1))), n)
    return _plan(t, granularity=label, english_audio=english_audio(n.rlike(r"^\s*\["), audio_signal(n), subtitle_signal(n)))


def _anime(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame]:
    t = _torrents(spark, root).withColumn("_m", bracket_marks(F.col("name")))
    group, episode = F.col("_m.group").isNotNull(), F.col("_m.absolute_episode")
    title = F.nullif(clean_titles(F.col("name"), episode), F.lit(""))
    sure = group & (episode.isNotNull() | is_batch(F.col("name")))
    return _plan(t, is_anime=sure, anime_title=F.when(sure, title), anime_type=with_anime_type(F.lit(None).cast("string"), F.col("name"), sure, episode.isNotNull()))


def _classify(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame]:
    if not o.source:
        raise ValueError("classify needs a workflow source")
    workflows, flags, keywords, extensions = read_source(o.source)
    files = table(spark, root, "torrent_files").groupBy(KEY).agg(F.collect_list(F.struct("path", "extension", "size")).alias("_files"))
    t = _torrents(spark, root).join(files, KEY, "left")
    own = F.array(F.struct(F.col("name").alias("path"), F.col("extension"), F.col("size")))
    t = t.withColumn("_files", F.coalesce("_files", own))
    scope = Scope({"torrent.name": F.col("name"), "torrent.size": F.col("size"), "torrent.files": F.col("_files")}, {f"extensions.{k}": v for k, v in extensions.items()}, {f"keywords.{k}": keyword_pattern(*v) for k, v in keywords.items()})
    content = table(spark, root, "content").select("content_type", "content_source", "content_id", "title", "release_year")
    done = Workflow(workflows, scope, content=content, flags=flags).apply(t.withColumnRenamed("private", "_private"))
    rows = done.withColumnRenamed("content_type", "_type").select(*[F.col("_private").alias(c) if c == "private" else F.col(c) for c in table(spark, root, "torrents").columns], "_type", "tags", "deleted")
    return _plan(rows.withColumnRenamed("tags", "_tags").withColumnRenamed("deleted", "_deleted"), content_type=F.col("_type"), tags=F.array_join("_tags", ","), deleted=F.col("_deleted"))


def _seeds(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame]:
    s = table(spark, root, "torrents_torrent_sources")
    answers = s.select(KEY, F.col("source").alias("tracker"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seeders", "leechers")], F.lit(0).alias("completed"))
    merged = merge_scrapes(answers, table(spark, root, "torrents"))
    t = _torrents(spark, root).join(merged.select(KEY, F.col("seeders").alias("_s"), F.col("leechers").alias("_l")), KEY, "left")
    return _plan(t, seeders=F.col("_s"), leechers=F.col("_l"))


PLANNED: dict[str, Callable[[SparkSession, str, Options], tuple[DataFrame, DataFrame]]] = {
    "anime-backfill": _anime, "backlog-local-classify": _classify, "derived-backfill": _derived, "episodes-backfill": _episodes, "process": _classify, "refresh-seeds": _seeds, "release-fields-repair": _extension_repair, "reprocess": _classify,
}


def _aliases(spark: SparkSession, root: str, o: Options) -> DataFrame:
    """Aliases of works by title, original title and other titles; an alias of several works goes to the smallest."""
    ref = F.concat_ws(":", "content_type", "content_source", "content_id")
    c = table(spark, root, "content")
    titles = c.select(ref.alias("work_id"), "title").unionByName(c.select(ref.alias("work_id"), F.col("original_title").alias("title"))).filter(F.col("title").isNotNull())
    return alias_table(titles, titles.select("work_id", F.col("work_id").alias("ref")).distinct(), title_family)


def _attribution(spark: SparkSession, root: str, o: Options) -> DataFrame:
    """How many torrents any source has live, knows as empty, or knows nothing of."""
    f = table(spark, root, "torrents").select(KEY).join(source_flags(table(spark, root, "torrents_torrent_sources")), KEY, "left")
    best = F.coalesce("tracker", "other")
    return f.groupBy(F.when(best > 0, "live").when(best == 0, "empty").otherwise("unknown").alias("verdict")).agg(F.count("*").alias("n"))


def _shadow(spark: SparkSession, root: str, o: Options) -> DataFrame:
    """Availability states at a time, for comparison only."""
    s, n = table(spark, root, "torrents_torrent_sources"), F.col("seeders")
    at = F.col("updated_at").cast("timestamp")
    obs = s.select(KEY, F.concat_ws(":", "source", micros("updated_at").cast("string")).alias("id"), "source", F.when(n.isNull(), "unknown").when(n == 0, "zero").otherwise("positive").alias("class"), at.alias("observed_at"), (at + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), F.lit(True).alias("qualified"), F.lit(False).alias("private"))
    return availability(obs, F.lit(o.now).cast("timestamp") if o.now else F.current_timestamp()).groupBy("state", "reason").agg(F.count("*").alias("n"))


REPORTS: dict[str, Callable[[SparkSession, str, Options], DataFrame]] = {"attribution": _attribution, "catalogue-policy-shadow": _shadow, "refresh-alt-titles": _aliases, "refresh-anime-titles": _aliases}


def purge(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame]:
    """(torrents that stay, snapshots of those whose content type is purged); the type is a column of an earlier classification."""
    if not o.types:
        raise ValueError("purge-content-types needs types")
    t = table(spark, root, "torrents")
    if "content_type" not in t.columns:
        raise ValueError("classify the torrents first: they have no content_type")
    doomed = t.filter(F.col("content_type").isin(*o.types))
    return remove_with_snapshot(t, KEY, doomed, "purged type", {"files": table(spark, root, "torrent_files")})


def run(spark: SparkSession, name: str, root: str, out: str | None = None, o: Options = Options()) -> dict:
    """Run a job; the result says what it changed, or would change, and up to which key."""
    if o.apply and not out:
        raise ValueError("a job that applies needs a place for its results")
    if name in REPORTS:
        rows = REPORTS[name](spark, root, o)
        if o.apply:
            rows.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
            rows = spark.read.parquet(f"{out}/{name}.parquet")
        return {"job": name, "applied": o.apply, "rows": rows.count()}
    if name == "purge-content-types":
        stay, gone = purge(spark, root, o)
        if o.apply:
            gone.write.mode("overwrite").parquet(f"{out}/snapshots.parquet")
            stay.write.mode("overwrite").parquet(f"{out}/torrents.parquet")
        return {"job": name, "applied": o.apply, "removed": gone.count()}
    if name not in PLANNED:
        raise ValueError(f"no such job: {name}")
    rows, journal = PLANNED[name](spark, root, o)
    if o.after is not None:
        journal = journal.filter(F.col(KEY) > o.after)
    if o.limit is not None:
        journal = journal.join(journal.select(KEY).distinct().orderBy(KEY).limit(o.limit), KEY, "left_semi")
    if o.apply:
        journal.write.mode("overwrite").parquet(f"{out}/journal.parquet")
        journal = spark.read.parquet(f"{out}/journal.parquet")
        keep = [c for c in rows.columns if not c.startswith("_")]
        changed = apply_changes(rows.select(*keep), KEY, journal, fields=[c for c in keep if c != KEY and c not in ("created_at", "updated_at")])
        changed.write.mode("overwrite").parquet(f"{out}/torrents.parquet")
    told = journal.groupBy("field").agg(F.count("*").alias("n"), F.max(KEY).alias("last")).collect()  # one row a field
    return {"job": name, "applied": o.apply, "changes": {r["field"]: r["n"] for r in sorted(told, key=lambda r: r["field"])}, "last_key": max((r["last"] for r in told), default=None)}


def main(argv: list[str] | None = None) -> None:
    jobs = sorted([*PLANNED, *REPORTS, "purge-content-types", "config"])
    p = argparse.ArgumentParser(prog="sparkloom.jobs", description="Batch jobs over a folder of tables.")
    p.add_argument("job", choices=jobs)
    p.add_argument("--tables")
    p.add_argument("--out")
    p.add_argument("--apply", action="store_true", help="write the results; without it nothing is changed")
    p.add_argument("--after", help="go on behind this key")
    p.add_argument("--limit", type=int, help="at most so many keys")
    p.add_argument("--source", help="file of a workflow source in JSON")
    p.add_argument("--types", nargs="*", default=[])
    p.add_argument("--now")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    spark = build_session(a.master, app="sparkloom-jobs")
    if a.job == "config":
        print(json.dumps(dict(sorted(spark.sparkContext.getConf().getAll())), indent=1))
        return
    if not a.tables:
        p.error("--tables is needed")
    source = open(a.source, encoding="utf-8").read() if a.source else None
    print(json.dumps(run(spark, a.job, a.tables, a.out, Options(a.after, a.limit, a.apply, source, tuple(a.types), a.now))))


if __name__ == "__main__":
    main()
