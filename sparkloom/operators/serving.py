"""What a consumer may see: freshness, dead and judged items, the mandatory base scope, and the routing of discovered hashes.

All evidence about an item is reduced to one row of flags before it meets the item, so each rule costs one join on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.folds import decision_ladder, latest

# Verdicts that block an item, and labels and tags that mark it as private.
BLOCKING = ["quarantined", "blacklisted", "tombstoned"]
PRIVATE_LABELS = ["private", "bitgrab"]
# The content type of each media type, and those that need their identity looked up.
MEDIA_TYPES = {"movie": "movie", "tv": "tv_show", "music": "music", "audiobook": "audiobook", "book": "ebook"}
LOOKED_UP = ["movie", "tv_show"]


def source_flags(sources: DataFrame, key: str = "info_hash") -> DataFrame:
    """(key, tracker, other, seen_at) per item: most seeders by its tracker rows and by the others, and when any source last saw it."""
    seen = F.greatest("updated_at", "published_at")  # the greater of those that are known
    best = lambda test: F.max(F.when(test, F.col("seeders")))
    return sources.groupBy(key).agg(best(F.col("source") == "tracker").alias("tracker"), best(F.col("source") != "tracker").alias("other"), F.max(seen).alias("seen_at"))


def drop_dead_confidence(items: DataFrame, sources: DataFrame, now: Column, hide_zero: bool = True, hide_unknown_days: int = 0, authoritative: bool = True, key: str = "info_hash") -> DataFrame:
    """``items`` without those that are surely dead, or unknown and stale.

    Authoritative: only a tracker's zero is a zero; what no tracker knows is dropped where nobody reports seeders and every source is
    older than ``hide_unknown_days``. Otherwise any zero counts. An item without sources is stale. Zero days switch that rule off.
    """
    j = items.join(source_flags(sources, key), key, "left")
    known = F.coalesce("tracker", "other")
    stale = F.col("seen_at").isNull() | (F.col("seen_at") <= now - F.expr(f"INTERVAL {hide_unknown_days} DAYS"))
    zero = (F.col("tracker") if authoritative else known) == 0
    unknown = (F.col("tracker").isNull() & (known.isNull() | (known == 0))) if authoritative else known.isNull()
    drop = reduce(lambda a, b: a | b, [t for t, on in ((zero, hide_zero), (unknown & stale, hide_unknown_days > 0)) if on], F.lit(False))
    return j.filter(~F.coalesce(drop, F.lit(False))).select(*items.columns)


def blocked_set(verdicts: DataFrame, key: str, order: list[str], verdict: str = "verdict") -> DataFrame:
    """(key) of the items whose latest verdict blocks them."""
    return latest(verdicts, [key], order, [verdict]).filter(F.col(verdict).isin(*BLOCKING)).select(key)


def exclude_judged(items: DataFrame, dead: DataFrame, blocked: DataFrame | None = None, live: bool = False, key: str = "info_hash") -> DataFrame:
    """``items`` without the dead, and without the blocked once the verdicts are ``live``. Without a blocked set nothing else is lost."""
    out = items.join(dead.select(key), key, "left_anti")
    return out.join(blocked.select(key), key, "left_anti") if live and blocked is not None else out


def signed_bytes(files: DataFrame, extensions: list[str], key: str = "info_hash") -> DataFrame:
    """(key, signed): sizes of files of these extensions less those of all others."""
    return files.groupBy(key).agg(F.sum(F.when(F.col("extension").isin(*extensions), F.col("size")).otherwise(-F.col("size"))).alias("signed"))


def complete_snapshots(quarantine: DataFrame, key: str = "info_hash") -> DataFrame:
    """(key) of quarantined items whose snapshots are whole: an object of the same hash and name that isn't private, an array of
    sources that each name themselves, and an array of files, if any, that each have a path."""
    torrent = lambda f: F.get_json_object("torrent_snapshot", f"$.{f}")
    rows = lambda c, fields: F.from_json(c, f"array<struct<{fields}>>")
    sources, files = rows("sources_snapshot", "info_hash: string, source: string, source_key: string"), rows("files_snapshot", "info_hash: string, path: string")
    right = F.col("torrent_snapshot").rlike(r"^\s*\{") & (torrent("info_hash") == F.col(key)) & (torrent("name") == F.col("torrent_name")) & (torrent("private") == "false")
    fine = lambda c: F.col(c).rlike(r"^\s*\[")
    known = fine("sources_snapshot") & F.forall(sources, lambda s: (s["info_hash"] == F.col(key)) & (F.length(s["source"]) > 0) & (s["source_key"] == s["source"]))
    paths = F.col("files_snapshot").isNull() | fine("files_snapshot") & F.forall(files, lambda f: (f["info_hash"] == F.col(key)) & f["path"].isNotNull())
    return quarantine.filter(F.coalesce(right & known & paths, F.lit(False))).select(key)


def serving_scope(torrents: DataFrame, quarantine: DataFrame | None = None, labels: DataFrame | None = None, tags: DataFrame | None = None, adult: DataFrame | None = None, files: DataFrame | None = None, media: list[str] = (), strong: str | None = None, key: str = "info_hash") -> DataFrame:
    """The torrents that any search may return: not private, not quarantined whole, without a private label or tag, and, where asked
    for, neither linked to adult content (``adult``: keys) nor mostly media with a strong word in its name or a path.

    ``labels``: key, category; ``tags``: key, name.
    """
    out = torrents.filter(~F.coalesce("private", F.lit(True)))
    private = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).isin(*PRIVATE_LABELS)
    banned = [q for q in (complete_snapshots(quarantine, key) if quarantine is not None else None, labels.filter(private("category")).select(key) if labels is not None else None, tags.filter(private("name")).select(key) if tags is not None else None, adult.select(key) if adult is not None else None) if q is not None]
    if banned:
        out = out.join(reduce(lambda a, b: a.unionByName(b), banned), key, "left_anti")
    if strong and files is not None:
        bare = lambda c: F.when(F.col("extension").isNotNull(), F.substring(F.col(c), F.lit(1), F.greatest(F.length(c) - F.length("extension") - 1, F.lit(0)))).otherwise(F.col(c))
        found = files.groupBy(key).agg(F.bool_or(bare("path").rlike(strong)).alias("_in_path"))
        j = out.join(signed_bytes(files, media, key), key, "left").join(found, key, "left")
        single = F.col("files_status") == "single"
        mostly = F.when(single, (F.col("size") > 0) & F.col("extension").isin(*media)).otherwise(F.coalesce("signed", F.lit(0)) > 0)
        name = F.when(single, bare("name")).otherwise(F.col("name"))
        out = j.filter(~F.coalesce(mostly & (name.rlike(strong) | F.coalesce("_in_path", F.lit(False))), F.lit(False))).select(*out.columns)
    return out


def triage(requests: DataFrame, torrents: DataFrame, sources: DataFrame, now: Column, blocklist: DataFrame, blocked: DataFrame, readmitted: DataFrame, verdicts: DataFrame, allowed: Column | None = None, files_threshold: int = 100, rescrape_days: int = 30, key: str = "info_hash") -> DataFrame:
    """(key, route) of distinct requested hashes: why each is dropped, or whether peers or a scrape are asked for.

    In this order: 'listed' (double hash in ``blocklist``), 'blocked' (in ``blocked`` and not ``readmitted``), 'judged' (in
    ``verdicts``), 'name' (known by a name that ``allowed`` refuses), 'get_peers' (unknown, or its files are), 'scrape' (its dht row lacks
    counts or is older than ``rescrape_days``), 'known'.
    """
    mark = lambda df, on, name: df.select(on).distinct().withColumn(name, F.lit(True))
    asked = requests.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("hash", F.sha2(F.unhex(key), 256))
    j = asked.join(mark(blocklist, "hash", "_listed"), "hash", "left").join(mark(blocked.join(readmitted.select(key), key, "left_anti"), key, "_blocked"), key, "left").join(mark(verdicts, key, "_judged"), key, "left")
    # the condition on the source belongs to the join: a torrent without a dht row stays
    dht = sources.filter(F.col("source") == "dht").groupBy(key).agg(F.max_by(F.struct("seeders", "leechers", "updated_at"), F.struct("updated_at", "seeders", "leechers")).alias("dht"))
    known = torrents.select(key, "name", "files_status", "files_count").withColumn("_known", F.lit(True))
    j = j.join(known, key, "left").join(dht, key, "left")
    status = F.col("files_status")
    no_files = F.col("_known").isNull() | (status == "no_info") | (status != "single") & F.col("files_count").isNull() | (status == "over_threshold") & (F.col("files_count") <= files_threshold)
    no_counts = F.col("dht.seeders").isNull() | F.col("dht.leechers").isNull() | (F.col("dht.updated_at") < now - F.expr(f"INTERVAL {rescrape_days} DAYS"))
    refused = (F.col("name") != "") & ~allowed if allowed is not None else F.lit(False)
    route = decision_ladder((F.col("_listed"), "listed"), (F.col("_blocked"), "blocked"), (F.col("_judged"), "judged"), (refused, "name"), (no_files, "get_peers"), (no_counts, "scrape"), otherwise="known")
    return j.select(key, route.alias("route"))


def canonical_preempt(items: DataFrame, labels: DataFrame, key: str = "info_hash") -> DataFrame:
    """``items`` with ``content_type``, ``hint_id`` and ``outcome`` by the canonical label (key, media_type, media_id) of the same hash.

    'preempted': the label decides; 'constrained': it fixes the type, and its id, unless local to its source, is the hint of the
    workflow's attachments; 'unknown_type': it says nothing usable; 'miss': there is none.
    """
    kinds = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    one = labels.groupBy(key).agg(F.max_by(F.struct("media_type", "media_id"), F.struct("media_type", "media_id")).alias("label"))
    j = items.join(one, key, "left").withColumn("content_type", kinds[F.col("label.media_type")])
    outcome = F.when(F.col("label").isNull(), "miss").when(F.col("content_type").isNull(), "unknown_type").when(F.col("content_type").isin(*LOOKED_UP), "constrained").otherwise("preempted")
    hint = F.when((outcome == "constrained") & ~F.coalesce(F.col("label.media_id"), F.lit("")).rlike("^(?:radarr:|sonarr:|$)"), F.col("label.media_id"))
    return j.select(*items.columns, "content_type", hint.alias("hint_id"), outcome.alias("outcome"))
