"""Evidence about hashes from webhooks, histories, clients and trackers, in one form, deduplicated, with its strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.folds import decision_ladder

# Media type of each application, strengths of observations, and what a client's states mean.
APPLICATIONS = {"sonarr": "tv", "radarr": "movie", "readarr": "book", "lidarr": "music"}
MEDIA_KEYS = {"sonarr": "seriesId", "radarr": "movieId", "readarr": "authorId", "lidarr": "artistId"}
CATEGORY_PUBLIC, CATEGORY_PRIVATE, STATE_ALIVE, STATE_SUSPECT = 30, 40, 50, 35
POLL_GRAB, POLL_IMPORT, WEBHOOK_GRAB, WEBHOOK_IMPORT = 60, 80, 60, 100
PRIVATE_CATEGORIES = ["private", "bitgrab"]
ALIVE = "seeding uploading forcedup forceddl downloading stalledup".split()
SUSPECT = "stalleddl metadl error missingfiles pauseddl unknown".split()
IGNORED = ["queueddl", "queuedup", "checkingdl", "checkingup", "checkingresumedata", "moving", "allocating", ""]

COLUMNS = ["source", "kind", "instance", "object_id", "info_hash", "download_id", "title", "media_type", "media_id", "category", "state", "observed_at", "strength"]
_PAYLOAD = "eventType string, id long, date timestamp, downloadId string, sourceTitle string, movieId long, seriesId long, authorId long, artistId long, title string"


def _by(column: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[column]


def _hash(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{40}\z"), F.lower(text))


def _evidence(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None).cast("int" if c == "strength" else "timestamp" if c == "observed_at" else "string")).alias(c) for c in COLUMNS])


def _media_id(app: Column, payload: Column) -> Column:
    number = F.coalesce(*[F.when(app == a, payload[k]) for a, k in MEDIA_KEYS.items()])
    return F.when(number != 0, F.concat(app, F.lit(":"), number.cast("string")))


def webhook_evidence(deliveries: DataFrame) -> DataFrame:
    """Evidence of webhook deliveries (instance, app, received_at, body: JSON). Unknown applications, other events and bodies
    that aren't JSON are ignored; a grab has strength 60, an import 100."""
    d = deliveries.withColumn("app", F.lower("app")).withColumn("p", F.from_json("body", _PAYLOAD))
    event = F.col("p.eventType")
    kind = F.when(event == "Grab", "webhook_grab").when(event.isin("Download", "DownloadFolderImported"), "webhook_import")
    d = d.withColumn("kind", kind).filter(F.col("app").isin(*APPLICATIONS) & F.col("kind").isNotNull())
    return _evidence(
        d, source=F.col("app"), kind=F.col("kind"), instance=F.col("instance"), object_id=F.concat_ws(":", event, F.lower("p.downloadId")), info_hash=_hash(F.col("p.downloadId")), download_id=F.lower("p.downloadId"),
        title=F.coalesce("p.sourceTitle", "p.title"), media_type=_by(F.col("app"), APPLICATIONS), media_id=_media_id(F.col("app"), F.col("p")), observed_at=F.col("received_at").cast("timestamp"), strength=F.when(F.col("kind") == "webhook_grab", WEBHOOK_GRAB).otherwise(WEBHOOK_IMPORT),
    )


def history_evidence(entries: DataFrame, since: Column | None = None) -> DataFrame:
    """Evidence of history entries (instance, app, event_code, entry: JSON): code 1 is a grab (60), 3 an import (80), others are
    ignored. ``since`` reads on from the last watermark."""
    names = F.when(F.col("event_code") == 1, "grabbed").when(F.col("event_code") == 3, "downloadFolderImported")
    e = entries.withColumn("app", F.lower("app")).withColumn("p", F.from_json("entry", _PAYLOAD)).withColumn("event", names).filter(F.col("event").isNotNull() & F.col("app").isin(*APPLICATIONS))
    e = e if since is None else e.filter(F.col("p.date") > since)
    return _evidence(
        e, source=F.col("app"), kind=F.lit("poll_history"), instance=F.col("instance"), object_id=F.concat_ws(":", "event", F.col("p.id").cast("string")), info_hash=_hash(F.col("p.downloadId")), download_id=F.lower("p.downloadId"),
        title=F.col("p.sourceTitle"), media_type=_by(F.col("app"), APPLICATIONS), media_id=_media_id(F.col("app"), F.col("p")), observed_at=F.col("p.date"), strength=F.when(F.col("event") == "grabbed", POLL_GRAB).otherwise(POLL_IMPORT),
    )


def state_class(state: Column) -> Column:
    """'alive', 'suspect' or 'ignore' of a client's state; one that isn't known is suspect."""
    s = F.lower(F.trim(F.coalesce(state, F.lit(""))))
    return F.when(s.isin(*ALIVE), "alive").when(s.isin(*IGNORED), "ignore").otherwise("suspect")


def client_evidence(torrents: DataFrame, with_states: bool = True) -> DataFrame:
    """Evidence of a client's torrents (instance, hash, name, category, state, polled_at): one row for a category, if it has one
    (private ones 40, others 30), and one for a state that is alive (50) or suspect (35), once a minute."""
    t = torrents.withColumn("info_hash", _hash(F.col("hash"))).filter(F.col("info_hash").isNotNull()).withColumn("cat", F.lower(F.trim("category"))).withColumn("class", state_class(F.col("state")))
    shared = {"source": F.lit("qbittorrent"), "instance": F.col("instance"), "info_hash": F.col("info_hash"), "title": F.col("name"), "category": F.nullif("cat", F.lit("")), "observed_at": F.col("polled_at").cast("timestamp")}
    labels = _evidence(t.filter(F.col("cat") != ""), **shared, kind=F.lit("poll_categories"), object_id=F.col("hash"), strength=F.when(F.col("cat").isin(*PRIVATE_CATEGORIES), CATEGORY_PRIVATE).otherwise(CATEGORY_PUBLIC))
    if not with_states:
        return labels
    minute = F.date_format(F.date_trunc("minute", F.col("polled_at").cast("timestamp")), "yyyy-MM-dd'T'HH:mm'Z'")
    states = _evidence(t.filter(F.col("class") != "ignore"), **shared, kind=F.lit("qb_state"), state=F.lower(F.trim("state")), object_id=F.concat_ws(":", "hash", F.lower(F.trim("state")), minute), strength=F.when(F.col("class") == "alive", STATE_ALIVE).otherwise(STATE_SUSPECT))
    return labels.unionByName(states)


def insert_evidence(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Evidence after an insert: rows without a hash and a download id are rejected, of those with equal source, kind, instance,
    object and hash the earliest stays."""
    every = new if old is None else old.unionByName(new)
    keys = ["source", "kind", "instance", "object_id", "info_hash"]
    rest = [c for c in COLUMNS if c not in keys]
    fine = every.filter(F.col("info_hash").isNotNull() | (F.length(F.coalesce("download_id", F.lit(""))) > 0))
    return fine.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("observed_at", *[c for c in rest if c != "observed_at"])).alias("w")).select(*keys, "w.*").select(*COLUMNS)


def merge_scrapes(answers: DataFrame, hashes: DataFrame, key: str = "info_hash") -> DataFrame:
    """(key, tracker_known, seeders, leechers, completed, best_tracker, class) of every asked hash.

    ``answers``: key, tracker, seeders, leechers, completed. An answer of zeros only doesn't know the hash; the others give the
    maximum of each count, and the tracker of most seeders.
    """
    counts = ["seeders", "leechers", "completed"]
    known = answers.filter(" or ".join(f"{c} > 0" for c in counts))
    merged = known.groupBy(key).agg(*[F.max(F.greatest(F.col(c), F.lit(0))).alias(c) for c in counts], F.min_by("tracker", F.struct(-F.col("seeders"), F.col("tracker"))).alias("best"))
    j = hashes.select(key).distinct().join(merged, key, "left")
    kind = F.when((F.col("seeders") > 0) | (F.col("leechers") > 0), "positive").when(F.col("seeders").isNotNull(), "known_zero").otherwise("unknown")
    return j.select(key, F.col("seeders").isNotNull().alias("tracker_known"), *counts, F.when(F.col("seeders") > 0, F.col("best")).alias("best_tracker"), kind.alias("class"))


def mirror_scrapes(sources: DataFrame, merged: DataFrame, at: Column, key: str = "info_hash", source: str = "tracker") -> DataFrame:
    """Source rows after a scrape: a hash that a tracker knows has one row of ``source`` with its counts, one that none knows has no
    such row; all other rows stay."""
    stay = sources.join(merged.select(key, F.lit(source).alias("source")), [key, "source"], "left_anti").select(*sources.columns)
    fresh = {"source": F.lit(source), "seeders": F.col("seeders"), "leechers": F.col("leechers"), "created_at": at, "updated_at": at}
    known = merged.filter("tracker_known")
    return stay.unionByName(known.select(*[(fresh[c] if c in fresh else F.col(c) if c == key else F.lit(None)).cast(sources.schema[c].dataType).alias(c) for c in sources.columns]))


def attribution_verdict(imported: Column, import_event: Column, held: Column, state: Column) -> Column:
    """What became of a grab: the first of seven rungs that holds."""
    going = ["downloading", "metaDL", "queuedDL", "stoppedDL", "checkingDL", "forcedDL"]
    done = ["uploading", "stalledUP", "queuedUP", "pausedUP", "checkingUP", "forcedUP"]
    return decision_ladder(
        (imported & (import_event == "downloadFolderImported"), "imported_ok"), (imported & import_event.isin("downloadFailed", "downloadIgnored"), "import_failed"), (~held, "missing_in_qb"),
        (state.isin(*going), "downloading"), (state.isin("stalledDL", "missingFiles", "error"), "stalled"), (state.isin(*done), "completed_pending_import"), otherwise="unknown",
    )


def attribution(grabs: DataFrame, clients: DataFrame, imports: DataFrame, key: str = "info_hash") -> DataFrame:
    """``grabs`` (key, source, ...) with client state, import event and verdict.

    ``imports`` (key, source, rank, event_type): of several sources the first by rank counts, and only if it is the grab's source
    or the grab has none. ``clients``: key, state, one row a hash.
    """
    first = imports.groupBy(key).agg(F.min_by(F.struct(F.col("source").alias("import_source"), F.col("event_type")), F.struct("rank", "source", "event_type")).alias("i"))
    j = grabs.join(clients.select(key, "state").withColumn("_held", F.lit(True)), key, "left").join(first, key, "left")
    fits = (F.col("i.import_source") == F.col("source")) | (F.coalesce("source", F.lit("")) == "")
    event = F.when(fits, F.col("i.event_type"))
    return j.select(*grabs.columns, "state", event.alias("import_event"), attribution_verdict(event.isNotNull(), event, F.coalesce("_held", F.lit(False)), F.col("state")).alias("verdict"))
