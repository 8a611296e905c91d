"""Liveness of hashes: revalidation, batch updates, availability over time, and advertised tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.folds import suspicion_runs

STATE = ["status", "last_qb_state", "suspect_first_seen_at", "suspect_observations", "last_observed_at", "blacklisted_at", "next_revalidate_at", "alive_source"]
#: Days after which a dead hash is looked at again.
REVALIDATE_DAYS = 30


def with_revalidation(events: DataFrame, key: str, at: str, order: list[str], alive: Column, suspect: Column, days: int = REVALIDATE_DAYS) -> DataFrame:
    """``suspicion_runs`` with ``next_revalidate_at`` of the dead, so many days after their last event."""
    rows = suspicion_runs(events, key, at, order, alive, suspect)
    return rows.withColumn("next_revalidate_at", F.when(F.col("status") == "dead", F.col("last_event_at") + F.expr(f"INTERVAL {days} DAYS")))


def due_for_revalidation(state: DataFrame, now: Column, most: int, key: str = "info_hash") -> DataFrame:
    """(key) of the dead whose time has come, longest due first: a bounded batch. Those without a time are never due."""
    due = state.filter((F.col("status") == "dead") & (F.col("next_revalidate_at") <= now))
    return due.orderBy("next_revalidate_at", key).limit(most).select(key)


def mark_alive_batch(state: DataFrame, hashes: DataFrame, at: Column, source: str, key: str = "info_hash") -> DataFrame:
    """State after a batch of live hashes: rows that are suspect or dead become alive; none is added, and the dead without a time
    for revalidation stay dead."""
    j = state.join(hashes.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    turn = F.coalesce("_hit", F.lit(False)) & (F.col("status") != "alive") & ~((F.col("status") == "dead") & F.col("next_revalidate_at").isNull())
    new = {"status": F.lit("alive"), "suspect_first_seen_at": F.lit(None), "suspect_observations": F.lit(0), "last_observed_at": at, "blacklisted_at": F.lit(None), "next_revalidate_at": F.lit(None), "alive_source": F.lit(source)}
    return j.select(*[F.when(turn, new[c].cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns])


def record_suspect_batch(state: DataFrame, hashes: DataFrame, at: Column, key: str = "info_hash") -> DataFrame:
    """State after a batch of remotely suspect hashes, each once: new ones are added; a row that the client has seen, or that is
    alive by local evidence, stays; an alive one starts a new run, others go on, and the dead stay dead."""
    j = state.withColumn("_old", F.lit(True)).join(hashes.select(key).distinct().withColumn("_hit", F.lit(True)), key, "full")
    hit, old = F.coalesce("_hit", F.lit(False)), F.coalesce("_old", F.lit(False))
    local = (F.col("status") == "alive") & F.coalesce(F.col("alive_source").isin("qb_state", "arr_webhook_import"), F.lit(False))
    turn = hit & (~old | F.col("last_qb_state").isNull() & ~local)
    fresh = ~old | (F.col("status") == "alive")
    new = {
        "status": F.when(old & (F.col("status") == "dead"), "dead").otherwise("suspect"), "suspect_first_seen_at": F.when(fresh, at).otherwise(F.coalesce(F.col("suspect_first_seen_at"), at)),
        "suspect_observations": F.when(fresh, F.lit(1)).otherwise(F.col("suspect_observations") + 1), "last_observed_at": at,
    }
    return j.select(*[F.when(turn, new[c].cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns])


def availability(observations: DataFrame, now: Column, fresh_hours: int = 24, protect_hours: int = 168, gap_hours: int = 1, span_hours: int = 4, least: int = 2, key: str = "info_hash") -> DataFrame:
    """(key, state, reason, observations) of each hash, judged at ``now`` from its timed observations.

    ``observations``: key, id, source, class ('positive', 'zero', 'stall', 'unknown'), observed_at, expires_at, qualified, private.
    Private, unnamed, future and self-expired ones don't count, and an id counts once. A fresh positive decides. Else those zeros and stalls
    count that are fresh, later than any unknown and any positive, and a gap apart from the last that counted; enough of them over a
    span make a suspicion, unless a positive of the last days protects. Per hash only its few last days are gathered.
    """
    o = observations.filter(~F.coalesce("private", F.lit(False)) & (F.col("id") != "") & (F.col("source") != "") & (F.col("observed_at") <= now) & (F.col("expires_at") > F.col("observed_at")))
    first = F.row_number().over(Window.partitionBy(key, "id").orderBy("observed_at"))
    o = o.withColumn("_n", first).filter("_n = 1")
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    fresh = (now < F.col("expires_at")) & (F.col("observed_at") > now - hours(fresh_hours))
    unknown = ~F.coalesce("qualified", F.lit(False)) | (F.col("class") == "unknown")
    positive = ~unknown & (F.col("class") == "positive")
    negative = ~unknown & F.col("class").isin("zero", "stall") & fresh
    item = F.struct("observed_at", "id", "class")
    per = o.groupBy(key).agg(
        F.max(F.when(unknown, F.col("observed_at"))).alias("unknown_at"), F.max(F.when(positive, F.col("observed_at"))).alias("positive_at"),
        F.max(F.when(positive & fresh, F.struct("observed_at", "id"))).alias("live"), F.array_sort(F.collect_list(F.when(negative, item))).alias("negatives"),
    )
    later = F.filter("negatives", lambda x: (F.col("unknown_at").isNull() | (x["observed_at"] > F.col("unknown_at"))) & (F.col("positive_at").isNull() | (x["observed_at"] > F.col("positive_at"))))
    none = F.array().cast(per.schema["negatives"].dataType)
    spaced = F.aggregate(later, none, lambda a, x: F.when((F.size(a) == 0) | (x["observed_at"] >= F.element_at(a, -1)["observed_at"] + hours(gap_hours)), F.array_append(a, x)).otherwise(a))
    per = per.withColumn("spaced", spaced).withColumn("n", F.size("spaced"))
    last, start = F.try_element_at("spaced", F.lit(-1)), F.try_element_at("spaced", F.lit(1))
    guarded = F.coalesce(F.col("positive_at") > now - hours(protect_hours), F.lit(False))
    repeated = (F.col("n") >= least) & (last["observed_at"] >= start["observed_at"] + hours(span_hours))
    stall = last["class"] == "stall"
    zero_state, zero_reason = F.when(stall, "unknown_stale").otherwise("fresh_known_zero"), F.when(stall, "client_stall_is_not_swarm_zero").otherwise("single_qualified_zero")
    live, empty = F.col("live").isNotNull(), F.col("n") == 0
    state = F.when(live, "fresh_positive").when(empty, "unknown_stale").when(guarded, zero_state).when(repeated, "suspected_unavailable").otherwise(zero_state)
    reason = F.when(live, "fresh_public_positive").when(empty, "no_fresh_qualified_observation").when(guarded, "recent_positive_history_protects").when(repeated, "repeated_qualified_negative_shadow_only").otherwise(zero_reason)
    counted = F.when(live, F.array(F.col("live.id"))).otherwise(F.transform("spaced", lambda x: x["id"]))
    return per.select(key, state.alias("state"), reason.alias("reason"), counted.alias("observations"))


def english_tracks(members: DataFrame, anime: Column | bool = False, subtitles_do: bool = False, key: str = "info_hash") -> DataFrame:
    """(key, state, reason) of releases from the advertised tracks of their members (key, audio, subtitles, incomplete).

    ``audio`` and ``subtitles``: 'yes', 'no', 'conflicting' or 'unknown'. A conflict decides, then members that differ; an incomplete
    member leaves the release unknown.
    """
    anime = F.lit(anime) if isinstance(anime, bool) else anime
    subs = anime & F.lit(subtitles_do)
    a, s = F.coalesce("audio", F.lit("unknown")), F.coalesce("subtitles", F.lit("unknown"))
    state = F.when((a == "conflicting") | (s == "conflicting"), "conflicting").when(a == "yes", "eligible_audio").when(subs & (s == "yes"), "eligible_anime_subtitles").when((a == "no") & (~subs | (s == "no")), "ineligible_review").otherwise("unknown")
    per = members.withColumn("_state", state).groupBy(key).agg(F.collect_set("_state").alias("states"), F.bool_or(F.coalesce("incomplete", F.lit(False))).alias("incomplete"))
    states = F.col("states")
    out = F.when(F.col("incomplete"), "unknown").when(F.array_contains(states, "conflicting"), "conflicting").when(F.size(states) > 1, "mixed_review").otherwise(F.get(states, F.lit(0)))
    reason = F.when(F.col("incomplete"), "incomplete_file_evidence").when(F.array_contains(states, "conflicting"), "contradictory_advertisements").when(F.size(states) > 1, "member_evidence_differs").when(F.get(states, F.lit(0)) == "unknown", "missing_track_evidence").otherwise("explicit_advertised_tracks")
    return per.select(key, out.alias("state"), reason.alias("reason"))
