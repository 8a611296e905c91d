"""Queued jobs as a table of states, tags of items, and weights learnt from feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.release import backoff_seconds

# Step and bound of a learnt weight, and the outcomes that reward or punish the rules that matched.
STEP, MOST_ADJUSTMENT = 0.05, 2.0
REWARDED, PUNISHED = ["applied", "import_succeeded"], ["import_failed", "rejected_policy", "rejected_ambiguous"]
COMPARED = ["teacher_consensus", "operator_override"]
TAG_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def pick_order() -> list[Column]:
    """Order in which jobs are taken: first attempts before retries, then by priority and the time from which they may run."""
    return [(F.col("status") == "retry").asc(), F.col("priority").asc(), F.col("run_after").asc(), F.col("id").asc()]


def enqueue(jobs: DataFrame, new: DataFrame, at: Column, delay_minutes: int = 0) -> DataFrame:
    """Jobs after new ones (id, queue, fingerprint, priority, max_retries) are added, to run ``delay_minutes`` later. A fingerprint that
    waits already, or comes twice, is added once."""
    waiting = jobs.filter(F.col("status").isin("pending", "retry")).select("fingerprint")
    one = new.groupBy("fingerprint").agg(F.min_by(F.struct(*[c for c in new.columns if c != "fingerprint"]), "id").alias("w")).select("fingerprint", "w.*").join(waiting, "fingerprint", "left_anti")
    extra = {"status": F.lit("pending"), "retries": F.lit(0), "created_at": at, "run_after": at + F.expr(f"INTERVAL {delay_minutes} MINUTES")}
    cols = [(extra[c] if c in extra else F.col(c) if c in one.columns else F.lit(None)).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns]
    return jobs.unionByName(one.select(*cols))


def due_jobs(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """The next jobs to run, in their order: a bounded batch."""
    return jobs.filter(F.col("status").isin("pending", "retry") & (F.col("run_after") <= now)).orderBy(*pick_order()).limit(most)


def finish_jobs(jobs: DataFrame, results: DataFrame, now: Column, jitter: Column) -> DataFrame:
    """Jobs after runs (id, error): a run without error is processed; a failed one, or one past its deadline, is tried again after
    a growing wait while it has retries, else it has failed. A job that was a retry counts one more."""
    j = jobs.join(results.select("id", F.col("error").alias("_error"), F.lit(True).alias("_ran")), "id", "left")
    ran = F.coalesce("_ran", F.lit(False))
    late = F.coalesce(F.col("deadline") < now, F.lit(False))
    error = F.when(late, "the job did not complete before its deadline").otherwise(F.col("_error"))
    tries = F.col("retries") + F.when(~late & (F.col("status") != "pending"), 1).otherwise(0)
    status = F.when(error.isNull(), "processed").when(tries < F.col("max_retries"), "retry").otherwise("failed")
    wait = F.make_dt_interval(secs=backoff_seconds(tries, jitter).cast("decimal(18,6)"))
    new = {"status": status, "retries": tries, "ran_at": now, "error": F.coalesce(error, F.col("error")), "run_after": F.when(status == "retry", now + wait).otherwise(F.col("run_after"))}
    return j.select(*[F.when(ran, new[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def collect_garbage(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs without those that are processed or failed and ran longer ago than their own archival time (seconds)."""
    gone = F.col("status").isin("processed", "failed") & (F.col("ran_at") + F.make_dt_interval(secs=F.col("archival_seconds").cast("decimal(18,6)")) < now)
    return jobs.filter(~F.coalesce(gone, F.lit(False)))


def reclaim_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """Leased jobs whose lease has run out are queued again; their generation stays, so a late answer of the old one is known."""
    expired = (F.col("state") == "leased") & (F.col("lease_until") < now)
    new = {"state": F.lit("queued"), "lease_until": F.lit(None), "reason": F.lit("lease_expired")}
    return jobs.select(*[F.when(expired, new[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def claim_leases(jobs: DataFrame, now: Column, seconds: int, most: int) -> DataFrame:
    """Jobs after the next ``most`` queued ones are leased, each with one more generation: a bounded batch."""
    free = jobs.filter(F.col("state").isin("queued", "deferred") & (F.col("available_at") <= now)).orderBy("available_at", "created_at", "job_id").limit(most).select("job_id", F.lit(True).alias("_taken"))
    j = jobs.join(free, "job_id", "left")
    taken = F.coalesce("_taken", F.lit(False))
    new = {"state": F.lit("leased"), "lease_generation": F.col("lease_generation") + 1, "lease_until": now + F.expr(f"INTERVAL {seconds} SECONDS")}
    return j.select(*[F.when(taken, new[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def answers_that_count(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (job_id, lease_generation, ...) of the present lease of their job; those of an earlier one are fenced off."""
    return answers.join(jobs.filter(F.col("state") == "leased").select("job_id", "lease_generation"), ["job_id", "lease_generation"], "left_semi")


def _tag_names(names: list[str]) -> list[str]:
    import re

    for n in names:
        if not re.fullmatch(TAG_PATTERN, n):
            raise ValueError(f"not a tag name: {n!r}")
    return sorted(set(names))


def _crossed(items: DataFrame, names: list[str], key: str) -> DataFrame:
    return items.select(key).distinct().select(key, F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("name"))


def put_tags(tags: DataFrame, items: DataFrame, names: list[str], key: str = "info_hash") -> DataFrame:
    """Tags after each item has these as well; no names change nothing."""
    names = _tag_names(names)
    return tags.select(key, "name").unionByName(_crossed(items, names, key)).distinct() if names else tags.select(key, "name")


def set_tags(tags: DataFrame, items: DataFrame, names: list[str], key: str = "info_hash") -> DataFrame:
    """Tags after each item has exactly these."""
    names = _tag_names(names)
    return tags.select(key, "name").join(items.select(key), key, "left_anti").unionByName(_crossed(items, names, key))


def delete_tags(tags: DataFrame, items: DataFrame | None = None, names: list[str] | None = None, key: str = "info_hash") -> DataFrame:
    """Tags without these names of these items; no items means all, no names means all, neither changes nothing."""
    if items is None and not names:
        return tags.select(key, "name")
    hit = F.col("name").isin(*names) if names else F.lit(True)
    if items is None:
        return tags.filter(~hit).select(key, "name")
    marked = tags.join(items.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.filter(~(F.coalesce("_hit", F.lit(False)) & hit)).select(key, "name")


def reward(outcome: Column, predicted: Column, truth: Column, predicted_out: Column, truth_out: Column) -> Column:
    """1, -1 or 0 for a prediction by its outcome; where types are to be compared, by whether they agree, else by exclusion, else 1."""
    same = F.when(F.coalesce(predicted, F.lit("")).eqNullSafe(truth), 1.0).otherwise(-1.0)
    compared = F.when((F.coalesce(truth, F.lit("")) != "") & (F.coalesce(predicted, F.lit("")) != ""), same).when(truth_out.isNotNull() & predicted_out.isNotNull(), F.when(predicted_out == truth_out, 1.0).otherwise(-1.0)).otherwise(1.0)
    return F.when(outcome.isin(*REWARDED), 1.0).when(outcome.isin(*PUNISHED), -1.0).when(outcome.isin(*COMPARED), compared).otherwise(0.0)


#: Steps of a rule that are folded at once.
PIECE = 10_000


def _then(a: Column, b: Column) -> Column:
    """Two clipped shifts, one after the other, as one: x to max(low, min(high, x + shift))."""
    clip = lambda x: F.greatest(b["low"], F.least(b["high"], x))
    return F.struct((a["shift"] + b["shift"]).alias("shift"), clip(a["low"] + b["shift"]).alias("low"), clip(a["high"] + b["shift"]).alias("high"))


def learnt_weights(feedback: DataFrame, order: list[str]) -> DataFrame:
    """(rule, adjustment, examples): each feedback (matched_rules, reward) in order moves its rules by a step, and an adjustment never
    leaves its bounds.

    A walk within bounds depends on its past, but each of its steps is a clipped shift, and clipped shifts compose to one. So a
    rule's feedback is folded in pieces of ``PIECE`` steps, and then its pieces: no rule's history has to fit one row.
    """
    steps = feedback.filter("reward <> 0").select(F.explode(F.array_distinct("matched_rules")).alias("rule"), (F.col("reward") * STEP).alias("shift"), *order)
    numbered = steps.withColumn("_i", F.row_number().over(Window.partitionBy("rule").orderBy(*order)))
    one = F.struct(F.col("shift"), F.lit(-MOST_ADJUSTMENT).alias("low"), F.lit(MOST_ADJUSTMENT).alias("high"))
    none = F.struct(F.lit(0.0).alias("shift"), F.lit(-MOST_ADJUSTMENT).alias("low"), F.lit(MOST_ADJUSTMENT).alias("high"))
    folded = lambda c: F.aggregate(F.array_sort(F.collect_list(F.struct("_i", c.alias("f")))), none, lambda a, x: _then(a, x["f"]))
    pieces = numbered.groupBy("rule", F.floor(F.col("_i") / PIECE).alias("_piece")).agg(F.min("_i").alias("_i"), folded(one).alias("f"), F.count("*").alias("n"))
    per = pieces.groupBy("rule").agg(folded(F.col("f")).alias("f"), F.sum("n").alias("examples"))
    return per.select("rule", F.round(F.greatest(F.col("f.low"), F.least(F.col("f.high"), F.col("f.shift"))), 6).alias("adjustment"), "examples")


def watermark(rows: DataFrame, at: str) -> DataFrame:
    """One row: the latest time of a table, null for an empty one."""
    return rows.agg(F.max(at).alias("watermark"))
