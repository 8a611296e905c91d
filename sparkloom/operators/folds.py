"""Event-sourced state: keep-strongest, keep-latest, runs, counters, priors and votes.

Order-independent folds are aggregates that combine before the shuffle; ordered ones are windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import micros


def strongest(events: DataFrame, key: str, strength: str, at: str, ident: str, fields: list[str]) -> DataFrame:
    """Per key, the fields of the event of greatest strength, then latest, then smallest id."""
    order = F.struct(F.col(strength), F.col(at), -F.col(ident))
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("w")).select(key, "w.*")


def latest(events: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Per key, the fields of the last event in the given order."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("w")).select(*keys, "w.*")


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Upsert by key: the row with the later ``at`` wins, the new one on a tie."""
    cols = old.columns
    every = old.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(*[c for c in cols if c not in keys]), F.struct(at, "_new"))
    return every.groupBy(*keys).agg(best.alias("w")).select(*keys, "w.*").select(*cols)


def previous_and_peak(events: DataFrame, key: str, order: list[str], value: str, at: str) -> DataFrame:
    """Each event with the value before it, the greatest so far, and the last time the value was positive."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("previous", F.lag(value).over(w)).withColumn("peak", F.max(value).over(upto)).withColumn("last_positive_at", F.last(F.when(F.col(value) > 0, F.col(at)), ignorenulls=True).over(upto))


def suspicion_runs(events: DataFrame, key: str, at: str, order: list[str], alive: Column, suspect: Column, hours: int = 4, least: int = 2) -> DataFrame:
    """Liveness at each key's last event: alive, suspect or dead.

    An alive event resets the run; a run of suspect events is dead once it has ``least`` of them, ``hours`` apart from its
    first to the current one, and stays dead until the next alive event. Runs are numbered by the alive events before them, so windows suffice.
    """
    w = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(alive, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    in_run = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.filter(alive | suspect).withColumn("_suspect", suspect).withColumn("_run", run)
    rows = rows.withColumn("_n", F.sum(F.col("_suspect").cast("int")).over(in_run)).withColumn("_first", F.min(F.when(F.col("_suspect"), F.col(at))).over(in_run))
    due = F.col("_suspect") & (F.col("_n") >= least) & (micros(at) - micros("_first") >= hours * 3_600_000_000)
    rows = rows.withColumn("_dead", F.max(due.cast("int")).over(in_run))
    state = F.when(F.col("_dead") == 1, "dead").when(F.col("_n") > 0, "suspect").otherwise("alive")
    fields = F.struct(state.alias("status"), F.col("_n").alias("suspect_observations"), F.col("_first").alias("first_suspect_at"), F.col(at).alias("last_event_at"))
    return rows.groupBy(key).agg(F.max_by(fields, F.struct(*order)).alias("w")).select(key, "w.*")


def beta_priors(outcomes: DataFrame, features: str, success: Column) -> DataFrame:
    """(type, value, alpha, beta): one count per distinct feature of each outcome, both sides starting at one."""
    f = outcomes.select(F.explode(F.array_distinct(features)).alias("f"), success.alias("ok"))
    return f.groupBy(F.col("f.type").alias("type"), F.col("f.value").alias("value")).agg((F.count_if("ok") + 1).alias("alpha"), (F.count_if(~F.col("ok")) + 1).alias("beta"))


def resolve_attempts(grabs: DataFrame, imports: DataFrame, now: Column, expiry_days: int, key: str = "key") -> DataFrame:
    """(key, success, features) of the attempts that are decided at ``now``: each import decides all attempts of its key since the one
    before, as one outcome with their features merged; attempts without one are a failure, one for a key, once they are older than
    ``expiry_days``. Younger ones are pending and not in the result.

    ``grabs``: key, at, features; ``imports``: key, at. Each attempt finds its import by a window over both, not by a join of pairs.
    """
    none = F.lit(None).cast(grabs.schema["features"].dataType)
    both = grabs.select(key, "at", "features", F.lit(1).alias("_grab")).unionByName(imports.select(key, "at", none.alias("features"), F.lit(0).alias("_grab")))
    # of equal times the import comes after
    later = Window.partitionBy(key).orderBy("at", F.col("_grab").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = both.withColumn("_import", F.min(F.when(F.col("_grab") == 0, F.col("at"))).over(later)).filter("_grab = 1")
    decided = seen.filter(F.col("_import").isNotNull() | (F.col("at") + F.expr(f"INTERVAL {expiry_days} DAYS") < now))
    one = decided.select(key, "_import", F.explode(F.array_distinct("features")).alias("f")).groupBy(key, "_import").agg(F.collect_set("f").alias("features"))
    return one.select(key, F.col("_import").isNotNull().alias("success"), "features")


def stable_rank(items: DataFrame, scores: DataFrame, key: str, position: str, score: str = "score") -> DataFrame:
    """``items`` with their new ``rank``: by score from high to low, those of equal or no score in their old order behind."""
    j = items.join(scores.select(key, score), key, "left")
    return j.select(*items.columns, F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), position)).alias("rank"))  # a page of results


def rerank(items: DataFrame, key: str, features: str, seeders: Column, priors: DataFrame, least: int = 10, floor: float = 0.01) -> DataFrame:
    """(key, score): geometric mean of the features' posteriors times 1 + ln(1 + seeders).

    A feature with fewer than ``least`` observations, or an unknown one, counts as the global average.
    """
    total = priors.agg((F.sum("alpha") / F.sum(F.col("alpha") + F.col("beta"))).alias("average"))
    exploded = items.select(key, seeders.alias("_s"), F.explode(features).alias("f")).select(key, "_s", "f.type", "f.value")
    j = exploded.join(priors, ["type", "value"], "left").crossJoin(F.broadcast(total))  # one row
    posterior = F.when(F.col("alpha") + F.col("beta") - 2 >= least, F.col("alpha") / (F.col("alpha") + F.col("beta"))).otherwise(F.coalesce("average", F.lit(0.5)))
    geo = F.exp(F.avg(F.log(F.greatest(posterior, F.lit(floor)))))
    return j.groupBy(key).agg(F.round(geo * (1 + F.log1p(F.coalesce(F.max("_s"), F.lit(0)))), 6).alias("score"))


def majority(votes: DataFrame, group: str, label: str, least: int = 2, share: tuple[int, int] = (2, 3)) -> DataFrame:
    """(group, label, votes, total): the label with most votes, ties to the smaller one, if it has enough votes and share."""
    counts = votes.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("votes"))
    per = counts.groupBy(group).agg(F.sum("votes").alias("total"), F.max("votes").alias("votes"), F.min_by(label, F.struct(-F.col("votes"), F.col(label))).alias(label))
    return per.filter((F.col("votes") >= least) & (F.col("votes") * share[1] >= F.col("total") * share[0])).select(group, label, "votes", "total")


def leave_one_out(votes: DataFrame, ident: str, group: str, label: str, least: int = 2, share: tuple[int, int] = (2, 3)) -> DataFrame:
    """(ident, label): for each row, what the other rows of its group elect. Built from counts, so a hot group stays small.

    A row's own vote only lowers the count of its own label, so the winner without it is the best label or the second.
    """
    counts = votes.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), label))).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    top = ranked.filter("r <= 2").groupBy(group).agg(F.first("total").alias("total"), *[F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in (label, "n")])
    j = votes.join(top, group)
    own = F.coalesce((F.col(label) == F.col(f"{label}1")).cast("int"), F.lit(0))
    own2 = F.coalesce((F.col(label) == F.col(f"{label}2")).cast("int"), F.lit(0))
    n1, n2 = F.col("n1") - own, F.coalesce(F.col("n2"), F.lit(0)) - own2
    first = (n1 > n2) | (n1 == n2) & (F.col(f"{label}1") < F.coalesce(F.col(f"{label}2"), F.col(f"{label}1"))) | F.col(f"{label}2").isNull()
    best, n = F.when(first, F.col(f"{label}1")).otherwise(F.col(f"{label}2")), F.when(first, n1).otherwise(n2)
    total = F.col("total") - F.col(label).isNotNull().cast("int")
    return j.select(ident, best.alias("elected"), n.alias("n"), total.alias("total")).filter((F.col("n") >= least) & (F.col("n") * share[1] >= F.col("total") * share[0])).select(ident, "elected")


def backoff_fold(events: DataFrame, key: str, order: list[str], ok: str, reason: str, schedule: tuple[int, ...] = (60, 300, 1800, 7200)) -> DataFrame:
    """(key, failures, last_reason, wait_seconds): failures in a row of one reason up to the last event, and the seconds to wait after
    it: success clears, another reason starts anew.

    Counted from the end: the run lasts until the first event, going back, that is a success or has another reason than the last.
    """
    back = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    success = F.coalesce(F.col(ok), F.lit(False))
    rows = events.select(key, *order, success.alias("_ok"), F.col(reason).alias("_reason")).withColumn("_last", F.first("_reason").over(upto))
    rows = rows.withColumn("_broken", F.max((F.col("_ok") | ~F.col("_reason").eqNullSafe(F.col("_last"))).cast("int")).over(upto))
    per = rows.groupBy(key).agg(F.count_if(F.col("_broken") == 0).alias("failures"), F.max(F.when(F.col("_broken") == 0, F.col("_last"))).alias("last_reason"))
    waits = F.element_at(F.array(*[F.lit(w).cast("long") for w in schedule]), F.least(F.col("failures"), F.lit(len(schedule))).cast("int"))
    return per.select(key, "failures", "last_reason", F.when(F.col("failures") > 0, waits).otherwise(F.lit(0).cast("long")).alias("wait_seconds"))


def decision_ladder(*rungs: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The label of the first rung whose test is true; null tests don't hold."""
    out = None
    for test, label in rungs:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(otherwise))


def xor_nearest(nodes: DataFrame, ident: str, target_hex: str, k: int) -> DataFrame:
    """The k ids closest to a target by XOR of their 160 bits: a top-k report."""
    chunks = [(1, 15), (16, 15), (31, 10)]
    dist = [F.conv(F.substring(ident, a, n), 16, 10).cast("long").bitwiseXOR(F.lit(int(target_hex[a - 1 : a - 1 + n], 16))) for a, n in chunks]
    cols = [d.alias(f"_d{i}") for i, d in enumerate(dist)]
    return nodes.select(ident, *cols).distinct().orderBy("_d0", "_d1", "_d2").limit(k).select(ident)


def keep_with_budget(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first rows in order up to a cap: the batch that a bounded job would take."""
    return df.orderBy(*order).limit(cap)
