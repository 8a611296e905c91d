"""Reversible changes: planned differences, compare-and-set application, removal with snapshots, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plan_changes(rows: DataFrame, key: str, **fresh: Column) -> DataFrame:
    """(key, field, old, new): cells whose derived value differs from the stored one, as text."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("old"), c.cast("string").alias("new")) for n, c in fresh.items()])
    return rows.select(key, F.explode(cells).alias("c")).select(key, "c.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def apply_changes(rows: DataFrame, key: str, journal: DataFrame, back: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Rows after a journal (or before it, with ``back``). A cell changes only if it still holds the expected value.

    ``fields`` are the columns that the journal may name; all but the key without them.
    """
    fields = [c for c in rows.columns if c != key] if fields is None else fields
    wide = journal.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.struct(F.col("new" if back else "old").alias("was"), F.col("old" if back else "new").alias("to")))).alias(f"_{f}") for f in fields])
    j = rows.join(wide, key, "left")
    for f in fields:
        hit = F.col(f"_{f}").isNotNull() & F.col(f).cast("string").eqNullSafe(F.col(f"_{f}.was"))
        j = j.withColumn(f, F.when(hit, F.col(f"_{f}.to").try_cast(rows.schema[f].dataType)).otherwise(F.col(f)))
    return j.select(*rows.columns)


def remove_with_snapshot(rows: DataFrame, key: str, doomed: DataFrame, reason: str, children: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, snapshots): removed rows and their children as JSON, enough to restore them."""
    gone = rows.join(doomed.select(key).distinct(), key, "left_semi")
    snap = gone.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("snapshot"), F.lit(reason).alias("reason"))
    for name, child in (children or {}).items():
        packed = child.join(doomed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in child.columns if c != key])))).alias(name))
        snap = snap.join(packed, key, "left")
    return rows.join(doomed.select(key).distinct(), key, "left_anti"), snap


def restore(rows: DataFrame, key: str, snapshots: DataFrame) -> DataFrame:
    """Rows with those of the snapshots; a key that is there again keeps its present row."""
    back = snapshots.select(F.from_json("snapshot", rows.schema).alias("r")).select("r.*")
    return rows.unionByName(back.join(rows.select(key), key, "left_anti").select(*rows.columns))


def restore_children(children: DataFrame, key: str, snapshots: DataFrame, name: str, back: DataFrame) -> DataFrame:
    """``children`` with those of the snapshots' column ``name``, for the keys of ``back`` that have no children now."""
    own = T.StructType([f for f in children.schema.fields if f.name != key])
    packed = snapshots.join(back.select(key), key, "left_semi").join(children.select(key).distinct(), key, "left_anti")
    kids = packed.select(key, F.explode(F.from_json(name, T.ArrayType(own))).alias("c")).select(key, "c.*")
    return children.unionByName(kids.select(*children.columns))


def union_of_removed(live: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are quarantined or removed, with where they are."""
    return live.select(key, F.lit("live").alias("place")).unionByName(snapshots.select(key, F.lit("snapshot").alias("place"))).distinct()


def quarantine_page(live: DataFrame, snapshots: DataFrame, key: str, limit: int, after: object = None) -> DataFrame:
    """(key, place) of the next page behind a key of what is quarantined or removed: a bounded page."""
    every = union_of_removed(live, snapshots, key)
    return (every if after is None else every.filter(F.col(key) > F.lit(after))).orderBy(key, "place").limit(limit)


def expire_quarantine(state: DataFrame, now: Column, days: int, most: int, key: str) -> DataFrame:
    """State after the next ``most`` of the oldest entries of over ``days`` have expired: a bounded step. Their snapshots are dropped,
    they stay listed."""
    due = state.filter(F.col("expired_at").isNull() & (F.col("quarantined_at") < now - F.expr(f"INTERVAL {days} DAYS"))).orderBy("quarantined_at", key).limit(most).select(key, F.lit(True).alias("_due"))
    j = state.join(due, key, "left")
    hit = F.coalesce("_due", F.lit(False))
    new = {"expired_at": now, "torrent_snapshot": F.lit(None), "files_snapshot": F.lit(None), "sources_snapshot": F.lit(None)}
    return j.select(*[F.when(hit, new[c].cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns])
