"""Faceted search as an immutable plan that yields lazy frames: items, count, facets.

A plan is a base frame plus criteria, joins, facets, order and page. Criteria are Columns or joins to key frames; joins are
declared once and only those that a criterion, an order or the selection needs are made, with those they depend on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import cut

DEFAULT_LIMIT = 10
#: Estimated rows up to which a total is counted exactly.
DEFAULT_BUDGET = 5000


@dataclass(frozen=True)
class Criterion:
    """A predicate: a Column over the joined frame, or a semi/anti join with a key frame; ``needs`` names declared joins."""

    column: Column | None = None
    keys: DataFrame | None = None
    on: tuple[str, ...] = ()
    anti: bool = False
    needs: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        if self.keys is not None:
            return df.join(self.keys.select(*self.on).distinct() if not self.anti else self.keys.select(*self.on), list(self.on), "left_anti" if self.anti else "left_semi")
        return df if self.column is None else df.filter(self.column)


def where(column: Column, *needs: str) -> Criterion:
    return Criterion(column=column, needs=needs)


def all_of(*criteria: Criterion) -> Criterion:
    """AND of column criteria; none at all is no predicate."""
    cols = [c.column for c in criteria if c.column is not None]
    return Criterion(column=reduce(lambda a, b: a & b, cols) if cols else None, needs=tuple(n for c in criteria for n in c.needs))


def any_of(*criteria: Criterion) -> Criterion:
    """OR of column criteria; none at all is no predicate, not FALSE."""
    cols = [c.column for c in criteria if c.column is not None]
    return Criterion(column=reduce(lambda a, b: a | b, cols) if cols else None, needs=tuple(n for c in criteria for n in c.needs))


def negate(c: Criterion) -> Criterion:
    if c.keys is not None:
        return replace(c, anti=not c.anti)
    return c if c.column is None else replace(c, column=~c.column)


def one_of(name: str, values: list, *needs: str) -> Criterion:
    """column IN values; an empty list matches nothing."""
    return Criterion(column=F.col(name).isin(*values) if values else F.lit(False), needs=needs)


def exists_in(keys: DataFrame, *on: str) -> Criterion:
    return Criterion(keys=keys, on=on)


def exists_flag(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Add a boolean: does ``on`` occur in ``keys``? For EXISTS inside an OR, where a semi join can't stand."""
    marks = keys.select(F.col(on)).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


@dataclass(frozen=True)
class JoinSpec:
    """A declared join: the frame, its condition columns, its kind, and the joins it depends on."""

    frame: DataFrame
    on: tuple[str, ...]
    kind: str = "inner"
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Facet:
    """A filterable and countable value. OR facets ignore their own filter while they are counted, AND facets keep it.

    ``value`` is a Column of the root, or an array of values if ``many``; ``labels`` give values that stay at count zero.
    """

    name: str
    value: Column
    logic: str = "or"
    selected: tuple = ()
    many: bool = False
    needs: tuple[str, ...] = ()

    def criterion(self) -> Criterion:
        if not self.selected:
            return Criterion(needs=self.needs)
        if self.many:
            wanted = F.array(*[F.lit(v) for v in self.selected])
            col = F.arrays_overlap(self.value, wanted) if self.logic == "or" else F.size(F.array_intersect(self.value, wanted)) == len(set(self.selected))
            return Criterion(column=col, needs=self.needs)
        tests = [self.value.isNull() if v is None else self.value == v for v in self.selected]
        return Criterion(column=reduce((lambda a, b: a | b) if self.logic == "or" else (lambda a, b: a & b), tests), needs=self.needs)


def _named(facet: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))


@dataclass(frozen=True)
class SearchPlan:
    """Root frame with options; every ``with_*`` returns a new plan, ``order`` replaces an earlier order."""

    root: DataFrame
    scope: tuple[Criterion, ...] = ()
    criteria: tuple[Criterion, ...] = ()
    joins: dict[str, JoinSpec] = field(default_factory=dict)
    facets: tuple[Facet, ...] = ()
    order: tuple[Column, ...] = ()
    tie: tuple[str, ...] = ()
    limit: int | None = DEFAULT_LIMIT
    offset: int = 0
    selection: tuple[Column | str, ...] = ()
    selection_needs: tuple[str, ...] = ()

    def with_scope(self, *c: Criterion) -> SearchPlan:
        return replace(self, scope=self.scope + c)

    def with_where(self, *c: Criterion) -> SearchPlan:
        return replace(self, criteria=self.criteria + c)

    def with_join(self, name: str, spec: JoinSpec) -> SearchPlan:
        return replace(self, joins=self.joins | {name: spec})

    def with_facets(self, *f: Facet) -> SearchPlan:
        return replace(self, facets=self.facets + f)

    def with_order(self, *cols: Column, tie: tuple[str, ...] = ()) -> SearchPlan:
        return replace(self, order=cols, tie=tie)

    def with_page(self, limit: int | None, page: int = 1, offset: int = 0) -> SearchPlan:
        return replace(self, limit=limit, offset=(page - 1) * (limit or 0) + offset)

    def with_select(self, *cols: Column | str, needs: tuple[str, ...] = ()) -> SearchPlan:
        return replace(self, selection=cols, selection_needs=needs)

    def required(self, extra: tuple[str, ...] = ()) -> list[str]:
        """Names of joins to make, dependencies first; an undeclared one is an error."""
        out: list[str] = []

        def visit(name: str) -> None:
            if name not in self.joins:
                raise KeyError(f"join {name!r} is not declared")
            for n in self.joins[name].needs:
                visit(n)
            if name not in out:
                out.append(name)

        for c in (*self.scope, *self.criteria, *[f.criterion() for f in self.facets]):
            for n in c.needs:
                visit(n)
        for n in extra:
            visit(n)
        return out

    def _filtered(self, facets: tuple[Facet, ...], extra: tuple[str, ...] = ()) -> DataFrame:
        df = self.root
        for name in self.required(extra):
            j = self.joins[name]
            df = df.join(j.frame, list(j.on), j.kind)
        for c in (*self.scope, *self.criteria, *[f.criterion() for f in facets]):
            df = c.apply(df)
        return df

    def matches(self) -> DataFrame:
        """All rows that fit, without order and page."""
        return self._filtered(self.facets, self.selection_needs)

    def total(self) -> DataFrame:
        """One row: the exact count."""
        return self.matches().agg(F.count("*").alias("total_count"))

    def estimate(self) -> int:
        """The optimiser's row estimate: its row count where statistics give one, else the bytes divided by the width of a row."""
        plan = self.matches()._jdf.queryExecution().optimizedPlan()
        stats = plan.stats()
        if stats.rowCount().isDefined():
            return int(str(stats.rowCount().get()))
        width = 8 + sum(int(f.dataType().defaultSize()) for f in self.matches()._jdf.schema().fields())
        return max(1, int(str(stats.sizeInBytes())) // width)

    def budgeted_total(self, budget: int | None = DEFAULT_BUDGET) -> DataFrame:
        """One row (total_count, is_estimate): exact while the estimated rows to read stay within ``budget`` or without one, else
        the optimiser's estimate."""
        estimate = self.estimate() if budget else 0
        if budget and estimate > budget:
            return self.root.sparkSession.createDataFrame([(estimate, True)], "total_count long, is_estimate boolean")
        return self.total().withColumn("is_estimate", F.lit(False))

    def exists(self) -> bool:
        return not self.matches().isEmpty()

    def items(self) -> DataFrame:
        """The page in order, with ``has_next_page`` from one row beyond it that is trimmed."""
        df = self.matches()
        if self.limit == 0:  # nothing to order: only whether there is a first row
            df, one = df.limit(0), df.offset(self.offset).limit(1)
            out = df.join(one.select(F.lit(True).alias("has_next_page")), F.lit(False))
            return out.select(*self.selection, "has_next_page") if self.selection else out
        order = [*self.order, *[F.col(t).asc_nulls_last() for t in self.tie]]
        if order:
            df = df.orderBy(*order)
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is None:
            out = df.withColumn("has_next_page", F.lit(False))
        else:
            # at most limit + 1 rows reach the window
            page = df.limit(self.limit + 1)
            numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(*order))) if order else page.withColumn("_n", F.row_number().over(Window.orderBy(F.lit(0))))
            out = numbered.withColumn("has_next_page", F.max("_n").over(Window.partitionBy()) > self.limit).filter(F.col("_n") <= self.limit).drop("_n")
        return out.select(*self.selection, "has_next_page") if self.selection else out

    def facet_counts(self, budget: int | None = None) -> DataFrame:
        """(facet, value, n, selected) from one scan; selected values stay at zero.

        Each row carries a flag per facet; for every facet whose other facets it fits, its values are exploded and counted in
        one aggregate. Facets that need other joins are counted apart from these. With a ``budget``, a column ``over_budget``
        tells the values of more rows than it.
        """
        if not self.facets:
            raise ValueError("the plan has no facets")
        groups: dict[tuple[str, ...], list[Facet]] = {}
        for f in self.facets:
            groups.setdefault(f.needs, []).append(f)
        parts = []
        for needs, mine in groups.items():
            # filters of facets that are not counted here apply as they are
            df = self._filtered(tuple(f for f in self.facets if f not in mine), needs)
            fits = {f.name: f.criterion().column for f in mine}
            flags = {f"_fits{i}": F.coalesce(fits[f.name], F.lit(False)) if fits[f.name] is not None else F.lit(True) for i, f in enumerate(mine)}
            values = {f"_value{i}": F.transform(F.array_distinct(f.value) if f.many else F.array(f.value), lambda v: v.cast("string")) for i, f in enumerate(mine)}
            df = df.select(*[c.alias(n) for n, c in (flags | values).items()])
            counted = []
            for i, f in enumerate(mine):
                others = [F.col(f"_fits{j}") for j in range(len(mine)) if j != i or f.logic == "and"]
                own = F.transform(F.coalesce(F.col(f"_value{i}"), F.array().cast("array<string>")), _named(f.name))
                counted.append(F.when(reduce(lambda a, b: a & b, others, F.lit(True)), own).otherwise(F.array().cast("array<struct<facet: string, value: string>>")))
            parts.append(df.select(F.explode(F.concat(*counted)).alias("x")).select("x.*").groupBy("facet", "value").agg(F.count("*").alias("n")))
        counts = reduce(lambda a, b: a.unionByName(b), parts)
        wanted = [(f.name, None if v is None else str(v)) for f in self.facets for v in f.selected]
        if wanted:
            zero = self.root.sparkSession.createDataFrame(wanted, "facet string, value string").select("facet", "value", F.lit(0).cast("long").alias("n"), F.lit(True).alias("selected"))
            both = counts.withColumn("selected", F.lit(False)).unionByName(zero)
            counts = both.groupBy("facet", "value").agg(F.sum("n").alias("n"), F.bool_or("selected").alias("selected"))
        else:
            counts = counts.withColumn("selected", F.lit(False))
        return counts if budget is None else counts.withColumn("over_budget", F.col("n") > budget)

    def grouped(self, keys: list[str], inner: list[Column], outer: list[Column] | None = None) -> DataFrame:
        """One representative per key by the inner order, then the outer order and the page."""
        best = self.matches().withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*inner))).filter("_r = 1").drop("_r")
        page = best.orderBy(*outer) if outer else best
        page = page.offset(self.offset) if self.offset else page
        page = page if self.limit is None else page.limit(self.limit)
        return page.select(*self.selection) if self.selection else page


def hydrate_one(roots: DataFrame, subs: DataFrame, on: str, name: str, must: bool = False) -> DataFrame:
    """Attach the one related row as a struct; with ``must``, a missing one is an error at run time."""
    packed = subs.select(F.col(on), F.struct(*[c for c in subs.columns if c != on]).alias(name))
    out = roots.join(packed, on, "left")
    if must:
        out = out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit(f"no {name} for "), F.col(on).cast("string")))).otherwise(F.col(name)))
    return out


def hydrate_many(roots: DataFrame, subs: DataFrame, on: str, name: str, fields: list[str]) -> DataFrame:
    """Attach the related rows as an array ordered by ``fields``; none is an empty array."""
    packed = subs.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return roots.join(packed, on, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(packed.schema[name].dataType)))


def found_and_missing(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(position, key, found) of the wanted keys in their order; repeats of a key are dropped."""
    first = wanted.groupBy(key).agg(F.min("position").alias("position"))
    return exists_flag(first, rows, key, "found").select("position", key, "found")


def recursive_closure(edges: DataFrame, source: str, target: str, most_rounds: int | None = None) -> DataFrame:
    """All (source, target) pairs that are reachable in any number of steps, semi-naive: each round joins only the new pairs.

    Rounds go on until one finds no new pair; each is materialised, so none is computed twice. ``most_rounds`` bounds them, and an
    unfinished closure is then an error, never a part of one.
    """
    step = cut(edges.select(F.col(source).alias(target), F.col(target).alias("_next")).distinct())
    every = fresh = cut(edges.select(source, target).distinct())
    rounds = 0
    while not fresh.isEmpty():
        if most_rounds is not None and rounds >= most_rounds:
            raise RuntimeError(f"the closure is not complete after {most_rounds} rounds")
        fresh = cut(fresh.join(step, target).select(source, F.col("_next").alias(target)).distinct().join(every, [source, target], "left_anti"))
        every = every.unionByName(fresh)
        rounds += 1
        if rounds % 8 == 0:
            every = cut(every)
    return every


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows by ``key`` beyond ``after``."""
    return (df if after is None else df.filter(F.col(key) > after)).orderBy(key).limit(limit)


Option = Callable[[SearchPlan], SearchPlan]


def fold(plan: SearchPlan, *options: Option) -> SearchPlan:
    """Apply options from left to right."""
    return reduce(lambda p, o: o(p), options, plan)


class ResultCache:
    """Frames held by a key for later searches: 'cached' reads the one that is held, 'warm' makes it anew; the least recently used
    of more than ``most`` is released."""

    def __init__(self, most: int = 16):
        self.most, self.held = most, {}

    def get(self, key: str, make: Callable[[], DataFrame], mode: str = "cached") -> DataFrame:
        if mode not in ("off", "cached", "warm"):
            raise ValueError(f"no such cache mode {mode!r}")
        if mode == "off":
            return make()
        held = self.held.pop(key, None)
        if held is not None and mode == "warm":
            held.unpersist()
            held = None
        self.held[key] = make().persist() if held is None else held
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held))).unpersist()
        return self.held[key]


def with_callbacks(page: DataFrame, *callbacks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A result page after its post-processing steps, in order; each sees the page of the one before."""
    return reduce(lambda df, f: f(df), callbacks, page)
