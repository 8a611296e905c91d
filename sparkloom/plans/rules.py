"""Rule workflows compiled to Columns: an expression language, conditions, and actions that thread a result through a frame.

A workflow is a list of actions (plain data, e.g. from JSON or YAML). Each becomes a projection that assigns a few state
columns on the rows of a mask, so a workflow's plan is linear in its actions; no row is interpreted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.anime import clean_titles, is_batch, is_film
from sparkloom.functions.episodes import episodes_of
from sparkloom.functions.naming import bracket_marks
from sparkloom.functions.release import KINDS_3D, MODIFIERS, infer_alias, release_group, video_codec, video_resolution, video_source
from sparkloom.functions.titles import date_in, title_and_year
from sparkloom.operators.matching import best_matches
from sparkloom.session import cut

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!()\[\],.?:]))")
_LEVELS = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%")]
UNITS = {"kb": 1_000, "mb": 1_000_000, "gb": 1_000_000_000}


@dataclass
class Scope:
    """What names mean: Columns by dotted path, named lists of constants, keyword regexes, and lambda variables."""

    columns: dict[str, Column] = field(default_factory=dict)
    lists: dict[str, list] = field(default_factory=dict)
    keywords: dict[str, str] = field(default_factory=dict)
    local: dict[str, Column] = field(default_factory=dict)


class ExpressionError(ValueError):
    pass


class Expression:
    """Compiler of one expression: literals, names, operators, 'in', '?:', methods matches, size, contains, startsWith,
    filter, map, exists, all, join, isSorted, sum, min, max, indexOf and lastIndexOf.

    '+' adds numbers, or joins lists where a side is written as one. sum of an empty list is 0; min and max of one are an
    error; indexOf of an absent value is -1.
    """

    def __init__(self, text: str, scope: Scope):
        self.text, self.scope, self.tokens, self.at = text, scope, [], 0
        pos = 0
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ExpressionError(f"unexpected {text[pos]!r} at {pos} in {text!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            pos = m.end()

    def compile(self) -> Column:
        out = self._ternary()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return _column(out)

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def _take(self, expected: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or expected is not None and self.tokens[self.at][1] != expected:
            raise ExpressionError(f"expected {expected or 'more'} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def _ternary(self):
        test = self._binary(0)
        if self._peek() != "?":
            return test
        self._take("?")
        yes = self._ternary()
        self._take(":")
        return F.when(_column(test), _column(yes)).otherwise(_column(self._ternary()))

    def _binary(self, level: int):
        if level == len(_LEVELS):
            return self._unary()
        left = self._binary(level + 1)
        while self._peek() in _LEVELS[level] and self.tokens[self.at][0] in ("op", "name"):
            op = self._take()[1]
            right = self._binary(level + 1)
            if op == "in":
                left = _column(left).isin(*right) if isinstance(right, list) else F.array_contains(_column(right), _column(left))
                continue
            a, b = _column(left), _column(right)
            if op == "+" and (isinstance(left, list) or isinstance(right, list)):
                left = F.concat(a, b)
                continue
            left = {"||": lambda: a | b, "&&": lambda: a & b, "==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[op]()
        return left

    def _unary(self):
        if self._peek() == "!":
            self._take()
            return ~_column(self._unary())
        if self._peek() == "-":
            self._take()
            return -_column(self._unary())
        return self._postfix()

    def _postfix(self):
        kind, value = self._take()
        if kind == "num":
            out = float(value) if "." in value else int(value)
            if self._peek() in UNITS:
                out *= UNITS[self._take()[1]]
            out = F.lit(out)
        elif kind == "str":
            out = _Text(re.sub(r"\\(.)", r"\1", value[1:-1]))
        elif value == "(":
            out = self._ternary()
            self._take(")")
        elif value == "[":
            items = []
            while self._peek() != "]":
                items.append(_column(self._ternary()))
                if self._peek() == ",":
                    self._take()
            self._take("]")
            out = items
        elif value in ("true", "false"):
            out = F.lit(value == "true")
        elif value == "null":
            out = F.lit(None)
        elif kind == "name":
            out = self._name(value)
        else:
            raise ExpressionError(f"unexpected {value!r} in {self.text!r}")
        while self._peek() == ".":
            self._take()
            out = self._member(out, self._take()[1])
        return out

    def _name(self, value: str):
        path = value
        s = self.scope
        while True:
            if path in s.local:
                return s.local[path]
            for known in (s.columns, s.lists, s.keywords):
                if path in known:
                    return known[path] if known is not s.keywords else _Pattern(known[path])
            if self._peek() != "." or self.at + 1 >= len(self.tokens):
                raise ExpressionError(f"unknown name {path!r} in {self.text!r}")
            self._take()
            path += "." + self._take()[1]

    def _member(self, out, name: str):
        if self._peek() != "(":
            return _column(out)[name]
        self._take("(")
        if name in ("filter", "map", "exists", "all"):
            var = self._take()[1]
            self._take(",")
            start = self.at
            made: list[int] = []

            def body(x: Column) -> Column:
                self.at = start
                self.scope.local[var] = x
                try:
                    return _column(self._ternary())
                finally:
                    del self.scope.local[var]
                    made.append(self.at)

            result = {"filter": F.filter, "map": F.transform, "exists": F.exists, "all": F.forall}[name](_column(out), body)
            self.at = made[-1]
            self._take(")")
            return result
        args = []
        while self._peek() != ")":
            args.append(self._ternary())
            if self._peek() == ",":
                self._take()
        self._take(")")
        c = _column(out)
        if name == "matches":
            return c.rlike(args[0].regex) if isinstance(args[0], _Pattern) else F.rlike(c, _column(args[0]))
        methods: dict[str, Callable[[], Column]] = {
            "size": lambda: F.size(c), "length": lambda: F.length(c), "contains": lambda: F.contains(c, _column(args[0])), "startsWith": lambda: F.startswith(c, _column(args[0])),
            "sum": lambda: F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + x), "min": lambda: F.when(F.size(c) == 0, F.raise_error(F.lit("min of an empty list"))).otherwise(F.array_min(c)), "max": lambda: F.when(F.size(c) == 0, F.raise_error(F.lit("max of an empty list"))).otherwise(F.array_max(c)),
            "join": lambda: F.array_join(c, args[0].text if isinstance(args[0], _Text) else ""), "isSorted": lambda: c == F.array_sort(c),
            "indexOf": lambda: F.array_position(c, _column(args[0])) - 1,
            "lastIndexOf": lambda: F.when(F.array_contains(c, _column(args[0])), F.size(c) - F.array_position(F.reverse(c), _column(args[0]))).otherwise(F.lit(-1)),
        }
        if name not in methods:
            raise ExpressionError(f"unknown method {name!r} in {self.text!r}")
        return methods[name]()


@dataclass(frozen=True)
class _Pattern:
    regex: str


@dataclass(frozen=True)
class _Text:
    text: str


def _column(x) -> Column:
    if isinstance(x, list):
        return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    if isinstance(x, _Pattern):
        return F.lit(x.regex)
    if isinstance(x, _Text):
        return F.lit(x.text)
    return x


def compile_condition(spec, scope: Scope) -> Column:
    """A condition: an expression string, or {'and': [...]}, {'or': [...]}, {'not': ...}. A null result is false."""
    if isinstance(spec, str):
        out = Expression(spec, scope).compile()
    elif isinstance(spec, dict) and len(spec) == 1:
        (kind, arg), = spec.items()
        if kind == "and":
            out = reduce(lambda a, b: a & b, [compile_condition(x, scope) for x in arg], F.lit(True))
        elif kind == "or":
            out = reduce(lambda a, b: a | b, [compile_condition(x, scope) for x in arg], F.lit(False))
        elif kind == "not":
            out = ~compile_condition(arg, scope)
        elif kind == "expression":
            out = Expression(arg, scope).compile()
        else:
            raise ExpressionError(f"unknown condition {kind!r}")
    else:
        raise ExpressionError(f"not a condition: {spec!r}")
    return F.coalesce(out, F.lit(False))


# The kinds of a flag.
FLAG_KINDS = {"bool": bool, "string": str, "int": int, "string_list": list, "content_type_list": list}
CONTENT_TYPES = ["movie", "tv_show", "music", "ebook", "comic", "audiobook", "game", "software", "course", "xxx"]


class Flags:
    """Typed parameters of a workflow: ``kinds`` gives the kind of each name, ``values`` their values; any mismatch is an error."""

    def __init__(self, kinds: dict[str, str], values: dict[str, object]):
        for name, kind in kinds.items():
            if kind not in FLAG_KINDS:
                raise ExpressionError(f"flag {name!r} has no such kind: {kind!r}")
        for name, value in values.items():
            if name not in kinds:
                raise ExpressionError(f"flag {name!r} is not defined")
            kind = kinds[name]
            if not isinstance(value, FLAG_KINDS[kind]) or kind == "int" and isinstance(value, bool):
                raise ExpressionError(f"flag {name!r} is not of kind {kind}: {value!r}")
            if kind.endswith("_list") and not all(isinstance(v, str) for v in value):
                raise ExpressionError(f"flag {name!r} holds other values than strings")
            if kind == "content_type_list" and (wrong := set(value) - set(CONTENT_TYPES)):
                raise ExpressionError(f"flag {name!r} holds no content types: {sorted(wrong)}")
        missing = set(kinds) - set(values)
        if missing:
            raise ExpressionError(f"flags without a value: {sorted(missing)}")
        self.kinds, self.values = kinds, values

    def into(self, scope: Scope) -> Scope:
        single = {f"flags.{n}": F.lit(v) for n, v in self.values.items() if not self.kinds[n].endswith("_list")}
        lists = {f"flags.{n}": list(v) for n, v in self.values.items() if self.kinds[n].endswith("_list")}
        return Scope(scope.columns | single, scope.lists | lists, scope.keywords, scope.local)


#: Columns of a workflow's result and their types.
STATE = {
    "content_type": "string", "tags": "array<string>", "deleted": "boolean", "unmatched": "boolean", "title": "string", "year": "int", "date": "date", "episodes": "map<int, array<int>>",
    "video": "struct<resolution: string, source: string, codec: string, modifier: string, kind_3d: string, release_group: string>",
    "content": "struct<content_type: string, content_source: string, content_id: string>", "fallback": "string",
}
#: Actions without an argument, and those with one and its JSON type.
PLAIN_ACTIONS = ["attach_local_content_by_id", "attach_local_content_by_search", "attach_tmdb_content_by_id", "attach_tmdb_content_by_search", "delete", "enrich_type_fallback", "parse_date", "parse_video_content", "type_fallback", "unmatched"]
ARGUMENT_ACTIONS = {"add_tag": "string", "apply": "string", "find_match": "array", "if_else": "object", "run_workflow": "string", "set_content_type": "string"}


def json_schema() -> dict:
    """A JSON schema of workflow sources."""
    condition = {"anyOf": [{"type": "string"}, *[{"type": "object", "required": [k], "additionalProperties": False, "properties": {k: v}} for k, v in (("and", {"type": "array", "items": {"$ref": "#/$defs/condition"}}), ("or", {"type": "array", "items": {"$ref": "#/$defs/condition"}}), ("not", {"$ref": "#/$defs/condition"}), ("expression", {"type": "string"}))]]}
    arguments = {k: {"type": t} for k, t in ARGUMENT_ACTIONS.items()} | {k: {"type": "null"} for k in PLAIN_ACTIONS}
    arguments["set_content_type"] = {"enum": CONTENT_TYPES}
    arguments["find_match"] = {"type": "array", "items": {"$ref": "#/$defs/action"}}
    arguments["if_else"] = {"type": "object", "required": ["condition"], "additionalProperties": False, "properties": {"condition": {"$ref": "#/$defs/condition"}, "if_action": {"$ref": "#/$defs/action"}, "else_action": {"$ref": "#/$defs/action"}}}
    action = {"anyOf": [{"enum": PLAIN_ACTIONS}, {"type": "array", "items": {"$ref": "#/$defs/action"}}, *[{"type": "object", "required": [k], "additionalProperties": False, "properties": {k: v}} for k, v in sorted(arguments.items())]]}
    source = {"workflows": {"type": "object", "additionalProperties": {"$ref": "#/$defs/action"}}, "flags": {"type": "object"}, "flag_definitions": {"type": "object", "additionalProperties": {"enum": sorted(FLAG_KINDS)}}, "keywords": {"type": "object", "additionalProperties": {"type": "array", "items": {"type": "string"}}}, "extensions": {"type": "object", "additionalProperties": {"type": "array", "items": {"type": "string"}}}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["workflows"], "properties": source, "$defs": {"action": action, "condition": condition}}


def read_source(text: str) -> tuple[dict, Flags, dict[str, list[str]], dict[str, list[str]]]:
    """(workflows, flags, keywords, extensions) of a workflow source in JSON."""
    source = json.loads(text)
    if not isinstance(source, dict) or "workflows" not in source:
        raise ExpressionError("a workflow source needs 'workflows'")
    unknown = set(source) - {"workflows", "flags", "flag_definitions", "keywords", "extensions"}
    if unknown:
        raise ExpressionError(f"unknown parts of a workflow source: {sorted(unknown)}")
    return source["workflows"], Flags(source.get("flag_definitions", {}), source.get("flags", {})), source.get("keywords", {}), source.get("extensions", {})


class Workflow:
    """Actions over the columns of ``STATE``, which thread through a frame as one projection per action.

    Actions: those of ``PLAIN_ACTIONS``, {'set_content_type': t}, {'add_tag': t}, {'run_workflow': name}, {'if_else': {'condition',
    'if_action', 'else_action'}}, {'find_match': [actions]} (the first that is not unmatched; if all are, the state passes
    through), a list of actions, or {'apply': name} for a registered Column function of the state. An action works on the rows of its
    mask, a column of its own, so the plan grows with the number of actions and no expression is repeated.

    ``content`` (content_type, content_source, content_id, title, release_year) serves the local attachments; hints are the
    columns hint_type, hint_source and hint_id of the frame. ``functions`` may hold 'type_fallback' (state to a content type) and the
    remote attachments 'attach_tmdb_content_by_id' and 'attach_tmdb_content_by_search' (state to a content struct); without these,
    a fallback changes nothing and a remote attachment is unmatched. ``name`` is the expression of the name that is parsed;
    ``fansub_groups`` are the known ones.
    """

    def __init__(self, workflows: dict[str, list], scope: Scope, functions: dict[str, Callable[[dict[str, Column]], object]] | None = None, content: DataFrame | None = None, name: str = "torrent.name", flags: Flags | None = None, single_episode_max_bytes: int = 0, fansub_groups: tuple[str, ...] = ()):
        self.workflows, self.functions, self.content, self.name, self.limit, self.groups = workflows, functions or {}, content, name, single_episode_max_bytes, fansub_groups
        self.scope = flags.into(scope) if flags else scope

    def columns(self, name: str = "default") -> list[str]:
        """The result's columns, once the actions are known to be well formed: no unknown action, no workflow that runs itself."""
        self._check(self.workflows[name], (name,))
        return list(STATE)

    def _check(self, spec, path: tuple[str, ...]) -> None:
        if isinstance(spec, list):
            for a in spec:
                self._check(a, path)
            return
        kind, arg = self._action(spec, path)
        if kind == "run_workflow":
            if arg in path:
                raise ExpressionError(f"workflow {arg!r} runs itself")
            if arg not in self.workflows:
                raise ExpressionError(f"no workflow {arg!r} in {'/'.join(path)}")
            self._check(self.workflows[arg], (*path, arg))
        elif kind == "if_else":
            if "condition" not in arg or set(arg) - {"condition", "if_action", "else_action"}:
                raise ExpressionError(f"if_else needs a condition, and takes if_action and else_action, in {'/'.join(path)}")
            for branch in ("if_action", "else_action"):
                self._check(arg.get(branch, []), path)
        elif kind == "find_match":
            self._check(arg, path)
        elif kind == "apply" and arg not in self.functions:
            raise ExpressionError(f"no function {arg!r} in {'/'.join(path)}")

    @staticmethod
    def _action(spec, path: tuple[str, ...]) -> tuple[str, object]:
        if isinstance(spec, str):
            spec = {spec: None}
        if not isinstance(spec, dict) or len(spec) != 1:
            raise ExpressionError(f"not an action: {spec!r} in {'/'.join(path)}")
        (kind, arg), = spec.items()
        if kind not in PLAIN_ACTIONS and kind not in ARGUMENT_ACTIONS:
            raise ExpressionError(f"unknown action {kind!r} in {'/'.join(path)}")
        return kind, arg

    def apply(self, df: DataFrame, name: str = "default") -> DataFrame:
        """``df`` with the columns of ``STATE``."""
        self.columns(name)
        start = {"tags": F.array().cast("array<string>"), "deleted": F.lit(False), "unmatched": F.lit(False)}
        out = df.withColumns({_state(n): start.get(n, F.lit(None)).cast(t) for n, t in STATE.items()} | {"_mask0": F.lit(True)})
        self._masks = 0
        out, _ = self._run(out, self.workflows[name], "_mask0", (name,))
        return out.select(*df.columns, *[F.col(_state(n)).alias(n) for n in STATE])

    def _mask(self, df: DataFrame, test: Column) -> tuple[DataFrame, str]:
        self._masks += 1
        name = f"_mask{self._masks}"
        return df.withColumn(name, test), name

    def _set(self, df: DataFrame, mask: str, **values: Column) -> tuple[DataFrame, set[str]]:
        return df.withColumns({_state(n): F.when(F.col(mask), v.cast(STATE[n])).otherwise(F.col(_state(n))) for n, v in values.items()}), set(values)

    def _run(self, df: DataFrame, spec, mask: str, path: tuple[str, ...]) -> tuple[DataFrame, set[str]]:
        """The frame after an action on the rows of ``mask``, and the state columns that it may have changed."""
        changed: set[str] = set()
        if isinstance(spec, list):
            for a in spec:
                df, going = self._mask(df, F.col(mask) & ~F.col(_state("deleted")) & ~F.col(_state("unmatched")))
                df, some = self._run(df, a, going, path)
                changed |= some
            return df, changed
        kind, arg = self._action(spec, path)
        on = F.col(mask)
        state = {n: F.col(_state(n)) for n in STATE}
        if kind == "set_content_type":
            return self._set(df, mask, content_type=F.lit(arg))
        if kind == "add_tag":
            return self._set(df, mask, tags=F.array_distinct(F.array_append(state["tags"], F.lit(arg))))
        if kind == "delete":
            return self._set(df, mask, deleted=F.lit(True))
        if kind == "unmatched":
            return self._set(df, mask, unmatched=F.lit(True))
        if kind == "run_workflow":
            return self._run(df, self.workflows[arg], mask, (*path, arg))
        if kind == "apply":
            return self._set(df, mask, **self.functions[arg](state))
        if kind == "if_else":
            scope = Scope(self.scope.columns | {f"result.{k}": v for k, v in state.items()}, self.scope.lists, self.scope.keywords)
            test = compile_condition(arg["condition"], scope)
            try:
                found = df.select(test.alias("t")).schema["t"].dataType.simpleString()
            except AnalysisException as e:
                raise ExpressionError(f"a condition doesn't fit its columns in {'/'.join(path)}: {arg['condition']!r}: {str(e)[:300]}") from None
            if found != "boolean":
                raise ExpressionError(f"a condition gives {found}, not boolean, in {'/'.join(path)}: {arg['condition']!r}")
            df, held = self._mask(df, test)
            df, yes = self._mask(df, on & F.col(held))
            df, no = self._mask(df, on & ~F.col(held))
            for branch, m in (("if_action", yes), ("else_action", no)):
                if arg.get(branch):
                    df, some = self._run(df, arg[branch], m, path)
                    changed |= some
            return df, changed
        if kind == "find_match":
            before = f"_before{self._masks}"
            df = df.withColumn(before, F.struct(*[c.alias(n) for n, c in state.items()]))
            for a in arg:
                df, some = self._run(df, a, mask, path)
                df, mask = self._mask(df, F.col(mask) & F.col(_state("unmatched")))
                df = df.withColumns({_state(n): F.when(F.col(mask), F.col(before)[n]).otherwise(F.col(_state(n))) for n in some | {"unmatched"}})
                changed |= some
            return df, changed
        return getattr(self, f"_{kind}")(df, mask, state)

    def _parsed_name(self, mask: str) -> Column:
        return F.when(F.col(mask), Expression(self.name, self.scope).compile())

    def _found(self, df: DataFrame, mask: str, test: Column, **values: Column) -> tuple[DataFrame, set[str]]:
        """Set values where the test holds, else unmatched."""
        df, hit = self._mask(df, F.coalesce(test, F.lit(False)))
        df, yes = self._mask(df, F.col(mask) & F.col(hit))
        df, no = self._mask(df, F.col(mask) & ~F.col(hit))
        df, some = self._set(df, yes, **values)
        df, more = self._set(df, no, unmatched=F.lit(True))
        return df, some | more

    def _parse_date(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        df = df.withColumn(f"_date{self._masks}", date_in(self._parsed_name(mask)))
        found = F.col(f"_date{self._masks}")
        return self._found(df, mask, found.isNotNull(), date=found)

    def _parse_video_content(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        """Title, year, episodes and attributes of a name. Without a type: episodes or a full date make a series, so does a fansub group
        (unless the name says film) and an absolute episode number, a year a film, nothing is unmatched. What is no series loses its
        episodes, and its title too where it has no year; a name of several films loses its title and year, so does a fansub name
        that tells neither episode nor film its title."""
        name, k = self._parsed_name(mask), self._masks
        df = df.withColumns({f"_title{k}": title_and_year(name), f"_episodes{k}": episodes_of(name), f"_marks{k}": bracket_marks(name)})
        p, e, marks = F.col(f"_title{k}"), F.col(f"_episodes{k}"), F.col(f"_marks{k}")
        fansub = F.coalesce(F.lower(marks["group"]).isin(*[g.lower() for g in self.groups]), F.lit(False)) if self.groups else F.lit(False)
        df = df.withColumn(f"_clean{k}", clean_titles(F.when(fansub, name), marks["absolute_episode"], self.groups))
        pack = p["pack"] & e.isNull()
        if self.limit and "torrent.size" in self.scope.columns:
            size = self.scope.columns["torrent.size"]
            small = F.forall(F.map_values(e), lambda x: F.size(x) == 0) & (size > 0) & (size <= self.limit)
            e = F.when(small, F.lit(None)).otherwise(e)
        episodic = marks["absolute_episode"].isNotNull() | is_batch(name)
        bare = state["content_type"].isNull() & F.col(f"_episodes{k}").isNull() & state["date"].isNull()
        year = F.when(~pack, p["year"])
        kind = F.coalesce(state["content_type"], F.when(F.col(f"_episodes{k}").isNotNull() | state["date"].isNotNull(), "tv_show").when(fansub & ~episodic & is_film(name), "movie").when(fansub | p["numbered"], "tv_show").when(year.isNotNull(), "movie"))
        series = kind == "tv_show"
        title = F.when(bare & fansub, F.when(episodic | is_film(name), F.nullif(F.col(f"_clean{k}"), F.lit("")))).when(~pack & (series | year.isNotNull()), p["title"])
        video = F.struct(video_resolution(name).alias("resolution"), video_source(name).alias("source"), video_codec(name).alias("codec"), infer_alias(name, MODIFIERS).alias("modifier"), infer_alias(name, KINDS_3D).alias("kind_3d"), release_group(name).alias("release_group"))
        return self._found(df, mask, kind.isNotNull() & p.isNotNull(), content_type=kind, title=title, year=year, episodes=F.when(series, e), video=video)

    def _local(self) -> DataFrame:
        if self.content is None:
            raise ExpressionError("local attachments need content")
        return self.content

    def _attach_local_content_by_id(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        hints = ["hint_type", "hint_source", "hint_id"]
        if not set(hints) <= set(df.columns):
            return self._set(df, mask, unmatched=F.lit(True))
        held = f"_held{self._masks}"
        keys = self._local().select(*[F.col(c).alias(h) for c, h in zip(("content_type", "content_source", "content_id"), hints)]).distinct().withColumn(held, F.lit(True))
        df = df.join(keys, hints, "left")
        content = F.struct(F.col("hint_type").alias("content_type"), F.col("hint_source").alias("content_source"), F.col("hint_id").alias("content_id"))
        return self._found(df, mask, F.col(held), content=content, content_type=F.col("hint_type"))

    def _attach_local_content_by_search(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        """The best local work of the state's type, title and, but for series, year: each distinct search is made once."""
        asked, k = f"_asked{self._masks}", self._masks
        wanted = F.col(mask) & state["title"].isNotNull() & state["content_type"].isNotNull()
        df = df.withColumn(asked, F.when(wanted, F.concat_ws("\x1f", state["content_type"], state["title"], F.when((state["content_type"] != "tv_show") & state["year"].isNotNull(), state["year"].cast("string")).otherwise(""))))
        df = cut(df)  # read twice below, for the searches and for their results
        part = F.split(asked, "\x1f")
        searches = df.select(asked).filter(F.col(asked).isNotNull()).distinct().select(F.col(asked).alias("l_id"), part[0].alias("kind"), part[1].alias("title"), F.expr(f"try_cast(split({asked}, '\x1f')[2] AS int)").alias("year"))
        works = self._local().select(F.concat_ws("\x1f", "content_type", "content_source", "content_id").alias("r_id"), F.col("content_type").alias("kind"), "title", F.col("release_year").alias("year"))
        best = best_matches(searches, works, kind="kind").select(F.col("l_id").alias(asked), F.split("r_id", "\x1f").alias(f"_work{k}"))
        df = df.join(best, asked, "left")
        w = F.col(f"_work{k}")
        return self._found(df, mask, w.isNotNull(), content=F.struct(w[0].alias("content_type"), w[1].alias("content_source"), w[2].alias("content_id")))

    def _remote(self, df: DataFrame, mask: str, state: dict[str, Column], name: str) -> tuple[DataFrame, set[str]]:
        if name not in self.functions:
            return self._set(df, mask, unmatched=F.lit(True))
        found = f"_remote{self._masks}"
        df = df.withColumn(found, self.functions[name](state))
        return self._found(df, mask, F.col(found).isNotNull(), content=F.col(found))

    def _attach_tmdb_content_by_id(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        return self._remote(df, mask, state, "attach_tmdb_content_by_id")

    def _attach_tmdb_content_by_search(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        return self._remote(df, mask, state, "attach_tmdb_content_by_search")

    def _type_fallback(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        if "type_fallback" not in self.functions:
            return df, set()
        df, open_ = self._mask(df, F.col(mask) & state["content_type"].isNull() & state["content"].isNull())
        kind = f"_kind{self._masks}"
        df = df.withColumn(kind, self.functions["type_fallback"](state))
        return self._set(df, open_, content_type=F.col(kind), fallback=F.when(F.col(kind).isin("movie", "tv_show"), F.col(kind)))

    def _enrich_type_fallback(self, df: DataFrame, mask: str, state: dict[str, Column]) -> tuple[DataFrame, set[str]]:
        """Parse and search for rows whose type the fallback gave; a film without a year is not searched. Nothing is unmatched by it."""
        df, going = self._mask(df, F.col(mask) & state["fallback"].isNotNull() & (state["fallback"] == state["content_type"]) & state["content"].isNull())
        df, changed = self._run(df, {"find_match": ["parse_video_content"]}, going, ("enrich_type_fallback",))
        df, searched = self._mask(df, F.col(going) & ((F.col(_state("content_type")) == "tv_show") | F.col(_state("year")).isNotNull()))
        df, more = self._run(df, {"find_match": ["attach_local_content_by_search"]}, searched, ("enrich_type_fallback",)) if self.content is not None else (df, set())
        return df, changed | more


def _state(name: str) -> str:
    return f"_state_{name}"
