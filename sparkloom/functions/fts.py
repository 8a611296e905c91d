"""Full-text search: tokenizer, query language, weighted postings, matching and cover-density rank."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
# Cyrillic and Greek letters in Latin, in alphabetical order.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяєіїґ", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e iu ia ie i i g".split(" ")))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(" ")))
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
#: Beyond this character scripts don't space their words, and each character is a token.
UNSPACED = 0x1FFF


def transliterate(ch: str) -> str:
    """Latin letters of a lower-case letter: Latin, Cyrillic and Greek are covered; other scripts keep their letters."""
    low = ch.lower()
    for t in (CYRILLIC, GREEK, LATIN):
        if low in t:
            return t[low]
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def tokenize(text: str) -> list[list[str]]:
    """Phrases of lexemes: a phrase ends at a non-word character; letters of unspaced scripts are lexemes of their own."""
    phrases, phrase, word = [], [], ""
    for ch in text + " ":
        if ch.isalnum() or ch == "_":
            if ord(ch) < 128:
                word += ch.lower()
            elif ord(ch) > UNSPACED and unicodedata.category(ch) in ("Lo", "Lm"):
                if word:
                    phrase.append(word)
                    word = ""
                phrase.append(transliterate(ch) or ch)
            else:
                word += transliterate(ch)
        elif unicodedata.combining(ch) and word:
            continue
        else:
            if word:
                phrase.append(word)
                word = ""
            if phrase:
                phrases.append(phrase)
                phrase = []
    return phrases


def tokenize_flat(text: str) -> list[str]:
    return [w for p in tokenize(text) for w in p]


@dataclass(frozen=True)
class Node:
    """'lexeme' (value, prefix), 'and' | 'or' | 'then' (left, right), 'not' (left)."""

    op: str
    value: str = ""
    prefix: bool = False
    left: Node | None = None
    right: Node | None = None

    def __str__(self) -> str:
        if self.op == "lexeme":
            quoted = self.value if self.value.replace("_", "a").isalnum() and self.value.isascii() else "'" + self.value.replace("'", "''") + "'"
            return quoted + (":*" if self.prefix else "")
        if self.op == "not":
            return "! " + str(self.left)
        sign = {"and": " & ", "or": " | ", "then": " <-> "}[self.op]
        wrap = lambda n: f"({n})" if n.op == "or" and self.op != "or" else str(n)
        return wrap(self.left) + sign + wrap(self.right)


def parse_query(text: str) -> Node | None:
    """The application's query language: words are AND-ed, '|' is or, '.' is followed-by, '!' negates, '*' is a prefix,
    quotes make phrases, parentheses group; unmatched quotes and parentheses close at the end. Tighter: not, then, and, or."""
    tokens: list[tuple[str, str]] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c in "()&|.!*":
            tokens.append((c, c))
            i += 1
        elif c == '"':
            end = text.find('"', i + 1)
            end = len(text) if end < 0 else end
            tokens.append(("words", text[i + 1 : end]))
            i = end + 1
        elif c.isalnum() or c == "_":
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] == "_" or unicodedata.combining(text[j])):
                j += 1
            tokens.append(("words", text[i:j]))
            i = j
        else:
            i += 1

    def chain(words: list[str], prefix: bool) -> Node | None:
        out: Node | None = None
        for k, w in enumerate(words):
            leaf = Node("lexeme", w, prefix and k == len(words) - 1)
            out = leaf if out is None else Node("then", left=out, right=leaf)
        return out

    def expression(at: int) -> tuple[Node | None, int]:
        parts: list[tuple[str, Node]] = []
        op, negated = "and", False
        while at < len(tokens):
            kind, value = tokens[at]
            node = None
            if kind == ")":
                at += 1
                break
            if kind in "&|.":
                op = {"&": "and", "|": "or", ".": "then"}[kind]
            elif kind == "!":
                negated = True
            elif kind == "(":
                node, at = expression(at + 1)
                at -= 1
            elif kind == "words":
                node = chain(tokenize_flat(value), at + 1 < len(tokens) and tokens[at + 1][0] == "*")
            if node is not None:
                parts.append((op, Node("not", left=node) if negated else node))
                op, negated = "and", False
            at += 1
        for level in ("then", "and", "or"):
            joined: list[tuple[str, Node]] = []
            for o, n in parts:
                if joined and o == level:
                    joined[-1] = (joined[-1][0], Node(level, left=joined[-1][1], right=n))
                else:
                    joined.append((o, n))
            parts = joined
        return (parts[0][1] if parts else None), at

    out, at = None, 0
    while at < len(tokens):
        node, at = expression(at)
        if node is not None:
            out = node if out is None else Node("and", left=out, right=node)
    return out


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "chunk": b["chunk"], "weight": b["weight"], "lexemes": [tokenize_flat(t) if t else [] for t in b["text"]]})


def ascii_lexemes(text: Column) -> Column:
    """Lexemes of text whose letters are ASCII, without leaving the JVM."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != "")


def postings(chunks: DataFrame) -> DataFrame:
    """(id, lexeme, pos, weight) of rows (id, chunk, weight, text): chunks of an id follow each other with a gap of one position.

    Texts of ASCII only are split in the JVM, the others in Arrow batches.
    """
    plain = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x00-\x7f]*$")
    simple = chunks.filter(plain).select("id", "chunk", "weight", ascii_lexemes(F.coalesce("text", F.lit(""))).alias("lexemes"))
    rest = chunks.filter(~plain).mapInPandas(_tokens, f"id {chunks.schema['id'].dataType.simpleString()}, chunk int, weight string, lexemes array<string>")
    every = simple.unionByName(rest).filter(F.size("lexemes") > 0)
    before = F.coalesce(F.sum(F.size("lexemes") + 1).over(Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.withColumn("before", before).select("id", F.posexplode("lexemes").alias("p", "lexeme"), "before", "weight").select("id", "lexeme", (F.col("before") + F.col("p") + 1).cast("int").alias("pos"), "weight")


def _leaves(node: Node) -> list[Node]:
    return [node] if node.op == "lexeme" else _leaves(node.left) + (_leaves(node.right) if node.right else [])


def _first_len(node: Node) -> int:
    return 1 if node.op == "lexeme" else max(_first_len(node.left), _first_len(node.right) if node.right else 0) if node.op != "then" else _first_len(node.left) + _first_len(node.right)


def match(posts: DataFrame, query: Node) -> DataFrame:
    """(id, hits) of the documents that fit: ``hits`` holds the positions and weights of the query's lexemes.

    Only postings of the query's lexemes are read; a document's positions per lexeme are gathered once, and the query's tree
    is one boolean Column over them. A query of negations only matches documents that hold any lexeme at all.
    """
    leaves = list(dict.fromkeys(_leaves(query)))
    test = {leaf: (F.col("lexeme").startswith(leaf.value) if leaf.prefix else F.col("lexeme") == leaf.value) for leaf in leaves}
    wanted = None
    for t in test.values():
        wanted = t if wanted is None else wanted | t
    pure = _needs_all(query)
    source = posts if pure else posts.filter(wanted)
    aggs = [F.array_sort(F.collect_set(F.when(test[leaf], F.col("pos")))).alias(f"_l{i}") for i, leaf in enumerate(leaves)]
    aggs.append(F.array_sort(F.collect_set(F.when(wanted, F.struct("pos", "weight")))).alias("hits"))
    per = source.groupBy("id").agg(*aggs)
    at = {leaf: F.col(f"_l{i}") for i, leaf in enumerate(leaves)}

    def ends(node: Node) -> Column:
        """Positions at which a match of a node ends."""
        if node.op == "lexeme":
            return at[node]
        if node.op == "then":
            step = _first_len(node.right)
            return F.array_intersect(F.transform(ends(node.left), lambda x: x + step), ends(node.right))
        if node.op == "or":
            return F.array_union(ends(node.left), ends(node.right))
        if node.op == "and":
            return F.when((F.size(ends(node.left)) > 0) & (F.size(ends(node.right)) > 0), F.array_union(ends(node.left), ends(node.right))).otherwise(F.array().cast("array<int>"))
        return F.array().cast("array<int>")

    def true(node: Node) -> Column:
        if node.op == "not":
            return ~true(node.left)
        if node.op == "and":
            return true(node.left) & true(node.right)
        if node.op == "or":
            return true(node.left) | true(node.right)
        return F.size(ends(node)) > 0

    return per.filter(true(query)).select("id", "hits")


def _needs_all(node: Node) -> bool:
    """Can a document without any of the lexemes fit?"""
    if node.op == "not":
        return True
    if node.op == "or":
        return _needs_all(node.left) or _needs_all(node.right)
    if node.op == "and":
        return _needs_all(node.left) and _needs_all(node.right)
    return False


def cover_density(matches: DataFrame) -> DataFrame:
    """(id, rank): every gap between neighbouring hits adds the harmonic mean of their weights over the gap's length; a single hit its weight."""
    w = lambda x: F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv])[x]
    pairs = F.zip_with(F.slice("hits", 1, F.size("hits") - 1), F.slice("hits", 2, F.size("hits") - 1), lambda a, b: F.lit(2.0) / (1 / w(a["weight"]) + 1 / w(b["weight"])) / F.greatest(F.lit(1), b["pos"] - a["pos"]))
    rank = F.when(F.size("hits") > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).when(F.size("hits") == 1, w(F.get("hits", F.lit(0))["weight"])).otherwise(0.0)
    return matches.select("id", F.round(rank, 6).alias("rank"))


def print_vectors(posts: DataFrame) -> DataFrame:
    """(id, vector): the postings of each id as text: quoted lexemes in order, each with its positions and weights (D is left out)."""
    place = F.concat(F.col("pos").cast("string"), F.when(F.col("weight") == "D", "").otherwise(F.col("weight")))
    per = posts.groupBy("id", "lexeme").agg(F.array_sort(F.collect_set(F.struct("pos", place.alias("p")))).alias("ps"))
    quoted = F.concat(F.lit("'"), F.replace(F.replace("lexeme", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("':"))
    words = per.select("id", F.struct("lexeme", F.concat(quoted, F.array_join(F.transform("ps", lambda x: x["p"]), ",")).alias("w")).alias("x"))
    return words.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), " ").alias("vector"))


def parse_vectors(vectors: DataFrame) -> DataFrame:
    """(id, lexeme, pos, weight) of printed vectors; the inverse of ``print_vectors``. Lexemes without quotes are read as well."""
    entry = r"(?:'((?:[^']|'')*)'|([^\s':]+)):((?:\d+[A-D]?,?)+)"
    all_of = lambda group: F.regexp_extract_all("vector", F.lit(entry), F.lit(group))
    parts = F.arrays_zip(all_of(1).alias("q"), all_of(2).alias("b"), all_of(3).alias("p"))
    rows = vectors.select("id", F.explode(parts).alias("x")).select("id", F.when(F.col("x.q") != "", F.replace(F.replace("x.q", F.lit("''"), F.lit("'")), F.lit("\\\\"), F.lit("\\"))).otherwise(F.col("x.b")).alias("lexeme"), F.explode(F.filter(F.split("x.p", ","), lambda p: p != "")).alias("p"))
    return rows.select("id", "lexeme", F.regexp_extract("p", r"\d+", 0).cast("int").alias("pos"), F.coalesce(F.nullif(F.regexp_extract("p", "[A-D]", 0), F.lit("")), F.lit("D")).alias("weight"))


def torrent_chunks(torrents: DataFrame, content: DataFrame | None = None, key: str = "info_hash") -> DataFrame:
    """(id, chunk, weight, text) of torrents (key, name, video: array<string>, files: string): hash and name weigh A, their video
    attributes C, their file strings D; ``content`` (key, title, original_title, year, collections, attributes) adds the work's texts."""
    own = [("A", F.col(key)), ("A", F.col("name")), ("C", F.array_join("video", " ")), ("D", F.col("files"))]
    works = [("A", F.col("title")), ("A", F.col("original_title")), ("B", F.col("year").cast("string")), ("D", F.array_join("collections", " ")), ("D", F.array_join("attributes", " "))]
    rows = torrents if content is None else torrents.join(content, key, "left")
    chunks = F.array(*[F.struct(F.lit(i).alias("chunk"), F.lit(w).alias("weight"), t.alias("text")) for i, (w, t) in enumerate((works if content is not None else []) + own)])
    return rows.select(F.col(key).alias("id"), F.explode(F.filter(chunks, lambda c: c["text"].isNotNull())).alias("c")).select("id", "c.*")
