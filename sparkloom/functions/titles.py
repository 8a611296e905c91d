"""Title normalisation: transliteration, kana, numerals, family keys, dates, and title-and-year parsing of names."""

from __future__ import annotations

import re
import unicodedata
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.fts import transliterate

# The sounds of kana by rows of the syllabary, in its order.
_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
KANA = {k: row + v for row, ks in _ROWS.items() for k, v in zip(ks, "aiueo")} | dict(zip("やゆよわをん", ["ya", "yu", "yo", "wa", "o", "n"])) | {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "ゔ": "vu"}
_SMALL = dict(zip("ゃゅょぁぃぅぇぉ", ["ya", "yu", "yo", "a", "i", "u", "e", "o"]))
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def kana_to_romaji(text: str) -> str:
    """Kana as Hepburn syllables; other characters stay. A small tsu doubles, a long mark repeats the vowel."""
    flat = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヴ" else c for c in unicodedata.normalize("NFKC", text))
    out, double = "", False
    for c in flat:
        if c == "っ":
            double = True
            continue
        if c in _SMALL and out and out[-1] in "aiueo":
            glide = _SMALL[c]
            base = out[:-1]
            out = base + (glide[1:] if glide[0] == "y" and base.endswith(("sh", "ch", "j")) else glide)
            continue
        if c == "ー" and out and out[-1] in "aiueo":
            out += out[-1]
            continue
        s = KANA.get(c, c)
        out += s[0] + s if double and c in KANA else s
        double = False
    return out


def normalize_title(title: str | None) -> str:
    """Lower-case words for matching: '&' as and, kana and accents in Latin, no leading article, numerals as digits."""
    text = kana_to_romaji((title or "").replace("&", " and "))
    text = re.sub(r"['’`]", "", "".join(transliterate(c) if not c.isascii() else c.lower() for c in text))
    words = re.findall(r"[^\W_]+", text)
    if len(words) > 1 and words[0] in ("the", "a", "an"):
        words = words[1:]
    out = []
    for i, w in enumerate(words):
        if w == "part" and i + 1 < len(words) and (words[i + 1] in ROMAN or words[i + 1].isdigit()):
            continue
        out.append(ROMAN.get(w, w) if i else w)
    return " ".join(out)


def family_key(title: str | None) -> str:
    return "".join(c for c in normalize_title(title) if c.isalnum())


# Endings of sites that put their name before a title, and words of releases that hold several films.
SITE_ENDINGS = "com org net to rsvp pics la pl vip red win pro site live online top fun icu cyou ws ru in ph ai gg cx sh st mov fyi lol day wtf autos skin".split()
PACK_WORDS = ["trilogy", "dilogy", "dilogies", "quadrilogy", "anthology", "filmography", "collection", "complete movies", "complete films", "complete collection"]

_SITE = re.compile(rf"^\s*(?:www\.(?:[a-z0-9-]+\.)+[a-z]{{2,10}}\b(?:[\s._]*-+[\s._]*|\s{{2,}})|(?:www\.)?[a-z0-9][a-z0-9-]*\.(?:{'|'.join(SITE_ENDINGS)})\b[\s._]*-+[\s._]*)", re.I)
_TAG = re.compile(r"^\s*\[[^\]]*\]\s*")
_WIDE_TAG = re.compile(r"【[^】]*】")
_YEARS = re.compile(r"\(?((?:18|19|20)\d\d)\s?[-–—]\s?(?:(?:18|19|20)\d\d|present|now|ongoing|\?{1,4})\)?", re.I)
_SEASON = re.compile(r"(?<![^\W_])s\d{1,2}(?:e\d{1,4})?(?![^\W_])|season\s+\d", re.I)
_PACK = re.compile(rf"(?<![^\W_])(?:{'|'.join(w.replace(' ', '[ ._-]+') for w in PACK_WORDS)}|\d+[ -]?movies?)(?![^\W_])", re.I)
_NUMBERED = re.compile(r"^(.*?[^\W_])[\s._-]+ep(\d{2,4})(?:v\d)?(?=[\s._\-\[(]|$)", re.I)
_EAST_ASIAN = re.compile(r"[\u1100-\u11ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def is_pack(name: str | None) -> bool:
    """A name that holds several films: a word for that, and no season or episode."""
    return bool(name) and bool(_PACK.search(name)) and not _SEASON.search(name)


def latin_half(title: str) -> str:
    """The Latin title behind an East Asian one: what follows its last such letter and a number glued to it, if that is two words or
    more, all Latin or numbers, one of them Latin, and no tag. Any other title stays."""
    first = next((c for c in title if c.isalpha()), "")
    last = max((m.end() for m in _EAST_ASIAN.finditer(title)), default=0)
    if not _EAST_ASIAN.match(first or " ") or not last:
        return title
    rest = re.sub(r"^\d+", "", title[last:]).strip()
    words = rest.strip(" -~.,:!&'’").split()
    fine = not rest.startswith("[") and len(words) >= 2 and all(re.fullmatch(r"[A-Za-zÀ-ɏ0-9'’&:!,.-]+", w) for w in words)
    return " ".join(words) if fine and any(re.search(r"[A-Za-zÀ-ɏ]", w) for w in words) else title


def _bare_name(name: str) -> str:
    text = _WIDE_TAG.sub(" ", name)
    for _ in range(3):
        text = _TAG.sub("", _SITE.sub("", text))
    return _YEARS.sub(r"\1", text)


def numbered_title(name: str | None) -> tuple[str, int | None] | None:
    """(title, year) before an absolute episode number like 'EP12'; None without one, or where it stands within a tag."""
    m = _NUMBERED.match(_bare_name(name or ""))
    if not m or m.group(1).count("[") != m.group(1).count("]"):
        return None
    parsed = parse_title_year(m.group(1) + " ")
    return parsed[:2] if parsed else None


def parse_title_year(name: str | None) -> tuple[str, int | None, str] | None:
    """(title, year, rest) of a release name. Up to three site and group tags before the title go, and tags in wide brackets anywhere;
    a range of years keeps its first; a year that leads the name is its year, if no other is; of a bilingual title the Latin half stays."""
    text = _bare_name(name or "")
    m = re.search(r"[\s._(\[{|~;,-]+((?:18|19|20)\d\d)(?![\dp])", text)
    led = re.match(r"\s*\(?((?:18|19|20)\d\d)\)?[\s._-]+(?=[^\W\d_])", text)
    if not m and led:
        text, year = text[led.end() :], int(led.group(1))
    else:
        year = int(m.group(1)) if m else None
    cut = re.search(r"(?i)[\s._(\[{|~;,-]+(?:s\d{1,4}(?:e\d|\W|$)|season\W\d|\d{3,4}[pi]\b|web|blu-?ray|b[dr]rip|dvd|hdtv)", text)
    end = min([x.start() for x in (m, cut) if x] or [len(text)])
    title = re.sub(r"\s+", " ", re.sub(r"[._]+", " ", text[:end])).strip(" -~|;,([{")
    if not title:
        return None
    return latin_half(title), year, text[end:].strip()


def parse_date(text: str | None) -> date | None:
    """The first three parts with equal separators that make a date: year first, then day first, then month first."""
    for m in re.finditer(r"(?<![^\W_])(?=(\w{1,9})([.\-/ ])(\w{1,9})\2(\w{1,4})(?![^\W_]))", text or ""):
        a, b, c = m.group(1), m.group(3), m.group(4)

        def make(y: str, mo: str, d: str) -> date | None:
            mo = str(MONTHS.index(mo[:3].lower()) + 1) if mo[:3].lower() in MONTHS and mo.isalpha() else mo
            if not (y.isdigit() and mo.isdigit() and d.isdigit() and len(y) in (2, 4) and len(d) <= 2 and len(mo) <= 2):
                return None
            try:
                return date(int(y) + (2000 if len(y) == 2 else 0), int(mo), int(d))
            except ValueError:
                return None

        for order in ((a, b, c), (c, b, a), (c, a, b)):
            found = make(*order)
            if found:
                return found
    return None


_JAPANESE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


def native_key(title: str | None) -> str:
    """Letters and digits of a title in Japanese script, widths and kana made uniform; empty for any other title."""
    if not title or not _JAPANESE.search(title):
        return ""
    flat = unicodedata.normalize("NFKC", title).lower()
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in flat if c.isalnum() or c == "ー")


@F.pandas_udf(T.StringType())
def native_form(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: native_key(t) or None)


@F.pandas_udf(T.StringType())
def normalized_title(titles: pd.Series) -> pd.Series:
    return titles.map(normalize_title)


@F.pandas_udf(T.StringType())
def title_family(titles: pd.Series) -> pd.Series:
    return titles.map(family_key)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("rest", T.StringType()), T.StructField("pack", T.BooleanType()), T.StructField("numbered", T.BooleanType())]))
def title_and_year(names: pd.Series) -> pd.DataFrame:
    """Title, year and rest, whether the name holds several films, and whether it is numbered by absolute episodes, whose title it then is."""
    numbered = [numbered_title(n) for n in names]
    parsed = [(*e, None) if e else parse_title_year(n) or (None, None, None) for e, n in zip(numbered, names)]
    return pd.DataFrame({"title": [p[0] for p in parsed], "year": pd.array([p[1] for p in parsed], dtype="Int32"), "rest": [p[2] for p in parsed], "pack": [is_pack(n) for n in names], "numbered": [e is not None for e in numbered]})


@F.pandas_udf(T.DateType())
def date_in(texts: pd.Series) -> pd.Series:
    return texts.map(parse_date)


def fold_title(title: Column) -> Column:
    """Lower-case ASCII words with single spaces, inside the JVM."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))


def slip_limit(title: Column) -> Column:
    """Edits that are allowed for a title: 15 % of its letters, rounded up, at most five."""
    return F.least(F.lit(5), ((F.length(title) * 15 + 99) / 100).cast("int"))


def year_penalty(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap.isNull() | (gap == 0), 0).when(gap == 1, 1).otherwise(100)
