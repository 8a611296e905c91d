"""Byte-level tables for wrong decodings: which encodings are confused, and total decoders for them."""

from __future__ import annotations

import codecs
import unicodedata
from functools import lru_cache

# Encodings that text was written in, and the single-byte or double-byte ones it was then read with.
UTF8_READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "mac-cyrillic", "gbk", "shift_jis", "big5", "euc-kr"]
DOUBLE_BYTE = ["shift_jis", "cp932", "euc-jp", "gbk", "euc-kr", "big5"]
DOUBLE_BYTE_READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "gbk", "shift_jis", "big5", "euc-kr"]
SINGLE_BYTE = ["cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "iso8859-5", "iso8859-2", "iso8859-7", "iso8859-9"]
SINGLE_BYTE_READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "gbk", "shift_jis", "big5", "euc-kr"]
LOSSY_SOURCES = ["cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp850", "cp866", "koi8-r", "shift_jis", "euc-jp", "gbk", "euc-kr", "big5"]

MULTIBYTE = {"gbk", "shift_jis", "big5", "euc-kr", "utf-8"}


def _chains() -> list[tuple[str, ...]]:
    """Every chain as (source, reader) or (source, reader, source, reader).

    'utf-8?' reads with U+FFFD for bad bytes; 'cp1252-' drops bytes without a character, 'cp1252--' also invisible ones.
    """
    out: list[tuple[str, ...]] = [("utf-8", r) for r in UTF8_READ_AS]
    out += [(s, r) for s in DOUBLE_BYTE for r in DOUBLE_BYTE_READ_AS if s != r]
    out += [(s, r) for s in SINGLE_BYTE for r in SINGLE_BYTE_READ_AS if s != r]
    out += [("utf-8", r, "utf-8", r) for r in ("latin-1", "cp1252")]
    out += [(s, "utf-8?") for s in LOSSY_SOURCES]
    out += [(s, "cp1252-") for s in ("utf-8", "cp850", "cp437", "shift_jis", "euc-jp", "gbk", "big5", "euc-kr")]
    out += [("utf-8", "cp1252--")]
    out += [("utf-8", "cp1252-", "utf-8", "cp1252-"), ("utf-8", "cp1252", "utf-8", "cp1252-")]
    return out


CHAINS = _chains()
#: No character has a longer garbled form: at most 4 code points once decomposed, of 4 bytes, each read as one character that is
#: 3 bytes when it is written and read once more.
LONGEST_CHARACTER_FORM = 4 * 4 * 3
UTF8_CHAINS = {i for i, c in enumerate(CHAINS) if c[0] == "utf-8"}


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> str:
    """Characters of all 256 bytes of a single-byte encoding; bytes without a character become the C1 control."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def read_bytes(raw: bytes, encoding: str) -> str | None:
    """Decode as a careless reader would; None where the encoding refuses the bytes."""
    if encoding == "utf-8?":
        return raw.decode("utf-8", "replace")
    if encoding in MULTIBYTE:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            return None
    if encoding == "cp1252-":
        return raw.decode("cp1252", "ignore")
    if encoding == "cp1252--":
        return raw.decode("cp1252", "ignore").replace("\xa0", "").replace("\xad", "")
    return codecs.charmap_decode(raw, "strict", byte_table(encoding))[0]


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """``text`` as it looks after the chain of wrong decodings, or None where it can't pass through."""
    for i in range(0, len(chain), 2):
        try:
            raw = text.encode(chain[i])
        except UnicodeEncodeError:
            return None
        out = read_bytes(raw, chain[i + 1])
        if out is None:
            return None
        text = out
    return text


@lru_cache(maxsize=1)
def _by_source() -> list[tuple[str, list[tuple[int, tuple[str, ...]]]]]:
    out: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
    for i, c in enumerate(CHAINS):
        out.setdefault(c[0], []).append((i, c))
    return list(out.items())


def garbled_forms(word: str, every_chain: bool = False) -> list[tuple[str, int]]:
    """All distinct garbled forms of a word, each with the first chain (or every chain) that makes it; both of its normal forms are tried."""
    out: dict[tuple[str, int], int] = {}
    for variant in dict.fromkeys((word, unicodedata.normalize("NFC", word), unicodedata.normalize("NFD", word))):
        for source, chains in _by_source():
            try:
                raw = variant.encode(source)
            except UnicodeEncodeError:
                continue
            for i, c in chains:
                form = read_bytes(raw, c[1]) if len(c) == 2 else garble(variant, c)
                if form and form != variant and form != word and not form.isascii():
                    at = (form, i if every_chain else -1)
                    if out.get(at, i) >= i:
                        out[at] = i
    return [(form, chain) for (form, _), chain in out.items()]


_ODD = {"Cc", "Cn", "Co", "So", "Sm", "Sc", "Sk", "No", "Po", "Pi", "Pf", "Ps", "Pe", "Pd", "Zs", "Zl", "Zp"}


@lru_cache(maxsize=200_000)
def char_class(ch: str) -> str:
    """Script of a letter ('LATIN', 'CYRILLIC', 'GREEK', 'HAN', 'HANGUL', ...), 'MARK', 'DIGIT', 'HIDE' (disguise),
    'WIDE' (East Asian punctuation) or 'ODD'."""
    c, cat = ord(ch), unicodedata.category(ch)
    if c < 128:
        return "LATIN" if ch.isalpha() else "DIGIT"
    if 0xFF00 <= c <= 0xFFEF and cat[0] != "L" or 0x3001 <= c <= 0x303F:
        return "WIDE"
    if cat == "Cf" or c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000):
        return "HIDE"
    if cat in ("Mn", "Mc"):
        return "MARK"
    if cat in _ODD or ch in "ªº" or cat == "Lm" and not 0x3000 <= c <= 0x30FF and not 0xFF00 <= c <= 0xFFEF:
        return "ODD"
    name = unicodedata.name(ch, "").split(" ")[0].split("-")[0]
    return {"CJK": "HAN", "HIRAGANA": "HAN", "KATAKANA": "HAN", "KATAKANA-HIRAGANA": "HAN", "FULLWIDTH": "LATIN", "HALFWIDTH": "HAN", "IDEOGRAPHIC": "HAN", "": "ODD"}.get(name, name)
