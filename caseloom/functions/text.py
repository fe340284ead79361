"""Text normalisation with source offsets."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values of the matching contract
APOSTROPHES = "’‘ʼ＇"
SPELLINGS = {
    "recognised": "recognized",
    "recognise": "recognize",
    "recognises": "recognizes",
    "recognising": "recognizing",
    "realised": "realized",
    "realise": "realize",
}

_STRAIGHT = {ord(c): "'" for c in APOSTROPHES}
_SPELLING = re.compile(r"\b(?:" + "|".join(sorted(SPELLINGS, key=len, reverse=True)) + r")\b")


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().translate(_STRAIGHT)


def _spelled(text: str) -> str:
    return _SPELLING.sub(lambda m: SPELLINGS[m[0]], text)


def normalize(text: str) -> str:
    """NFKC, case folding, straight apostrophes, single spaces, one spelling."""
    return _spelled(" ".join(_folded(text).split()))


@lru_cache(1)
def _joining() -> np.ndarray:
    """For each code point: 0 NFKC never joins it to what stands before, 1 it may (second half of some composition), 2 it always can (a mark)."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    seconds = {chr(c) for lo, hi in ((0x1161, 0x1175), (0x11A8, 0x11C2)) for c in range(lo, hi + 1)}  # Hangul vowels and finals
    for c in map(chr, range(sys.maxunicode + 1)):
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d:
            seconds.add(chr(int(d.split()[1], 16)))
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        first = unicodedata.normalize("NFKD", c)[0]
        out[ord(c)] = 2 if unicodedata.combining(first) else first in seconds
    return out


def _pieces(text: str) -> np.ndarray:
    """Starts of the shortest pieces that NFKC maps on their own."""
    kind = _joining()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    start = kind == 0
    start[:1] = True
    nfkc = unicodedata.normalize
    for i in np.flatnonzero((kind == 1) & ~start).tolist():  # rare: whether they compose depends on what stands before
        a = i - 1 - int(np.argmax(start[i - 1 :: -1]))
        start[i] = nfkc("NFKC", text[a : i + 1]) == nfkc("NFKC", text[a:i]) + nfkc("NFKC", text[i])
    return np.flatnonzero(start)


def normalized_offsets(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """normalize(text) and, for each of its characters, start and end of the source span it comes from."""
    if text.isascii():
        out, begin = text.lower(), np.arange(len(text))
        end = begin + 1
    else:
        begin = _pieces(text)
        end = np.append(begin[1:], len(text))
        known: dict[str, str] = {}
        parts = [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        parts = [known[p] if p in known else known.setdefault(p, _folded(p)) for p in parts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        out, begin, end = "".join(parts), np.repeat(begin, size), np.repeat(end, size)
    blank = np.fromiter(map(str.isspace, out), bool, len(out))
    if not blank.all():
        inner = np.flatnonzero(~blank)[[0, -1]]
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # a run of white space is its first character
        keep[: inner[0]] = keep[inner[1] + 1 :] = False
        at = np.flatnonzero(keep)
        last = np.append(at[1:], inner[1] + 1) - 1
        out = "".join([" " if b else c for c, b in zip(map(out.__getitem__, at.tolist()), blank[at].tolist(), strict=True)])
        begin, end = begin[at], end[last]
    else:
        out, begin, end = "", begin[:0], end[:0]
    return _spelled(out), begin, end  # spellings have equal lengths


def compatibility_class() -> str:
    """Inside of a regex class: the non-ASCII characters whose normal form holds an ASCII letter."""
    hits = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and re.search("[a-z]", _folded(chr(c)))]
    at = np.array(hits)
    cuts = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True))


@F.pandas_udf(StringType())
def _normalize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(normalize, na_action="ignore")


def normalize_column(c: Column) -> Column:
    """normalize() as a column: JVM functions for ASCII texts, which the Arrow UDF for the others gets as nulls."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    low = F.trim(F.regexp_replace(F.lower(c), r"[\s\x0B\x1c-\x1f]+", " "))
    spelled = low
    for a, b in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{a}\b", b)
    return F.when(ascii_, F.when(low.rlike("recognis|realis"), spelled).otherwise(low)).otherwise(_normalize_udf(F.when(~ascii_, c)))


def typed_id(c: Column, kind: str = "t3") -> Column:
    """Trimmed, lower-cased t1_/t3_ id, the default prefix added; null where it is no id."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.rlike(r"^t[13]_[a-z0-9]+$"), s).when(s.rlike(r"^[a-z0-9]+$"), F.concat(F.lit(f"{kind}_"), s))


def real_author(c: Column) -> Column:
    return F.coalesce((c != "") & ~c.isin("[deleted]", "[removed]", "AutoModerator"), F.lit(False))


def triage_flags(c: Column) -> Column:
    """Sampling strata; they never decide a label."""
    # fixed values of the sampling contract
    doubt = ("if ", "might ", "would ", "hope ", "afraid", "worried", "in case", "don't want", "didn't", "did not")
    shared = ("showed ", "told ", "gave ")
    low = F.lower(c)

    def any_of(words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    quoted = F.contains(c, F.lit(">")) | F.contains(c, F.lit('"'))
    return F.array_compact(F.array(
        F.when(any_of(doubt), "negation_or_hypothetical_language"),
        F.when(quoted, "possible_quotation"),
        F.when(any_of(shared), "possible_voluntary_sharing"),
    ))


def text_parts(c: Column, size: int = 14000) -> Column:
    """Code-point slices of fixed size; one empty part for an empty text."""
    n = F.greatest(F.ceil(F.length(c) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def utf16_units(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def sheet_literal(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def sheet_cell(c: Column) -> Column:
    """sheet_literal(), and numbers and ISO times kept as text as well."""
    number, time = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(c.rlike(r"^\s*[=+\-@]") | c.rlike(number) | c.rlike(time), F.concat(F.lit("'"), c)).otherwise(c)


def utc_date(seconds: Column) -> Column:
    """Day of epoch seconds in UTC, null where unknown."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def account_age(at: Column, created: Column) -> Column:
    """Seconds since the account was made; null before that or where either is unknown."""
    return F.when(at >= created, at - created)


def month_number(month: Column) -> Column:
    """'YYYY-MM' as an integer that sorts like it."""
    return F.replace(month, F.lit("-"), F.lit("")).cast("int")
