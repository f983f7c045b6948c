"""Detection of obfuscated values ("alice at example dot com", zero-width characters, leetspeak).

The text is folded to a plain form, scanned, and matches are mapped back to the original span. Spark
has no NFKC function, so folding with offsets runs in one Arrow UDF. A JVM test runs first and keeps
texts that cannot yield a finding out of Python: it folds common characters natively and tries the
patterns on the result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions.arrays import bind
from textguard.functions.regex import java_pattern, match_spans, sql_name, sql_string
from textguard.operators.act import splice
from textguard.patterns import BUILTIN, SECRETS

# The folds that define obfuscation.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
CONFUSABLE = {"\uff20": "@", "\uff0e": ".", "\u3002": ".", "\u0430": "a", "\u0435": "e", "\u043e": "o"}
WORDS = {"at": "@", "dot": "."}
URL_MARKS = (" dot ", "http", "\u200b")
EMAIL_MARKS = (" at ", " dot ", "\u200b")
MAX_STRETCH = 4
MIN_REACH = 256

_WORD_RE = re.compile(r"\b(?:at|dot)\b", re.I)
_SPLIT_SECRET_RE = re.compile(r"\bsk[\s-]+([a-z0-9][a-z0-9\s_-]{8,})", re.I)
_DIGITS_RE = re.compile(r"\d{4}")
_JOINERS_RE = re.compile(r"[\s_-]+")

_UDF_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("category", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("severity", T.StringType()),
            T.StructField("normalized", T.BooleanType()),
            T.StructField("safe_replace", T.BooleanType()),
        ]
    )
)


# -- in the worker: fold with offsets -----------------------------------------------------------


@lru_cache(maxsize=65536)
def fold_char(char: str) -> str:
    plain = unicodedata.normalize("NFKC", char)
    plain = "".join(CONFUSABLE.get(c, c) for c in plain)
    if len(plain) == 1 and plain in ZERO_WIDTH:
        return ""
    return "".join(LEET.get(c, c) for c in plain)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Folded:
    """Folded text plus, for each of its characters, the original half-open span it came from."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray) -> None:
        self.text, self.lo, self.hi = text, lo, hi

    def keep(self, mask: np.ndarray) -> Folded:
        if mask.all():
            return self
        text = _codes(self.text)[mask].tobytes().decode("utf-32-le", "surrogatepass")
        return Folded(text, self.lo[mask], self.hi[mask])

    def replace(self, edits: list[tuple[int, int, str]]) -> Folded:
        """Swap ``[start, end)`` for a string whose characters all stand for the whole piece."""
        if not edits:
            return self
        texts, lows, highs, done = [], [], [], 0
        for start, end, new in edits:
            texts += [self.text[done:start], new]
            lows += [self.lo[done:start], np.full(len(new), self.lo[start])]
            highs += [self.hi[done:start], np.full(len(new), self.hi[end - 1])]
            done = end
        texts.append(self.text[done:])
        return Folded(
            "".join(texts), np.concatenate([*lows, self.lo[done:]]), np.concatenate([*highs, self.hi[done:]])
        )


def fold_characters(text: str) -> Folded:
    codes = _codes(text)
    distinct, place = np.unique(codes, return_inverse=True)
    folded = [fold_char(chr(c)) for c in distinct]
    widths = np.array([len(f) for f in folded], dtype=np.int64)[place]
    index = np.repeat(np.arange(len(codes)), widths)
    if all(len(f) <= 1 for f in folded):
        table = np.array([ord(f) if f else 0 for f in folded], dtype=np.uint32)
        plain = table[place][widths > 0].tobytes().decode("utf-32-le", "surrogatepass")
    else:
        plain = "".join(folded[i] for i in place)
    return Folded(plain, index, index + 1)


def separators_to_drop(text: str) -> np.ndarray:
    """Mask of blanks, hyphens and underscores that only serve to break up an address or a word.

    Looks at the nearest non-space character on each side, found for all positions at once.
    """
    codes = _codes(text)
    n = len(codes)
    drop = np.zeros(n, dtype=bool)
    if n == 0:
        return drop
    distinct, place = np.unique(codes, return_inverse=True)
    chars = [chr(c) for c in distinct]

    def flag(test) -> np.ndarray:
        return np.array([test(c) for c in chars], dtype=bool)[place]

    solid = ~flag(str.isspace)
    position = np.arange(n)
    left = np.full(n, -1)
    left[1:] = np.maximum.accumulate(np.where(solid, position, -1))[:-1]
    right = np.full(n, n)
    right[:-1] = np.minimum.accumulate(np.where(solid, position, n)[::-1])[::-1][1:]
    inside = (left >= 0) & (right < n)
    left, right = np.maximum(left, 0), np.minimum(right, n - 1)
    mark, alnum = flag(lambda c: c in ".@"), flag(str.isalnum)
    bar = flag(lambda c: c in "-_")
    loose = bar | flag(lambda c: c in " \t\n")
    drop = loose & inside & (mark[left] | mark[right])
    return drop | (bar & inside & alnum[left] & alnum[right])


def fold(text: str) -> Folded:
    out = fold_characters(text)
    out = out.replace([(m.start(), m.end(), WORDS[m.group().lower()]) for m in _WORD_RE.finditer(out.text)])
    out = out.keep(~separators_to_drop(out.text))
    return out.replace(
        [(m.start(), m.end(), "sk-" + _JOINERS_RE.sub("", m.group(1))) for m in _SPLIT_SECRET_RE.finditer(out.text)]
    )


def find_obfuscated(text: str) -> list[dict]:
    folded = fold(text)
    if folded.text == text:
        return []
    lower = text.lower()
    url_ok = any(mark in lower for mark in URL_MARKS)
    email_ok = "@" not in text or any(mark in lower for mark in EMAIL_MARKS)
    crowded = folded.text.count("@") > 1
    found: list[dict] = []
    whole: set[tuple[str, str]] = set()
    any_match = False
    plain = folded.text.lower().replace("\u0131", "i")
    few_digits = not _DIGITS_RE.search(plain)
    for pattern in BUILTIN + SECRETS:
        if pattern.needs and not any(n in plain for n in pattern.needs) or few_digits and pattern.name == "phone":
            continue
        for at, to in pattern.spans(folded.text):
            if pattern.skip_suffixes and folded.text.endswith(pattern.skip_suffixes, at, to):
                continue
            any_match = True
            is_email = pattern.category == "private_email"
            if (is_email and not email_ok) or (pattern.category == "private_url" and not url_ok):
                continue
            severity = "critical" if pattern.severity == "critical" else "high"
            piece = slice(at, to)
            start, end = int(folded.lo[piece].min()), int(folded.hi[piece].max())
            reach = max(MIN_REACH, MAX_STRETCH * (to - at))
            if end - start <= reach and not (is_email and crowded):
                found.append(_row(pattern.category, start, end, severity, True, True))
            elif (pattern.category, severity) not in whole:
                # Equal whole-text findings resolve to one; emit one, as each would carry the text.
                whole.add((pattern.category, severity))
                found.append(_row(pattern.category, 0, len(text), severity, True, False))
    if not any_match and any(c in text for c in ZERO_WIDTH):
        found.append(_row("obfuscated_text", 0, len(text), "high", False, False))
    return found


def _row(category: str, start: int, end: int, severity: str, normalized: bool, safe: bool) -> dict:
    return {
        "category": category,
        "start": start,
        "end": end,
        "severity": severity,
        "normalized": normalized,
        "safe_replace": safe,
    }


@F.pandas_udf(_UDF_TYPE)
def obfuscated_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([find_obfuscated(t) if t is not None else None for t in texts], dtype=object)


# -- in the JVM: who needs the UDF --------------------------------------------------------------

_ODD_CHARS = "\r\x0b\f\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"
_ODD_SPACE = r"[\r\x0B\f\x1C-\x1F\x{85}\x{1680}\x{2028}\x{2029}]"
# Long runs of characters that NFKC leaves alone; tested first, as they make up most text.
_PLAIN = r"\x{C0}-\x{131}\x{400}-\x{4FF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"

# Such white space next to a separator is folded in the UDF only.
_ODD_NEIGHBOUR = rf"{_ODD_SPACE}(?:(?<=[.@_-][ \t\n]{{0,64}}.)|(?<=[ \t\n]{{64}}.)|[ \t\n]*+[.@_-])"


@lru_cache(maxsize=1)
def unusual_characters() -> str:
    """Java class of the characters whose compatibility form differs (no-break space and ellipsis,
    which the tests below allow for, aside)."""
    ranges: list[list[int]] = []
    for code in range(0xA1, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or char == "\u2026":
            continue
        if unicodedata.normalize("NFKC", char) != char or char == "\u3002":
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    listed = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    # Left to right, cheapest test first: most characters fail the first range.
    return rf"[\x{{A1}}-\x{{10FFFF}}&&[^{_PLAIN}]&&[{listed}]]"


_ALNUM = r"[\p{L}\p{N}]"
_GAP = r"[\s\x{A0}_-]*+"
_LOOKALIKE = {"o": "0\u043e", "i": "1\u0130\u0131", "e": "3\u0435", "a": "4\u0430", "s": "5\u017f", "t": "7", "k": "\u212a"}


def _letter(char: str) -> str:
    """Class of a letter, its capital and its look-alikes. (Spelled out: ignoring case by flag is
    several times slower.)"""
    return f"[{char}{char.upper()}{_LOOKALIKE.get(char, '')}]" if char.isalpha() else char


def _loosely(*words: str) -> str:
    """Any of the words, with look-alike letters and single hyphens or underscores in between."""
    return "(?:" + "|".join("[_-]?".join(_letter(c) for c in w) for w in words) + ")"


def _alone(word: str) -> str:
    """The word by itself. Looks back after the first letter, so most positions fail at once."""
    first, *rest = (_letter(c) for c in word)
    return f"{first}(?<!{_ALNUM}.)" + "".join(rest) + f"(?!{_ALNUM})"


def may_be_obfuscated(text: str) -> Column:
    """False only if folding and scanning the text would yield nothing.

    Every test is on the raw text and looser than what the folded match needs. Digits other than
    2, 6, 8 and 9 turn into letters, so few folded numbers are possible.
    """
    return F.expr(_may_be_obfuscated_sql(sql_name(text)))


def _may_be_obfuscated_sql(source: str) -> str:
    at = f"(?:@|{_alone('at')})"
    dot = f"(?:[.\u2026]|{_alone('dot')})"
    label = rf"{_ALNUM}++(?:[_-]+{_ALNUM}++)*"
    host = rf"(?:(?:{dot}{_GAP})?{label}{_GAP}{dot}|(?:{dot}{_GAP}){{2,}}|\u2026)"
    digit = r"[2689[\p{Nd}&&[^\x00-\x7F]]]"
    octet = rf"{digit}(?:[_-]?{digit}){{0,2}}"
    hexes = r"[A-Fa-f234689\x{430}\x{435}](?:[_-]?[A-Fa-f234689\x{430}\x{435}]){0,3}"

    def has(value: str) -> str:
        return f"contains({source}, {sql_string(value)})"

    def found(pattern: str) -> str:
        return f"rlike({source}, {sql_string(pattern)})"

    email_ok = f"(NOT {has('@')} OR {found(' [aA][tT] | [dD][oO][tT] ')})"
    # Split keys, three kinds in one pass: a first letter at a word start, then the rest.
    s_, k_, i_, a_, e_, y_, j_ = (_letter(c) for c in "skiaeyj")
    heads = "".join(c[1:-1] for c in (s_, a_, e_))
    key_starts = (
        rf"(?<={s_})[_-]?{k_}[_-]*[\s\x{{A0}}-]",
        f"(?<={a_})[_-]?{k_}[_-]?{i_}[_-]?{a_}",
        f"(?<={e_})[_-]?{y_}[_-]?{j_}",
    )
    odd_space = " OR ".join(has(c) for c in _ODD_CHARS)
    tests = [
        *[has(char) for char in ZERO_WIDTH],
        f"contains(lower({source}), 'http')",
        f"contains(lower({source}), ' dot ')",
        found(f"{at}{_GAP}{host}{_GAP}{_ALNUM}") + " AND " + email_ok,
        found(rf"{dot}{_GAP}{_loosely('corp', 'internal', 'local', 'lan', 'example')}"),
        has("/") + " AND " + found(f"/{_loosely('users', 'home', 'var', 'etc', 'opt', 'srv')}/"),
        f"({has('=')} OR {has(':')}) AND " + found(rf"{_loosely('secret', 'token', 'password')}{_GAP}[=:]"),
        found(rf"[{heads}](?<!{_ALNUM}.)(?:{'|'.join(key_starts)})"),
        has("://"),
        has("-----") + " AND " + found("-----[bB]"),
        has(":") + " AND " + found(f":{hexes}:"),
        found(rf"(?:{octet}{_GAP}{dot}{_GAP}){{3}}{digit}"),
        found(rf"(?:{digit}[\s\x{{A0}}._()+\u2026-]*+){{10}}"),
        found(unusual_characters()),
        f"({odd_space}) AND {found(_ODD_NEIGHBOUR)}",
    ]
    return " OR ".join(f"({t})" for t in tests)


# -- text only: the folded form as a column -----------------------------------------------------


def fold_text(text: Column) -> Column:
    """Fold common look-alikes, drop zero-width characters, read "at" and "dot" as symbols."""
    out = F.translate(text, "".join(CONFUSABLE) + "\u00a0" + ZERO_WIDTH, "".join(CONFUSABLE.values()) + " ")
    out = F.regexp_replace(out, java_pattern(r"\bat\b"), "@")
    out = F.regexp_replace(out, java_pattern(r"\bdot\b"), ".")
    out = F.regexp_replace(out, java_pattern(r"\s*@\s*"), "@")
    return F.regexp_replace(out, java_pattern(r"\s*\.\s*"), ".")


def unleet_text(text: Column) -> Column:
    return F.translate(text, "".join(LEET), "".join(LEET.values()))


def normalize_text(df: DataFrame, text: str = "text", output: str = "normalized") -> DataFrame:
    """Add the full text-level fold: also joins spaced-out characters and split keys."""

    def joined(frame: DataFrame, pattern: str, skip: int, lead: str) -> DataFrame:
        spans = match_spans(output, java_pattern(pattern))
        plain = splice(
            F.col(output),
            spans,
            lambda s: F.concat(
                F.lit(lead), F.regexp_replace(F.substr(s["value"], F.lit(skip + 1)), r"[\s_-]+", "")
            ),
        )
        return frame.withColumn(output, plain)

    spaced = java_pattern(r"\b([A-Za-z0-9])(?:[\s-]+)(?=[A-Za-z0-9]\b)")
    out = df.withColumn(output, F.regexp_replace(fold_text(F.col(text)), spaced, "$1"))
    out = joined(out, r"\bsk[\s-]+[a-z0-9][a-z0-9\s_-]{8,}", 2, "sk-")
    out = joined(out, r"\bAKIA(?:[\s-]+[A-Z0-9]+){3,}", 0, "")
    return out.withColumn(output, unleet_text(F.col(output)))


def _span_findings(spans: Column, source: Column) -> Column:
    from textguard.operators.detect import finding, no_findings

    return F.coalesce(
        F.transform(
            spans,
            lambda s: finding(
                s["category"],
                s["start"],
                s["end"],
                F.substr(source, s["start"] + 1, s["end"] - s["start"]),
                F.lit("normalization"),
                s["severity"],
                normalized=s["normalized"],
                safe_replace=s["safe_replace"],
            ),
        ),
        no_findings(),
    )


def normalized_findings(text: str) -> Column:
    source = F.expr(sql_name(text))
    return _span_findings(obfuscated_spans(F.when(may_be_obfuscated(text), source)), source)


@F.pandas_udf(T.ArrayType(_UDF_TYPE))
def obfuscated_spans_of_each(texts: pd.Series) -> pd.Series:
    """For arrays of texts; null texts and rows need no work."""
    return pd.Series(
        [None if row is None else [None if t is None else find_obfuscated(t) for t in row] for row in texts], dtype=object
    )


def normalized_findings_of_each(texts: str) -> Column:
    """The same for every text of a column of arrays of texts."""
    doubtful = F.expr(f"transform(`{texts}`, t -> CASE WHEN {_may_be_obfuscated_sql('t')} THEN t END)")
    some = bind(doubtful, lambda d: F.when(F.exists(d, lambda t: t.isNotNull()), d))
    spans = F.coalesce(obfuscated_spans_of_each(some), F.transform(texts, lambda t: F.lit(None).cast(_UDF_TYPE)))
    return F.zip_with(spans, texts, _span_findings)
