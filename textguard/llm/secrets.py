"""Secret scan by guess cost.

Patterns find assignments, access keys and hex runs. Values in a credential context (``key: value``,
bearer headers, connection strings) are judged by how many guesses an attacker needs:
dynamic programming finds the cheapest way to cut the value into dictionary words, dates, repeats,
keyboard walks and brute-force spans, and values above a cost count as secrets. The dictionary is a public
tokenizer's vocabulary, where a word's rank is its number of guesses.

Defined results: null and empty texts have no spans. Equal rows get equal results. Extra columns are
ignored by :func:`find`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log10

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.regex import match_spans
from textguard.llm.common import query, table
from textguard.llm.spans import SPAN, Kind, all_spans, counted, listed

MIN_COST = 10.0
MIN_VALUE = 8
LONGEST_WORD = 16
_BRUTE = 1.0  # log10 guesses per brute-force character
_PART = 0.5  # what each further part adds: the attacker must also guess where parts meet

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ASSIGN = Kind(
    "assign",
    "(?i)" + _ASSIGN,
    r"(?i)(?:pass|secret|token|api_?key)",
    lambda v: F.char_length(F.regexp_extract(v, "(?i)" + _ASSIGN, 2)) >= 8,
)
ACCESS = Kind("access", "AKIA[A-Z0-9]++", "AKIA", lambda v: F.char_length(v) >= 16)
HEX = Kind("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", "[0-9a-f]{32}", lambda v: F.lit(True))
KINDS = (ASSIGN, ACCESS, HEX)
GUESS = "guess_cost"

# Names that announce a credential, wider than the base patterns.
_NAMES = "password|passwd|passphrase|passcode|pass|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credential|auth|authorization"
# Any letters may stand before a name (dbPassword). A quoted value goes up to the closing quote on its line, any other to
# white space or a quote, without delimiters at its end; in a connection string up to the last @ before the path.
_AUTH = r"(?:bearer\x20|basic\x20)?"
_NAMED = rf"""(?:{_NAMES})["']?\x20*+(?>=>|:=|[:=])\x20*+{_AUTH}"""
_LOGIN = r"://[^\s:/@]*+:"
_QUOTED = "|".join(rf"{q}{_AUTH}(?:(?!(?<!\\){q})[^\r\n])++(?={q})" for q in "\"'")
_BARE = r"""[^\s"']++"""
_CONTEXT = rf"""(?i)(?:{_NAMED}(?:{_QUOTED}|["']?{_AUTH}{_BARE})|{_LOGIN}(?:[^\s"'/?#]+(?=@)|[^\s"'<>,;@]++))"""
_CONTEXT_GUARD = r"(?i)(?:pass|pwd|secret|token|key|credential|auth|://)"
_BEFORE = rf"""^(?i)(?:{_NAMED}["']?{_AUTH}|{_LOGIN})"""
_TRAILING = "[,;@<>]+$"

# Rows of common keyboards.
KEYBOARD_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("013457@$!", "oieastasi")


def read_dictionary(path: str | None = None) -> dict[str, float]:
    """Word to log10 of its rank, from a byte-level rank file; default: the public 50k one."""
    import base64

    import public_tokenizers

    words: dict[str, float] = {}
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        for line in lines:
            raw, rank = line.split()
            word = base64.b64decode(raw).decode("utf-8", "replace").strip().lower()
            if 3 <= len(word) <= LONGEST_WORD and word.isalpha():
                words.setdefault(word, log10(int(rank) + 1))
    return words


def _walks() -> set[str]:
    """Pairs of neighbouring keys, both ways, and of following letters or digits."""
    rows = [*KEYBOARD_ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789"]
    return {r[i : i + 2] for row in rows for r in (row, row[::-1]) for i in range(len(row) - 1)}


_WALK_PAIRS = _walks()


def guess_cost(value: str, dictionary: dict[str, float]) -> float:
    """log10 of the guesses for the cheapest segmentation; time grows with length times the longest word."""
    n = len(value)
    low = value.lower()
    plain = low.translate(_LEET)
    dates: dict[int, list[int]] = {}
    for at in range(n):
        if value[at].isdigit():
            found = _DATE.match(value, at)
            if found:
                dates.setdefault(found.end(), []).append(at)
    best = [0.0] + [0.0] * n
    run = walk = period = 1  # how far back a repeat, a keyboard walk, a repeated block reaches from here
    blocks = [0, 0, 0, 0, 0]
    for end in range(1, n + 1):
        i = end - 1
        cost = best[i] + _BRUTE
        run = run + 1 if i and value[i] == value[i - 1] else 1
        walk = walk + 1 if i and low[i - 1 : end] in _WALK_PAIRS else 1
        if run >= 3:
            cost = min(cost, best[end - run] + _PART + 1.0 + log10(run))
        if walk >= 3:
            cost = min(cost, best[end - walk] + _PART + 1.5 + log10(walk))
        for period in (2, 3, 4):
            blocks[period] = blocks[period] + 1 if i >= period and value[i] == value[i - period] else 0
            if blocks[period] >= period:
                length = blocks[period] + period
                cost = min(cost, best[end - length] + _PART + period * _BRUTE + log10(length / period))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + _PART + 4.0)
        for size in range(3, min(LONGEST_WORD, end) + 1):
            word, spelled = low[end - size : end], plain[end - size : end]
            rank = dictionary.get(word)
            if rank is None:
                rank = dictionary.get(spelled)
                rank = None if rank is None else rank + 0.5
            if rank is not None:
                upper = 0.3 if any(c.isupper() for c in value[end - size : end]) else 0.0
                cost = min(cost, best[end - size] + _PART + rank + upper)
        best[end] = cost
    return best[n]


_dictionaries: dict[str | None, dict[str, float]] = {}


def costs(values: Column, dictionary: str | None = None) -> Column:
    """Guess cost of each value of an array column; only the values go to Python, not the text."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if dictionary not in _dictionaries:
            _dictionaries[dictionary] = read_dictionary(dictionary)
        words = _dictionaries[dictionary]
        for batch in batches:
            yield pd.Series([None if v is None else [guess_cost(x, words) for x in v] for v in batch], dtype=object)

    return run(values)


def _context_value(span: Column) -> Column:
    """The value of a match of ``_CONTEXT``: what follows the name, the sign and the opening quote."""
    after = F.regexp_replace(span["value"], _BEFORE, "")
    quoted = F.regexp_extract(span["value"], _BEFORE, 0).rlike(rf"""["']{_AUTH}$""")
    value = F.when(quoted, after).otherwise(F.regexp_replace(after, _TRAILING, ""))
    start = span["end"] - F.char_length(after)
    return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"))


def find(docs: DataFrame, min_cost: float = MIN_COST, dictionary: str | None = None) -> DataFrame:
    """``doc_id, base, spans`` of every row of ``docs (doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    context = F.transform(match_spans("text", _CONTEXT, _CONTEXT_GUARD), _context_value)
    context = F.filter(context, lambda s: F.char_length(s["value"]) >= MIN_VALUE)
    found = docs.select("doc_id", all_spans("text", KINDS).alias("base"), context.alias("context"))
    values = F.when(F.size("context") > 0, F.transform("context", lambda s: s["value"]))
    costly = found.withColumn("cost", costs(values, dictionary))
    extra = F.filter(F.arrays_zip("context", "cost"), lambda x: x["cost"] >= min_cost)
    spans = F.transform(
        extra,
        lambda x: F.struct(
            x["context"]["start"].alias("start"),
            F.lit(len(KINDS)).alias("rank"),
            x["context"]["end"].alias("end"),
            F.lit(GUESS).alias("kind"),
            x["context"]["value"].alias("value"),
        ),
    ).cast(SPAN)
    every = F.array_sort(F.concat("base", F.coalesce(spans, F.array().cast(SPAN))))
    return costly.select("doc_id", "base", every.alias("spans"))


@query("op7_secret_guess_cost")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    spans = find(table(spark, folder, "documents", "doc_id", "text"))
    counts = [counted(F.col("base"), kind.name).alias(f"n_{kind.name}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
