"""Regex helpers: one pattern dialect for JVM and Python, and match spans from built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.arrays import bind, scan

# Python's word, digit and space classes for str patterns, spelled for java.util.regex. Spelling them
# out also makes the result independent of the JDK (the meaning of \b changed in JDK 19).
_WORD = r"\p{L}\p{N}_"
_DIGIT = r"\p{Nd}"
_SPACE = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
_CLASSES = {"w": _WORD, "d": _DIGIT, "s": _SPACE}
_AFTER_WORD, _BEFORE_WORD = rf"(?<=[{_WORD}])", rf"(?=[{_WORD}])"
_NOT_AFTER_WORD, _NOT_BEFORE_WORD = rf"(?<![{_WORD}])", rf"(?![{_WORD}])"
_BOUNDARY = f"(?:{_AFTER_WORD}{_NOT_BEFORE_WORD}|{_NOT_AFTER_WORD}{_BEFORE_WORD})"
_NO_BOUNDARY = f"(?:{_AFTER_WORD}{_BEFORE_WORD}|{_NOT_AFTER_WORD}{_NOT_BEFORE_WORD})"
# One element that can only match word characters, at the start and at the end of a pattern piece.
_STARTS_WITH_WORD = re.compile(r"(?:[A-Za-z0-9_]|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+\])(?![*?]|\{0?,)")
_ENDS_WITH_WORD = re.compile(
    r"(?:(?<!\\)[A-Za-z0-9_]|(?<!\\)\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+\])(?:\+|\{[1-9][0-9]*,?[0-9]*\})?$"
)

SPAN_TYPE = "struct<start:int,end:int,value:string>"


def _boundary(before: str, after: str) -> str:
    """Word boundary; a one-sided look suffices where the neighbour is known to be a word character."""
    if _STARTS_WITH_WORD.match(after):
        return _NOT_AFTER_WORD
    if _ENDS_WITH_WORD.search(before):
        return _NOT_BEFORE_WORD
    return _BOUNDARY


def java_pattern(pattern: str, multiline: bool = True) -> str:
    """Spell a Python ``re`` pattern (ignoring case) so that Spark's regex functions agree with it."""
    out: list[str] = []
    in_class = False
    at_class_start = False
    i = 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            i += 2
            if nxt in _CLASSES:
                out.append(_CLASSES[nxt] if in_class else f"[{_CLASSES[nxt]}]")
            elif nxt.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[nxt.lower()]}]")
            elif nxt == "b" and not in_class:
                out.append(_boundary(pattern[: i - 2], pattern[i:]))
            elif nxt == "b":
                out.append(r"\x08")
            elif nxt == "B":
                out.append(_NO_BOUNDARY)
            elif nxt == "Z":
                out.append(r"\z")
            elif nxt == "v":
                out.append(r"\x0B")
            else:
                out.append("\\" + nxt)
            at_class_start = False
            continue
        if in_class:
            if char == "]" and not at_class_start:
                in_class = False
                out.append(char)
            elif char in "[]" or (char == "&" and pattern[i + 1 : i + 2] == "&"):
                out.append("\\" + char)
            else:
                out.append(char)
            at_class_start = at_class_start and char == "^"
        elif char == "[":
            in_class, at_class_start = True, True
            out.append(char)
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif pattern.startswith("(?P=", i):
            stop = pattern.index(")", i)
            out.append(rf"\k<{pattern[i + 4 : stop]}>")
            i = stop + 1
            continue
        else:
            out.append(char)
        i += 1
    # i, u: ignore case over all of Unicode; d: only \n ends a line, as in Python.
    return ("(?imud)" if multiline else "(?iud)") + "".join(out)


def java_keyword(value: str) -> str:
    """A literal, matched ignoring case."""
    return "(?iu)" + re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", value)


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(column: str) -> str:
    return f"coalesce(`{column}`, '')"


def matches_sql(
    text: str, pattern: str, guard: str | None = None, labels: dict[str, str] | None = None, lead: bool = False
) -> str:
    """SQL for the matches of a (non-empty-matching) Java pattern in a text expression, else null.

    Yields ``named_struct('values', matches, 'pieces', what precedes each match, labels...)``. The
    regex runs once: matches are set between marks, and the text is cut at the marks. ``guard`` is a cheaper pattern (or a
    plain string) that every text with a match also matches. With ``lead``, the match is group 2 of the
    pattern, and group 1, in front of it, belongs to the piece before. (Detectors are built as SQL text: a policy has dozens of
    them, and one parse is much faster than hundreds of column calls.)
    """
    return _matches_sql(text, sql_string(pattern), guard, labels, lead)


def matches_of_column_sql(text: str, pattern: str, labels: dict[str, str] | None = None) -> str:
    """The same for a column of patterns."""
    return _matches_sql(text, f"`{pattern}`", None, labels, False)


# A character that no text should hold (Unicode keeps it for use inside programs); texts that do hold it are cut without marks.
_MARK = "\ufdd0"


def _matches_sql(text: str, p: str, guard: str | None, labels: dict[str, str] | None, lead: bool) -> str:
    extra = "".join(f", '{name}', {value}" for name, value in (labels or {}).items())
    marks = f"'{'$1' if lead else ''}{_MARK}{'$2' if lead else '$0'}{_MARK}'"
    parts = f"split(regexp_replace({text}, {p}, {marks}), '{_MARK}', -1)"
    pieces = f"slice(split({text}, {p}, -1), 1, size(v))"
    if lead:
        pieces = f"zip_with({pieces}, regexp_extract_all({text}, {p}, 1), (piece, lead) -> piece || lead)"
    unmarked = f"""flatten(transform(array(regexp_extract_all({text}, {p}, {2 if lead else 0})), v ->
        flatten(zip_with({pieces}, v, (piece, value) -> array(piece, value)))))"""
    found = f"""transform(array(CASE WHEN contains({text}, '{_MARK}') THEN {unmarked} ELSE {parts} END), v -> CASE WHEN size(v) > 1 THEN
        named_struct('values', filter(v, (x, i) -> i % 2 = 1), 'pieces', filter(v, (x, i) -> i % 2 = 0 AND i < size(v) - size(v) % 2){extra}) END)[0]"""
    if guard is None:
        return found
    test = "rlike" if re.search(r"[][\\^$.|?*+(){}]", guard) else "contains"
    return f"CASE WHEN {test}({text}, {sql_string(guard)}) THEN {found} END"


def spans_of(matches: Column) -> Column:
    """Offsets of matches as ``array<SPAN_TYPE>``.

    Spark returns match values but no offsets. The pieces between matches give them: a match starts
    after all earlier pieces and matches.
    """
    pairs = F.zip_with(
        matches["pieces"],
        matches["values"],
        lambda piece, value: F.struct(F.char_length(piece).alias("gap"), value.alias("value")),
    )

    def step(position: Column, pair: Column) -> Column:
        start = position + pair["gap"]
        end = start + F.char_length(pair["value"])
        return F.struct(
            end.alias("state"),
            F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))).alias("emit"),
        )

    return scan(pairs, F.lit(0), step, f"array<{SPAN_TYPE}>")["out"]


def match_spans(text: str, pattern: str, guard: str | None = None) -> Column:
    """All non-overlapping matches in a text column (by name), as ``array<SPAN_TYPE>``."""
    found = F.expr(matches_sql(sql_name(text), pattern, guard))
    return bind(
        found,
        lambda m: F.when(m.isNotNull(), spans_of(m)).otherwise(F.array().cast(f"array<{SPAN_TYPE}>")),
    )
