"""What the built-in detectors look for.

Each entry carries the pattern in Python syntax (``functions.regex.java_pattern`` spells it for the
JVM) and a ``guard``: a cheap JVM regex (or plain string) that is true for every text with a match, so
most rows never reach the full pattern. ``needs`` serves the same purpose for folded text in Python:
one of these strings is in the lower-cased text of every match. ``anchored`` spells a pattern whose plain form
reads a run of characters again from each place in it; it has the same matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Anchored:
    """A pattern whose matches are looked for once per run of characters, so that any text is read in linear time.

    ``start`` is a look-behind that holds only where a run begins. ``lead`` takes, for good, what stands
    in front of the first place in the run where a match may start; a match is ``value`` from there. If that place has no match, no later one
    in the run has. ``again``: a match may also start inside a run, right where the match before it ended.
    """

    start: str
    lead: str
    value: str
    again: bool = False

    @property
    def pattern(self) -> str:
        """For the JVM (``\\G`` is the end of the last match); group 1 is the lead, group 2 the match."""
        start = rf"(?:{self.start}|\G)" if self.again else self.start
        return f"{start}({self.lead})({self.value})"

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """The same matches in Python, which has no ``\\G``."""
        search, go_on = _compiled(self)
        at = 0
        while found := (self.again and at and go_on.match(text, at)) or search.search(text, at):
            yield found.span(2)
            at = found.end()


@lru_cache(maxsize=64)
def _compiled(anchored: Anchored) -> tuple[re.Pattern, re.Pattern]:
    rest = f"({anchored.lead})({anchored.value})"
    return re.compile(anchored.start + rest, re.I | re.M), re.compile(rest, re.I | re.M)


@dataclass(frozen=True)
class Pattern:
    name: str
    category: str
    severity: str
    pattern: str
    guard: str
    detector: str = "regex"
    skip_suffixes: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    anchored: Anchored | None = None

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Matches in Python."""
        if self.anchored:
            return self.anchored.spans(text)
        return (m.span() for m in _plain(self.pattern).finditer(text))


@lru_cache(maxsize=64)
def _plain(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I | re.M)


def _run(chars: str, head: str, rest: str, again: bool = False) -> Anchored:
    r"""``\b{head}{rest}`` where ``head`` and what follows it are in one run of ``chars``."""
    return Anchored(f"(?<![{chars}])", rf"(?:(?!\b{head})[{chars}])*+", rf"\b{head}{rest}", again)


def _labels(chars: str, last: str) -> Anchored:
    r"""``\b(?:[chars]+\.)+last\b``. The run is one of labels with single dots between. In it,
    runs of labels are taken up to the next label that may be the last one, as often as there is one."""
    step = rf"[{chars}]++\."
    lead = rf"(?:(?!\b[{chars}])(?:[{chars}]|(?<=[{chars}])\.(?=[{chars}])))*+"
    return Anchored(
        rf"(?<![{chars}])(?<![{chars}]\.)", lead, rf"\b(?:(?:{step}(?!{last}\b))*+{step}(?={last}\b))++{last}\b"
    )


# Results depend on these exact patterns, categories and severities.
BUILTIN = (
    Pattern("email", "private_email", "high", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"@", needs=("@",),
            anchored=_run("A-Z0-9._%+-", "", r"[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}\b", again=True)),
    Pattern(
        "phone",
        "private_phone",
        "medium",
        r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)",
        r"\p{Nd}{4}",
    ),
    Pattern(
        "ipv4",
        "ip_address",
        "medium",
        r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
        r"\p{Nd}\.\p{Nd}",
        needs=(".",),
    ),
    Pattern("ipv6", "ip_address", "medium", r"\b(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4}\b", r":[A-Fa-f0-9]{1,4}:", needs=(":",)),
    Pattern("url", "private_url", "medium", r"\bhttps?://[^\s<>'\"]+", r"(?iu)https?://", needs=("://",)),
    Pattern(
        "internal_domain",
        "internal_domain",
        "medium",
        r"\b(?:[a-z0-9-]+\.)+(?:corp|internal|local|lan|example)\b",
        r"(?iu)\.(?:corp|internal|local|lan|example)",
        needs=(".",),
        anchored=_labels("a-z0-9-", "(?:corp|internal|local|lan|example)"),
    ),
    Pattern(
        "file_path",
        "file_path",
        "medium",
        r"(?:/Users|/home|/var|/etc|/opt|/srv)/[^\s'\"]+",
        r"(?iu)/(?:users|home|var|etc|opt|srv)/",
        needs=("/",),
    ),
    Pattern(
        "bare_domain",
        "private_url",
        "low",
        r"\b([a-z0-9-]+\.)+[a-z]{2,}\b",
        r"(?iu)\.[a-z]",
        skip_suffixes=(".md", ".py", ".txt", ".yaml"),
        needs=(".",),
        anchored=_labels("a-z0-9-", "[a-z]{2,}+"),
    ),
)

SECRETS = (
    Pattern("sk_key", "api_key", "critical", r"\bsk-[A-Za-z0-9_-]{8,}", r"(?iu)sk-", "secrets", needs=("sk-",)),
    Pattern("aws_key", "api_key", "critical", r"\bAKIA[0-9A-Z]{16}\b", r"(?iu)akia", "secrets", needs=("akia",)),
    Pattern("git_key", "api_key", "critical", r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"(?iu)gh[pousr]_", "secrets", needs=("_",)),
    Pattern("jwt", "jwt", "critical", r"\beyJ[\w-]+\.[\w-]+\.[\w-]+", r"(?iu)eyj", "secrets", needs=("eyj",),
            anchored=_run(r"\w-", "eyJ", r"[\w-]++\.[\w-]++\.[\w-]++")),
    Pattern(
        "database_url",
        "database_url",
        "critical",
        r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s'\"]+",
        r"://",
        "secrets",
        needs=("://",),
    ),
    Pattern("private_key", "secret", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----", "secrets", needs=("-----",)),
    Pattern(
        "assignment",
        "secret",
        "critical",
        r"\b[A-Z0-9_]*(?:API_KEY|SECRET|TOKEN|PASSWORD)\s*[=:]\s*\S+",
        r"[YyTtNnDd][\p{IsWhite_Space}\x{1C}-\x{1F}]*+[=:]",
        "secrets",
        needs=("=", ":"),
    ),
)

BY_NAME = {p.name: p for p in BUILTIN + SECRETS}
