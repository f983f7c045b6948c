"""The folding UDF against a slow character-by-character model, and the JVM pretest against the UDF."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from textguard.operators import normalize as N
from textguard.patterns import BUILTIN, SECRETS

PIECES = [
    "alice", "@", " at ", "At", "4t", " dot ", ".", "d0t", "com", "example", "-", "_", " ", "\n", "\t", "​", "﻿", "2",
    "6", "89", "269", "(", "sk", "SK-", "5k", "abc123456", "secret", "t0ken", "=", ":", "//", "http", "https://", "/", "home",
    "/h0me/x", "corp", "loc-al", "internal", "AKIA", "ABCDEFGHIJ123456", "eyJ", "ab.cd.ef", "-----BEGIN", "PRIVATE KEY-----",
    "аt", "о", " ", "…", "\r\n", "é", "ª", "ﬁ", "192.168.9.8", "26.89.92.6", "226-889-6622", "fe:ad:29",
    "ghp_", "p0stgres://u:p@h", "Then", "noon", "x", "Raven", "٣", "a-l-i-c-e", "_at_", "-dot-", "＠", "。", ".example",
]


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def slow_fold(text):
    """Pairs of (character, original span), one rule after the other, looking around naively."""
    pairs = []
    for i, original in enumerate(text):
        plain = "".join(N.CONFUSABLE.get(c, c) for c in unicodedata.normalize("NFKC", original))
        if plain not in list(N.ZERO_WIDTH):
            pairs += [(N.LEET.get(c, c), (i, i + 1)) for c in plain]

    def swap(found, make):
        for m in reversed(list(found)):
            new = make(m)
            span = (pairs[m.start()][1][0], pairs[m.end() - 1][1][1])
            pairs[m.start() : m.end()] = [(c, span) for c in new]

    def flat():
        return "".join(c for c, _ in pairs)

    swap(re.finditer(r"\b(?:at|dot)\b", flat(), re.I), lambda m: N.WORDS[m.group().lower()])
    line = flat()

    def near(indices):
        return next((line[j] for j in indices if not line[j].isspace()), None)

    kept = []
    for i, pair in enumerate(pairs):
        left, right = near(range(i - 1, -1, -1)), near(range(i + 1, len(line)))
        goes = False
        if left and right and pair[0] in " \t\n-_":
            goes = bool({left, right} & {".", "@"}) or (pair[0] in "-_" and left.isalnum() and right.isalnum())
        if not goes:
            kept.append(pair)
    pairs = kept
    swap(
        re.finditer(r"\bsk[\s-]+([a-z0-9][a-z0-9\s_-]{8,})", flat(), re.I),
        lambda m: "sk-" + re.sub(r"[\s_-]", "", m.group(1)),
    )
    return flat(), [s for _, s in pairs]


def test_fold_equals_slow_model():
    for text in texts(5, 4000):
        folded = N.fold(text)
        line, spans = slow_fold(text)
        assert folded.text == line, text
        assert list(zip(folded.lo.tolist(), folded.hi.tolist())) == spans, text


def slow_find(text):
    """All patterns on the slowly folded text; which findings are mapped, whole, or dropped."""
    line, spans = slow_fold(text)
    found, matches = set(), 0
    if line == text:
        return found
    for p in BUILTIN + SECRETS:
        for m in re.finditer(p.pattern, line, re.I | re.M):
            if m.group().endswith(p.skip_suffixes or "\0"):
                continue
            matches += 1
            if p.category == "private_url" and not re.search("http| dot |\u200b", text.lower()):
                continue
            if p.category == "private_email" and "@" in text and not re.search(" at | dot |\u200b", text.lower()):
                continue
            start, end = min(a for a, _ in spans[m.start() : m.end()]), max(b for _, b in spans[m.start() : m.end()])
            severity = "critical" if p.severity == "critical" else "high"
            if (p.category == "private_email" and line.count("@") > 1) or end - start > max(256, 4 * len(m.group())):
                found.add((p.category, 0, len(text), severity, True, False))
            else:
                found.add((p.category, start, end, severity, True, True))
    if not matches and re.search("[\u200b\u200c\u200d\ufeff]", text):
        found.add(("obfuscated_text", 0, len(text), "high", False, False))
    return found


def test_findings_equal_slow_model():
    for text in texts(7, 8000):
        got = N.find_obfuscated(text)
        assert {tuple(f.values()) for f in got} == slow_find(text), text


def test_pretest_never_hides_a_finding(spark):
    values = texts(6, 20000)
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string").repartition(8)
    lost = df.select(
        "text", N.may_be_obfuscated("text").alias("maybe"), F.size(N.obfuscated_spans("text")).alias("n")
    ).where("n > 0 AND NOT maybe")
    assert lost.collect() == []


def test_fixture_texts(redact):
    rows = redact(
        [
            "j0hn d0e at ex@mpl3 dot com",
            "contact alice at example dot com",
            "contact ali​ce@example.com",
            "zero​width only",
            "Summarize this public architecture note",
            "Signal: sk abc 123 456 789 SECRET here",
        ]
    )
    first = rows[0].resolved[0]
    assert first.normalized and not first.safe_replace and not rows[0].allowed
    assert [f.value for f in rows[1].resolved if f.category == "private_email"] == ["alice at example dot com"]
    assert rows[1].allowed and rows[1].redacted.startswith("contact [PRIVATE_EMAIL_")
    assert [f.value for f in rows[2].resolved if f.category == "private_email"] == ["ali​ce@example.com"]
    assert rows[3].blocked_categories == ["obfuscated_text"]
    assert rows[4].resolved == []
    assert not rows[5].allowed


def test_guards_against_false_alarms():
    # A sentence end that looks like a domain is dropped, unless the text has signs of obfuscation.
    assert N.find_obfuscated("It ends. Next one") == []
    assert [f["category"] for f in N.find_obfuscated("see site dot org now")] == ["private_url"]
    # Plain addresses are the raw detector's business.
    assert not [f for f in N.find_obfuscated("mail bob@x.com 0") if f["category"] == "private_email"]


def test_whole_text_findings_are_emitted_once():
    text = "a at b dot com and c at d dot com and e at f dot com"
    whole = [f for f in N.find_obfuscated(text) if not f["safe_replace"]]
    assert len(whole) == 1 and (whole[0]["start"], whole[0]["end"]) == (0, len(text))


def test_long_reach_is_not_trusted():
    text = "alice at example" + " " * 300 + " dot com"
    assert not next(f for f in N.find_obfuscated(text) if f["category"] == "private_email")["safe_replace"]


def test_text_level_fold(spark):
    df = spark.createDataFrame(
        [("a l i c e at ex​ample dot c0m",), ("key s k - abc 123 456 789",), ("AKIA ABCD EFGH IJKL 1234",)], "text string"
    )
    got = [r.normalized for r in N.normalize_text(df).collect()]
    assert got[0] == "alice@example.com"
    assert got[2].lower().startswith("akiaabcdefghijkl") and " " not in got[2]
