import hashlib
import math
import re
from collections import Counter, defaultdict

from textguard.llm import pii
from textguard.llm.pii import GENERALISE_AT, MIN_SUPPORT, REMOVE_AT, WINDOW, find, sanitise
from textguard.llm.spans import listed

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def kept(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, m.end(), kind, m[0]) for m in re.finditer(pattern, text or "") if kept(kind, m[0])]
    return sorted(out)


def brute(rows):
    """All spans per row, by the definition in the module's docstring."""
    found = [base(t) for _, t in rows]
    around = []
    for (_, text), spans in zip(rows, found, strict=True):
        seen = set()
        for start, _, end, kind, value in spans:
            name = f"{kind}:" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))
            lo, hi = max(0, start - WINDOW), min(len(text), end + WINDOW)
            for a, b, cut_lo, cut_hi in ((lo, start, lo > 0, False), (end, hi, False, hi < len(text))):
                for m in re.finditer(r"[^\W_]+", text[a:b]):
                    s, e = a + m.start(), a + m.end()
                    if (cut_lo and s == a) or (cut_hi and e == b) or any(x[0] < e and s < x[2] for x in spans):
                        continue
                    seen.add((name, m[0].lower(), s, e))
        around.append(seen)
    both, per_entity = Counter(), Counter()
    for seen in around:
        both.update({(n, t) for n, t, _, _ in seen})
        per_entity.update({n for n, *_ in seen})
    per_term = Counter(t for _, text in rows for t in {w.lower() for w in re.findall(r"[^\W_]+", text or "")})
    share = {}
    for (name, term), n in both.items():
        information = math.log(len(rows) / per_entity[name])
        if n >= MIN_SUPPORT and information > 0:
            share[name, term] = 1 + math.log(n / max(per_term[term], n)) / information
    out = []
    for spans, seen in zip(found, around, strict=True):
        best = defaultdict(lambda: -9.0)
        for name, term, s, e in seen:
            best[s, e] = max(best[s, e], share.get((name, term), -9))
        extra = [(s, 5 if v >= REMOVE_AT else 4, e, pii.REMOVED if v >= REMOVE_AT else pii.GENERALISED) for (s, e), v in best.items() if v >= GENERALISE_AT]
        out.append(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted([x[:4] for x in spans] + extra)))
    return out


def rows_for_test(prose):
    draw = prose.draw
    people = [f"p{k}.{w}@mail{k}.example.com" for k, w in enumerate(prose(6))]
    rows = []
    for k in range(60):
        words = prose(draw.randint(5, 40))
        if k % 3 == 0:
            at = draw.randrange(len(words))
            p = draw.randrange(6)
            words[at:at] = [f"Agent{p}", people[p], f"desk{p % 3},"]
        if k % 5 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(["+1 (743) 555-3824", "4785380592391139", "10.1.22.255", "10.1.22.256", "4785380592391138"]))
        rows.append((k, " ".join(words)))
    odd = ["", None, "a@b", "a@b.c@d.e%x@y.z", "1.2.3.4.5.6.7.8", "+1234567890", "x" * 5000 + "@y.zz", "é@ü.com ÀÉ 1 2 3", rows[0][1]]
    return rows + [(100 + k, t) for k, t in enumerate(odd)] + [rows[0], rows[3]]


def test_spans_match_brute_force(docs, prose):
    from pyspark.sql import functions as F

    rows = rows_for_test(prose)
    got = find(docs(rows)).select("doc_id", listed(F.col("base")).alias("b"), listed(F.col("spans")).alias("s")).collect()
    want = [(d, ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in base(t)), s) for (d, t), s in zip(rows, brute(rows), strict=True)]
    assert sorted((r.doc_id, r.b, r.s) for r in got) == sorted(want)
    assert any("term_" in s for *_, s in want)


def test_sanitise_keeps_columns_and_clean_texts(docs, prose):
    rows = rows_for_test(prose)
    df = docs(rows)
    out = sanitise(df)
    assert out.columns == df.columns
    texts = {}
    for r in out.collect():
        assert r.base == "x" and r.spans == "x"
        texts.setdefault(r.doc_id, set()).add(r.text)
    for doc_id, text in rows:
        if not base(text):
            assert text in texts[doc_id]
        else:
            assert all(not base(t) for t in texts[doc_id])
    assert sanitise(df.limit(0)).count() == 0


def test_query_digest(spark, docs):
    from textguard.llm.common import QUERIES

    assert "op1_pii_disclosure" in QUERIES
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_telling_terms_far_from_the_entity_go_everywhere(docs, prose):
    far = " ".join(prose(200))
    rows = [(k, f"Quixbury {far} mail zed@mail.example.com {far} end quixbury, QUIXBURY") for k in range(3)]
    rows += [(10 + k, " ".join(prose(300))) for k in range(40)] + [(90, "only here once@mail.example.com Uniqueword")]
    texts = {r.doc_id: r.text for r in sanitise(docs(rows)).collect()}
    assert all("quixbury" not in texts[k].lower() and "zed@" not in texts[k] for k in range(3))
    # The stated rule for entities of one document: only the entity goes.
    assert texts[90] == "only here [EMAIL] Uniqueword"
