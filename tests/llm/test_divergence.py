import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from textguard.llm import divergence as module
from textguard.llm.divergence import divergence

SCHEMA = "doc_id long, lang string, source string, text string"


def slow(rows, min_docs=10, top=10):
    groups, held = defaultdict(Counter), defaultdict(set)
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang, source].update(terms)
        for t in terms:
            held[lang, t].add(k)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (at, t), d in held.items() if at == lang and len(d) >= min_docs)
        sources = [s for at, s in groups if at == lang]
        shares = {}
        whole = Counter()
        for s in sources:
            whole.update(groups[lang, s])
        for s, counts in [*((s, groups[lang, s]) for s in sources), (None, whole)]:
            below = sum(counts[t] for t in kept) + 2 * len(kept)
            shares[s] = {t: 1 + 1_000_000_000 * (counts[t] + 2) // below for t in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(apart(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, apart(shares[s][t], shares[None][t])) for t in kept if groups[lang, s][t] and shares[s][t] > shares[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(ranked[:most], 1)]
    return sorted(out)


def check(spark, rows, **more):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    frame = frame.withColumns({c: F.lit("x") for c in ("chunk", "term", "p", "q", "rank", "ids", "docs", "block")})
    got = divergence(frame, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_by_brute_force(spark, prose):
    draw = prose.draw
    words = ["cat", "Cat,", "cat-dog", "(cat)", "http://a.b/cat", "naïve", "NAÏVE", "über all", "42", "x1y", "--", "Été", "zzz", "猫", "a"]
    words += [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(6)]
    rows = []
    for _ in range(260):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["s1", "s1", "s2", "s3", None, ""])
        rows.append((lang, source, draw.choice([" ", "\n", "\t "]).join(draw.choice(words) for _ in range(draw.randint(0, 14)))))
    rows += [("en", "only null", None), ("fr", "rare", "seul mot"), ("fr", "rare too", ""), ("it", "alone", "uno"), rows[3], rows[3]]
    rows += [("en", "s2", f"u{chr(97 + k)}/rare,{chr(97 + k)}q seldom{'!' * k}") for k in range(12)]  # terms that no chunk decides
    rows += [("de", "s2", f"nine{'?' * k} nine") for k in range(9)]
    rows.append(("en", "s1", "a b " * 30000))
    assert check(spark, rows) == slow(rows)
    assert check(spark, rows, min_docs=3, top=2) == slow(rows, 3, 2)


def test_small_batches_and_blocks_change_nothing(spark, prose, monkeypatch):
    rows = [("en", f"s{k % 5}", " ".join(prose(60)[: 10 + k % 50])) for k in range(200)]
    want = slow(rows)
    monkeypatch.setattr(module, "BLOCK_TERMS", 16)
    assert check(spark, rows) == want


def test_small_task_batches(prose):
    texts = [" ".join(prose(40)[: k % 9]) for k in range(30)]
    held = module.Batch()
    for k, text in enumerate(texts):
        held.add("en", f"s{k % 2}", text.encode())
    doc, code, times = held.per_document()
    names = list(held.number)
    got = sorted((d, names[c].decode(), t) for d, c, t in zip(doc, code, times, strict=True))
    assert got == sorted((k, w, n) for k, t in enumerate(texts) for w, n in Counter(t.split()).items())


def test_empty_table(spark):
    assert check(spark, []) == []


def test_wanted_chunks_of_documents(prose):
    held = module.Batch()
    for k in range(30):
        held.add("en", "s", " ".join(prose(40)[: k % 9]).encode())
    doc, code, _ = held.per_document()
    wanted = np.arange(len(held.number)) % 3 == 0
    got = held.per_document_of(wanted)
    assert [a.tolist() for a in got] == [doc[wanted[code]].tolist(), code[wanted[code]].tolist()]
    assert [a.tolist() for a in module.Batch().per_document_of(np.zeros(0, bool))] == [[], []]


def test_shares_are_exact_beyond_64_bits(spark):
    most = module.MOST_PLAIN
    rows = [(n, t, v) for n in (0, 1, 7, most, most + 1, 10**15) for t in (n, n + 10**12) for v in (1, 40_000)]
    got = spark.createDataFrame(rows, "n long, t long, v long").select(module.share(F.col("n"), F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + module.BILLION * (n + 2) // (t + 2 * v) for n, t, v in rows]
