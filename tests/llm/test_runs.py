import hashlib
import re
import zlib

from textguard.llm.runs import chunk_runs, find_runs, run_digests, with_period


def slow_runs(words):
    """All runs by comparing words at every period."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def some_words(draw):
    words = [str(draw.randint(0, draw.choice([0, 1, 2, 5]))) for _ in range(draw.randint(0, 50))]
    unit = words[: draw.randint(1, 7)]
    at = draw.randint(0, len(words))
    return words[:at] + unit * draw.randint(1, 9) + words[at:]


def test_runs_by_brute_force(prose):
    for _ in range(300):
        texts = [[w.encode() for w in some_words(prose.draw)] for _ in range(prose.draw.randint(1, 6))]
        for words, found in zip(texts, chunk_runs(texts), strict=True):
            assert [tuple(r) for r in found.tolist()] == slow_runs(words)


def test_planted_periods():
    hit = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    words = [b"%d" % k for k in range(40)]
    got = with_period(words, hit)
    g = zlib.crc32(str(hit).encode()) // 10
    a = g % 40
    p = 1 + (40 - a) // (3 + g % 8)
    assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(40)]
    assert with_period(words, None) == words


def test_rows_by_brute_force(spark, docs, prose):
    texts = [" ".join(some_words(prose.draw)) for _ in range(150)]
    texts += ["", None, " \n\t ", "a\x1cb c " * 9, "Ä ä " * 8, "x", "one two " * 40000, " ".join(prose(300)) + " la" * 7]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "q " * 6), (None, None)]
    got = [tuple(r) for r in run_digests(docs(rows), planted=True).collect()]
    short = [r for r in rows if r[1] is None or len(r[1]) < 10000]
    want = [slow_row(*r) for r in short]
    assert sorted(map(repr, want)) == sorted(map(repr, (r for r in got if r[0] != 156)))
    (long,) = [r for r in got if r[0] == 156]
    assert long[1] >= 1 and long[3] >= 80000 // 3
    assert run_digests(docs([]), planted=True).collect() == []


def test_collapsed_text(docs):
    (row,) = find_runs(docs(["go home now now now now now now and sing la di la di la di la di"])).collect()
    assert [tuple(r) for r in row.runs] == [(2, 6, 1), (10, 8, 2)] and row.collapsed == "go home now and sing la di"
    (row,) = find_runs(docs([None])).collect()
    assert row.runs == [] and row.collapsed == ""
