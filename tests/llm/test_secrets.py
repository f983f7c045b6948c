import re

from pyspark.sql import functions as F

from textguard.llm.secrets import GUESS, find, guess_cost, read_dictionary
from textguard.llm.spans import listed

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text, re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(out))


def test_base_spans_match_brute_force(docs, prose):
    draw = prose.draw
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", '"', "'", " ", "  ", ":", "=", "abcdefgh", "abc", "AKIA", "ABCDEF012345", "0123456789abcdef" * 2, "é", "\n", "ſecret", "a=b"]
    texts = ["", None, "token = secret: longvalue123", "token" + " " * 3000 + "=", "f" * 40_000, "AKIAAKIAABCDEFGHIJK"]
    texts += ["".join(draw.choice(bits) for _ in range(draw.randint(1, 25))) for _ in range(300)]
    got = find(docs(texts)).select("doc_id", listed(F.col("base")).alias("b")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.b == base(texts[r.doc_id]), repr(texts[r.doc_id])


def test_guess_costs():
    words = read_dictionary()
    easy = [guess_cost(x, words) for x in ("password", "qwertyuiop", "aaaaaaaaaaaa", "2021-03-04", "abababababab", "p4ssw0rd")]
    hard = [guess_cost(x, words) for x in ("xK9#vQ2!mZ7p", "f3Tz0qLw8RbN5y")]
    assert max(easy) < 7 < min(hard) and guess_cost("", words) == 0
    assert guess_cost("x" * 50_000, words) < 10


def brute_cost(value, words, memo=None):
    """Without walks, dates and repeats: words or single characters, all segmentations."""
    best = {0: 0.0}
    for end in range(1, len(value) + 1):
        options = [best[end - 1] + 1.0]
        options += [best[s] + 0.5 + words[value[s:end]] for s in range(end) if value[s:end] in words]
        best[end] = min(options)
    return best[len(value)]


def test_segmentation_is_the_cheapest(prose):
    words = read_dictionary()
    for word in prose(60):
        if not re.search(r"(.)\1\1|(..+)\2", word):
            assert guess_cost(word, words) <= brute_cost(word, words) + 1e-9


def test_context_values_and_ordinary_prose(docs):
    texts = [
        'db_password => "xK9vQ2mZ7pLw8RbN"',
        "Authorization: Bearer f3Tz0qLw8RbN5yGh2",
        "postgres://bob:xK9vQ2mZ7pLw8R@host/db",
        "the secret garden is a book, its token value is words",
        "password: password",
        None,
    ]
    rows = {r.doc_id: [s.kind for s in r.spans] for r in find(docs(texts + [(0, texts[0])])).collect()}
    assert GUESS in rows[0] and GUESS in rows[1] and GUESS in rows[2]
    assert rows[3] == [] and GUESS not in rows[4] and rows[5] == []
    assert find(docs(texts).limit(0)).count() == 0


def test_values_are_taken_whole(docs):
    cases = [
        ('pwd="abc@Kx92!mQz7,Lp"', "abc@Kx92!mQz7,Lp"),
        ("pwd = 'x;Kx92<mQz7>Lp w' and", "x;Kx92<mQz7>Lp w"),
        ('dbPassword: xK9,vQ2;mZ7@pLw8, then', "xK9,vQ2;mZ7@pLw8"),
        (r'{"secret": "xK9\"vQ2mZ7pLw8", "b": 1}', r"xK9\"vQ2mZ7pLw8"),
        ('"Authorization": "Bearer f3Tz0qLw8RbN5yGh2"', "f3Tz0qLw8RbN5yGh2"),
        ("postgres://" + "u" * 90 + ":xK9v@Q2m,Z7pLw8R@host/db?a=b@c", "xK9v@Q2m,Z7pLw8R"),
        ('token: "xK9,vQ2;mZ7@pLw8 and no end', "xK9,vQ2;mZ7@pLw8"),
        ('db_password => "xK9vQ2mZ7pLw8RbN"', "xK9vQ2mZ7pLw8RbN"),
    ]
    got = {r.doc_id: [(s.start, s.value) for s in r.spans if s.kind == GUESS] for r in find(docs([t for t, _ in cases])).collect()}
    assert got == {k: [(t.index(v), v)] for k, (t, v) in enumerate(cases)}


def test_long_runs_in_a_context(docs):
    texts = ["pwd=" + "x;" * 50_000, 'pwd="' + "y\\\"" * 30_000, "://" + "u" * 100_000, "pwd='" * 20_000]
    assert find(docs(texts)).count() == len(texts)
    assert len([r for r in find(docs(texts)).collect() if r.spans is not None]) == len(texts)
