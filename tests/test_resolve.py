import random

from pyspark.sql import functions as F

from textguard.operators.act import splice
from textguard.operators.detect import FINDINGS_TYPE
from textguard.operators.resolve import resolve
from textguard.policy import ACTION_RANK, SEVERITY_RANK, Policy

CATEGORIES = ["private_email", "private_phone", "ip_address", "account_number", "other"]


def brute(findings, policy):
    """Quadratic model: every new finding meets all kept ones."""

    def rank(f):
        return ACTION_RANK[policy.action_for(f[0])], SEVERITY_RANK[f[5]], f[2] - f[1]

    def clash(a, b):
        return a[1] < b[2] and b[1] < a[2]

    order = sorted(range(len(findings)), key=lambda i: (findings[i][1], findings[i][1] - findings[i][2], -rank(findings[i])[0], -rank(findings[i])[1], i))
    kept = []
    for f in (findings[i] for i in order):
        rivals = [k for k in kept if clash(k, f)]
        if all(rank(f) >= rank(k) for k in rivals):
            kept = [k for k in kept if k not in rivals] + [f]
    return sorted(kept, key=lambda f: f[1])


def make(rnd, n, length):
    out = []
    for i in range(n):
        start = rnd.randrange(length)
        end = min(length, start + rnd.randint(1, 8))
        out.append((rnd.choice(CATEGORIES), start, end, f"v{i}", f"d{i}", rnd.choice(list(SEVERITY_RANK)), None, False, True, None))
    return out


def test_sweep_equals_quadratic_model(spark):
    policy = Policy.builtin()
    rnd = random.Random(3)
    cases = [make(rnd, rnd.randint(0, 9), 20) for _ in range(1500)] + [make(rnd, 700, 900)]
    df = spark.createDataFrame(list(enumerate(cases)), f"id int, findings {FINDINGS_TYPE}")
    rows = resolve(df, policy).orderBy("id").collect()
    for case, row in zip(cases, rows):
        assert [tuple(f) for f in row.resolved] == brute(case, policy)


def test_allowlist_is_case_sensitive_and_matches_parts(redact):
    use = Policy.builtin()
    use.allowlist = ["example.com"]
    rows = redact(["bob@example.com and bob@EXAMPLE.com"], use)
    assert [f.value for f in rows[0].resolved] == ["bob@EXAMPLE.com"]


def test_splice_equals_python(spark):
    rnd = random.Random(4)
    cases = []
    for size in [0, 1, 3, 63, 64, 65, 200, 700]:
        text = "".join(rnd.choice("abé😀 .") for _ in range(size * 5 + 3))
        cuts = sorted(rnd.sample(range(len(text) + 1), size * 2))
        cases.append((text, [(cuts[i], cuts[i + 1]) for i in range(0, size * 2, 2)]))
    df = spark.createDataFrame(
        [(i, t, s) for i, (t, s) in enumerate(cases)], "id int, text string, spans array<struct<start:int,end:int>>"
    )
    replaced = splice(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("<"), s["start"].cast("string"), F.lit(">")))
    for (text, spans), row in zip(cases, df.withColumn("out", replaced).orderBy("id").collect()):
        want, done = "", 0
        for start, end in spans:
            want += text[done:start] + f"<{start}>"
            done = end
        assert row.out == want + text[done:]
