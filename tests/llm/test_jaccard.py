import numpy as np
import pytest

from textguard.llm import jaccard
from textguard.llm.filters import bit_filter
from textguard.llm.jaccard import Sets, classify, join_members
from textguard.llm.shingles import shingle_sets


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    smallest = {}
    for k, (doc_id, _) in enumerate(rows):
        if sets[k] and doc_id is not None:
            smallest[find(k)] = min(smallest.get(find(k), doc_id), doc_id)
    return sorted(((d, len(sets[k]), smallest.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=repr)


def edited(prose, words, times):
    words = list(words)
    for _ in range(times):
        words[prose.draw.randrange(len(words))] = prose(1)[0]
    return words


def rows_for_test(prose):
    draw = prose.draw
    passage, hub = prose(60), prose(150)
    texts = []
    for _ in range(18):
        words = prose(draw.choice([3, 4, 5, 6, 8, 12, 20, 40, 80, 200])) + (passage if draw.random() < 0.3 else [])
        texts += [words] + [edited(prose, words, draw.choice([0, 1, 1, 2, 3, 5])) for _ in range(draw.choice([0, 1, 3, 8]))]
    texts += [edited(prose, hub, draw.choice([1, 1, 2, 3, 4])) for _ in range(30)]
    texts += [passage + prose(draw.choice([5, 10, 14, 20])) for _ in range(20)]
    rows = list(enumerate([" ".join(w) for w in texts] + ["", "  \n", None, "A b C", "a B c"]))
    draw.shuffle(rows)
    return rows + [rows[3], (None, rows[5][1]), (None, rows[7][1]), (None, "alone in its class without an id")]


@pytest.mark.parametrize("bounds", [{}, {"LEAF": 700, "PIVOTS": 5}, {"LEAF": 700, "PIVOTS": 3, "MAX_ROUNDS": 1}])
def test_classes_match_brute_force(docs, prose, monkeypatch, bounds):
    """Small bounds, so that frequent shingles, cells, recursion and blocks all take part."""
    for name, value in {"FREQUENT": 2, "SAMPLE_OF": 2, **bounds}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = rows_for_test(prose)
    got = classify(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def sets_of(groups):
    import pyarrow as pa

    return Sets(pa.chunked_array([pa.array([sorted(g) for g in groups], pa.list_(pa.int64()))]))


def many_sets(draw, n):
    """Sets around a few centres, some of them between two."""
    centres = [draw.sample(range(3000), 60) for _ in range(4)]
    out = []
    for _ in range(n):
        c = set(draw.choice(centres))
        for _ in range(draw.choice([0, 2, 5, 9, 14])):
            c.discard(draw.choice(sorted(c)))
            c.add(draw.randrange(3000))
        out.append(c)
    return out


def parts(n, edges):
    part = list(range(n))
    for a, b in edges:
        old, new = part[a], part[b]
        part = [new if p == old else p for p in part]
    return [part.index(p) for p in part]


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_join_of_members(prose):
    for _ in range(20):
        groups = many_sets(prose.draw, 60)
        n = len(groups)
        for home in (np.ones(n, bool), np.array([prose.draw.random() < 0.5 for _ in range(n)])):
            got = join_members(sets_of(groups), home)
            every = [(i, j) for i in range(n) for j in range(i) if similar(groups[i], groups[j])]
            needed = [e for e in every if home[e[0]] or home[e[1]]]
            assert all(similar(groups[a], groups[b]) for a, b in got)
            both = parts(n, got)
            assert all(both[a] == both[b] for a, b in needed)


def test_similar_members_meet_in_one_cell(prose):
    import pyarrow as pa

    groups = many_sets(prose.draw, 200) + [set(range(9000 + 70 * k, 9060 + 70 * k)) for k in range(20)]
    groups += [g | {1} for g in groups[-20:]]
    n = len(groups)
    lists = pa.array([sorted(g) for g in groups], pa.list_(pa.int64()))
    members = pa.table({"region": ["r"] * n, "key": list(range(n)), "home": [True] * n, "shingles": lists})
    pivots = pa.table({"key": [0, 50, 100, 150], "shingles": lists.take(pa.array([0, 50, 100, 150]))})
    rows = jaccard._to_cells(members, pivots).to_pylist()
    cells = {}
    for r in rows:
        cells.setdefault(r["cell"], {})[r["key"]] = r["home"]
    assert sorted(r["key"] for r in rows if r["home"]) == list(range(n))
    for i in range(n):
        for j in range(i):
            meet = sum(i in c and j in c and (c[i] or c[j]) for c in cells.values())
            assert meet == 1 if similar(groups[i], groups[j]) else meet <= 1
    for r in rows:
        pivot = groups[r["pivot"]]
        assert r["linked"] == (r["cell"] >= 0 and similar(groups[r["key"]], pivot))


def test_empty_table(docs):
    assert classify(docs(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filter_never_says_no_wrongly(spark, n):
    hashes = np.random.default_rng(n).integers(-(2**63), 2**63, n)
    test = bit_filter(spark.createDataFrame([(int(h),) for h in hashes], "h long"), "h")
    assert test(hashes.view(np.uint64)).all()
    other = np.random.default_rng(n + 1).integers(0, 2**63, 20_000).view(np.uint64)
    assert test(other).mean() < 0.002


def test_shingles_of_any_text(prose):
    draw = prose.draw
    for _ in range(200):
        texts = ["".join(draw.choice("aB \n\x85é\t") for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 5))]
        sets = shingle_sets(texts)
        for x, s in zip(texts, sets, strict=True):
            words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x)) if w]
            want = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
            assert len(s) == len(want)


def test_tables_of_whole_sets_go_before_links(docs, prose, monkeypatch):
    """Whole sets lie in one table while regions are joined, those of large regions in a folder of their own."""
    seen = {}

    def note(members, contents, number, scratch, cut=jaccard._cut):
        seen.setdefault(number, [t.columns for t, _ in scratch.tables if "shingles" in t.columns])
        seen.setdefault("large", sorted(contents.select("key").distinct().toPandas()["key"]) == sorted(members.select("key").toPandas()["key"]))
        return cut(members, contents, number, scratch)

    monkeypatch.setattr(jaccard, "_cut", note)
    for name, value in {"FREQUENT": 2, "SAMPLE_OF": 2, "LEAF": 700, "PIVOTS": 5}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = rows_for_test(prose)
    got = classify(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert len(seen[0]) == 1 and "large" in seen[0][0] and seen["large"]


def test_small_regions_share_groups_of_bounded_size(docs, prose, monkeypatch):
    """More regions make more groups, not larger ones."""
    sizes = []

    def note(self, *names):
        if [n for n in names if isinstance(n, str)] == ["crowd"]:
            sizes.append(max(r["count"] for r in group(self, "crowd").count().collect()))
        return group(self, *names)

    monkeypatch.setattr(jaccard, "LEAF", 60)
    monkeypatch.setattr(jaccard, "CROWD", 1)
    rows = []
    for k in range(200):
        words = prose(30)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "x"]))]
    frame = docs(rows)
    group = type(frame).groupBy
    monkeypatch.setattr(type(frame), "groupBy", note)
    assert classify(frame).select("component_id").distinct().count() == 200
    assert len(sizes) == 1 and 27 * sizes[0] <= 6 * 60


def test_batches_are_small_only_meanwhile(spark, docs, monkeypatch):
    seen = []
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def note(*args, links=jaccard.links):
        seen.append(spark.conf.get(setting))
        return links(*args)

    monkeypatch.setattr(jaccard, "links", note)
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 7)
    before = spark.conf.get(setting)
    assert classify(docs(["a b c d e f", "a b c d e f", "x"])).count() == 3
    assert seen == ["7"] and spark.conf.get(setting) == before


def test_pairs_that_part_in_a_later_round_are_still_compared(docs, prose, monkeypatch):
    """In a chain each document is similar to the next one only, so one pair that no cell compares cuts it."""
    for name, value in {"LEAF": 600, "PIVOTS": 6, "MAX_ROUNDS": 2}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = []
    for chain in range(12):
        words = prose(60 + 5 * 120)
        rows += [(1000 * chain + k, " ".join(words[5 * k : 5 * k + 60])) for k in range(120)]
    assert similar(shingles(rows[0][1]), shingles(rows[1][1])) and not similar(shingles(rows[0][1]), shingles(rows[2][1]))
    assert {r.component_id for r in classify(docs(rows, extra=False)).collect()} == {1000 * chain for chain in range(12)}


@pytest.mark.parametrize("few", [0, 1000])
def test_members_without_a_first_shingle_in_common_are_not_compared(prose, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    draw = prose.draw
    for _ in range(5):
        groups = many_sets(draw, 80)
        got = join_members(sets_of(groups), np.ones(80, bool))
        every = [(i, j) for i in range(80) for j in range(i) if similar(groups[i], groups[j])]
        assert all(similar(groups[a], groups[b]) for a, b in got) and parts(80, got) == parts(80, every)
    # Sets with a passage in common and nothing else.
    passage, compared = set(range(40)), []
    groups = [passage | set(draw.sample(range(100, 10**9), 60)) for _ in range(200)]
    counts = Sets.counts
    monkeypatch.setattr(Sets, "counts", lambda self, of, wanted: compared.append(len(of)) or counts(self, of, wanted))
    assert join_members(sets_of(groups), np.ones(200, bool)) == []
    assert sum(compared) == 0 if few == 0 else sum(compared) > 5000
