import numpy as np
import pytest

from textguard.llm import covertree
from textguard.llm.covertree import DualTraversal, Tree, build_tree, near_vectors


def slow(rows, cosine):
    """Links by comparing all pairs."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))

    units = [unit(v) for _, v in rows]
    link = [[a is not None and b is not None and len(a) == len(b) and i != j and a @ b >= cosine for j, b in enumerate(units)]
            for i, a in enumerate(units)]
    part = list(range(len(rows)))
    for _ in rows:
        part = [min([part[i]] + [part[j] for j in range(len(rows)) if link[i][j]]) for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((key, sum(link[i]), least, key == least))
    return sorted(out, key=repr)


def clustered(seed, n, width, spread=0.2):
    draw = np.random.default_rng(seed)
    heads = draw.normal(size=(max(2, n // 12), width))
    heads /= np.linalg.norm(heads, axis=1)[:, None]
    return heads[draw.integers(0, len(heads), n)] + draw.normal(size=(n, width)) * spread / np.sqrt(width)


def as_tree(units):
    order, nodes = build_tree(units)
    return Tree(units[order].tobytes(), order.astype(np.int64).tobytes(), np.ones(len(order), np.int64).tobytes(), nodes.tobytes())


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_tree_and_traversal(spread, monkeypatch):
    monkeypatch.setattr(covertree, "BASE_PAIRS", 30)
    for seed in range(6):
        x = clustered(seed, 400, 6, spread)
        x /= np.linalg.norm(x, axis=1)[:, None]
        trees = [as_tree(x[:250]), as_tree(x[250:])]
        for tree in trees:
            assert sorted(tree.pids) == list(range(len(tree.pids)))
            for node in tree.nodes:
                inside = tree.units[node["start"] : node["stop"]]
                assert np.linalg.norm(inside - inside[0], axis=1).max() <= node["radius"] + 1e-6
                if node["last"]:
                    kids = tree.nodes[node["first"] : node["last"]]
                    assert kids[0]["start"] == node["start"] and kids[-1]["stop"] == node["stop"]
                    level = 2.0 ** (np.ceil(np.log2(node["radius"])) - 1)
                    centres = tree.units[kids["start"]]
                    gaps = np.linalg.norm(centres[:, None] - centres, axis=2) + 9 * np.eye(len(kids))
                    assert gaps.min() > level - 1e-6 and kids["radius"].max() <= level + 1e-6
        for b in (None, trees[1]):
            work = DualTraversal(trees[0], b, 0.9)
            work.run()
            pid, links, joined = work.rows()
            other = x[250:] if b else x[:250]
            want = (x[:250] @ other.T >= 0.9) & (True if b else ~np.eye(250, dtype=bool))
            counts = dict(zip(pid[: np.count_nonzero(work.links[:250])], links, strict=False))
            assert [counts.get(i, 0) for i in range(250)] == want.sum(axis=1).tolist()


def check(spark, rows, **more):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    frame = frame.withColumns({c: F.lit("x") for c in ("unit", "cell", "pid", "weight", "label", "kept")})
    got = near_vectors(frame, **more)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_rows_by_brute_force(spark, monkeypatch):
    x = clustered(3, 330, 8, 0.35)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(400 + k, rows[5][1]) for k in range(60)] + [(7, rows[7][1]), (None, rows[8][1]), (500, [2 * v for v in rows[9][1]])]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [1.0] * 7 + [None]), (604, [float("nan")] * 8), (605, [float("inf")] * 8),
             (606, [1.0, 0.0]), (607, [1.0, 0.1]), (608, [1e-200] * 8), (609, [1e200] * 8)]
    want = [r if r[0] is not None else r for r in slow([r for r in rows if r[0] not in (None, 608, 609)], 0.9)]
    plain = [r for r in rows if r[0] not in (None, 608, 609)]
    assert check(spark, plain) == want
    # Many small blocks give the same.
    monkeypatch.setattr(covertree, "LEAST_BLOCK", 20)
    monkeypatch.setattr(covertree, "BLOCK_BYTES", 20 * 64)
    monkeypatch.setattr(covertree, "FANOUT", 4)
    assert check(spark, plain) == want
    monkeypatch.setattr(covertree, "MAX_SPLITS", 1)
    assert check(spark, plain) == want


def test_odd_rows(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1e-200, 1e-200]), (4, [1e200, 1e200]), (5, [5.0, -1.0]), (5, [5.0, -1.0])]
    assert check(spark, rows) == sorted(
        [(None, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (4, 3, 3, False), (5, 1, 5, True), (5, 1, 5, True)], key=repr
    )
    assert check(spark, [(None, [1.0])]) == [(None, 0, None, True)]
    assert check(spark, []) == []
    with pytest.raises(ValueError, match="cosine"):
        near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"), cosine=1.0)


def test_tight_groups_are_not_compared_pair_by_pair():
    x = np.random.default_rng(1).normal(size=(1, 32)) + np.random.default_rng(2).normal(size=(4000, 32)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    work = DualTraversal(as_tree(x), None, 0.9)
    work.run()
    assert set(work.links) == {3999} and work.compared == 0


def test_cells_far_apart_or_near_are_settled_by_their_radius(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAST_BLOCK", 20)
    monkeypatch.setattr(covertree, "BLOCK_BYTES", 20 * 24)
    tight = np.array([1.0, 0, 0]) + np.random.default_rng(5).normal(size=(90, 3)) * 0.004
    rows = [(k, v.tolist()) for k, v in enumerate(tight)] + [(100 + k, [0.0, 1.0, 0.001 * k]) for k in range(90)]
    got = check(spark, rows)
    assert [r[1:3] for r in got if r[0] < 100] == [(89, 0)] * 90 and [r[1:3] for r in got if r[0] >= 100] == [(89, 100)] * 90


def test_trees_are_not_shuffled_with_pairs_of_blocks(spark, monkeypatch):
    """What a task gets of a pair of blocks is their names, however many pairs a block is in."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    dealt = []
    apply = PandasGroupedOpsMixin.applyInArrow

    def note(self, func, schema):
        if func.__name__ == "traverse":
            dealt.append(dict(self._df.dtypes))
        return apply(self, func, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", note)
    for name, value in {"LEAST_BLOCK": 20, "BLOCK_BYTES": 20 * 64, "FEW_TILES": 2}.items():
        monkeypatch.setattr(covertree, name, value)
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(7, 200, 8, 0.35))]
    assert check(spark, rows) == slow(rows, 0.9)
    assert len(dealt) == 1 and "binary" not in dealt[0].values() and not any(t.startswith("array") for t in dealt[0].values())
