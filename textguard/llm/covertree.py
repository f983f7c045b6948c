"""Exact join of vectors by a cosine threshold: dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most tau = sqrt(2 - 2 c). Equal unit vectors are one point with a
weight. The points form one tree in two parts:

1. Upper part, as tables: cells with more points than a block are split among points of their own as centres, each point going
   to the nearest, until every cell is a block. A cell has a centre and a covering radius.
2. Lower part, one cover tree per block, built in a task: nodes of a level cover their points within a radius that is a power of
   two, their centres are farther apart than it, the radius halves from level to level, and a node's centre is the centre of
   its first child (nested levels). Each node also knows the true largest distance to its points.

Two trees are traversed together, from the cells down. A pair of nodes farther apart than both covering radii plus tau holds no link
and is left; one whose farthest points must be within tau is linked as a whole, without looking at points; all others
are opened. What ends in points is decided by the cosine itself, so the result does not depend on the bounds. Per pair of blocks only
counts per point and one edge per linked point come out, never pairs. Trees lie in the shared folder and are read there by the tasks
that traverse them, a few blocks by a few blocks at a time: pairs of blocks are shuffled by name, never with their trees.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; neither do vectors of
different length. Rows that repeat a vector link with each other, whatever their ids. Null ids count as larger than all others in
``component_id``, which is null if no vector of the component has an id; then all of them are kept. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textguard.llm.common import Scratch, query, table
from textguard.llm.components import components, joined
from textguard.session import filesystem, scratch_folder

COSINE = 0.9
BLOCK_BYTES = 4 << 20  # coordinates of a block
LEAST_BLOCK = 256  # but at least so many points
SLICE_BYTES = 32 << 20  # coordinates that are dealt to centres in one task
FANOUT = 64
MAX_SPLITS = 16
TILE = 4  # about so many blocks by blocks are traversed with one reading of their trees
FEW_TILES = 16  # but of few blocks each has its own
MOST_TASKS = 5000
SLACK = 1e-6  # covers the rounding of distances; only lets more pairs be opened
LEAF = 8
FEW = 32  # nodes of so many points are opened before they are compared: bounds would cost more than they save
BASE_PAIRS = 1 << 16  # node pairs with no more pairs of points than this are compared outright
NODE = np.dtype([("start", "<i4"), ("stop", "<i4"), ("first", "<i4"), ("last", "<i4"), ("radius", "<f8")])


def unit_vector(vector: str) -> Column:
    """The vector scaled to length one, null where it can link with nothing."""
    x = F.col(vector).cast("array<double>")
    usable = (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    top = F.array_max(F.transform(x, F.abs))
    # Scaled by its largest component first, so that no square is too large or too small.
    scaled = F.transform(F.array(F.struct(x.alias("x"), top.alias("top"))), lambda s: F.transform(s["x"], lambda v: v / s["top"]))
    unit = F.transform(
        F.transform(scaled, lambda s: F.struct(s.alias("s"), F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, v: a + v * v)).alias("norm"))),
        lambda p: F.transform(p["s"], lambda v: v / p["norm"] + 0.0),
    )
    return F.when(F.coalesce(usable & (top > 0), F.lit(False)), unit[0])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _centres(points: DataFrame, big: DataFrame, number: int) -> DataFrame:
    """``cell, parts, child, centre``: points of each big cell, drawn by a hash; a bounded number per cell."""
    draw = F.pmod(F.xxhash64("pid", F.lit(number)), F.lit(1 << 40))
    want = F.least(F.lit(FANOUT), F.ceil(F.col("points") * 1.5 / F.col("room")) + 1)
    drawn = points.select("pid", "unit", "cell").join(big.select("cell", "points", "parts", want.alias("want")), "cell")
    # Far more than are wanted pass on average, so the window sorts a few per cell only.
    drawn = drawn.where(draw < F.lit(float(1 << 40)) * 6 * F.col("want") / F.col("points"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(draw, "pid"))
    chosen = drawn.withColumn("place", place).where("place <= want")
    return chosen.select("cell", "parts", F.concat_ws(".", "cell", "place").alias("child"), F.col("unit").alias("centre"))


def _to_nearest(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Each point with its nearest centre (the first of equally near ones) and the distance to it."""
    if not points.num_rows:
        return pa.table({"pid": pa.array([], pa.int64()), "child": pa.array([], pa.string()), "distance": pa.array([], pa.float64())})
    centres = centres.sort_by("child")
    children = np.array(centres.column("child").to_pylist(), object)
    to = _matrix(centres.column("centre"))
    x = _matrix(points.column("unit"))
    nearest, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 4096):
        cosine = x[at : at + 4096] @ to.T
        nearest[at : at + 4096] = cosine.argmax(axis=1)
        distance[at : at + 4096] = _distance(cosine.max(axis=1))
    return pa.table({"pid": points.column("pid"), "child": pa.array(children[nearest], pa.string()), "distance": distance})


def upper_tree(points: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Points with the block (``cell``) they are in; all cells ``cell, parent, centre, radius``; how many times cells were split.

    The first cells have no parent and no centre: one per length of vectors.
    """
    width = F.size("unit")
    placed = points.select("pid", "unit", "weight", width.cast("string").alias("cell"))
    cells = scratch.store(placed.select("cell").distinct().selectExpr("cell", "CAST(NULL AS STRING) AS parent",
                          "CAST(NULL AS ARRAY<DOUBLE>) AS centre", "CAST(NULL AS DOUBLE) AS radius"), "cells")
    number = 0
    while True:
        room = F.greatest(F.lit(LEAST_BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.first(F.size("unit"))))).alias("room")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("points"), room)
        slice_rows = F.lit(SLICE_BYTES / BLOCK_BYTES) * F.col("room")
        big = sizes.where("points > room").withColumn("parts", F.ceil(F.col("points") / slice_rows).cast("int"))
        big = scratch.store(big, "big")
        if big.isEmpty():
            return placed, cells, number
        if number == MAX_SPLITS:  # points so near each other that centres do not part them: cut by a hash
            piece = F.pmod(F.xxhash64("pid", F.lit(-1)), F.ceil(F.col("points") / F.col("room")))
            child = F.when(F.col("points").isNotNull(), F.concat_ws(".", "cell", piece)).alias("child")
            moved = placed.join(big, "cell", "left").select("pid", "unit", "weight", "cell", child)
            old = cells.select("cell", "centre", "radius")
            new = moved.where("child IS NOT NULL").select("child", "cell").distinct().join(old, "cell")
            added = new.select(F.col("child").alias("cell"), F.col("cell").alias("parent"), "centre", "radius")
            placed = scratch.store(moved.select("pid", "unit", "weight", F.coalesce("child", "cell").alias("cell")), "placed")
            return placed, scratch.store(cells.unionByName(added), "cells"), number + 1
        centres = scratch.store(_centres(placed, big, number), "centres")
        split = centres.select("cell", "parts").distinct()
        part = F.pmod(F.xxhash64("pid", F.lit(-2)), "parts").cast("int").alias("part")
        dealt = placed.join(split, "cell").select("pid", "unit", "cell", part)
        each = centres.select("cell", "child", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        near = dealt.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInArrow(
            _to_nearest, "pid bigint, child string, distance double"
        )
        near = scratch.store(near, "near")
        radius = near.groupBy("child").agg(F.max("distance").alias("radius"))
        added = centres.join(radius, "child").select(F.col("child").alias("cell"), F.col("cell").alias("parent"), "centre", "radius")
        cells = scratch.store(cells.unionByName(added), "cells")
        moved = placed.join(near, "pid", "left").select("pid", "unit", "weight", F.coalesce("child", "cell").alias("cell"))
        before, placed = placed, scratch.store(moved, "placed")
        scratch.drop(big, centres, near, *[before] * (number > 0))
        number += 1


def build_tree(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of points in which every node's points stand together, its centre first; and the nodes, children together."""
    order = np.arange(len(units))
    nodes: list[list] = [[0, len(units), 0, 0, 0.0]]
    at = 0
    while at < len(nodes):
        start, stop = nodes[at][:2]
        members = order[start:stop]
        radius = float(_distance(units[members] @ units[members[0]]).max())
        nodes[at][4] = radius
        if len(members) > LEAF and radius > SLACK:
            parts = _covered(units, members, 2.0 ** (ceil(log2(radius)) - 1))
            if len(parts) > 1:
                order[start:stop] = np.concatenate(parts)
                nodes[at][2:4] = len(nodes), len(nodes) + len(parts)
                for part in parts:
                    nodes.append([start, start + len(part), 0, 0, 0.0])
                    start += len(part)
        at += 1
    return order, np.array([tuple(n) for n in nodes], NODE)


def _covered(units: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Members by the centre that covers them: centres are taken in order, each farther than ``radius`` from those before it."""
    parts = []
    left = members
    while len(left):
        first = left[:256]
        distance = _distance(units[left] @ units[first].T)
        within = distance <= radius
        centre: list[int] = []
        covered = np.zeros(len(first), bool)
        for k in range(len(first)):
            if not covered[k]:
                centre.append(k)
                covered |= within[k]
        near = np.where(within[:, centre], distance[:, centre], np.inf)
        nearest = near.argmin(axis=1)
        hit = near[np.arange(len(left)), nearest] < np.inf
        hit[centre], nearest[centre] = True, np.arange(len(centre))
        by = np.argsort(nearest[hit], kind="stable")
        taken, of = left[hit][by], nearest[hit][by]
        for part, c in zip(np.split(taken, np.flatnonzero(np.diff(of)) + 1), centre, strict=True):
            parts.append(np.concatenate([[left[c]], part[part != left[c]]]))
        left = left[~hit]
    return parts


class Tree:
    def __init__(self, units: bytes, pids: bytes, weights: bytes, nodes: bytes):
        self.pids = np.frombuffer(pids, np.int64)
        self.weights = np.frombuffer(weights, np.int64)
        self.units = np.frombuffer(units, np.float64).reshape(len(self.pids), -1)
        self.nodes = np.frombuffer(nodes, NODE)

    def children(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the children; -1 stands for a point of a child with few points."""
        row = self.nodes[node]
        at = np.arange(row["first"], row["last"]) if row["last"] else np.array([node])
        rows = self.nodes[at]
        few = rows["stop"] - rows["start"] <= FEW
        sizes = (rows["stop"] - rows["start"])[few]
        points = np.zeros(sizes.sum(), NODE)
        points["start"] = np.repeat(rows["start"][few], sizes) + np.arange(len(points)) - np.repeat(sizes.cumsum() - sizes, sizes)
        points["stop"] = points["start"] + 1
        return np.concatenate([rows[~few], points]), np.concatenate([at[~few], np.full(len(points), -1)])


class DualTraversal:
    """Links between the points of two trees (or within one): counts of linked weight per point, and edges that join what links join."""

    def __init__(self, a: Tree, b: Tree | None, cosine: float):
        self.a, self.b, self.same = a, b or a, b is None
        self.cosine, self.tau = cosine, sqrt(2 - 2 * cosine)
        self.shift = 0 if self.same else len(a.pids)
        self.n = self.shift + len(self.b.pids)
        self.links = np.zeros(self.n, np.int64)
        self.x: list[np.ndarray] = []
        self.y: list[np.ndarray] = []
        self.kept = 0
        self.compared = 0

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x.append(x)
        self.y.append(y)
        self.kept += len(x)
        if self.kept > max(1 << 20, 4 * self.n):
            label = joined(np.concatenate(self.x), np.concatenate(self.y), self.n)
            self.x, self.y, self.kept = [np.arange(self.n)], [label], self.n

    def _found(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of linked places, of the one and of the other tree."""
        np.add.at(self.links, i, self.b.weights[j])
        np.add.at(self.links, j + self.shift, self.a.weights[i])
        self._join(i, j + self.shift)

    def _whole(self, p: np.void, q: np.void, own: bool) -> None:
        left, right = np.arange(p["start"], p["stop"]), np.arange(q["start"], q["stop"])
        if own:
            self.links[left] += self.a.weights[left].sum() - self.a.weights[left]
        else:
            self.links[left] += self.b.weights[right].sum()
            self.links[right + self.shift] += self.a.weights[left].sum()
        self._join(left, np.full(len(left), right[0] + self.shift))
        self._join(np.full(len(right), left[0]), right + self.shift)

    def _points(self, left: np.ndarray, right: np.ndarray, own: bool) -> None:
        """Compare points outright, by their places."""
        for at in range(0, len(left), 1024):
            rows = left[at : at + 1024]
            linked = self.a.units[rows] @ self.b.units[right].T >= self.cosine
            self.compared += linked.size
            i, j = np.nonzero(linked)
            i, j = rows[i], right[j]
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                self._found(i, j)

    def run(self) -> None:
        stack = [(0, 0)]
        while stack:
            at, to = stack.pop()
            p, q = self.a.nodes[at], self.b.nodes[to]
            own = self.same and at == to
            if own and 2 * p["radius"] + SLACK < self.tau:
                self._whole(p, q, own)
            elif (p["stop"] - p["start"]) * (q["stop"] - q["start"]) <= BASE_PAIRS or not (p["last"] or q["last"]):
                self._points(np.arange(p["start"], p["stop"]), np.arange(q["start"], q["stop"]), own)
            else:
                self._open(self.a.children(at), self.b.children(to), own, stack)

    def _open(self, left: tuple, right: tuple, own: bool, stack: list) -> None:
        """Compare the centres of all children of two nodes, and go on with those pairs that bounds do not decide."""
        (p, left), (q, right) = left, right
        alone_p, alone_q = left < 0, right < 0
        centres = self.b.units[q["start"]].T
        for at in range(0, len(left), 512):
            rows = p[at : at + 512]
            cosine = self.a.units[rows["start"]] @ centres
            self.compared += cosine.size
            # Pairs no farther apart than both radii plus tau, by the cosine that belongs to that distance.
            if alone_p[at : at + 512].all() and alone_q.all():
                near = cosine >= self.cosine
            else:
                bound = self.tau + SLACK + rows["radius"][:, None] + q["radius"]
                near = cosine >= 1 - bound * bound / 2
            i, j = np.nonzero(near)
            if own:
                i, j = i[at + i <= j], j[at + i <= j]
            if not len(i):
                continue
            value = cosine[i, j]
            lone_i, lone_j = alone_p[at + i], alone_q[j]
            linked = lone_i & lone_j & (value >= self.cosine)
            if own:
                linked &= at + i < j
            if linked.any():
                self._found(rows["start"][i[linked]].astype(np.int64), q["start"][j[linked]].astype(np.int64))
            more = ~(lone_i & lone_j)
            i, j, value = i[more], j[more], value[more]
            whole = _distance(value) + rows["radius"][i] + q["radius"][j] + SLACK < self.tau
            whole &= ~(own & (at + i == j))
            for r, c in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
                self._whole(rows[r], q[c], False)
            i, j = i[~whole], j[~whole]
            # A node against many single points is one comparison.
            of_point = alone_q[j]
            for r in np.unique(i[of_point]):
                node = rows[r]
                self._points(np.arange(node["start"], node["stop"]), q["start"][j[of_point & (i == r)]], False)
            of_point = alone_p[at + i]
            for c in np.unique(j[of_point]):
                node = q[c]
                self._points(rows["start"][i[of_point & (j == c)]], np.arange(node["start"], node["stop"]), False)
            both = ~(alone_p[at + i] | alone_q[j])
            stack += zip(left[at + i[both]].tolist(), right[j[both]].tolist(), strict=True)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pid, linked weight, and the pid it is joined to, of all points with a link."""
        pids = self.a.pids if self.same else np.concatenate([self.a.pids, self.b.pids])
        if not self.x:
            none = np.zeros(0, np.int64)
            return none, none, none
        label = joined(np.concatenate(self.x), np.concatenate(self.y), self.n)
        some = np.flatnonzero(self.links)
        return pids[some], self.links[some], pids[label[some]]


TREE = ["units", "pids", "weights", "nodes"]


def _planted(points: pa.Table) -> pa.Table:
    """The tree of one block."""
    points = points.sort_by("pid")
    units = _matrix(points.column("unit"))
    order, nodes = build_tree(units)
    pids = points.column("pid").to_numpy()[order]
    weights = points.column("weight").to_numpy()[order]
    cell = points.column("cell")[0].as_py()
    values = [cell, int(weights.sum()), int(pids[0]), units[order].tobytes(), pids.tobytes(), weights.tobytes(), nodes.tobytes()]
    values.append(cell)
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.string()]
    names = ["cell", "total", "first", *TREE, "name"]
    return pa.table({n: pa.array([v], k) for n, v, k in zip(names, values, kinds, strict=True)})


def block_pairs(cells: DataFrame, splits: int, tau: float, scratch: Scratch) -> DataFrame:
    """``a, b, whole``: pairs of blocks that may hold links; the cells' trees are traversed together, level by level."""
    parents = cells.where("parent IS NOT NULL").select(F.col("parent").alias("cell")).distinct()
    blocks = cells.join(parents, "cell", "left_anti")
    below = cells.where("parent IS NOT NULL").unionByName(blocks.withColumn("parent", F.col("cell")))
    below = scratch.store(below, "below")
    first = cells.where("parent IS NULL")
    pairs = first.select(F.col("cell").alias("a"), F.col("cell").alias("b"), F.lit(False).alias("whole"))
    left = below.select(*[F.col(c).alias(f"{c}_a") for c in below.columns])
    right = below.select(*[F.col(c).alias(f"{c}_b") for c in below.columns])
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    reach = F.col("radius_a") + F.col("radius_b")
    for _ in range(splits):
        met = pairs.join(left, F.col("a") == F.col("parent_a")).join(right, F.col("b") == F.col("parent_b"))
        met = met.where((F.col("a") != F.col("b")) | (F.col("cell_a") <= F.col("cell_b")))
        met = met.withColumn("apart", apart).where(F.coalesce(F.col("apart") <= reach + tau + SLACK, F.lit(True)))
        whole = (F.col("cell_a") != F.col("cell_b")) & (F.col("apart") + reach + SLACK < tau)
        pairs = scratch.store(
            met.select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), F.coalesce(whole, F.lit(False)).alias("whole")), "pairs"
        )
    return pairs


def links(points: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """``pid, links, joined`` for ``points (pid, unit, weight)``: parts of the linked weight of a point, each with a point
    that it is joined to. Parts have to be added up."""
    tau = sqrt(2 - 2 * cosine)
    placed, cells, splits = upper_tree(points, scratch)
    schema = "cell string, total bigint, first bigint, units binary, pids binary, weights binary, nodes binary, name string"
    folder = scratch_folder(points.sparkSession, "covertree-trees")
    planted = placed.groupBy("cell").applyInArrow(_planted, schema)
    planted.select("name", "total", "first", *TREE, F.col("cell")).write.partitionBy("cell").parquet(folder)
    trees = points.sparkSession.read.schema("name string, total bigint, first bigint").parquet(folder)
    trees = trees.select(F.col("name").alias("cell"), "total", "first")
    pairs = block_pairs(cells, splits, tau, scratch)

    def traverse(tile: pa.Table) -> pa.Table:
        files, path = filesystem(folder)
        found, at_hand = [], {}
        for a, b in sorted(zip(tile.column("a").to_pylist(), tile.column("b").to_pylist(), strict=True)):
            # A tile needs the trees of one block of its rows and of those of its columns at a time.
            wanted = {a, *tile.column("b").to_pylist()}
            at_hand = {cell: tree for cell, tree in at_hand.items() if cell in wanted}
            for cell in {a, b} - set(at_hand):
                row = pq.read_table(f"{path}/cell={cell}", filesystem=files, columns=TREE, partitioning=None).to_pylist()[0]
                at_hand[cell] = Tree(*[row[c] for c in TREE])
            work = DualTraversal(at_hand[a], None if a == b else at_hand[b], cosine)
            work.run()
            found.append(pa.table(dict(zip(("pid", "links", "joined"), work.rows(), strict=True))))
        return pa.concat_tables(found)

    blocks = trees.count()
    tiles = max(-(-blocks // TILE), min(blocks, FEW_TILES), 1)
    tile_a, tile_b = (F.pmod(F.xxhash64(c), F.lit(tiles)).alias(f"tile_{c}") for c in ("a", "b"))
    opened = pairs.where("NOT whole").select("a", "b", tile_a, tile_b)
    # Pairs are small and their work is not, so tasks are counted by pairs of tiles and not by bytes.
    tasks = min(tiles * tiles, MOST_TASKS)
    found = opened.repartition(tasks, "tile_a", "tile_b").groupBy("tile_a", "tile_b").applyInArrow(traverse, "pid bigint, links bigint, joined bigint")
    # Blocks linked as a whole: every point of the one with every point of the other.
    whole = pairs.where("whole").select("a", "b")
    whole = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = trees.select("cell", "total", "first")
    partners = whole.join(known.withColumnRenamed("cell", "b"), "b")
    per_block = partners.groupBy("a").agg(F.sum("total").alias("links"), F.min("first").alias("joined"))
    by_block = placed.join(per_block.withColumnRenamed("a", "cell"), "cell").select("pid", "links", "joined")
    firsts = partners.select("a", F.col("first").alias("joined")).join(known.withColumnRenamed("cell", "a"), "a")
    between = firsts.select(F.col("first").alias("pid"), F.lit(0).cast("bigint").alias("links"), "joined")
    return found.unionByName(by_block).unionByName(between)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links``, ``component_id``, ``kept``."""
    if not -1 < cosine < 1:
        raise ValueError("cosine must be between -1 and 1")
    scratch = Scratch("covertree")
    rows = scratch.store(vectors.select(F.col(vec_id).alias("vec_id"), unit_vector(vector).alias("unit")), "rows")
    some = rows.where("unit IS NOT NULL")
    equal = some.groupBy("unit").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
    points = scratch.store(equal.withColumn("pid", F.monotonically_increasing_id()), "points")
    parts = scratch.store(links(points.select("pid", "unit", "weight"), cosine, scratch), "links")
    edges = parts.where("pid <> joined").select(F.col("pid").alias("a"), F.col("joined").alias("b"))
    of = components(edges, scratch)
    counts = parts.groupBy("pid").agg(F.sum("links").alias("links"))
    named = points.select("pid", "unit", "weight", "first_id").join(of.withColumnRenamed("key", "pid"), "pid", "left")
    named = named.join(counts, "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    total = F.col("weight") - 1 + F.coalesce("links", F.lit(0))
    known = named.join(smallest, "component").select("unit", total.alias("n_links"), "component_id")
    joined = rows.join(known, "unit", "left")
    component = F.when(F.col("unit").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    done = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("vec_id", vec_id)


_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
    AND list_cosine_similarity(x.e, y.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


@query("op13_cover_tree_pairs", _SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"))
