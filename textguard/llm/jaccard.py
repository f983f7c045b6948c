"""Exact Jaccard join of documents by their word shingles, as a metric-space join.

Jaccard distance is a metric; two sets are similar (J >= 0.8) at a distance of at most 0.2.

1. A global order of shingles puts frequent ones last (any order is right; which are frequent is taken from a sample). Two similar
   sets share a shingle among the first of each. Documents that share no first shingle with any other one, or
   that have too many rare shingles to themselves, are similar to none and need nothing more. Nearly all documents are at distance 1
   from each other, so this is what pivots could not tell apart.
2. What is connected by shared first shingles is a region. Every document is in one region, and so is every pair of similar ones.
3. A region too large for one task is cut into Voronoi cells: each member goes to its nearest pivot, members at distance 1 from all
   pivots to a cell of their own. A similar pair may lie in two cells, x near p and y near q, with d(x, q) <= d(x, p) + 0.4;
   such x are also members, as guests, of every earlier cell q. (Members at 0.8 or more from all pivots are guests of the
   cell without a pivot.) So a similar pair meets in one cell, with at least one of the two at home there. Which of them that is may change
   from round to round, so each member keeps the rounds it was at home in. Members within 0.2 of the pivot
   are one class; once linked to it, they stay in the cell only if a member outside the class is near enough for a link by the triangle
   inequality. Cells are regions again and are cut in turn.
4. A region that fits is joined in one task, member by member as pivot: known distances to earlier pivots exclude whoever differs by more
   than 0.2, members of one class are not compared, and neither are those without a first shingle in common, in an order of the region's own
   that puts its rarest first. If cells do not get smaller, the region is joined in blocks of members, all
   pairs of blocks.

Documents with equal sets are one point. Links are decided on whole sets; classes are the connected components over them.

Sets and shingles are told apart by 64-bit hashes. Defined results: null, empty and blank texts have
no shingles and are linked with nothing; a text of fewer than five words is one shingle; null ids count as larger
than all others in ``component_id``. Equal rows share a class. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import Scratch, query, table
from textguard.llm.components import components
from textguard.llm.filters import BitFilter, bit_filter
from textguard.llm.shingles import in_chunks_of, shingle_sets
from textguard.session import small_batches

SAMPLE_OF = 16  # one document in so many shows which shingles are frequent
FREQUENT = 4  # in so many sampled documents
BATCH_ROWS = 1000  # documents that come to a Python worker at once, and
RANGE_BYTES = 1 << 18  # bytes of their texts that it works on at once
FEW = 64  # members of a region that are compared without a look at their first shingles
LEAF = 1_500_000  # shingles of a region that one task joins
PIVOTS = 32
MAX_ROUNDS = 12
CROWD = 64  # regions that are so many times smaller than a leaf share groups
RADIUS, SLACK = 0.2, 1e-9  # the slack only lets more members be compared
COUNTED = np.uint64(2**64 * 3 // 10)  # hashes below it, of rare shingles, are counted in full
_SHARE, _OF = 4, 5  # similar: inter / union >= 4 / 5


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        # Only the texts of one range become Python strings at a time.
        for lo, hi in in_chunks_of(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), RANGE_BYTES):
            part = batch.slice(lo, hi - lo)
            yield part, shingle_sets(part.column("text").to_pylist())


def _key(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _first(shingles: np.ndarray, frequent: BitFilter) -> tuple[np.ndarray, int, int, int]:
    """First shingles, rare ones first, and three counts. The first n - ceil(0.8 n) + 1 (first count) are such that
    similar sets have one of them in common; all rare ones below COUNTED (second count) are among what is returned;
    the third says how many of those returned are rare (all there are, if frequent ones follow)."""
    n = len(shingles)
    size = n - -(-_SHARE * n // _OF) + 1
    often = frequent(shingles)
    rare = shingles[~often]
    counted = int(np.searchsorted(rare, COUNTED))
    if len(rare) >= size:
        return rare[: max(size, counted)], size, counted, max(size, counted)
    return np.concatenate([rare, shingles[often][: size - len(rare)]]), size, counted, len(rare)


def _signed(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64))


def frequent_shingles(docs: DataFrame, scratch: Scratch) -> BitFilter:
    """Shingles that several documents of the sample have. This sets the order only; no result depends on it."""

    def run(batches):
        for _, sets in _sets_of(batches):
            yield pa.RecordBatch.from_arrays([_signed(sets)], ["h"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_OF)) == 0).select("doc_id", "text").distinct()
    counted = drawn.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return bit_filter(scratch.store(counted.select("h"), "frequent"), "h")


def shared_firsts(docs: DataFrame, frequent: BitFilter, scratch: Scratch) -> BitFilter:
    """First shingles that at least two different sets have."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for _, sets in _sets_of(batches):
            firsts = [_first(s, shared.value)[0] if len(s) else s for s in sets]
            keys = np.repeat(np.array([_key(s) for s in sets], np.int64), [len(f) for f in firsts])
            yield pa.RecordBatch.from_arrays([_signed(firsts), pa.array(keys)], ["h", "key"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "h bigint, key bigint")
    several = rows.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    return bit_filter(scratch.store(several.select("h"), "shared"), "h")


def points(docs: DataFrame, frequent: BitFilter, shared_first: BitFilter) -> DataFrame:
    """``doc_id, text_hash, key, n, reach, shingles, firsts`` per document; the last two only where a partner is possible.

    D, the size of the symmetric difference, is at least what two sets have alone; they are similar exactly if 9 D <= n + m, so
    only if their reaches n - 9 alone are not negative together.
    """
    filters = docs.sparkSession.sparkContext.broadcast((frequent, shared_first))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    new = {"key": pa.int64(), "n": pa.int64(), "reach": pa.int64(), "shingles": pa.list_(pa.int64()), "firsts": pa.list_(pa.int64())}

    def run(batches):
        often, common = filters.value
        for batch, sets in _sets_of(batches):
            out: list[tuple] = []
            for s in sets:
                if not len(s):
                    out.append((None, 0, None, None, None))
                    continue
                first, size, counted, _ = _first(s, often)
                hit = common(first)
                # Counted shingles that no other set has lie between this set and every other one. A partner has at most
                # 5 n / 4 shingles, so a quarter of n may be alone.
                alone = counted - int(hit[:counted].sum())
                possible = hit[:size].any() and 4 * alone <= len(s)
                some = (s.view(np.int64), first[:size].view(np.int64)[hit[:size]]) if possible else (None, None)
                out.append((_key(s), len(s), len(s) - 9 * alone, *some))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), new.values(), strict=True)]
            kept = [batch.column("doc_id"), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["doc_id", "text_hash", *new])

    schema = f"doc_id {id_type}, text_hash bigint, key bigint, n bigint, reach bigint, shingles array<bigint>, firsts array<bigint>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def first_regions(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, region``: what shared first shingles connect.

    Similar sets differ in size by a factor of 5/4 at most, so a shingle connects sets within a window of sizes; each
    set is in its own window and the next one. Of those with a shingle and window in common, all that can be similar to any are tied to the
    one of largest reach: whoever it is too far from is too far from all.
    """
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(_OF / _SHARE)) + 1e-9)
    placed = sets.select("key", "reach", F.explode(F.array(own, own + 1)).alias("w"), "firsts")
    firsts = placed.select("key", "reach", "w", F.explode("firsts").alias("first"))
    firsts = scratch.store(firsts.select("key", "reach", F.xxhash64("first", "w").alias("h")), "firsts")
    # Groups and their members are dealt out once, for the heads and for the join with them.
    firsts_by = firsts.repartition("h")
    best = F.max(F.struct("reach", "key")).alias("best")
    heads = firsts_by.groupBy("h").agg(best, F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    heads = heads.select("h", F.col("best.reach").alias("head_reach"), F.col("best.key").alias("head"))
    tied = firsts_by.join(heads, "h").where("key <> head AND reach + head_reach >= 0")
    # Members of a group share many shingles, with many different heads. Tying each member to its best head, and that one to the member's
    # other heads, connects the same; the latter ties are the same for most members.
    ties = tied.groupBy("key").agg(F.collect_set("head").alias("heads"), F.max(F.struct("head_reach", "head")).alias("best"))
    ties = scratch.store(ties.select("key", "heads", F.col("best.head").alias("top")), "heads")
    scratch.drop(firsts)
    own = ties.select(F.col("key").alias("a"), F.col("top").alias("b"))
    others = ties.select(F.col("top").alias("a"), F.explode("heads").alias("b")).where("a <> b").distinct()
    found = components(scratch.store(own.unionByName(others), "ties"), scratch)
    scratch.drop(ties)
    return found.withColumnRenamed("component", "region")


class Sets:
    """Several sets of shingles, side by side, each sorted as unsigned numbers."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.flat = lists.flatten().to_numpy().view(np.uint64)
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.start = self.sizes.cumsum() - self.sizes
        # Shingles by their places among the different ones, so that membership is a look into a table.
        self.known, self.place, self.held_by = np.unique(self.flat, return_inverse=True, return_counts=True)
        self.marks = np.zeros(len(self.known), bool)

    def counts(self, of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """How many of each set's members are in ``wanted`` (sorted), for the sets ``of``."""
        at = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        at = at[self.known[at] == wanted]
        self.marks[at] = True
        if len(of) < len(self.sizes):
            sizes = self.sizes[of]
            start = sizes.cumsum() - sizes
            hit = self.marks[self.place[np.arange(sizes.sum()) + np.repeat(self.start[of] - start, sizes)]]
        else:
            start, hit = self.start, self.marks[self.place]
        self.marks[at] = False
        return np.add.reduceat(hit, start, dtype=np.int64)

    def firsts(self) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
        """The first shingles of each set, those that few sets have first, and the sets that have each of them among theirs. Similar sets
        share one of them. Shingles of one set are left out."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((self.place, self.held_by[self.place], owner))
        rank = np.arange(len(order)) - np.repeat(self.start, self.sizes)
        sizes = self.sizes - -(-_SHARE * self.sizes // _OF) + 1
        first = order[(rank < np.repeat(sizes, self.sizes)) & (self.held_by[self.place[order]] > 1)]
        place, owner = self.place[first], owner[first]
        of_set = np.split(place, np.searchsorted(owner, np.arange(1, len(self.sizes))))
        by = np.argsort(place, kind="stable")
        edges = np.flatnonzero(np.diff(place[by], prepend=-1))
        return of_set, dict(zip(place[by][edges].tolist(), np.split(owner[by], edges[1:]), strict=False))

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.start[k] : self.start[k] + self.sizes[k]]


def _similar(inter: np.ndarray, union: np.ndarray) -> np.ndarray:
    return 100 * inter >= 80 * union


def join_members(sets: Sets, home: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of a region, enough of them to join all that similar pairs with one of them at home join.

    ``home`` is a truth value or has a bit for each round; in every round one of the two must have been at home.
    """
    n = len(sets.sizes)
    part, waits, away = np.arange(n), np.ones(n, bool), ~home
    firsts, sets_with = sets.firsts() if n > FEW else ([], {})
    distances: list[np.ndarray] = []
    found = []
    for x in range(n):
        waits[x] = False
        size = sets.sizes[x]
        near = waits & (part != part[x]) & (5 * sets.sizes >= 4 * size) & (5 * size >= 4 * sets.sizes)
        if away[x]:
            near &= (away & away[x]) == 0
        if n > FEW:
            shared = np.zeros(n, bool)
            for first in firsts[x].tolist():
                shared[sets_with[first]] = True
            near &= shared
        for known in distances:
            near &= np.abs(known - known[x]) <= RADIUS + SLACK
        to = np.flatnonzero(near)
        if not len(to):
            continue
        # Where many are compared, all are, and the distances then exclude pairs of others.
        of = np.arange(n) if 4 * len(to) > n else to
        inter = sets.counts(of, sets[x])
        union = sets.sizes[of] + size - inter
        if len(of) == n:
            distances = [*distances[-7:], 1 - inter / union]
        linked = of[_similar(inter, union) & near[of]]
        if len(linked):
            found += [(x, int(y)) for y in linked]
            part[np.isin(part, part[linked])] = part[x]
    return found


def _joined(rows: pa.Table) -> pa.Table:
    """Links in one group of whole regions."""
    found: list[tuple[int, int]] = []
    if rows.num_rows:
        rows = rows.sort_by([("region", "ascending"), ("key", "ascending")])
        keys = rows.column("key").to_numpy()
        home = rows.column("home").to_numpy()
        regions = rows.column("region").combine_chunks().dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.diff(regions, prepend=-1, append=-1))
        for lo, hi in zip(edges, edges[1:], strict=False):
            links_of = join_members(Sets(rows.column("shingles").slice(lo, hi - lo)), home[lo:hi])
            found += [(keys[lo + x], keys[lo + y]) for x, y in links_of]
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


NO_PIVOT = -1
_CELL_SCHEMA = "region string, key bigint, cell int, home boolean, distance double, pivot bigint, linked boolean"


def _to_cells(members: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each member's own cell, and the earlier cells that it is a guest of."""
    out: dict[str, list] = {c: [] for c in ("region", "key", "cell", "home", "distance", "pivot", "linked")}
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.bool_())
    if members.num_rows and pivots.num_rows:
        pivots = pivots.sort_by("key")
        sets, centres = Sets(members.column("shingles")), Sets(pivots.column("shingles"))
        n, k = members.num_rows, pivots.num_rows
        every = np.arange(n)
        inter = np.stack([sets.counts(every, centres[c]) for c in range(k)], axis=1)
        union = sets.sizes[:, None] + centres.sizes - inter
        distance = 1 - inter / union
        nearest = distance.argmin(axis=1)
        least = distance[every, nearest]
        own = np.where(least < 1, nearest, NO_PIVOT)
        member_of = (distance <= least[:, None] + 2 * RADIUS + SLACK) & (np.arange(k) < nearest[:, None]) & (least < 1)[:, None]
        member_of[every[own >= 0], own[own >= 0]] = True
        row, cell = np.nonzero(member_of)
        alone = np.flatnonzero((own == NO_PIVOT) | (least >= 1 - RADIUS - SLACK))
        pivot_keys = pivots.column("key").to_numpy()
        keys = members.column("key").to_numpy()
        values = {
            "key": np.concatenate([keys[row], keys[alone]]),
            "cell": np.concatenate([cell, np.full(len(alone), NO_PIVOT)]),
            "home": np.concatenate([own[row] == cell, own[alone] == NO_PIVOT]),
            "distance": np.concatenate([distance[row, cell], np.ones(len(alone))]),
            "pivot": np.concatenate([pivot_keys[cell], keys[alone]]),
            "linked": np.concatenate([_similar(inter, union)[row, cell], np.zeros(len(alone), bool)]),
        }
        name = members.column("region")[0].as_py()
        out = {"region": [name] * len(values["key"]), **values}
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})


def _cut(large: DataFrame, sets: DataFrame, number: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to pivots; members of the cells (``region, key, n, home``) that may hold more; regions that cells do not make smaller.

    ``home`` has a bit for each round, set unless the member was a guest then.
    """
    draw = F.xxhash64("key", F.lit(number))
    sizes = large.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    sizes = scratch.store(sizes.withColumn("slices", F.ceil(F.col("total") / LEAF).cast("int")), "sizes")
    # A bounded number of pivots per region: the smallest draws of each of so many shares.
    share = F.pmod(draw, F.lit(PIVOTS)).cast("int")
    chosen = large.groupBy("region", share.alias("share")).agg(F.min_by("key", F.struct(draw, "key")).alias("key"))
    slices = sizes.select("region", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    pivots = chosen.select("region", "key").join(slices, "region").join(sets, "key").select("region", "slice", "key", "shingles")
    pivots = scratch.store(pivots, "pivots")
    part = F.pmod(F.xxhash64("key", F.lit(-1)), "slices").cast("int").alias("slice")
    dealt = large.join(sizes, "region").select("region", part, "key").join(sets, "key")
    dealt = dealt.select("region", "slice", "key", "shingles")
    cells = dealt.groupBy("region", "slice").cogroup(pivots.groupBy("region", "slice")).applyInArrow(_to_cells, _CELL_SCHEMA)
    cells = scratch.store(cells, "cells")
    linked = cells.where("linked AND key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    name = F.concat_ws(".", "region", F.lit(number), "cell")
    in_cells = cells.select("region", name.alias("child"), "key", "home", "distance", "linked")
    outside = in_cells.where("NOT linked").groupBy("child").agg(F.min("distance").alias("nearest"))
    kept = in_cells.join(outside, "child").where(~F.col("linked") | (F.col("distance") >= F.col("nearest") - RADIUS - SLACK))
    kept = scratch.store(kept.select("region", "child", "key", "home"), "kept")
    # Guests alone have nothing to join. Cells that hold most of their region again, or all cells together far more, do not help.
    per_cell = kept.groupBy("region", "child").agg(F.count(F.lit(1)).alias("m"), F.bool_or("home").alias("some"))
    grown = per_cell.groupBy("region").agg(F.sum("m").alias("all"), F.max("m").alias("most")).join(sizes, "region")
    stuck = scratch.store(grown.where("all > 3 * members OR most > 0.9 * members").select("region"), "stuck")
    some = per_cell.where("some AND m > 1").select("child").join(kept.select("region", "child", "key", "home"), "child")
    further = some.join(stuck, "region", "left_anti").withColumnRenamed("home", "here")
    bits = F.when(F.col("here"), F.col("home")).otherwise(F.col("home").bitwiseAND(~(1 << number))).alias("home")
    further = further.join(large.select("region", "key", "n", "home"), ["region", "key"]).select(F.col("child").alias("region"), "key", "n", bits)
    further = scratch.store(further, "members")
    scratch.drop(kept)
    return linked, further, large.join(stuck, "region", "left_semi")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Regions as all pairs of blocks of their members, each pair a region of its own."""
    total = members.groupBy("region").agg(F.ceil(2 * F.sum("n") / LEAF).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key", F.lit(-2)), "blocks").cast("int")
    placed = members.join(total, "region").withColumn("block", block)
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(".", "region", F.lit("b"), F.least("block", "other"), F.greatest("block", "other"))
    return other.select(pair.alias("region"), "key", "n", "home")


def links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: links between similar sets, enough of them to join all that similar pairs join."""
    first = first_regions(sets, scratch).join(sets.select("key", "n"), "key")
    first = first.select(F.col("region").cast("string").alias("region"), "key", "n", F.lit(-1).alias("home"))
    members = scratch.store(first, "members")
    # Whole sets are dealt out by key once. Those of large regions lie apart: what cuts these reads no others.
    total = members.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")).where("m > 1").select("region", "total")
    placed = members.join(total, "region").withColumn("large", F.col("total") > LEAF).join(sets.select("key", "shingles"), "key")
    whole = scratch.store(placed.select("region", "key", "n", "home", "total", "shingles", "large"), "placed", "large")
    scratch.drop(sets, members)
    leaves = whole.where("NOT large").drop("large")
    contents = whole.where("large").select("key", "n", "shingles")
    members = whole.where("large").select("region", "key", "n", "home")
    done: DataFrame | None = None
    number = 0
    further: DataFrame | None = None
    while not members.isEmpty():
        if number == MAX_ROUNDS:
            blocks, further = members, None
        else:
            linked, further, blocks = _cut(members, contents, number, scratch)
            done = linked if done is None else done.unionByName(linked)
        small = scratch.store(_in_blocks(blocks).withColumn("total", F.lit(LEAF).cast("bigint")), "blocks")
        if further is not None:
            # Where one round finds all members away, there is no pair to compare.
            of = [F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"), F.bit_or("home").alias("homes")]
            sized = further.groupBy("region").agg(*of).where("m > 1 AND homes = -1").select("region", "total")
            known = scratch.store(further.join(sized, "region"), "regions")
            small = small.unionByName(known.where(F.col("total") <= LEAF).select(small.columns))
            further = known.where(F.col("total") > LEAF).drop("total")
        leaves = leaves.unionByName(small.join(contents.select("key", "shingles"), "key").select(leaves.columns))
        if further is None:
            break
        members = further
        number += 1
    # Regions that are small by far share groups, so that few tasks have thousands of groups; a group has about as much as one region may.
    light = F.col("total") * CROWD <= LEAF
    crowds = 1 + (whole.where(~F.col("large") & light).agg(F.sum("n")).first()[0] or 0) // LEAF
    crowds = max(crowds, 4 * whole.sparkSession.sparkContext.defaultParallelism)
    crowd = F.coalesce(F.when(light, F.pmod(F.xxhash64("region"), F.lit(crowds))).cast("string"), F.concat(F.lit("r"), "region"))
    rows = leaves.select(crowd.alias("crowd"), "region", "key", "home", "shingles")
    found = rows.groupBy("crowd").applyInArrow(_joined, "a bigint, b bigint")
    return scratch.store(found if done is None else found.unionByName(done), "links")


def _classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, key, n`` per document, and ``key, component`` of all sets that are linked with others."""
    frequent = frequent_shingles(docs, scratch)
    every = scratch.store(points(docs, frequent, shared_firsts(docs, frequent, scratch)), "points")
    possible = every.where("firsts IS NOT NULL").groupBy("key")
    sets = scratch.store(possible.agg(*[F.first(c).alias(c) for c in ("n", "reach", "shingles", "firsts")]), "sets")
    rows = scratch.store(every.select("doc_id", "text_hash", "key", "n"), "rows")
    scratch.drop(every)
    return rows, components(links(sets, scratch), scratch)


def classify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, text_hash, n_shingles, component_id`` and ``component``, a class
    number that also tells classes without ids apart (null without shingles)."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        rows, parts = _classes(docs.select("doc_id", "text"), Scratch("jaccard"))
    smallest = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    named = smallest.join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_key = named.join(ids, "component").select("key", "component", "component_id")
    joined = rows.select("doc_id", "text_hash", "key", F.col("n").alias("n_shingles")).join(by_key, "key", "left")
    component_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component_id.alias("component_id"), "component")


_SQL = r"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 80 * (na.n + nb.n - inter)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT o.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, o.doc_id) AS component_id
FROM documents o LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = o.doc_id"""


@query("op10_jaccard_regions", _SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")
