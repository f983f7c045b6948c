"""Benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies come from all documents (terms hashed to ``TERM_BITS`` bits).
2. A randomised SVD of the TF-IDF matrix of benchmark passages gives the latent space of a block: a task multiplies
   the block's rows with a sketch, and the small factorisations run on the driver. The space has the fewest leading dimensions in which
   every passage keeps ``MIN_KEPT`` of its norm, so what passages have in common counts and what is left of each alone is cut. A
   passage's vector is scaled by what it lost: a verbatim copy scores the same in a space of any rank.
3. Windows of every whole document are folded into the space, and their cosine with every passage is taken. The
   norm of a window counts all its terms. Windows have ``WINDOWS`` words; passages shorter than the shortest have windows
   of their own length at every word, and so has every passage where its first and last word stand as far apart as in it, so
   that a verbatim copy always has a window of cosine 1. Left out are only windows that cannot reach the cosine, by the
   sum of the largest score of each word with any passage.
4. Windows near an item are merged, and the longest common subsequence of words decides: a
   long one alone, a shorter one (a paraphrase) if the item's answer, its last sentence, is there as well.

Items are searched in blocks of at most ``BLOCK_PASSAGES`` passages (an item with more is a block of its own), and
``PASS_BLOCKS`` blocks are broadcast together. A worker hashes the words of its texts once and searches one part after the other, of
which it holds one at a time, however large the benchmark.

Defined results: null and empty texts and items match nothing. Items under ``SHORT_ITEM`` words must stand there whole, word
after word. Item ids may have any type; items with a null id are reported with it.
Equal rows get equal results; equal items are all reported. Extra columns are kept by :func:`with_leaks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import chunks, query, table
from textguard.llm.shingles import in_chunks, word_hashes

TERM_BITS = 17
POWER_ROUNDS = 2
WINDOWS, CELL = (12, 24, 48), 3  # words; windows begin at every quarter of their length, in whole cells
ITEM_WORDS = 64  # longer items are searched by passages of this length
SLACK = 1e-3  # of the cosine: windows are chosen in float32, their cosine is then taken in float64
MIN_COSINE = 0.4
MIN_KEPT = 0.8
MIN_LCS = 0.75
MIN_PARAPHRASE_LCS = 0.5
MIN_ANSWER_LCS = 0.7
SHORT_ITEM = 8
BLOCK_PASSAGES = 192
PASS_BLOCKS = 8
LEAK = "array<struct<item_id:{},cosine:double,lcs:double,answer:boolean>>"


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed idf of every term slot, from all documents; at most 2**TERM_BITS counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << TERM_BITS, np.int64)
        n = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for lo, hi in in_chunks(texts):
                hashes, begin = word_hashes(texts[lo:hi], letters_only=True)
                of_text = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(begin))
                seen = np.unique((of_text << TERM_BITS) | (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64))
                counts += np.bincount(seen & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(counts[slots], n))], ["slot", "n"])

    got = docs.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = got["slot"].to_numpy(), got["n"].to_numpy()
    total = int(n[slots == -1].sum())
    counts = np.zeros(1 << TERM_BITS)
    counts[slots[slots >= 0]] = n[slots >= 0]
    return np.log((total + 1) / (counts + 1)) + 0.1


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    answer: np.ndarray


@dataclass
class Space:
    """Latent space of a block of items."""

    items: list[Item]
    idf: np.ndarray
    terms: np.ndarray  # sorted word hashes of the block's vocabulary
    basis: np.ndarray  # a row per term
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # a row per passage, scaled so that it scores itself as if whole
    of_vector: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the item of each vector
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # words of each passage
    ends: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # row of each passage's first and last word

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        return self.idf[(hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)]

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary row of each word, or -1."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def scores(self) -> np.ndarray:
        """What a word adds to the dot product with each vector: a row per term, and one of zeros for other words."""
        if not hasattr(self, "_scores"):
            by_term = (self.weights(self.terms)[:, None] * (self.basis @ self.vectors.T)).astype(np.float32)
            self._scores = np.concatenate([by_term, np.zeros_like(by_term[:1])])
        return self._scores


def _answer(text: str) -> str:
    """The last sentence or line."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


def _passages(words: np.ndarray) -> range:
    """Where an item's passages begin."""
    return range(0, max(1, len(words) - ITEM_WORDS // 2), ITEM_WORDS)


def read_items(benchmark: DataFrame, block: int = BLOCK_PASSAGES) -> Iterator[list[Item]]:
    """Items in blocks of at most ``block`` passages, or of one item with more."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator()
    part: list[Item] = []
    held = 0
    for item_id, text in rows:
        words = word_hashes([text], letters_only=True)[0]
        if not len(words):
            continue
        more = len(_passages(words))
        if part and held + more > block:
            yield part
            part, held = [], 0
        part.append(Item(item_id, words, word_hashes([_answer(text)], letters_only=True)[0]))
        held += more
    if part:
        yield part


def _tf_idf(space: Space, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = space.rows(words)
    values = space.weights(words)
    values = values / max(float(np.sqrt((values**2).sum())), 1e-12)
    return rows, values


def latent_space(spark: SparkSession, items: list[Item], idf: np.ndarray, seed: int = 1) -> Space:
    """Randomised SVD of the items' TF-IDF rows, cut where each passage still keeps ``MIN_KEPT``; a task takes the products."""
    terms = np.unique(np.concatenate([i.words for i in items]))
    space = Space(items, idf, terms, np.zeros((len(terms), 0)))
    passages = [(k, lo) for k, i in enumerate(items) for lo in _passages(i.words)]
    words = [items[k].words[lo : lo + ITEM_WORDS] for k, lo in passages]
    space.of_vector = np.array([k for k, _ in passages])
    space.sizes = np.array([len(w) for w in words])
    space.ends = np.array([space.rows(w[[0, -1]]) for w in words])
    size = min(len(words), len(terms))
    rows = spark.createDataFrame([(k, lo) for k, lo in passages], "k int, at int").coalesce(1)
    known = spark.sparkContext.broadcast(space)

    def product(basis: np.ndarray) -> np.ndarray:
        """Transposed matrix times matrix times ``basis``."""
        shared = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(shared.value)
            for batch in batches:
                for k, lo in zip(batch["k"], batch["at"], strict=True):
                    at, values = _tf_idf(known.value, known.value.items[k].words[lo : lo + ITEM_WORDS])
                    np.add.at(total, at, np.outer(values, values @ shared.value[at]))
            yield pd.DataFrame({"total": [total.astype(np.float32).tobytes()]})

        total = np.zeros_like(basis)
        for row in rows.mapInPandas(run, "total binary").toLocalIterator():
            total += np.frombuffer(row["total"], np.float32).reshape(basis.shape)
        shared.destroy()
        return total

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms), size)))[0]
    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(product(basis))[0]
    _, turn = np.linalg.eigh(basis.T @ product(basis))
    basis = (basis @ turn[:, ::-1]).astype(np.float32)
    known.destroy()
    weighted = [_tf_idf(space, w) for w in words]
    vectors = np.stack([(values[:, None] * basis[at]).sum(axis=0) for at, values in weighted])
    whole = np.array([(np.bincount(at, values) ** 2).sum() for at, values in weighted])
    kept = (vectors**2).cumsum(axis=1)
    enough = np.flatnonzero((kept >= MIN_KEPT**2 * whole[:, None]).all(axis=0))
    rank = int(enough[0]) + 1 if len(enough) else size
    space.basis = basis[:, :rank]
    space.vectors = vectors[:, :rank] * (np.sqrt(whole) / np.maximum(kept[:, rank - 1], 1e-12))[:, None]
    return space


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with a bit per word of ``a``."""
    places: dict[int, int] = {}
    for k, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        match = places.get(word)
        if match is not None:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _stands(item: np.ndarray, region: np.ndarray) -> bool:
    """All words of an item stand in a region, one after the other."""
    if len(region) < len(item):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(region, len(item)) == item).all(axis=1).any())


def _own_windows(space: Space, rows: np.ndarray, text_end: np.ndarray, every: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and vectors to compare, of windows as long as a passage."""
    known = np.concatenate([[0], (rows >= 0).cumsum()])
    order = np.argsort(rows, kind="stable")
    of_row = np.searchsorted(rows[order], np.arange(len(space.terms) + 1))
    for size in np.unique(space.sizes):
        vectors = np.flatnonzero(space.sizes == size)
        if size < WINDOWS[0]:
            scores = space.scores()[:, vectors]
            start = np.arange(max(0, len(rows) - size + 1))
            start = start[start + size <= text_end[start]]
            best = np.concatenate([[0.0], scores.max(axis=1).astype(np.float64).clip(0)[rows].cumsum()])
            near = best[start + size] - best[start] >= (min_cosine - SLACK) * np.sqrt(every[start + size] - every[start])
            yield start[near], start[near] + size, vectors
            continue
        firsts, lasts = space.ends[vectors, 0], space.ends[vectors, 1]
        for first in np.unique(firsts):
            start = order[of_row[first] : of_row[first + 1]]
            start = start[start + size <= text_end[start]]
            start = start[(known[start + size] - known[start] == size) & np.isin(rows[start + size - 1], lasts[firsts == first])]
            if len(start):
                yield start, start + size, vectors[firsts == first]


def _cells(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cells of ``CELL`` words begin, and the cells where texts begin (with the number of all as last entry)."""
    per_text = -(-np.diff(begin) // CELL)
    first = np.concatenate([[0], per_text.cumsum()])
    text = np.repeat(np.arange(len(per_text)), per_text)
    return begin[text] + (np.arange(first[-1]) - first[text]) * CELL, first


def _near_windows(space: Space, rows: np.ndarray, begin: np.ndarray, every: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and vector of windows of ``WINDOWS`` words whose cosine may be as large as wanted."""
    scores = space.scores()
    at, first = _cells(begin)
    stop = np.append(at, len(rows))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    within = np.arange(len(at)) - first[text]
    best = np.concatenate([[0.0], scores.max(axis=1).astype(np.float64).clip(0)[rows].cumsum()])
    least = min_cosine - SLACK
    starts, ends = [], []
    for size in WINDOWS:
        lo = np.flatnonzero(within % (size // 4 // CELL) == 0)
        hi = np.minimum(lo + size // CELL, first[text[lo] + 1])
        a, b = stop[lo], stop[hi]
        total = every[b] - every[a]
        near = best[b] - best[a] >= least * np.sqrt(total)
        starts.append(lo[near])
        ends.append(hi[near])
    start, end = np.concatenate(starts), np.concatenate(ends)
    if not len(start):
        return
    # Only cells of these windows are summed.
    used = np.zeros(len(at) + 1, np.int64)
    np.add.at(used, start, 1)
    np.add.at(used, end, -1)
    used = used.cumsum()[:-1] > 0
    place = np.concatenate([[0], used.cumsum()])
    kept = np.flatnonzero(used)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    a, b = place[start], place[end]
    need = (least * np.sqrt(every[stop[end]] - every[stop[start]])).astype(np.float32)
    longest = WINDOWS[-1] // CELL
    for lo in range(0, len(kept), 2048):
        w = slice(*np.searchsorted(a, [lo, lo + 2048]))
        if w.start == w.stop:
            continue
        cells = kept[lo : lo + 2048 + longest]
        grid = at[cells][:, None] + np.arange(CELL)[None, :]
        which = np.where(grid < stop[cells + 1][:, None], rows[np.minimum(grid, len(rows) - 1)], -1)
        sums = np.zeros((len(cells) + 1, scores.shape[1]), np.float32)
        for k in range(CELL):
            sums[1:] += scores[which[:, k]]
        np.cumsum(sums, axis=0, out=sums)
        dots = sums[b[w] - lo] - sums[a[w] - lo]
        found, vector = np.nonzero(dots >= need[w, None])
        yield stop[start[w][found]], stop[end[w][found]], vector


def _candidates(space: Space, words: np.ndarray, begin: np.ndarray, min_cosine: float) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
    """Windows near items: (text, item number) to (start, end, cosine)."""
    rows = space.rows(words)
    squares = space.weights(words) ** 2
    every = np.concatenate([[0.0], squares.cumsum()])
    text_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    scores = space.scores()
    pairs = [*_near_windows(space, rows, begin, every, min_cosine)]
    for start, end, vectors in _own_windows(space, rows, begin[text_of + 1], every, min_cosine):
        pairs.append((np.repeat(start, len(vectors)), np.repeat(end, len(vectors)), np.tile(vectors, len(start))))
    found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for start, end, vector in pairs:
        for a, b, v in zip(start.tolist(), end.tolist(), vector.tolist(), strict=True):
            cosine = float(scores[rows[a:b], v].sum(dtype=np.float64) / np.sqrt(max(squares[a:b].sum(), 1e-12)))
            if cosine >= min_cosine:
                found.setdefault((int(text_of[a]), int(space.of_vector[v])), []).append((a, b, cosine))
    return found


def leaks_of(space: Space, words: np.ndarray, begin: np.ndarray, min_cosine: float = MIN_COSINE) -> list[list[tuple]]:
    """(item, cosine, LCS share, answer found) of each item that each text holds, in full or paraphrased."""
    out: list[list[tuple]] = [[] for _ in range(len(begin) - 1)]
    if not len(words) or not space.items:
        return out
    for (text, number), windows in sorted(_candidates(space, words, begin, min_cosine).items()):
        item = space.items[number]
        size = len(item.words)
        first, stop = int(begin[text]), int(begin[text + 1])
        regions: list[list[int]] = []
        for start, end, _ in sorted(windows):
            lo, hi = max(first, start - size), min(stop, end + size)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], hi)
            else:
                regions.append([lo, hi])
        best, best_answer, whole = 0, False, False
        for lo, hi in regions:
            region = words[lo:hi]
            whole = whole or (size < SHORT_ITEM and _stands(item.words, region))
            # The subsequence cannot be longer than the number of the item's words that stand there at all.
            if int(np.isin(item.words, region).sum()) < min(MIN_PARAPHRASE_LCS, MIN_LCS) * size:
                continue
            common = lcs_length(item.words, region)
            if (common, True) > (best, best_answer):
                answer = lcs_length(item.answer, region) >= MIN_ANSWER_LCS * len(item.answer)
                best, best_answer = max((best, best_answer), (common, answer))
        share = best / size
        if size < SHORT_ITEM:
            leak = whole
        else:
            leak = share >= MIN_LCS or (share >= MIN_PARAPHRASE_LCS and best_answer)
        if leak:
            out[text].append((item.item_id, round(max(c for *_, c in windows), 6), share, best_answer))
    return out


def _search(parts: list[Broadcast], text: str, kind: str) -> Column:
    """Leaks of each text of a column; only the texts go through Python."""
    names = ("item_id", "cosine", "lcs", "answer")

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            hashed = [word_hashes(texts[lo:hi], letters_only=True) for lo, hi in in_chunks(texts)]
            out: list[list[dict]] = [[] for _ in texts]
            for part in parts:
                for space in part.value:
                    at = 0
                    for words, begin in hashed:
                        for leaks in leaks_of(space, words, begin):
                            out[at] += [dict(zip(names, leak, strict=True)) for leak in leaks]
                            at += 1
                if len(parts) > 1:
                    del part._value  # read again from the task's disk for the next texts
            yield pd.Series(out, dtype=object)

    return run(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, output: str = "leaks") -> DataFrame:
    """Documents with all their columns and an array of leaks, as ``output`` (a column of that name is replaced)."""
    spark = docs.sparkSession
    kind = LEAK.format(benchmark.schema["item_id"].dataType.simpleString())
    idf = inverse_frequencies(docs)
    spaces = (latent_space(spark, items, idf) for items in read_items(benchmark))
    parts = [spark.sparkContext.broadcast(part) for part in chunks(spaces, PASS_BLOCKS)]
    return docs.withColumn(output, _search(parts, "text", kind) if parts else F.array().cast(kind))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item."""
    name = "_leaks"
    while name in docs.columns:
        name += "_"
    return with_leaks(docs, benchmark, output=name).where(F.size(name) == 0).drop(name)


@query("op3_benchmark_leaks")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = with_leaks(docs, table(spark, folder, "benchmark", "item_id", "text"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*").distinct()
