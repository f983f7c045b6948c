"""Periodic runs of words, found by an enhanced suffix array with the branching-tandem test.

The words of several texts are sorted as suffixes together, each text with numbers of its own, so no suffix of one text
ever equals one of another. From the sort come the suffix array, its inverse (ISA) and the lengths of common
prefixes (LCP). Every boundary of the LCP array splits an interval of suffixes that share ``depth`` words into two parts; for each
suffix i of the smaller part, ISA[i + depth] and ISA[i - depth] tell whether two occurrences of the same ``depth`` words stand
side by side and go on differently: a branching square. No tree is built, and n log n suffixes are tested at most.
The last square of a run is branching, so each run is met; rotating it to the left as far as
it goes gives where the run starts. Squares of one stretch merge into the run of smallest period.

Sorting doubles the compared length in each step and touches only suffixes that are not yet told apart. The classes of each
step are kept; they answer how far two places agree, forwards (LCP) and backwards (rotation).

Defined results: a null, empty or blank text has no words and no runs. Repeated rows and null ids
are handled one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textguard.llm.common import query, table

MIN_LENGTH = 6
MIN_EXPONENT = 4
CHUNK_WORDS = 200_000  # texts sorted together; a longer one is sorted alone


def _classes(codes: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling: the k-th array numbers places by their next 2**k words, in order; the last one tells all apart.

    ``codes`` must end in a number of its own.
    """
    n = len(codes)
    counts = np.bincount(codes)
    rank = (counts.cumsum() - counts).astype(np.int32)[codes]
    levels = [rank]
    open_places = np.flatnonzero(counts[codes] > 1)
    step = 1
    while len(open_places):
        own = rank[open_places].astype(np.int64)
        key = own * n + rank[np.minimum(open_places + step, n - 1)]
        at = key.argsort(kind="stable")
        open_places, own, key = open_places[at], own[at], key[at]
        group = np.ones(len(key), bool)
        group[1:] = np.diff(own) != 0
        part = np.ones(len(key), bool)
        part[1:] = np.diff(key) != 0
        group_at, part_at = np.flatnonzero(group), np.flatnonzero(part)
        sizes = np.diff(part_at, append=len(key))
        shift = np.repeat(part_at, sizes) - np.repeat(group_at, np.diff(group_at, append=len(key)))
        rank = rank.copy()
        rank[open_places] = own + shift
        levels.append(rank)
        open_places = open_places[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


def _agree(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from ``x`` and ``y`` on (or before them) are equal; x < y or y < x, never the same."""
    n = len(levels[0])
    length = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        size = 1 << k
        if back:
            a, b = x - length - size, y - length - size
            fits = np.minimum(a, b) >= 0
        else:
            a, b = x + length, y + length
            fits = np.maximum(a, b) < n
        same = np.zeros(len(x), bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        length[same] += size
    return length


def _reach(values: np.ndarray, at: np.ndarray, or_equal: bool) -> np.ndarray:
    """How many neighbours before each place are all at least (or, for ``or_equal``, above) its value: nearest smaller values by halving
    steps over minima of stretches of powers of two. ``values`` has walls of 0 or less between positive stretches."""
    walls = np.flatnonzero(values <= 0)
    bits = int(np.diff(walls).max(initial=1)).bit_length()
    minima = [values]  # minima[j][k]: the least of the 2**j values up to k
    for j in range(bits - 1):
        last = minima[-1]
        wider = last.copy()
        np.minimum(last[1 << j :], last[: -(1 << j)], out=wider[1 << j :])
        minima.append(wider)
    least = values[at] + or_equal
    place = at.copy()
    for j in reversed(range(bits)):
        back = minima[j][place - 1] >= least
        back &= place >= 1 << j
        place[back] -= 1 << j
    return at - place


def _squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of branching squares that may end a run of ``MIN_EXPONENT`` periods."""
    isa = levels[-1].astype(np.int64)
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    # lcp[k] is that of the suffixes at k - 1 and k; walls of -1 stand at both ends.
    lcp = np.zeros(n + 1, np.int64)
    shared = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[shared] = _agree(levels, sa[shared - 1], sa[shared])
    lcp[0] = lcp[n] = -1
    low = shared - _reach(lcp, shared, or_equal=True) - 1
    high = shared + _reach(lcp[::-1], n - shared, or_equal=False) + 1
    # The interval of boundary k holds the suffixes low .. high - 1; the boundary cuts it before suffix k. All first
    # words of a run's periods but the last start with the same `depth` words, so an interval without that many has no run.
    depth = lcp[shared]
    enough = high - low >= np.where(depth == 1, MIN_LENGTH - 1, MIN_EXPONENT - 1)
    low, cut, high, depth = low[enough], shared[enough], high[enough], depth[enough]
    left_is_small = cut - low <= high - cut
    start, stop = np.where(left_is_small, low, cut), np.where(left_is_small, cut, high)
    other, other_stop = np.where(left_is_small, cut, low), np.where(left_is_small, high, cut)
    sizes = stop - start
    of = np.repeat(np.arange(len(sizes)), sizes)
    i = sa[start[of] + np.arange(len(of)) - np.repeat(sizes.cumsum() - sizes, sizes)]
    size = depth[of]
    found = []
    for to in (size, -size):
        partner = i + to
        inside = (partner >= 0) & (partner < n)
        row = isa[np.where(inside, partner, 0)]
        hit = inside & (row >= other[of]) & (row < other_stop[of])
        found.append((np.minimum(i, partner)[hit], size[hit]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def runs_of(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of all runs in numbers that end in one of its own."""
    levels = _classes(codes)
    start, period = _squares(levels)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    stop = start + 2 * period
    start = start - _agree(levels, start, start + period, back=True)
    long = stop - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
    start, stop, period = start[long], stop[long], period[long]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(stop) != 0)
    out = np.stack([start, stop - start, period], axis=1)[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def words_of(text: str | None) -> list[bytes]:
    """Words between spaces and \\t to \\r, as UTF-8 (the white space that bytes are split at)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words with the periods that the id plants: one id in ten repeats what follows word ``a``."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def chunk_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each list of words; all lists are sorted together."""
    codes: list[int] = []
    base, starts = 0, [0]
    for words in texts:
        number: dict[bytes, int] = {}
        codes += [number.setdefault(w, base + len(number)) for w in words]
        base += len(number)
        starts.append(len(codes))
    found = runs_of(np.array([*codes, base], np.int64))
    edges = np.searchsorted(found[:, 0], starts)
    return [found[lo:hi] - [at, 0, 0] for lo, hi, at in zip(edges, edges[1:], starts, strict=False)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words without those that a run repeats: of each run its first period stays, unless another run repeats that."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(change[:-1].cumsum() == 0)]


def _longest(runs: np.ndarray) -> tuple:
    """start, length, period, exponent in thousandths of the longest run; ties: smallest start, then period."""
    if not len(runs):
        return (None,) * 4
    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    return start, length, period, 1000 * length // period


def _in_chunks(batch: pa.RecordBatch, planted: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, chunk, total = [], [], 0
    for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
        doc_id = doc_id.as_py()
        words = words_of(text.as_py())
        ids.append(doc_id)
        chunk.append(with_period(words, doc_id) if planted else words)
        total += len(words)
        if total >= CHUNK_WORDS:
            yield ids, chunk
            ids, chunk, total = [], [], 0
    if ids:
        yield ids, chunk


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, runs array<struct<start, length, period>>, collapsed`` (the text with one
    period of each run, words joined by a space). ``planted`` repeats words as ``with_period`` says."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, texts in _in_chunks(batch, planted):
                found = chunk_runs(texts)
                flat = np.concatenate(found)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))
                kept = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(ids)), pa.ListArray.from_arrays(offsets, values), pa.array(kept, pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )
                done += len(ids)

    schema = f"doc_id {id_type}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def run_digests(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row: number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, texts in _in_chunks(batch, planted):
                rows = []
                for words, runs in zip(texts, chunk_runs(texts), strict=True):
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
                    kept = b" ".join(collapsed(words, runs))
                    rows.append((len(runs), *_longest(runs), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(ids)), *arrays], ["doc_id", *numbers, "runs_sha256", "collapsed_sha256"]
                )
                done += len(ids)

    schema = f"doc_id {id_type}, {', '.join(f'{c} bigint' for c in numbers)}, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(digest, schema)


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(table(spark, folder, "documents", "doc_id", "text"), planted=True)
