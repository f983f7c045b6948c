"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

A piece goes where the sum over residual gaps of (open bins with that gap) squared becomes smallest,
which keeps the gaps varied, so later pieces find bins that they fill. Pieces are packed in even shares of the table
(dealt round robin, so no key matters); bins left with a gap are then opened again and their pieces
packed in fewer, larger shares.

Defined results: a null or empty text is the end token alone; only texts longer than a sequence are
cut, from the end, so that their first piece is the short one. Where the tokenizer file's added token
``<|endoftext|>`` stands in a text, its id stands in the ids, as the file itself has it. Equal rows are packed one by one. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import query, table
from textguard.session import durable

CAPACITY = 2048
END_ID = 0
SHARE_ROWS = 40_000

# Two white-space characters in a row (a superset of what the tokenizer counts as white space).
_DOUBLE_SPACE = re.compile(r"\s\s")
_LOOKAHEAD = r"\s+(?!\S)|"


class Encoder:
    """Ids of a text by the byte-level vocabulary, as little-endian 32-bit bytes.

    The splitting pattern's look-ahead only matters where white space follows white space; other texts
    take the pattern without it, which is much faster. Tests hold both against the tokenizer file itself.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = pattern.replace(_LOOKAHEAD, "")
        self._full, self._fast = (
            tiktoken.Encoding(f"public-{k}", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for k, p in enumerate((pattern, plain))
        )
        self._added = added
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    def bytes_of(self, text: str) -> bytes:
        encode = self._full if _DOUBLE_SPACE.search(text) else self._fast
        if self._cut and self._cut.search(text):
            # The text between added tokens is split into words on its own.
            parts = self._cut.split(text)
            ids = array("I", [i for k, part in enumerate(parts) for i in ([self._added[part]] if k % 2 else self._full(part))])
        else:
            ids = array("I", encode(text))
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str | None) -> Encoder:
    """One encoder per worker process. ``vocabulary`` is a rank file, without added tokens; default: the public 50k one, with those of
    the tokenizer file of the same vocabulary."""
    if vocabulary not in _encoders:
        import public_tokenizers

        added = {}
        if vocabulary is None:
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
                added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        _encoders[vocabulary] = Encoder(path, public_tokenizers.PATTERN, added)
    return _encoders[vocabulary]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document; the first one is the short one."""
    if length <= capacity:
        return [(0, length)]
    stops = list(range(length, 0, -capacity))[::-1]
    return list(zip([0, *stops[:-1]], stops, strict=True))


def tokenize(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids``."""
    end = np.array([END_ID], "<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bytes_of = encoder(vocabulary).bytes_of
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = bytes_of(text or "") + end
                for piece, (start, stop) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * stop]
                    row = (doc_id, piece, start, stop - start, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None)
                    for values, value in zip(out.values(), row, strict=True):
                        values.append(value)
            if not with_ids:
                del out["ids"]
            frame = pd.DataFrame(out)
            frame["doc_id"] = pd.Series(out["doc_id"], dtype=batch["doc_id"].dtype if len(batch) and batch["doc_id"].notna().all() else object)
            yield frame

    return docs.select("doc_id", "text").mapInPandas(run, schema + (", ids array<bigint>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece in the order given, and what each bin holds.

    With N(g) open bins of gap g, putting a piece of length s into one of gap g changes the sum of
    squares by 2 * (N(g - s) - N(g)) + 2 (gap 0 does not count); a new bin changes it by 2 * N(capacity - s) + 1.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        gaps = count[size:capacity]
        after = count[: capacity - size]
        change = np.where(gaps > 0, 2 * (after - gaps) + 2, never)
        if len(change):
            if gaps[0]:
                change[0] = 1 - 2 * gaps[0]
            best = int(change.argmin())
            cost = change[best]
        else:
            best, cost = 0, never
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if cost != never and cost <= fresh:
            gap = best + size
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        at[k], offset[k] = b, fill[b]
        fill[b] += size
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return at, offset, np.array(fill, np.int64)


def _pack_round(pieces: DataFrame, shares: int, capacity: int, number: int, last: bool, slack: int) -> DataFrame:
    """Pack each share; bins with a gap over ``slack`` are given up (null ids) unless it is the last round."""
    columns = pieces.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        share = pd.concat(parts, ignore_index=True)
        # Pieces of similar length together, longest first: equal input then packs alike on a retry.
        share = share.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        at, offset, fill = sum_of_squares(share["length"].to_numpy(), capacity)
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        done = last | (fill[at] >= capacity - slack)
        # Integers with nulls throughout: as floats, large sequence numbers would run together.
        share["sequence_id"] = pd.Series(base + at, index=share.index, dtype="Int64").where(done)
        share["offset"] = pd.Series(offset, index=share.index, dtype="Int64").where(done)
        yield share[[*columns, "sequence_id", "offset"]]

    return pieces.repartition(max(1, shares)).mapInPandas(run, f"{types}, sequence_id bigint, offset bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, share_rows: int = SHARE_ROWS, slack: int = 8) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``.

    Three rounds; a share has about ``share_rows`` pieces, which bounds a task's memory.
    """
    left = durable(pieces)
    finished = []
    for number in range(3):
        rows = left.count()
        last = number == 2 or rows <= 1
        done = durable(_pack_round(left, -(-rows // share_rows), capacity, number, last, slack))
        finished.append(done.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        left = done.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    return pack(tokenize(docs, capacity, vocabulary), capacity)


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents", "doc_id", "text"))
