import zlib
from collections import defaultdict

import numpy as np
import pytest

from textguard.llm.packing import CAPACITY, cut, encoder, pack, pack_documents, sum_of_squares, tokenize


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_file(reference, prose):
    draw = prose.draw
    letters = "ab's 12,.\n\t\r  \x0b\x1c\x85 　é中😀'll<|endoftext|>"
    marks = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x  ", "<|endoftext", "\n <|endoftext|>\n\n y"]
    texts = ["", " ", "a", "  a  b  ", "\n\n", " ".join(prose(50)), *marks]
    assert reference(marks[0]) == [64, 220, 50256, 275]
    texts += ["".join(draw.choice([*letters, "<|endoftext|>"]) for _ in range(draw.randint(0, 30))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(encoder(None).bytes_of(text), "<u4").tolist() == reference(text), repr(text)


def test_pieces_and_sequences(docs, prose, reference):
    rows = [" ".join(prose(n)) for n in (1, 5, 50, 700, 3000, 9000, 300, 300, 20)] + ["", None]
    rows = list(enumerate(rows)) + [(3, " ".join(prose(700))), (0, "x"), (0, "x"), (None, "y z")]
    got = pack_documents(docs(rows)).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    want = []
    for doc_id, text in rows:
        ids = [*reference(text or ""), 0]
        for piece, (start, stop) in enumerate(cut(len(ids), CAPACITY)):
            want.append((doc_id, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)


def test_sequences_of_all_rounds_are_apart(spark, prose):
    """Large sequence numbers of later rounds stay exact."""
    rows = [(k, 0, 0, prose.draw.randint(1, CAPACITY), k) for k in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    sequences = defaultdict(list)
    for r in pack(pieces, share_rows=50).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
    assert max(sequences) > 1 << 56
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(sequences) < 1.15 * sum(r[3] for r in rows) / CAPACITY


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(5, 4) == [(0, 1), (1, 5)] and cut(9, 4) == [(0, 1), (1, 5), (5, 9)]


def slow_sum_of_squares(sizes, capacity):
    fill = []
    for size in sizes:
        def total(bins):
            counts = defaultdict(int)
            for f in bins:
                if f < capacity:
                    counts[f] += 1
            return sum(n * n for n in counts.values())

        options = [(total([f + size if k == b else f for k, f in enumerate(fill)]), 0) for b in range(len(fill)) if fill[b] + size <= capacity]
        fresh = total([*fill, size])
        if options and min(options)[0] <= fresh:
            best = min(options)[0]
            # Of equal choices the tightest bin.
            b = min((capacity - fill[k], k) for k in range(len(fill)) if fill[k] + size <= capacity and total([f + size if j == k else f for j, f in enumerate(fill)]) == best)[1]
            fill[b] += size
        else:
            fill.append(size)
    return sorted(fill)


def test_rule_equals_the_definition(prose):
    for _ in range(20):
        sizes = [prose.draw.randint(1, 10) for _ in range(30)]
        _, _, fill = sum_of_squares(np.array(sizes), 10)
        assert sorted(fill.tolist()) == slow_sum_of_squares(sizes, 10)


def test_few_sequences(spark, prose):
    sizes = [prose.draw.randint(1, 2048) for _ in range(3000)]
    pieces = spark.createDataFrame([(k, 0, s, k) for k, s in enumerate(sizes)], "doc_id long, piece int, length long, ids_crc32 long")
    for share in (40_000, 700):
        used = pack(pieces, share_rows=share).select("sequence_id").distinct().count()
        assert used <= 1.03 * sum(sizes) / CAPACITY + 2


def test_empty_table(docs):
    assert pack_documents(docs(["a"]).limit(0)).count() == 0
    with_ids = tokenize(docs(["hello world"]), with_ids=True).first()
    assert len(with_ids.ids) == with_ids.length
