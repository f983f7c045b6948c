"""Language identification with unigram piece models, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, found by the forward algorithm; a text is the
product over its words. Probabilities are learned by expectation maximisation: tasks compute the
expected piece counts of their words, Spark sums them per language and piece, and the driver holds
only the piece table (vocabulary size times languages).

Defined results: a null text, a text without letters, and every text if nothing can be learned give
``und`` with score 0. Ties go to the language that sorts first. Repeated rows are scored alike, and a
repeated training row counts again. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import query, table
from textguard.llm.shingles import in_chunks
from textguard.session import durable

UNKNOWN = "und"
MAX_PIECE = 10
CACHE_TOKENS = 150_000
PASS_TOKENS = 40_000  # tokens looked up together
GROUP_WORDS = 4096  # words scored together
LONG_WORD = 64
FLOOR = 1e-9


def _letters() -> re.Pattern:
    """Runs of letters (Unicode categories L). Python's ``\\w`` also has numbers such as ½ and Ⅷ, which are taken out."""
    odd = [c for c in map(chr, range(0x110000)) if c.isalnum() and not unicodedata.category(c).startswith("L")]
    return re.compile(rf"[^\W\d_{re.escape(''.join(odd))}]+")


_LETTERS = _letters()
_NO_LETTERS = "".join(c for c in map(chr, range(128)) if not c.isalpha())


def letter_runs(token: str) -> list[str]:
    """Lower-cased runs of letters; nearly all tokens are one run between marks, which needs no pattern (``isalpha`` is category L)."""
    low = token.lower()
    run = low.strip(_NO_LETTERS)
    if run.isalpha():
        return [run]
    return _LETTERS.findall(run) if run else []


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """Lower-cased pieces made of letters, from a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = (model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()))
    return sorted({p for p in raw if p and len(p) <= MAX_PIECE and _LETTERS.fullmatch(p)})


@dataclass
class Model:
    """``pieces`` holds probabilities per language; ``prefixes`` also has all beginnings of pieces (with None)."""

    languages: list[str]
    pieces: dict[str, tuple[float, ...]]

    def __post_init__(self) -> None:
        self.prefixes: dict[str, tuple[float, ...] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.prefixes.update(self.pieces)

    def unknown(self) -> tuple[float, ...]:
        return (FLOOR,) * len(self.languages)


def _edges(word: str, prefixes: dict, unknown: tuple) -> list[tuple[int, int, tuple]]:
    """Pieces found in a word as (start, end, probabilities), by start; every letter has one."""
    found = []
    n = len(word)
    for i in range(n):
        found.append((i, i + 1, prefixes.get(word[i]) or unknown))
        for j in range(i + 2, min(n, i + MAX_PIECE) + 1):
            row = prefixes.get(word[i:j], 0)
            if row:
                found.append((i, j, row))
            elif row == 0:  # no piece begins like this
                break
    return found


def word_log_probs(word: str, model: Model) -> list[float]:
    """Log-probability of a word in each language, over all segmentations."""
    unknown = model.unknown()
    if len(word) > LONG_WORD:
        return _long_word(word, model.pieces, unknown)
    edges = _edges(word, model.prefixes, unknown)
    out = []
    for k in range(len(unknown)):
        alpha = [1.0] + [0.0] * len(word)
        for i, j, row in edges:
            alpha[j] += alpha[i] * row[k]
        out.append(log(alpha[-1]))
    return out


def _long_word(word: str, pieces: dict, unknown: tuple) -> list[float]:
    """The same sum in a sliding window, rescaled at each letter so that nothing underflows."""
    size = len(unknown)
    scale = [0.0] * size
    window: list[list[float]] = [[1.0] * size]
    for j in range(1, len(word) + 1):
        total = [0.0] * size
        for back, alpha in enumerate(reversed(window), start=1):
            row = pieces.get(word[j - back : j], unknown if back == 1 else None)
            if row is not None:
                for k in range(size):
                    total[k] += alpha[k] * row[k]
        window = window[-(MAX_PIECE - 1) :] + [total]
        for k in range(size):
            by = total[k]
            scale[k] += log(by)
            for alpha in window:
                alpha[k] /= by
    return scale


class PieceTable:
    """Looks pieces up for many words at once: open addressing over a rolling hash of letters."""

    MIX = np.uint64(0x9E3779B97F4A7C15)
    STEP = np.uint64(0xD6E8FEB86659FD93)
    PROBES = 8

    def __init__(self, model: Model):
        names = list(model.prefixes)
        self.letters = np.zeros(0x110000, np.uint64)
        for k, letter in enumerate(sorted({c for name in names for c in name}), start=1):
            self.letters[ord(letter)] = k
        rows = [model.unknown()]
        number = np.zeros(len(names), np.int64)  # 0: only a prefix
        for at, name in enumerate(names):
            row = model.prefixes[name]
            if row is not None:
                number[at] = len(rows)
                rows.append(row)
        self.rows = np.array(rows)
        self.bits = max(4, (8 * len(names)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.full(1 << self.bits, -1, np.int64)
        mask = (1 << self.bits) - 1
        with np.errstate(over="ignore"):
            for at, name in enumerate(names):
                key = np.uint64(0)
                for letter in name:
                    key = key * self.STEP + self.letters[ord(letter)]
                slot = int(self._slots(key))
                for _ in range(self.PROBES):
                    if self.numbers[slot] < 0:
                        break
                    slot = (slot + 1) & mask
                else:
                    raise ValueError("piece table too dense")
                self.keys[slot], self.numbers[slot] = key, number[at]

    def _slots(self, keys):
        return (keys * self.MIX) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key; 0 for a mere prefix, -1 for neither."""
        slots = self._slots(keys).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for _ in range(self.PROBES):
            numbers = self.numbers[slots]
            hit = (self.keys[slots] == keys[left]) & (numbers >= 0)
            out[left[hit]] = numbers[hit]
            go_on = ~hit & (numbers >= 0)
            left, slots = left[go_on], (slots[go_on] + 1) & (len(self.keys) - 1)
            if not len(left):
                break
        return out

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of many short words; a letter that is no piece keeps the floor."""
        codes = self.letters[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - np.repeat(sizes.cumsum() - sizes, sizes)
        room = sizes[word] - place
        longest = int(sizes.max(initial=0))
        alpha = np.zeros((longest + 1, len(words), self.rows.shape[1]))
        alpha[0] = 1.0
        edges: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        at, keys = np.arange(len(codes)), codes
        for size in range(1, MAX_PIECE + 1):
            numbers = self.find(keys)
            known = (numbers > 0) | (size == 1)
            ends = place[at[known]] + size
            order = ends.argsort(kind="stable")
            ends, of_word, row = ends[order], word[at[known]][order], np.maximum(numbers[known], 0)[order]
            cuts = np.flatnonzero(np.diff(ends, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                edges.setdefault(int(ends[lo]), []).append((size, of_word[lo:hi], row[lo:hi]))
            go_on = (numbers >= 0) & (room[at] > size)
            at = at[go_on]
            keys = keys[go_on] * self.STEP + codes[at + size]
        for end in range(1, longest + 1):
            for size, of_word, row in edges.get(end, ()):
                alpha[end, of_word] += alpha[end - size, of_word] * self.rows[row]
        return np.log(alpha[sizes, np.arange(len(words))])


class Scorer:
    """Log-likelihoods of texts; scores of tokens are kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model = model
        self.table = PieceTable(model)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1))

    def _learn(self, tokens: list[str]) -> None:
        """Score new tokens: the sum over their runs of letters."""
        runs = [letter_runs(t) for t in tokens]
        # Words of similar length together, so that a group's table is no longer than its words.
        words = sorted({w for found in runs for w in found}, key=len)
        scores = np.zeros((len(words), self.rows.shape[1]))
        scores[:, -1] = np.fromiter(map(len, words), np.int64, len(words))
        short = int(np.searchsorted(scores[:, -1], LONG_WORD, side="right"))
        for at in range(0, short, GROUP_WORDS):
            scores[at : min(at + GROUP_WORDS, short), :-1] = self.table.log_probs(words[at : min(at + GROUP_WORDS, short)])
        for at in range(short, len(words)):
            scores[at, :-1] = _long_word(words[at], self.model.pieces, self.model.unknown())
        first, stop = len(self.index), len(self.index) + len(tokens)
        while len(self.rows) < stop:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.index.update(zip(tokens, range(first, stop), strict=True))
        number = dict(zip(words, range(len(words)), strict=True))
        of_run = np.array([number[w] for found in runs for w in found], np.int64)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        some = np.flatnonzero(sizes)
        self.rows[first:stop] = 0.0
        if len(some):
            self.rows[first + some] = np.add.reduceat(scores[of_run], (sizes.cumsum() - sizes)[some], axis=0)

    def texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """Log-likelihood per language, and number of letters, of each text."""
        totals = np.zeros((len(texts), len(self.model.languages) + 1))
        for lo, hi in in_chunks(texts):
            waiting: list[tuple[int, list[str]]] = []
            size = 0
            for k in range(lo, hi):
                tokens = (texts[k] or "").split()
                for at in range(0, len(tokens), PASS_TOKENS):
                    waiting.append((k, tokens[at : at + PASS_TOKENS]))
                    size += len(waiting[-1][1])
                    if size >= PASS_TOKENS:
                        self._add(totals, waiting)
                        waiting, size = [], 0
            self._add(totals, waiting)
        return [(row[:-1], round(row[-1])) for row in totals]

    def _add(self, totals: np.ndarray, parts: list[tuple[int, list[str]]]) -> None:
        if len(self.index) > CACHE_TOKENS:
            self._clear()
        new = set().union(*[tokens for _, tokens in parts]).difference(self.index)
        if new:
            self._learn(list(new))
        for k, tokens in parts:
            at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
            totals[k] += self.rows[at].sum(axis=0)


def _expected(word: str, model: Model, k: int) -> dict[str, float]:
    """Expected number of uses of each piece in a word, in language ``k`` (forward-backward)."""
    n, pieces = len(word), model.pieces
    edges = _edges(word, model.prefixes, model.unknown())
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, row in edges:
        alpha[j] += alpha[i] * row[k]
    for i, j, row in reversed(edges):
        beta[i] += beta[j] * row[k]
    out: dict[str, float] = {}
    for i, j, row in edges:
        piece = word[i:j]
        if piece in pieces:
            out[piece] = out.get(piece, 0.0) + alpha[i] * row[k] * beta[j] / alpha[n]
    return out


def _em_round(words: DataFrame, model: Model, smoothing: float) -> Model:
    """One step of expectation maximisation; what comes back has at most a row per language and piece."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        position = {name: k for k, name in enumerate(known.languages)}
        sums: dict[tuple[str, str], float] = {}
        for batch in batches:
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                for piece, share in _expected(word, known, position[lang]).items():
                    sums[lang, piece] = sums.get((lang, piece), 0.0) + n * share
        rows = [(lang, piece, value) for (lang, piece), value in sums.items()]
        yield pd.DataFrame(rows, columns=["lang", "piece", "value"])

    got = words.mapInPandas(expect, "lang string, piece string, value double")
    counts: dict[tuple[str, str], float] = {
        (r["lang"], r["piece"]): r["value"] for r in got.groupBy("lang", "piece").agg(F.sum("value").alias("value")).collect()
    }
    names = list(model.pieces)
    totals = [sum(counts.get((lang, p), 0.0) for p in names) + smoothing * len(names) for lang in model.languages]
    return Model(
        model.languages,
        {p: tuple((counts.get((lang, p), 0.0) + smoothing) / t for lang, t in zip(model.languages, totals, strict=True)) for p in names},
    )


def fit(
    labelled: DataFrame,
    vocabulary: str | None = None,
    docs_per_language: int = 800,
    rounds: int = 3,
    smoothing: float = 0.5,
) -> Model:
    """Learn piece probabilities from ``labelled (text, lang)``, ignoring rows where either is null.

    The classifier is fitted on a bounded sample: about ``docs_per_language`` texts of each language,
    chosen by a hash of the text. Their words are counted by Spark.
    """
    names = read_pieces(vocabulary or default_vocabulary())
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {})
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(docs_per_language / sizes[lang])).otherwise(share)
    drawn = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_000)) / 1_000_000 < share
    words = (
        rows.where(drawn)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .where(F.char_length("word") <= LONG_WORD)
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    words = durable(words)
    flat = tuple(1.0 / len(names) for _ in languages)
    model = Model(languages, dict.fromkeys(names, flat))
    for _ in range(rounds):
        model = _em_round(words, model, smoothing)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (posterior of the predicted language under even priors); columns of these names are
    replaced, all others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        scorer = Scorer(known)
        for batch in batches:
            out = []
            for likelihood, letters in scorer.texts(batch.tolist()):
                if not letters or not known.languages:
                    out.append((UNKNOWN, 0.0))
                    continue
                best = int(likelihood.argmax())
                out.append((known.languages[best], 1.0 / sum(exp(x - likelihood[best]) for x in likelihood)))
            yield pd.DataFrame(out, columns=["lang", "score"])

    own = "_language"
    while own in docs.columns:
        own += "_"
    found = docs.withColumn(own, classify(F.col(text)))
    return found.withColumns({"lang_pred": F.col(f"{own}.lang"), "score": F.col(f"{own}.score")}).drop(own)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id, as text, leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    model = fit_documents(table(spark, folder, "documents", "doc_id", "text", "lang"))
    docs = table(spark, folder, "documents", "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")
