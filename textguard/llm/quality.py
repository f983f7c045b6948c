"""Quality verdicts by a learned decision list.

Sequential covering: rules for bad documents are grown one threshold condition at a time by information
gain on one part of the labelled documents, pruned on the other part, and taken while they hold there.
Every step reads one table of counts (feature, bin, good, bad) that Spark aggregates from all labelled
documents; its size depends on the number of features and thresholds only. The list comes out as an
ordered conditional expression.

Defined results: a null or empty text has no words and fails the base rule. Ties between conditions go
to the first feature and lowest threshold. Repeated labels all count. Without labels there are no rules,
and the base rule decides alone. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.arrays import bind
from textguard.llm.common import query, table, words_of
from textguard.session import durable

WINDOW_WORDS = 5
THRESHOLDS = 32
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.8
MIN_COVERED = 5

FEATURES = (
    "n_words",
    "mean_word_chars",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "words_per_line",
    "ended_line_share",
    "distinct_word_share",
    "punctuation_share",
    "longest_word",
)


def repeated_words(words: Column) -> Column:
    """Words inside windows of five that stand in the text twice or more.

    Most texts have no such window, which a hash set over the windows' hashes shows. For the others the hashes
    are sorted with their places, so equal windows become neighbours.
    """

    def marked(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            def same(row: Column, at: Column) -> Column:
                before, after = F.get(rows, at - 1)["h"], F.get(rows, at + 1)["h"]
                return F.coalesce(before == row["h"], F.lit(False)) | F.coalesce(after == row["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, same), lambda r: r["i"]))

        def covered(places: Column) -> Column:
            widths = F.transform(places, lambda p, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW_WORDS))))
            return F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, w: a + w)

        return bind(bind(placed, twice), covered)

    def count(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - WINDOW_WORDS)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW_WORDS)]))
        some = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), marked(h)).otherwise(F.lit(0).cast("bigint")))
        return F.when(F.size(ws) > WINDOW_WORDS, some).otherwise(F.lit(0).cast("bigint"))

    return bind(words, count)


def _without(text: str, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measure(docs: DataFrame) -> DataFrame:
    """Base counts and features of ``docs (doc_id, text)``, in one narrow pass."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(ws)).alias("n_distinct"),
            F.aggregate(ws, F.lit(0), lambda a, w: F.greatest(a, F.char_length(w))).alias("longest"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda line: line.rlike(r"[.!?\"]$"))).alias("n_ended"),
        )

    n_chars = F.char_length("t")
    counted = text.select(
        "doc_id",
        bind(words_of(F.col("t")), of_words).alias("w"),
        bind(lines, of_lines).alias("l"),
        n_chars.alias("n_chars"),
        _without("t", " \t\n\x0b\x0c\r").cast("bigint").alias("word_chars"),
        (n_chars - _without("t", "#*$%&|<>")).cast("bigint").alias("n_symbols"),
        (n_chars - _without("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (n_chars - _without("t", "0123456789")).alias("n_digits"),
        (n_chars - _without("t", ".,;:!?")).alias("n_punctuation"),
    ).select("*", "w.*", "l.*")

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))

    features = {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "words_per_line": share("n_words", "n_lines"),
        "ended_line_share": share("n_ended", "n_lines"),
        "distinct_word_share": share("n_distinct", "n_words"),
        "punctuation_share": share("n_punctuation", "n_words"),
        "longest_word": F.col("longest").cast("double"),
    }
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counted.select("doc_id", *base, *[value.alias(name) for name, value in features.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``; ``bin`` is the threshold's number."""

    feature: str
    above: bool
    bin: int
    threshold: float

    def binned(self) -> Column:
        return F.col(f"b_{self.feature}") > self.bin if self.above else F.col(f"b_{self.feature}") <= self.bin

    def plain(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions: Rule, form: str) -> Column:
    return reduce(lambda a, b: a & b, [getattr(c, form)() for c in conditions], F.lit(True))


def _any(rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [_all(r, "binned") for r in rules], F.lit(False))


def _grow(rows: DataFrame, thresholds: dict[str, list[float]]) -> Rule:
    """Add the condition of highest information gain until no good document is covered."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        here = rows.where(_all(rule, "binned"))
        bins = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("bin")) for f in FEATURES])).alias("x")
        counts = (
            here.select("bad", bins)
            .groupBy("x.feature", "x.bin")
            .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
            .collect()
        )
        table_ = {(r["feature"], r["bin"]): (r["bad"], r["good"]) for r in counts}
        first = [table_.get((FEATURES[0], b), (0, 0)) for b in range(len(thresholds[FEATURES[0]]) + 1)]
        bad, good = sum(p for p, _ in first), sum(n for _, n in first)
        if bad == 0 or good == 0:
            break
        best, best_gain = None, 1e-9
        for feature in FEATURES:
            below_bad = below_good = 0
            for b, threshold in enumerate(thresholds[feature]):
                p, n = table_.get((feature, b), (0, 0))
                below_bad, below_good = below_bad + p, below_good + n
                for above, (q, m) in ((False, (below_bad, below_good)), (True, (bad - below_bad, good - below_good))):
                    if q < MIN_COVERED or m == good:
                        continue
                    gain = q * (log2(q / (q + m)) - log2(bad / (bad + good)))
                    if gain > best_gain:
                        best, best_gain = Condition(feature, above, b, threshold), gain
        if best is None:
            break
        rule = (*rule, best)
    return rule


def _prune(rows: DataFrame, rule: Rule, min_precision: float) -> Rule:
    """The prefix with the best (bad - good) / (bad + good) on rows not grown on, if it holds there."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k], "binned").cast("int")
        sums += [F.sum(hit * F.col("bad")).alias(f"p{k}"), F.sum(hit * (1 - F.col("bad"))).alias(f"n{k}")]
    got = rows.agg(*sums).first()
    scored = []
    for k in range(1, len(rule) + 1):
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        if p + n and p / (p + n) >= min_precision:
            scored.append(((p - n) / (p + n), p, -k))
    return rule[: -max(scored)[2]] if scored else ()


def learn(measured: DataFrame, labels: DataFrame, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules for bad documents from ``labels (doc_id, quality)``; all labelled documents are used."""
    cuts = [k / THRESHOLDS for k in range(1, THRESHOLDS)]
    got = measured.agg(*[F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted({float(x) for x in got[f] or ()}) for f in FEATURES}
    if not all(thresholds.values()):
        return []

    def binned(feature: str) -> Column:
        over = [(F.col(feature) > t).cast("int") for t in thresholds[feature]]
        return reduce(lambda a, b: a + b, over).cast("int").alias(f"b_{feature}")

    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).alias("bad"))
    joined = measured.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))
    rows = durable(joined.select("bad", part.alias("part"), *[binned(f) for f in FEATURES]))
    grow_rows, prune_rows = rows.where("part > 0"), rows.where("part = 0")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = ~_any(rules)
        rule = _grow(grow_rows.where(left), thresholds)
        rule = _prune(prune_rows.where(left), rule, min_precision) if rule else ()
        if not rule:
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds drops the document, else it stays."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule, "plain"), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, features, ``base_failed`` and ``kept`` of every document."""
    measured = durable(measure(docs.select("doc_id", "text")))
    rules = learn(measured, labels)
    return measured.withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    judged = judge(docs, table(spark, folder, "labels", "doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
