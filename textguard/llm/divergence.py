"""How far the sources of a language differ in their words: a chunk factorization of the term counts.

A chunk is what stands between ASCII white space. Texts are never tokenized; they are only cut into chunks, and
each task turns its documents into counts per (language, source, chunk). Every globally distinct chunk is
tokenized once, and its terms are joined back to the counts.

Documents that hold a term cannot be added up over chunks, as a document may hold a term in several. They
need not be told apart where one chunk alone is in enough documents of the language, nor where all chunks together are in too few. For the
terms in between, a second pass over the documents lists which of them hold the chunks of those terms (found by a fixed-size filter, then
by a join), and distinct documents are counted.

Shares are whole numbers of a billion, smoothed so that no term has none. Two shares p, q differ by floor((p - q)**2 / (p + q)). All
arithmetic is on whole numbers; products that could pass 64 bits are decimals.

Defined results: null text, lang and source count as ''. Every row is a document of its own, repeated ones too. Extra columns are
ignored. A language whose terms are all rare has V = 0: its pairs have the value 0, and there are no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textguard.llm.common import Scratch, ascii_lower, query, table
from textguard.llm.filters import BitFilter, bit_filter

MIN_DOCS = 10
TOP_TERMS = 10
BILLION = 1_000_000_000
MOST_PLAIN = 9_000_000_000  # counts up to it can be taken a billion times in 64 bits
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BATCH_WORDS = 1_500_000  # chunks, and
BATCH_BYTES = 16 << 20  # bytes of text that a task counts together
BLOCK_TERMS = 2048
TILE = 1 << 20


class Batch:
    """Documents that a task counts together."""

    def __init__(self) -> None:
        self.names: list[tuple[str, str]] = []
        self.number: dict[bytes, int] = {}
        self.codes: list[int] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        words, number = text.split(), self.number
        self.names.append((lang, source))
        self.codes += [number.setdefault(w, len(number)) for w in words]
        self.sizes.append(len(words))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.codes) > BATCH_WORDS or self.bytes > BATCH_BYTES

    def chunks(self, code: np.ndarray) -> pa.Array:
        return pa.array(list(self.number), pa.binary()).take(pa.array(code)).cast(pa.string())

    def per_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the document, number of the chunk, and occurrences, of all chunks in a document."""
        k = max(1, len(self.number))
        pair = np.repeat(np.arange(len(self.sizes)) * k, self.sizes) + np.array(self.codes, np.int64)
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        return *np.divmod(pair[first], k), np.diff(first, append=len(pair))


    def per_document_of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the document and number of the chunk, of the chunks in a document that are wanted."""
        k = max(1, len(self.number))
        code = np.array(self.codes, np.int64)
        at = np.flatnonzero(wanted[code]) if len(code) else code
        return np.divmod(np.unique(np.repeat(np.arange(len(self.sizes)), self.sizes)[at] * k + code[at]), k)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    held = Batch()
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            held.add(lang.as_py(), source.as_py(), text.as_buffer().to_pybytes())
            if held.full():
                yield held
                held = Batch()
    if held.names:
        yield held


def chunk_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, chunk, occurrences, docs, lang_docs`` for ``docs (lang, source, text)`` without nulls; the last one counts the
    language's documents with the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(batches):
            groups = sorted(set(held.names))
            place = {g: k for k, g in enumerate(groups)}
            doc, code, times = held.per_document()
            k = max(1, len(held.number))
            key = np.array([place[g] for g in held.names], np.int64)[doc] * k + code
            order = key.argsort(kind="stable")
            key, times = key[order], times[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            group, code = np.divmod(key[first], k)
            occurrences = np.add.reduceat(times, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
            labels = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(group)) for k in (0, 1)]
            columns = [*labels, held.chunks(code), pa.array(occurrences), pa.array(np.diff(first, append=len(key)))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "chunk", "occurrences", "docs"])

    schema = "lang string, source string, chunk string, occurrences bigint, docs bigint"
    parts = docs.select("lang", "source", "text").mapInArrow(run, schema)
    # Within a task the rows are summed already: nothing is gained by doing it again before the shuffle.
    sums = parts.repartition("chunk").groupBy("lang", "source", "chunk").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs")
    )
    return sums.withColumn("lang_docs", F.sum("docs").over(Window.partitionBy("lang", "chunk")))


def holders(docs: DataFrame, wanted: BitFilter) -> DataFrame:
    """``lang, chunk, id``: which documents hold chunks that the filter lets through. Numbers of documents are those of their task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        base = TaskContext.get().partitionId() << 40
        for held in _batches(batches):
            # The hash that Spark's xxhash64 gives.
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in held.number], np.uint64)
            let_through = shared.value(hashes)
            doc, code = held.per_document_of(let_through)
            langs = pa.array([g[0] for g in held.names], pa.string()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([langs, held.chunks(code), pa.array(base + doc)], ["lang", "chunk", "id"])
            base += len(held.names)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, chunk string, id bigint")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``chunk, term, times`` of distinct chunks."""
    found = F.regexp_extract_all(ascii_lower(F.col("chunk")), F.lit(TERM), F.lit(0))
    return chunks.select("chunk", F.explode(found).alias("term")).groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("times"))


def kept_terms(docs: DataFrame, counts: DataFrame, terms: DataFrame, min_docs: int, scratch: Scratch) -> DataFrame:
    """``lang, term`` of the terms in at least ``min_docs`` documents of the language, from counts per (lang, source, term)."""
    per_term = counts.groupBy("lang", "term").agg(F.max("most").alias("most"), F.sum("docs").alias("docs"))
    per_term = scratch.store(per_term.where(F.col("docs") >= min_docs), "candidates")
    sure = per_term.where(F.col("most") >= min_docs).select("lang", "term")
    unsure = per_term.where(F.col("most") < min_docs).select("lang", "term")
    chunks = scratch.store(terms.select("chunk", "term").join(unsure, "term"), "unsure")
    if chunks.isEmpty():
        return sure
    wanted = bit_filter(chunks.select(F.xxhash64("chunk").alias("h")).distinct(), "h")
    held = holders(docs, wanted).join(chunks, ["lang", "chunk"]).select("lang", "term", "id").distinct()
    found = held.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    return sure.unionByName(found.select("lang", "term"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * kinds)), exact."""
    above = F.lit(BILLION).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (total + 2 * kinds).cast("decimal(20,0)")
    wide = F.transform(F.array(F.struct(above.alias("a"), below.alias("b"))), lambda s: F.call_function("div", s["a"], s["b"]))[0]
    # Decimals are slow, and nearly always 64 bits are enough.
    plain = F.call_function("div", F.lit(BILLION).cast("bigint") * (count + 2), (total + 2 * kinds).cast("bigint"))
    return F.when(count <= MOST_PLAIN, plain).otherwise(wide) + 1


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Summed differences of all pairs of sources over the terms of one block."""
    groups = groups.sort_by("source")
    sources = groups.column("source").to_pylist()
    place = {s: k for k, s in enumerate(sources)}
    rest = groups.column("p0").to_numpy()
    names, column = np.unique(np.array(rows.column("term").to_pylist(), object), return_inverse=True)
    row = np.array([place[s] for s in rows.column("source").to_pylist()], np.int64)
    value = rows.column("p").to_numpy()
    sums = np.zeros((len(sources), len(sources)), np.int64)
    width = max(1, TILE // len(sources))
    for at in range(0, len(names), width):
        here = (column >= at) & (column < at + width)
        p = np.repeat(rest[:, None], min(width, len(names) - at), axis=1)
        p[row[here], column[here] - at] = value[here]
        for k in range(len(sources) - 1):
            gap = p[k + 1 :] - p[k]
            sums[k, k + 1 :] += (gap * gap // (p[k + 1 :] + p[k])).sum(axis=1)
    i, j = np.triu_indices(len(sources), 1)
    names = pa.array(sources, pa.string())
    lang = groups.column("lang").combine_chunks()[:1].take(pa.array(np.zeros(len(i), np.int64)))
    return pa.table({"lang": lang, "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": pa.array(sums[i, j])})


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return df.withColumn("rank", F.row_number().over(order).cast("int"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from each other one (part ``pair``), and
    the terms by which it stands out most from its language (part ``term``)."""
    scratch = Scratch("divergence")
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = scratch.store(chunk_counts(docs), "counts")
    terms = scratch.store(chunk_terms(counts.select("chunk").distinct()), "terms")
    per_term = counts.join(terms, "chunk").groupBy("lang", "source", "term").agg(
        F.sum(F.col("occurrences") * F.col("times")).alias("n"), F.max("lang_docs").alias("most"), F.sum("docs").alias("docs")
    )
    per_term = scratch.store(per_term, "per-term")
    scratch.drop(counts)
    kept = scratch.store(kept_terms(docs, per_term, terms, min_docs, scratch), "kept")
    found = scratch.store(per_term.select("lang", "source", "term", "n").join(kept, ["lang", "term"], "left_semi"), "found")
    scratch.drop(terms, per_term)

    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "v")])
    groups = scratch.store(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), "groups")
    shares = found.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    per_lang = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(whole, "lang")
    ahead = shares.join(per_lang, ["lang", "term"]).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
    ahead = ahead.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
    term_part = _ranked(ahead).where(F.col("rank") <= top)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("bigint")
    own = shares.withColumn("block", F.pmod(F.xxhash64("term"), blocks)).select("lang", "block", "source", "term", "p")
    each = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    sums = own.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(
        _pair_sums, "lang string, source string, item string, value bigint"
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    back = pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pair_part = _ranked(pairs.unionByName(back))
    columns = ("lang", "source", "part", "item", "value", "rank")
    parts = [part.withColumn("part", F.lit(name)).select(*columns) for part, name in ((pair_part, "pair"), (term_part, "term"))]
    return parts[0].unionByName(parts[1])


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
t AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v FROM t GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN t USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(v.v, 0) AS v FROM d LEFT JOIN v USING (lang)),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * g.v))::BIGINT AS p
    FROM g JOIN t USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(w.total) + 2 * any_value(v.v)))::BIGINT AS q
    FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang) w USING (lang) GROUP BY lang, term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p))::BIGINT AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM a QUALIFY part = 'pair' OR rank <= 10"""


@query("op11_source_divergence", _SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents", "lang", "source", "text"))
