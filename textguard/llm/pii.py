"""Sanitisation of personal data by how much the words around it reveal.

Patterns find the protected entities (emails, addresses, cards, phones). How strongly a term in the same
document reveals an entity is estimated from the whole corpus: with document counts n, the share

    PMI(entity; term) / IC(entity) = 1 + ln(n(entity, term) / n(term)) / ln(N / n(entity))

is 1 if the term only ever stands in documents with that entity. Terms above ``generalise_at`` are
replaced by their kind, above ``remove_at`` they are removed, wherever they stand in a document with the entity.

All counts are of whole documents. Terms are runs of letters and digits outside entities, lower-cased.

An entity of a single document has no telling terms: any word seen once in the corpus would have the share 1 with it, so
one document cannot tell what reveals the entity from what happens to stand there. The entity itself is replaced all the
same. The rule holds for pairs too: a term counts from ``MIN_SUPPORT`` documents that hold both.

Defined results: null and empty texts have no spans. Equal rows count once each. An entity that
stands in every document reveals nothing new, so no term goes for it. Documents without an entity
are returned as they are. Extra columns are kept by :func:`sanitise`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.arrays import scan
from textguard.functions.regex import match_spans
from textguard.functions.skew import lookup_join
from textguard.llm.common import query, table
from textguard.llm.spans import SPAN, Kind, all_spans, counted, listed, possible, replaced
from textguard.session import durable

WINDOW = 1 << 31  # characters on either side of an entity: more than a string can have, so always the whole document
MIN_SUPPORT = 2
GENERALISE_AT = 0.8
REMOVE_AT = 0.98

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_BYTE = r"\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_TERM = r"[\p{L}\p{N}]++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


# A match can start only where a run starts or where the last match ended (\G).
EMAIL = Kind(
    "email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "@", lambda v: F.lit(True)
)
IP = Kind(
    "ip",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    lambda v: F.concat(F.lit("."), v).rlike(rf"^(?:{_BYTE}){{4}}$"),
)
CARD = Kind(
    "card",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"[0-9](?:[\x20-]?[0-9]){13}",
    lambda v: F.char_length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v)),
)
PHONE = Kind(
    "phone",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"\+[0-9][\x20().0-9-]",
    lambda v: F.char_length(_digits(v)).between(10, 15),
)
KINDS = (EMAIL, IP, CARD, PHONE)
GENERALISED, REMOVED = "term_generalised", "term_removed"


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that hold an entity, with ``base`` spans and a row number that later steps share."""
    found = docs.where(possible(text, KINDS)).withColumn("base", all_spans(text, KINDS)).where(F.size("base") > 0)
    return durable(found.withColumn("_row", F.monotonically_increasing_id()))


def without_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(~possible(text, KINDS) | (F.size(all_spans(text, KINDS)) == 0))


def _entity_name(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(_digits(value)))


def _outside(text: Column, spans: Column) -> Column:
    """The text with blanks for all characters of the spans, so that places stay."""

    def step(stop: Column, span: Column) -> Column:
        gap = F.substring(text, stop + 1, F.greatest(span["start"] - stop, F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(span["end"] - F.greatest(stop, span["start"]), F.lit(0)))
        return F.struct(F.greatest(stop, span["end"]).alias("state"), F.array(F.concat(gap, blank)).alias("emit"))

    done = scan(spans, F.lit(0), step, "array<string>")
    return F.transform(
        F.array(done), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["state"] + 1, F.char_length(text)))
    )[0]


def contexts(found: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``_row, entities, terms`` of documents with an entity of ``MIN_SUPPORT`` documents or more, and ``entity, n_entity``.

    Entities are distinct, terms are ``term, start, end`` of every occurrence. No pair of a rarer entity has support.
    """
    names = F.array_distinct(F.transform("base", lambda s: _entity_name(s["kind"], s["value"])))
    named = found.select("_row", F.explode(names).alias("entity"))
    per_entity = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    support = per_entity.withColumn("supported", F.col("n_entity") >= MIN_SUPPORT)
    known = lookup_join(named, support, ["entity"], count="n_entity").where("supported")
    with_known = found.join(known.groupBy("_row").agg(F.collect_list("entity").alias("entities")), "_row")
    blanked = with_known.select("_row", "entities", _outside(F.col(text), F.col("base")).alias("_outside"))
    terms = F.transform(match_spans("_outside", _TERM), lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"].alias("start"), m["end"].alias("end")))
    return durable(blanked.select("_row", "entities", terms.alias("terms"))), per_entity


def disclosure(docs: DataFrame, pairs: DataFrame, per_entity: DataFrame, text: str = "text") -> DataFrame:
    """``entity, term, share, n_both`` for pairs seen together in at least ``MIN_SUPPORT`` documents."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    joint = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= MIN_SUPPORT)
    per_term = (
        docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_term"))
    )
    counts = joint.join(per_entity, "entity").join(per_term, "term", "left").crossJoin(F.broadcast(n_docs))
    information = F.log(F.col("n_docs") / F.col("n_entity"))
    share = 1 + F.log(F.col("n_both") / F.greatest("n_term", "n_both")) / information
    return counts.where(information > 0).select("entity", "term", share.alias("share"), "n_both")


def term_spans(docs: DataFrame, found: DataFrame, generalise_at: float, remove_at: float, text: str = "text") -> DataFrame:
    """``_row, extra``: spans of all occurrences of the terms that reveal too much, per document with an entity."""
    around, per_entity = contexts(found, text)
    distinct = F.array_distinct(F.transform("terms", lambda t: t["term"]))
    pairs = around.select("_row", F.explode("entities").alias("entity"), distinct.alias("terms")).select("_row", "entity", F.explode("terms").alias("term"))
    telling = durable(disclosure(docs, pairs, per_entity, text).where(F.col("share") >= generalise_at))
    flagged = lookup_join(pairs, telling, ["entity", "term"], count="n_both").where("share IS NOT NULL").groupBy("_row", "term").agg(F.max("share").alias("share"))
    places = around.select("_row", F.explode("terms").alias("t")).select("_row", "t.*").join(flagged, ["_row", "term"])
    removed = F.col("share") >= remove_at
    span = F.struct(
        F.col("start"),
        F.when(removed, F.lit(len(KINDS) + 1)).otherwise(F.lit(len(KINDS))).alias("rank"),
        F.col("end"),
        F.when(removed, F.lit(REMOVED)).otherwise(F.lit(GENERALISED)).alias("kind"),
        F.lit("").alias("value"),
    )
    return places.groupBy("_row").agg(F.collect_list(span).alias("extra"))


def _with_spans(docs: DataFrame, generalise_at: float, remove_at: float, text: str) -> tuple[DataFrame, DataFrame]:
    found = entities(docs, text)
    extra = term_spans(docs, found, generalise_at, remove_at, text)
    spans = F.array_sort(F.concat("base", F.coalesce(F.col("extra"), F.array().cast(SPAN)).cast(SPAN)))
    return found.join(extra, "_row", "left").withColumn("spans", spans).drop("extra", "_row"), without_entities(docs, text)


def find(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """``doc_id, base, spans`` of every document of ``docs (doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    found, clean = _with_spans(docs, generalise_at, remove_at, "text")
    none = F.array().cast(SPAN)
    return found.select("doc_id", "base", "spans").unionByName(clean.select("doc_id", none.alias("base"), none.alias("spans")))


def _placeholder(text: Column) -> Callable[[Column], Column]:
    def name(span: Column) -> Column:
        value = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        shape = F.when(value.rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).when(value.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        return (
            F.when(span["kind"] == REMOVED, F.lit(""))
            .when(span["kind"] == GENERALISED, shape)
            .otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
        )

    return name


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, text: str = "text") -> DataFrame:
    """Documents with all their columns, entities and telling terms in the text replaced."""
    columns = docs.columns
    renamed = docs.toDF(*[c if c == text else f"_in_{k}" for k, c in enumerate(columns)])
    found, clean = _with_spans(renamed, generalise_at, remove_at, text)
    done = found.withColumn(text, replaced(F.col(text), F.col("spans"), _placeholder(F.col(text)))).drop("base", "spans")
    return done.unionByName(clean).select(*renamed.columns).toDF(*columns)


@query("op1_pii_disclosure")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    spans = find(table(spark, folder, "documents", "doc_id", "text"))
    counts = [counted(F.col("base"), kind.name).alias(f"n_{kind.name}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
