"""License scan by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions of the same k-grams in license
templates; the words are compared, so a vote never rests on a hash alone. A vote lies on the diagonal
(text position - template position). Votes are summed per diagonal, neighbouring diagonals (texts with
a word more or less) are merged, and a span counts if it covers enough of its template.

Short phrases are templates with two-word grams that must be covered whole, on one diagonal.

Defined results: a null or empty text has no words and no labels. Equal rows get equal results. Extra
columns are ignored. The templates and their number are fixed, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.llm.common import ascii_lower, query, row_key, table

GRAM = 4
PHRASE_GRAM = 2
GAP = 3
MIN_COVER = 0.6
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with the label that each gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices, in lower case without punctuation.
NOTICES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
        " license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on"
        " an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or at your option any later"
        " version",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not"
        " distributed with this file you can obtain one at",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
}


def _template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, tuple[str, ...]]) -> DataFrame:
    """``template, label, k, t_pos, t_words, windows`` of every gram of every template."""
    rows = []
    templates = [(text, label, PHRASE_GRAM) for text, label in phrases.items()]
    templates += [(text, label, GRAM) for label, texts in notices.items() for text in texts]
    for number, (text, label, k) in enumerate(templates):
        words = text.split()
        for at in range(len(words) - k + 1):
            rows.append((number, label, k, at, words[at : at + k], len(words) - k + 1))
    grams = spark.createDataFrame(rows, "template int, label string, k int, t_pos int, t_words array<string>, windows int")
    return grams.withColumn("hash", F.xxhash64("t_words"))


def words_column(text: str = "text"):
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), _SPLIT, -1), lambda w: w != "")


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``doc_id, key, template, label, k, windows, diagonal, pos``: a row per verified k-gram vote."""
    words = docs.select("doc_id", row_key("doc_id", "text").alias("key"), words_column().alias("words"))
    # Templates are few: only hashes that one of them has leave the text's row, which would be copied for each of its grams otherwise.
    wanted = {k: [r["hash"] for r in grams.where(F.col("k") == k).select("hash").distinct().collect()] for k in (PHRASE_GRAM, GRAM)}

    def hashes(k: int):
        # The last grams are cut short.
        rolling = F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.xxhash64(F.slice("words", i + 1, F.lit(k))).alias("hash")))
        return F.filter(rolling, lambda g: g["hash"].isin(wanted[k]))

    rolled = words.where(F.size("words") > 0).select(
        "doc_id", "key", "words", F.inline(F.concat(hashes(PHRASE_GRAM), hashes(GRAM)))
    )
    joined = rolled.join(F.broadcast(grams), "hash")
    same = joined.where(F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("t_words"))
    return same.select("doc_id", "key", "template", "label", "k", "windows", (F.col("pos") - F.col("t_pos")).alias("diagonal"), "pos")


def spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES, min_cover: float = MIN_COVER) -> DataFrame:
    """``doc_id, key, template, label, k, first, last, cover``: word spans that match a template."""
    grams = _template_grams(docs.sparkSession, phrases, notices)
    by_diagonal = (
        votes(docs, grams)
        .groupBy("doc_id", "key", "template", "label", "k", "windows", "diagonal")
        .agg(F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last"), F.count_distinct("pos").alias("votes"))
    )
    in_text = Window.partitionBy("doc_id", "key", "template").orderBy("first", "diagonal")
    apart = (
        (F.col("k") == PHRASE_GRAM)
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(in_text)) > GAP)
        | (F.col("first") > F.lag("last").over(in_text) + GAP)
    )
    merged = (
        by_diagonal.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("apart").over(in_text))
        .groupBy("doc_id", "key", "template", "label", "k", "windows", "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"))
    )
    cover = F.least(F.col("votes") / F.col("windows"), F.lit(1.0))
    needed = F.when(F.col("k") == PHRASE_GRAM, F.lit(1.0)).otherwise(F.lit(min_cover))
    return merged.withColumn("cover", cover).where(F.col("cover") >= needed).drop("run", "votes", "windows")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: word count, places and labels of phrases and notices."""
    docs = docs.select("doc_id", "text")
    base = F.col("k") == PHRASE_GRAM

    def joined(labels):
        return F.array_join(F.array_sort(labels), ",")

    found = (
        spans(docs, phrases, notices)
        .groupBy("doc_id", "key")
        .agg(
            F.count(F.when(base, True)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set("label")).alias("labels"),
            F.max("cover").alias("score"),
        )
    )
    light = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.size(words_column()).cast("bigint").alias("n_words"))
    return (
        light.alias("d")
        .join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left")
        .select(
            "d.doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


# The whole-row columns of the base; labels of notices that are not phrases need the templates.
_WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


def _check_sql() -> str:
    """The same diagonals, voted without hashes: text positions joined to template positions by their words."""
    templates = [(t, label, PHRASE_GRAM) for t, label in PHRASES.items()]
    templates += [(t, label, GRAM) for label, texts in NOTICES.items() for t in texts]
    values = ", ".join(f"({n}, '{label}', {k}, '{text}')" for n, (text, label, k) in enumerate(templates))
    return f"""
    WITH d AS (SELECT doc_id, text, {_WORDS_SQL} AS w FROM documents),
    t AS (SELECT *, string_split(body, ' ') AS tw FROM (VALUES {values}) AS v(template, label, k, body)),
    g AS (SELECT template, label, k, len(tw) - k + 1 AS windows, unnest(range(len(tw) - k + 1)) AS t_pos, tw FROM t),
    gw AS (SELECT *, array_to_string(tw[t_pos + 1 : t_pos + k], ' ') AS gram FROM g),
    e AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS gram
          FROM (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d), (VALUES ({PHRASE_GRAM}), ({GRAM})) AS ks(k)
          WHERE pos + k <= len(w)),
    dg AS (SELECT doc_id, template, label, k, windows, pos - t_pos AS diagonal, min(pos) AS first, max(pos) + k - 1 AS last,
                  count(*) AS votes
           FROM e JOIN gw USING (k, gram) GROUP BY doc_id, template, label, k, windows, pos - t_pos),
    r AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS run
          FROM (SELECT *, CASE WHEN coalesce(k = {PHRASE_GRAM} OR abs(diagonal - lag(diagonal) OVER x) > {GAP}
                                             OR first > lag(last) OVER x + {GAP}, true) THEN 1 ELSE 0 END AS apart
                FROM dg WINDOW x AS (PARTITION BY doc_id, template ORDER BY first, diagonal))),
    m AS (SELECT doc_id, template, label, k, run, min(first) AS first, least(sum(votes) / any_value(windows), 1.0) AS cover
          FROM r GROUP BY doc_id, template, label, k, run),
    s AS (SELECT * FROM m WHERE cover >= CASE WHEN k = {PHRASE_GRAM} THEN 1.0 ELSE {MIN_COVER} END),
    f AS (SELECT doc_id, count(*) FILTER (k = {PHRASE_GRAM}) AS n_base, min(first) FILTER (k = {PHRASE_GRAM}) AS first_word,
                 max(first) FILTER (k = {PHRASE_GRAM}) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k = {PHRASE_GRAM}) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
          FROM s GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
           CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN f USING (doc_id)"""


@query("op5_license_diagonals", _check_sql())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents", "doc_id", "text"))
