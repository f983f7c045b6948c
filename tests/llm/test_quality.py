import re
from collections import Counter

from pyspark.sql import functions as F

from textguard.llm.quality import base_failed, judge, learn, measure, verdict


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))


def test_base_counts_match_brute_force(docs, prose):
    draw = prose.draw
    texts = ["", None, " \n\t ", "a b c d e a b c d e", "a " * 30, "x\nx\ny\n\nx", "one", "#*$%&|<> é中😀", "\x0b\x0c\r\n", "w " * 30_000]
    for _ in range(60):
        words = [draw.choice("abcd") for _ in range(draw.randint(1, 60))]
        texts.append("".join(w + draw.choice([" ", "\n", "  ", "\t", "."]) for w in words))
    got = measure(docs(texts)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id][:80]
    assert len(got) == len(texts)


def labelled(spark, docs, prose):
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        words = prose(40)
        rows.append((k, " ".join(w + "###" if bad else w for w in words)))
        labels.append((k, 0 if bad else 1))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_are_learned_and_ordered(spark, docs, prose):
    df, labels = labelled(spark, docs, prose)
    judged = judge(df, labels).join(labels, "doc_id")
    assert judged.where("kept <> (quality = 1)").count() == 0
    rules = learn(measure(df), labels)
    assert rules and all(rule for rule in rules)
    assert "CASE WHEN" in str(verdict(rules))


def test_no_labels_and_no_documents(spark, docs, prose):
    df, labels = labelled(spark, docs, prose)
    none = labels.limit(0)
    assert learn(measure(df), none) == []
    only_base = judge(df, none).select((F.col("kept") != F.col("base_failed")).alias("ok")).distinct().collect()
    assert [r.ok for r in only_base] == [True]
    assert judge(df.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert judge(df, nulls.unionByName(labels).unionByName(labels)).count() == 240


def test_null_text_fails_the_base_rule(docs):
    row = measure(docs([None])).select(base_failed().alias("b")).first()
    assert row.b
