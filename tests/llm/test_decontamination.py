import numpy as np
import pytest

from textguard.llm import decontamination as dc
from textguard.llm.decontamination import lcs_length, remove_leaks, with_leaks


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_lcs_equals_the_table(prose):
    draw = prose.draw
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randint(0, 80))] for _ in range(2))
        assert lcs_length(np.array(a, np.uint64), np.array(b, np.uint64)) == slow_lcs(a, b)


@pytest.fixture
def items(spark, prose):
    texts = [" ".join(prose(30)) + ". Answer " + " ".join(prose(6)) + "." for _ in range(12)] + ["tiny item here", None, ""]
    return texts, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_planted_items_are_found_and_clean_texts_left(docs, items, prose):
    texts, benchmark = items
    draw = prose.draw

    def paraphrase(text):
        words = text.split()
        for k in range(0, len(words) - 8, 4):
            words[k] = prose(1)[0]
        return " ".join(words)

    rows = {
        0: " ".join(prose(400)) + " " + texts[0] + " " + " ".join(prose(300)),
        1: texts[1].upper().replace(" ", "  ###  "),
        2: " ".join(prose(50)) + "\n" + paraphrase(texts[2]) + " " + " ".join(prose(50)),
        3: texts[3] + " " + texts[4],
        4: " ".join(prose(2000)),
        5: "",
        6: None,
        7: "a tiny item here now",
        8: " ".join(prose(60)),
        9: " ".join(sorted(texts[5].split(), key=lambda _: draw.random())),
    }
    df = docs(list(rows.items()) + [(0, rows[0]), (None, texts[6])])
    got = {(r.doc_id, i.item_id) for r in with_leaks(df, benchmark, output="found").collect() for i in r.found}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (3, 4), (7, 12), (None, 6)}
    left = remove_leaks(df, benchmark)
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 8, 9] and left.columns == df.columns


def test_blocks_give_the_same(docs, items, prose, monkeypatch):
    texts, benchmark = items
    df = docs([" ".join(prose(20)) + " " + t for t in texts[:12]])
    one = {(r.doc_id, i.item_id) for r in with_leaks(df, benchmark, output="f").collect() for i in r.f}
    monkeypatch.setattr(dc.read_items, "__defaults__", (5,))
    assert {(r.doc_id, i.item_id) for r in with_leaks(df, benchmark, output="f").collect() for i in r.f} == one == {(k, k) for k in range(12)}


def test_text_ids_and_parts_in_turn(spark, docs, prose, monkeypatch):
    texts = [" ".join(prose(25)) for _ in range(12)]
    benchmark = spark.createDataFrame([(f"item-{k}", t) for k, t in enumerate(texts)], "item_id string, text string")
    monkeypatch.setattr(dc.read_items, "__defaults__", (2,))
    monkeypatch.setattr(dc, "PASS_BLOCKS", 2)
    df = docs([" ".join(prose(20)) + " " + t for t in texts]).repartition(1)
    rows = with_leaks(df, benchmark, output="leaks").collect()  # a column of that name is there already
    assert {(r.doc_id, i.item_id) for r in rows for i in r.leaks} == {(k, f"item-{k}") for k in range(12)}


def test_short_items_stand_word_after_word(spark, docs):
    benchmark = spark.createDataFrame([(1, "never eat yellow snow")], "item_id long, text string")
    rows = ["you should never eat yellow snow here", "never do eat yellow or white snow", "Never EAT, yellow; snow!"]
    got = with_leaks(docs(rows), benchmark, output="f").orderBy("doc_id").collect()
    assert [len(r.f) for r in got] == [1, 0, 1]


def test_the_space_is_cut_and_copies_score_the_same(spark, prose):
    shared = [" ".join(prose(24)) for _ in range(3)]
    texts = [f"{shared[k % 3]} {' '.join(prose(8))}" for k in range(24)] + [" ".join(prose(30)) for _ in range(3)]
    words = [dc.word_hashes([t], letters_only=True)[0] for t in texts]
    space = dc.latent_space(spark, [dc.Item(k, w, w[-3:]) for k, w in enumerate(words)], np.ones(1 << dc.TERM_BITS))
    assert space.basis.shape[1] < len(texts)
    plain = np.zeros((len(space.terms), len(words)))
    for k, w in enumerate(words):
        np.add.at(plain[:, k], space.rows(w), 1.0)
    plain /= np.linalg.norm(plain, axis=0)
    scores = space.scores()[:-1].astype(float)
    assert abs(scores - plain).max() > 0.05
    for k, w in enumerate(words):
        assert scores[space.rows(w), k].sum() == pytest.approx(plain[space.rows(w), k].sum(), rel=1e-3)
        text, begin = np.concatenate([w, w[::-1]]), np.array([0, 2 * len(w)])
        assert k in [leak[0] for leak in dc.leaks_of(space, text, begin)[0]]


def test_empty_tables(docs, items):
    _, benchmark = items
    df = docs(["some text"])
    assert remove_leaks(df, benchmark.limit(0)).count() == 1
    assert remove_leaks(df.limit(0), benchmark).count() == 0


def test_every_verbatim_item_of_the_tables(spark):
    from textguard.llm.common import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    planted = {(d, i) for i, b in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for d, t in texts if b in (t or "")}
    assert planted <= {(r.doc_id, r.item_id) for r in QUERIES["op3_benchmark_leaks"](spark, folder).collect()}


def test_every_copy_of_thousands_of_items_is_found(spark, docs, prose):
    draw = prose.draw
    texts = [" ".join(f"w{int(20_000 ** draw.random())}" for _ in range(40)) for _ in range(2400)]
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    planted = range(0, len(texts), 7)
    df = docs([" ".join(prose(60)) + " " + texts[k] + " " + " ".join(prose(60)) for k in planted])
    got = {(r.doc_id, i.item_id) for r in with_leaks(df, benchmark, output="f").collect() for i in r.f}
    assert {(d, k) for d, k in enumerate(planted)} <= got


def test_short_items_among_rare_words_are_found(spark, docs, prose):
    draw = prose.draw
    vocabulary = prose(300)
    texts = [" ".join(draw.choice(vocabulary) for _ in range(n)) for n in range(3, 29) for _ in range(2)]
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")

    def rare(k, n):
        return " ".join(f"r{k}x{draw.randrange(10**9)}" for _ in range(n))

    common = [" ".join(draw.choice(vocabulary) for _ in range(100)) for _ in range(60)]
    df = docs([rare(k, 300 + k) + " " + t + " " + rare(k, 200) for k, t in enumerate(texts)] + common)
    got = {(r.doc_id, i.item_id) for r in with_leaks(df, benchmark, output="f").collect() for i in r.f}
    assert {(k, k) for k in range(len(texts))} <= got
