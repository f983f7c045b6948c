import itertools
from math import exp, log

import numpy as np
import pytest

from textguard.llm.language_id import _LETTERS, UNKNOWN, Model, PieceTable, Scorer, _long_word, fit, letter_runs, predict, word_log_probs

PIECES = {"a": (0.2, 0.1), "b": (0.1, 0.3), "ab": (0.3, 0.05), "ba": (0.05, 0.2), "aba": (0.1, 0.1), "abab": (0.02, 0.03)}


@pytest.fixture
def model():
    return Model(["l1", "l2"], PIECES)


def all_segmentations(word, k, floor=1e-9):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        p, start = 1.0, 0
        for end in ends:
            piece = word[start:end]
            p *= PIECES[piece][k] if piece in PIECES else floor if len(piece) == 1 else 0.0
            start = end
        total += p
    return log(total)


def test_forward_equals_all_segmentations(model):
    words = ["a", "ab", "aba", "abab", "babab", "abxba", "x", "bbaabbab", "é中a"]
    table = PieceTable(model).log_probs(words)
    for row, word in zip(table, words, strict=True):
        want = [all_segmentations(word, k) for k in range(2)]
        assert np.allclose(row, want) and np.allclose(word_log_probs(word, model), want)
        assert np.allclose(_long_word(word, model.pieces, model.unknown()), want)


def test_long_words_do_not_underflow(model):
    long = "ab" * 5000 + "x"
    assert np.isfinite(Scorer(model).texts([long])[0][0]).all()
    assert np.allclose(_long_word("ab" * 30, model.pieces, model.unknown()), word_log_probs("ab" * 30, model))


def test_texts_are_sums_over_words(model):
    got, letters = Scorer(model).texts(["AB, aba-b 12\nab"])[0]
    want = [sum(all_segmentations(w, k) for w in ("ab", "aba", "b", "ab")) for k in range(2)]
    assert np.allclose(got, want) and letters == 8


def test_defined_results(docs, model):
    rows = ["ab ab", "b ba bb", "", None, "123 -- ", (0, "ab ab"), (None, "b ba bb")]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in predict(docs(rows).drop("score"), model).collect()}
    assert got[0, "ab ab"][0] == "l1" and got[1, "b ba bb"][0] == got[None, "b ba bb"][0] == "l2"
    assert got[2, ""] == got[3, None] == got[4, "123 -- "] == (UNKNOWN, 0.0)
    likelihood = Scorer(model).texts(["ab ab"])[0][0]
    assert got[0, "ab ab"][1] == pytest.approx(1 / (1 + exp(likelihood[1] - likelihood[0])))
    assert [r.lang_pred for r in predict(docs(["ab"]), Model([], {})).collect()] == [UNKNOWN]
    assert predict(docs(["ab"]).limit(0), model).count() == 0


def test_numbers_are_no_letters(docs, model):
    got = predict(docs(["½ ² Ⅷ ①", "½ab²ba", "aⅧ"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [UNKNOWN, "l1", "l1"]
    assert Scorer(model).texts(["½ab²ba"])[0][1] == 4


def test_few_tokens_need_the_pattern(model, monkeypatch):
    class Pattern:
        asked = []

        def findall(self, text):
            self.asked.append(text)
            return _LETTERS.findall(text)

    monkeypatch.setattr("textguard.llm.language_id._LETTERS", Pattern())
    marked = ["(ab),", "Straße.", "AB", "12", "--", "_x_", "слово!", "İ", "a½", "½", "ab-ba", "a1b", "Ⅷ", "ªb", "e\u0301a", ""]
    for token in marked:
        Pattern.asked.clear()
        got = letter_runs(token)
        assert got == _LETTERS.findall(token.lower()), token
        assert not Pattern.asked or not token.lower().strip("()-,.!_123").isalpha()
    Pattern.asked.clear()
    rows = Scorer(model).texts(["ab, (ba) ab. 12 --", "ab-ba ab"])
    assert [n for _, n in rows] == [6, 6] and Pattern.asked == ["ab-ba"]


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([("ab ab", "mine", 7, "kept")], "text string, lang_pred string, score int, _language string")
    row = predict(df, model).first()
    assert (row.lang_pred, row._language) == ("l1", "kept") and 0 < row.score <= 1


def test_memory_does_not_follow_the_texts(model, monkeypatch):
    import tracemalloc

    from textguard.llm import language_id

    monkeypatch.setattr(language_id, "CACHE_TOKENS", 2000)
    monkeypatch.setattr(language_id, "PASS_TOKENS", 1000)
    monkeypatch.setattr(language_id, "GROUP_WORDS", 200)
    texts = [" ".join(f"{'ab' * 25}{'abx'[k % 3]}{'a' * (k % 7)}x{'b' * (j % 5)}" for j in range(600)) for k in range(120)]
    texts.append(" ".join("a" * (k % 60) + "b" * (k // 60) for k in range(3000)))
    scorer = Scorer(model)
    want = [sum(word_log_probs(w, model)[0] for w in t.split()) for t in (texts[3], texts[-1])]
    tracemalloc.start()
    got = scorer.texts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose([got[3][0][0], got[-1][0][0]], want) and peak < 20e6


def test_learning(spark, prose):
    rows = [(" ".join(w + ("ung" if k % 2 else "tion") for w in prose(30)), "de" if k % 2 else "en") for k in range(80)]
    rows += [(None, "de"), ("x", None), ("", "en"), rows[0]]
    model = fit(spark.createDataFrame(rows, "text string, lang string"), rounds=2)
    assert model.languages == ["de", "en"]
    for k in range(2):
        assert sum(row[k] for row in model.pieces.values()) == pytest.approx(1)
    scores = Scorer(model).texts(["Wanderung", "nation"])
    assert scores[0][0].argmax() == 0 and scores[1][0].argmax() == 1
    assert fit(spark.createDataFrame([], "text string, lang string")).languages == []


def test_held_out_accuracy(spark):
    from textguard.llm.common import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op9_language_id"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    good, every = got.where("lang_pred = lang").count(), got.where("lang IS NOT NULL AND length(text) > 40").count()
    assert good >= 0.95 * every > 0
