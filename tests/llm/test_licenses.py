from textguard.llm.licenses import NOTICES, scan


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_phrases_notices_and_odd_texts(docs):
    notice = NOTICES["mit"][1]
    bent = notice.split()
    bent[20] = "changed"
    del bent[40]
    rows = [
        "MIT License, mit-license; the Apache license",
        "",
        None,
        "general public\nLICENSE general public x license",
        "foo " + notice.upper() + " bar",
        "foo " + " ".join(bent),
        " ".join(notice.split()[:12]),
        "word " * 3000 + "mit license",
        "mitlicense mit licensed",
    ]
    got = by_id(scan(docs(rows + [(0, rows[0]), (None, "mit license")])))
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 0, 5, "apache,mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert got[2].n_words == 0 and got[2].labels == ""
    assert (got[3].n_base, got[3].base_labels) == (1, "gpl")
    assert (got[4].n_base, got[4].base_labels, got[4].labels, got[4].score) == (0, "", "mit", 1.0)
    assert got[5].labels == "mit" and 0.6 <= got[5].score < 1
    assert got[6].labels == ""
    assert (got[7].n_words, got[7].first_word) == (3002, 3000)
    assert got[8].n_base == 0
    assert got[None].n_base == 1


def test_repeated_rows_and_empty_table(docs):
    df = docs([(1, "mit license")] * 3)
    rows = scan(df).collect()
    assert [r.n_base for r in rows] == [1, 1, 1]
    assert scan(df.limit(0)).count() == 0
