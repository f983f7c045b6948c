import zlib
from collections import Counter

from pyspark.sql import functions as F

from textguard.llm.sharding import two_pass_shuffle, write_shards


def size():
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 1


def test_counts_and_slots(docs):
    rows = [(k % 50, f"text {k % 70}") for k in range(203)] + [(None, None)] * 5 + [(7, "same")] * 90
    df = docs(rows, extra=False)
    for bucket_bytes in (1 << 20, 100):
        got = two_pass_shuffle(df, size(), bucket_bytes=bucket_bytes).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
        shards = Counter(r.shard for r in got)
        assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1
        for s in range(8):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(shards[s]))


def test_order_is_shuffled_and_follows_the_seed(docs):
    df = docs([f"t{k}" for k in range(400)], extra=False)
    one, two = (
        [r.doc_id for r in two_pass_shuffle(df, size(), seed=s, unique=True).orderBy("shard", "slot").collect()] for s in (1, 2)
    )
    assert sorted(one) == sorted(two) == list(range(400)) and one != two and one != sorted(one)


def test_empty_and_few(docs, spark):
    df = docs(["a", "b", "c"], extra=False)
    assert two_pass_shuffle(df.limit(0), size()).count() == 0
    assert sorted(r.slot for r in two_pass_shuffle(df, size()).collect()) == [0, 0, 0]


def test_clashing_columns_and_written_shards(docs, tmp_path, spark):
    df = docs(["a", "b", None, "ü" * 9]).drop("shard", "slot")
    write_shards(df, size(), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4 and set(df.columns) < set(back.columns)


def test_query_columns(spark):
    from textguard.llm.common import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op4_two_pass_shuffle"](spark, folder).collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_query_writes_the_texts(spark, tmp_path, monkeypatch):
    from textguard.llm import sharding
    from textguard.llm.common import QUERIES

    folder, out = "/root/testdata/sf0.001", str(tmp_path / "shards")
    monkeypatch.setattr(sharding, "scratch_folder", lambda *_: out, raising=False)
    got = sorted((r.doc_id, r.shard, r.slot) for r in QUERIES["op4_two_pass_shuffle"](spark, folder).collect())
    back = spark.read.parquet(out).collect()
    assert got == sorted((r.doc_id, r.shard, r.slot) for r in back)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_no_records_are_written_and_read(docs, tmp_path):
    assert write_shards(docs(["a"], extra=False).limit(0), size(), str(tmp_path / "none")).count() == 0
