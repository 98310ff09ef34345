import zlib

from gridloom.llm.sharding import byte_shards


def check(rows, shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    for k, members in by_shard.items():
        assert 0 <= k < shards
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert sum(r.size for r in members) <= total / shards + largest
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)  # contiguous


def test_awkward_rows(awkward):
    source = awkward.collect()
    rows = byte_shards(awkward, 4).collect()
    check(rows, 4)
    want = sorted(
        (-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 16,
         zlib.crc32((r.text or "").encode())) for r in source
    )
    assert want == sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows)


def test_one_id_holds_all_rows(spark):
    df = spark.createDataFrame([(7, "same")] * 5000, "doc_id long, text string").repartition(4)
    rows = byte_shards(df, 10).collect()
    check(rows, 10)
    assert {sum(r.shard == k for r in rows) for k in range(10)} == {500}


def test_whole_table(docs):
    rows = byte_shards(docs, 40).collect()
    assert len(rows) == docs.count()
    check(rows, 40)


def test_empty(empty):
    assert byte_shards(empty).count() == 0
