import zlib
from collections import Counter

from flowloom.llm.shard_tree import assign_shards


def test_law_and_slots(spark):
    docs = [(i, f"text é {i}" * (i % 7)) for i in range(3000)] + [(5, "again"), (5, "again"), (None, "n"), (None, None), (7, None), (8, "")] + [(77, "hot")] * 800
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, size int, shard string").repartition(6)
    got = assign_shards(df, 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, place = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 40) and r.rack == r.shard // 4 and r.region == r.shard // 20 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    grown = {r.doc_id: r.shard for r in assign_shards(df, 41).collect()}
    assert all(grown[d] == g for d, (_, g) in place.items())
    assert assign_shards(df.limit(0), 40).count() == 0


def test_weights_move_rows_only_into_the_changed_shard(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    before = {r.doc_id: r.shard for r in assign_shards(df, 12).collect()}
    after = {r.doc_id: r.shard for r in assign_shards(df, 12, [1.0] * 5 + [3.0] + [1.0] * 6).collect()}
    moved = {d for d in before if before[d] != after[d]}
    assert moved and all(after[d] == 5 for d in moved)
    share = sum(s == 5 for s in after.values()) / 4000
    assert abs(share - 3 / 14) < 0.03
    assert 0 not in {r.shard for r in assign_shards(df, 3, [0.0, 1.0, 1.0]).collect()}
