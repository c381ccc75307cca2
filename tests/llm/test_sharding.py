import zlib
from collections import defaultdict

from tapcast.llm import queries, sharding
from tapcast.llm.common import shared_path

from .cases import ROWS, SF, awkward, empty, texts


def test_query_against_brute_force(spark):
    rows = queries.op6_virtual_slots(spark, SF).collect()
    docs = texts()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(8))
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r.vslot].add(r.shard)
    assert all(len(s) == 1 for s in by_slot.values())


def test_growing_moves_slots_only_into_the_new_shard(spark):
    recs = sharding.records(spark.read.parquet(f"{SF}/documents.parquet"))
    sizes = sharding.slot_sizes(recs)
    path = shared_path(spark, "maps")
    sharding.save_map(sharding.first_map(sizes, 4), path)
    sharding.save_map(sharding.grown_map(sharding.load_map(spark, path), sizes, 4), path)
    one = {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    two = {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert len(one) == len(two) == sharding.SLOTS
    moved = {s for s in one if one[s] != two[s]}
    assert moved and all(two[s] == 4 for s in moved)
    size = {r.vslot: r.bytes for r in sizes.collect()}
    load = [sum(size[s] for s in two if two[s] == k) for k in range(5)]
    assert abs(load[4] - sum(load) / 5) < 4 * max(size.values())


def test_awkward_rows_and_empty_table(spark):
    for df, n in ((awkward(spark), len(ROWS)), (empty(spark), 0)):
        recs = sharding.records(df)
        sizes = sharding.slot_sizes(recs)
        assert sizes.count() == sharding.SLOTS
        got = sharding.placed(recs, sizes, sharding.first_map(sizes, 3)).collect()
        assert len(got) == n
        for k in range(3):
            own = sorted(r.slot for r in got if r.shard == k)
            assert own == list(range(len(own)))
        assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t in ROWS[:n])


def test_plan_has_no_python(spark):
    recs = sharding.records(spark.read.parquet(f"{SF}/documents.parquet"))
    sizes = sharding.slot_sizes(recs)
    plan = sharding.placed(recs, sizes, sharding.first_map(sizes, 8))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
