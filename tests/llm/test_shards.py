import zlib
from collections import Counter

import pytest

from cropframe.llm import shards as S


def test_bytes_near_equal_positions_gapless(spark, documents):
    rows = [(i, "ü" * (i * 37 % 400)) for i in range(3000)] + [(None, None)] * 5 + [(7, "same")] * 1500
    got = S.shard_documents(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes, by_shard = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 801
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    want = Counter((i, 1 if t is None else len(t.encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert len({r.virtual_slot for r in got if r.doc_id == 7}) > 500  # copies are spread


def test_map_versions(spark, documents, tmp_path):
    docs = documents([(i, "x" * (i % 90)) for i in range(4000)])
    rows = S.slotted(docs, 256).persist()
    sizes = S.slot_sizes(rows, 256)
    v0 = S.first_map(spark, 256, 8)
    v1 = S.rebalance(v0, sizes, 8)
    v2 = S.rebalance(v0.unionByName(v1), sizes, 9)
    a, b = ({r.virtual_slot: r.shard for r in v.collect()} for v in (v1, v2))
    assert len(a) == len(b) == 256 and {r.version for r in v2.collect()} == {2}
    load = Counter()
    for r in sizes.collect():
        load[b[r.virtual_slot]] += r.bytes
    assert set(load) == set(range(9)) and max(load.values()) < 1.05 * sum(load.values()) / 9
    assert sum(a[s] == b[s] for s in a) > 0.8 * 256  # only what the new shard needs moves
    path = str(tmp_path / "map")
    S.shard_documents(docs, 256, 8, path).count()
    assert {r.version for r in spark.read.parquet(path).collect()} == {0, 1}
    rows.unpersist()


def test_stored_map_is_edited_and_keeps_its_history(spark, documents, tmp_path):
    docs = documents([(i, "x" * (i % 90)) for i in range(4000)])
    path = str(tmp_path / "map")
    S.shard_documents(docs, 256, 8, path).count()
    grown = S.shard_documents(docs, 256, 9, path)
    assert {r.map_version for r in grown.select("map_version").distinct().collect()} == {2}
    maps = {}
    for r in spark.read.parquet(path).collect():
        maps.setdefault(r.version, {})[r.virtual_slot] = r.shard
    assert {v: len(m) for v, m in maps.items()} == {0: 256, 1: 256, 2: 256}
    assert set(maps[2].values()) == set(range(9)) and sum(maps[1][s] == maps[2][s] for s in maps[1]) > 0.8 * 256
    with pytest.raises(ValueError):
        S.shard_documents(docs, 128, 8, path)


def test_copies_are_numbered_in_runs(documents, monkeypatch):
    monkeypatch.setattr(S, "RUN", 7)
    got = S.slotted(documents([(1, "a")] * 50 + [(2, "b")] + [(3, "c")] * 7 + [(4, "d")] * 8)).collect()
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert {i: sorted(c) for i, c in copies.items()} == {1: list(range(1, 51)), 2: [1], 3: list(range(1, 8)), 4: list(range(1, 9))}


def test_empty(documents):
    assert S.shard_documents(documents([])).count() == 0
