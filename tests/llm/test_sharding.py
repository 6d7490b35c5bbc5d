import zlib
from collections import defaultdict

from lakekin.llm import sharding


def brute(rows, shards):
    """Shard per text by taking the least loaded shard, largest group first."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    size = lambda t: len(groups[t]) * (len(t.encode()) + 1)
    first = lambda t: min((i is not None, i or 0) for i in groups[t])
    loads, found = [0] * shards, {}
    for text in sorted(groups, key=lambda t: (-size(t), first(t))):
        k = loads.index(min(loads))
        loads[k] += size(text)
        found[text] = k
    return found, loads


def read(out, docs):
    rows = out.collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[r.text_sha256].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    loads = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    return rows, loads


def test_edges(edge_docs, edge_rows):
    rows, loads = read(sharding.shard_rows(edge_docs), edge_docs)
    expected, wanted = brute([(i, t) for i, t, _ in edge_rows], 8)
    assert loads == wanted
    crc = {zlib.crc32(t.encode()): k for t, k in expected.items()}
    assert all(crc[r.text_crc32] == r.shard for r in rows)
    sizes = sorted(len((t or "").encode()) + 1 for _, t, _ in edge_rows)
    assert sorted(r.size for r in rows) == sizes


def test_several_rounds(make_docs):
    """Heaps of few groups: still level, and copies of one text stay together."""
    rows = [(i, f"{i} " + "word " * (1 + i * 37 % 90), "s") for i in range(3000)]
    rows += [(10_000 + i, "copied text " * 10, "s") for i in range(1500)]
    docs = make_docs(rows).repartition(6)
    out = sharding.shard_rows(docs, per_heap=1000, piles=128)
    _, loads = read(out, docs)
    total, copied = sum(loads), 1500 * (len("copied text " * 10) + 1)
    assert max(loads) == copied > total / 8
    rest = sorted(loads)[:-1]
    assert rest[-1] - rest[0] < 0.02 * total / 8


def test_reruns_agree(make_docs):
    docs = make_docs([(i, f"t{i % 700} " * (i % 13), "s") for i in range(1000)])
    first, second = (sharding.shard_rows(d, per_heap=100, piles=16).collect() for d in (docs, docs.repartition(7)))
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_heap():
    assert sharding.least_loaded([5, 4, 3, 3, 3], 2) == [0, 1, 1, 0, 1]


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "yy")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.size) for r in sharding.shard_rows(docs).collect()) == [("", 3), ("a", 2), ("b", 2)]


def test_empty(no_docs):
    out = sharding.shard_rows(no_docs)
    assert out.collect() == []
    assert set(out.columns) == {"doc_id", "size", "text_crc32", "text_sha256", "shard", "slot"}
