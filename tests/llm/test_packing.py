from collections import Counter

import numpy as np

from lakekin.llm import packing


def slow_best_fit(lengths, row):
    rooms, placed = [], []
    for n in lengths:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            least = min(fits)[0]
            i = next(i for room, i in fits if room == least)
        else:
            i = len(rooms)
            rooms.append(row)
        rooms[i] -= n
        placed.append(i)
    return rooms


def test_best_fit_fills_like_a_plain_search():
    rng = np.random.default_rng(2)
    for row, n in [(10, 50), (64, 400), (2048, 300), (1, 5)]:
        lengths = np.sort(rng.integers(1, row + 1, n))[::-1]
        placed = packing.best_fit(lengths, row)
        used = np.bincount(placed, weights=lengths).astype(int)
        assert sorted(row - used) == sorted(slow_best_fit(lengths.tolist(), row))


def check(df, rows, row, shard_ids):
    found = packing.pack_documents(df, row=row, shard_ids=shard_ids).collect()
    docs = Counter()
    pieces = {}
    for r in found:
        ids = np.frombuffer(r["ids"], np.uint8)
        assert len(ids) == row and r["cumulative"][0] == 0 and r["cumulative"][-1] == r["n_ids"]
        assert r["resets"] == r["cumulative"][:-1]
        assert (ids[r["n_ids"] :] == packing.PAD_ID).all()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cumulative"], r["cumulative"][1:]):
            pieces.setdefault((doc, start), []).append(ids[a:b].tolist())
    # A repeated row's pieces come as often as the row.
    for doc in {d for d, _ in pieces}:
        own = sorted((s, p) for (d, s), p in pieces.items() if d == doc)
        for k in range(len(own[0][1])):
            whole = [i for _, p in own for i in p[k]]
            assert whole[-1] == packing.END_ID
            docs[doc, bytes(whole[:-1]).decode()] += 1
    want = Counter((i, t) for i, t, _ in rows if t)
    assert docs == want
    return found


def test_lossless(edge_docs, edge_rows):
    rows = check(edge_docs, edge_rows, 256, 1 << 12)
    assert len({r["shard"] for r in rows}) > 5
    check(edge_docs, edge_rows, packing.ROW, packing.SHARD_IDS)


def test_one_hot_document_spreads_over_shards(make_docs):
    rows = [(1, "x" * 100_000, "s"), (2, "y", "s")]
    found = check(make_docs(rows), rows, 128, 4096)
    assert len({r["shard"] for r in found}) > 10


def test_empty(no_docs):
    assert packing.pack_documents(no_docs).collect() == []


def test_wider_ids(spark):
    ids = {1: [5, 60_000, 7], 2: [300], 3: [1, 2]}
    rows = [(0, d, 0, len(v), bytearray(np.array(v, "<u2").tobytes())) for d, v in ids.items()]
    df = spark.createDataFrame(rows, "shard int, doc_id long, start long, n long, ids binary")
    found = packing.pack(df, row=4, pad_id=9, width=2).orderBy("row").collect()
    got = [np.frombuffer(r["ids"], "<u2").tolist() for r in found]
    assert got == [[5, 60_000, 7, 300], [1, 2, 9, 9]]
