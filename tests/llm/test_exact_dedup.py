import hashlib
import re
from collections import defaultdict

import pytest

from lakekin.llm import exact_dedup

GAP = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[GAP.sub(" ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for n, i in enumerate(ids):
            out.append((i, ids[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("key_bits", [64, 3, 1])
def test_edges_and_collisions(edge_docs, edge_rows, key_bits):
    assert got(exact_dedup.groups(edge_docs, key_bits=key_bits)) == brute(edge_rows)


def test_many_buckets_and_a_hot_group(make_docs):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 100}", "s") for i in range(600)]
    df = make_docs(rows).repartition(5)
    assert got(exact_dedup.groups(df, capacity=500)) == brute(rows)


def test_directory_splits_overfull_buckets_only(make_docs):
    stored = exact_dedup.entries(make_docs([(i, f"text {i} " * 5, "s") for i in range(300)]))
    found = exact_dedup.directory(stored, capacity=2000).collect()
    assert len({r["bucket"] for r in found}) > 8 and max(r["depth"] for r in found) > 2
    one = exact_dedup.directory(stored, capacity=1 << 30).collect()
    assert {(r["depth"], r["bucket"]) for r in one} == {(0, 1)}


def test_kept_rows_carry_all_columns(edge_docs, edge_rows):
    kept = exact_dedup.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    found = sorted(((r["doc_id"], r["text"], r["key"]) for r in kept.collect()), key=str)
    texts = {i: t for i, t, _ in edge_rows}
    assert found == sorted(((i, texts[i], 2) for i, _, _, k, _ in brute(edge_rows) if k), key=str)


def test_empty(no_docs):
    assert exact_dedup.groups(no_docs).collect() == []
    assert exact_dedup.keep_first(no_docs).collect() == []
