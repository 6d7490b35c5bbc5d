import re
from collections import defaultdict

import pytest

from lakekin.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levels(sizes, weights=(1, 2, 3)):
    """Targets by dealing again until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if 3 * sizes[s] < share * weight[s]]
        if not over:
            target.update({s: share * weight[s] for s in free})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def check(rows, found):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target = levels(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        # Rows repeated alike share the cut evenly and may lose a word each.
        assert target[s] - 3 <= taken[s] <= target[s] + 1e-6


def test_edges(edge_docs, edge_rows):
    check(edge_rows, mixing.mix(edge_docs).collect())


def test_many_sources_and_one_hot(make_docs):
    rows = [(i, "w " * (i % 17), "hot" if i % 3 else f"s{i % 29}") for i in range(900)]
    rows += [(1000 + i, "long " * 5000, f"s{i}") for i in range(2)]
    df = make_docs(rows)
    check(rows, mixing.mix(df).collect())
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixing.mix(df).collect()))


def test_rows_match_the_plan(make_docs):
    rows = [(i, f"d{i} " + "word\t" * (i % 23), f"s{i % 5}") for i in range(200)]
    df = make_docs(rows)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    got = defaultdict(int)
    text = {i: t for i, t, _ in rows}
    for r in mixed.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert text[r["doc_id"]].startswith(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {i: n for i, n in plan.items() if n} == dict(got)


def test_empty(no_docs):
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mixed_rows(no_docs).collect() == []


def test_no_words(make_docs):
    found = mixing.mix(make_docs([(1, None, "a"), (2, " ", "b")])).collect()
    assert [(r["target"], r["taken"]) for r in found] == [(0.0, 0), (0.0, 0)]
