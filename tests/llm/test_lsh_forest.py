import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakekin.llm import lsh_forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest id reachable, per row with an id."""
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(n)
    common = defaultdict(int)
    for found in where.values():
        for x in range(len(found)):
            for y in range(x):
                common[found[y], found[x]] += 1
    for (x, y), both in common.items():
        if 100 * both >= 75 * (len(sets[x][1]) + len(sets[y][1]) - both):
            a, b = find(sets[x][0]), find(sets[y][0])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in sets}


def check(df, rows):
    found = lsh_forest.near_groups(df).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    sizes = {i: len(shingles(t)) for i, t, _ in rows}
    for r in found:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["n_shingles"] == sizes[r["doc_id"]]


def test_edges(edge_docs, edge_rows):
    check(edge_docs, edge_rows)


def varied(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_chains_and_a_common_passage(make_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(vocabulary) for _ in range(120)]
    rows, n = [], 0
    for size in (2, 3, 5, 80):
        base = [rng.choice(vocabulary) for _ in range(100)]
        for _ in range(size):
            rows.append((n, varied(rng, base, rng.randrange(0, 4)), "s"))
            n += 1
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(12):
        chain[rng.randrange(200)] = f"c{n}"
        chain[rng.randrange(200)] = f"d{n}"
        rows.append((n, " ".join(chain), "s"))
        n += 1
    # Many texts half of which is one passage: crowded, and mostly not similar.
    for _ in range(60):
        rows.append((n, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(10, 120))]), "s"))
        n += 1
    rng.shuffle(rows)
    check(make_docs(rows), rows)


def test_exact_join_of_crowded(spark, make_docs):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, varied(rng, base, rng.randrange(0, 6)), "s") for i in range(60)]
    df = make_docs(rows)
    sets = lsh_forest.sets_of(df.select("doc_id", "text"))
    prefix = lsh_forest.prefixes(df.select(df.doc_id.alias("rep")), sets)
    met = {(r["a"], r["b"]) for r in lsh_forest.crowded_pairs(prefix, None, False).collect()}
    stars = {(r["a"], r["b"]) for r in lsh_forest.crowded_pairs(prefix, None, True).collect()}
    assert stars and all(a < b for a, b in stars)
    own = {i: shingles(t) for i, t, _ in rows}
    for a in own:
        for b in own:
            if a < b and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                assert (a, b) in met
    links = lsh_forest.confirmed(spark.createDataFrame(sorted(met), "a long, b long"), sets).collect()
    assert all(100 * len(own[r["a"]] & own[r["b"]]) >= 75 * len(own[r["a"]] | own[r["b"]]) for r in links)


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_neighbours_do_not_depend_on_batches(step):
    rng = np.random.default_rng(1)
    rows = sorted((t, bytes(rng.integers(0, 2, 1, np.uint8)) + bytes(31), int(i)) for t in range(2) for i in range(60))
    table = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([9] * len(rows))],
        names=["tree", "label", "rep", "n"],
    )
    parts = [table.slice(i, step) for i in range(0, table.num_rows, step)]
    found = sorted({(r["a"], r["b"], r["tree"]) for b in lsh_forest._neighbours(iter(parts)) for r in b.to_pylist()}, key=str)
    want = set()
    for tree in range(2):
        own = [r for r in rows if r[0] == tree]
        for i, r in enumerate(own):
            same = [x for x in own if x[1] == r[1]]
            at = same.index(r)
            for other in [*same[max(0, at - lsh_forest.REACH) : at], same[0]]:
                if other is not r:
                    want.add((min(r[2], other[2]), max(r[2], other[2]), 1 << tree))
            if len(same) > lsh_forest.REACH and (at >= lsh_forest.REACH or at + lsh_forest.REACH < len(same)):
                want.add((r[2], None, 1 << tree))
    assert found == sorted(want, key=str)


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
    found = lsh_forest.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == n and {r["component"] for r in found} == {0}


def test_empty_and_kept_rows(no_docs, edge_docs, edge_rows):
    assert lsh_forest.near_groups(no_docs).collect() == []
    assert lsh_forest.keep_one(no_docs).collect() == []
    kept = lsh_forest.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    want = brute(edge_rows)
    found = {r["doc_id"] for r in kept.collect()}
    assert {i for i in found if i is not None} == {i for i in want if want[i] == i} and None in found


def test_crowded_documents_without_candidates_are_joined(make_docs, monkeypatch):
    texts = [" ".join(f"w{k}" for k in range(60)) + f" end{i}" for i in range(4)]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])

    def none_offered(classes):
        pairs = classes.selectExpr("rep as a", "rep as b", "1 as trees").filter("a < 0")
        return pairs, classes.select("rep")

    monkeypatch.setattr(lsh_forest, "candidates", none_offered)
    assert {r["component_id"] for r in lsh_forest.near_groups(docs).collect()} == {0}


def test_words_of_equal_polynomials(make_docs):
    """Different one-word documents stay apart, however alike their bits are."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits), "a"), (2, "".join("ba"[b] for b in bits), "a"), (3, "".join("ab"[b] for b in bits), "a")]
    found = {r.doc_id: r.component_id for r in lsh_forest.near_groups(make_docs(rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
