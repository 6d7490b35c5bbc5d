"""The inverted key index against plain sets, and what a search of it reads."""

import random
import statistics
from collections import Counter, defaultdict

import pytest

from lakekin.operators import exact, key_index
from lakekin.operators.pairs import LakeTable
from lakekin.session import new_folder

CELLS = "table_id string, row_id long, column_id int, column_name string, cell string, num double"


def lake_cells(rng, tables=40, rows=60):
    """Tables of two key columns and two measures; a few keys stand everywhere."""
    cells, keys = [], {}
    for t in range(tables):
        reach = rng.choice([8, 30, 200])
        for r in range(rng.randint(rows // 2, rows)):
            for c in range(2):
                key = rng.choice(["all", "most"]) if rng.random() < 0.3 else f"k{rng.randrange(reach)}"
                key = None if c == 1 and t % 3 == 0 else key
                cells.append((f"t{t:02d}", r, c, f"key{c}", key, None))
                if key is not None:
                    keys.setdefault((f"t{t:02d}", f"key{c}"), []).append((r, key))
            for c in (2, 3):
                number = None if rng.random() < 0.1 else float(rng.randrange(100))
                cells.append((f"t{t:02d}", r, c, f"m{c}", None if number is None else str(number), number))
    # A column whose every cell is missing counts as numbers, so it is no key.
    return cells, {c: found for c, found in keys.items() if not (c[1] == "key1" and int(c[0][1:]) % 3 == 0)}


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(4)
    cells, keys = lake_cells(rng)
    frame = spark.createDataFrame(cells, CELLS).repartition(4)
    path = new_folder(spark, "cells")
    frame.write.parquet(path)
    index = key_index.save_index(spark.read.parquet(path), new_folder(spark, "key-index"))
    rows = [(f"k{rng.randrange(40)}" if rng.random() < 0.8 else "all", f"k{rng.randrange(9)}", float(rng.randrange(50))) for _ in range(90)]
    rows += [(None, "most", 1.0), ("unknown", None, None)]
    query = spark.createDataFrame(rows, "a string, b string, x double")
    moments = exact.keyed_moments([LakeTable("query", query, ("a", "b"), ("x",))])
    return index, moments, cells, keys, rows


def own_keys(rows, at):
    return {r[at] for r in rows if r[at] is not None}


@pytest.mark.parametrize("k", [1, 3, 10, 500])
def test_overlap_topk(built, k):
    index, moments, _, keys, rows = built
    found = defaultdict(list)
    for r in key_index.overlap_topk_cells(index, moments, k).collect():
        found[r.query_key].append((-r.overlap, r.table_id, r.key_col, r.joinability))
    for at, name in enumerate("ab"):
        own, counts = own_keys(rows, at), Counter(r[at] for r in rows)
        expected = []
        for (table, column), cells in keys.items():
            held = {key for _, key in cells} & own
            if held:
                expected.append((-len(held), table, column, sum(counts[key] for _, key in cells)))
        assert sorted(found[name]) == sorted(expected)[:k]


def test_a_long_list_makes_no_candidates(built):
    """With a bound of all keys but one, only the rarest keys are looked up."""
    index, moments, *_ = built
    known = key_index.known_keys(index, moments)
    needed = known.select(*key_index.QUERY).distinct().selectExpr("*", "1L AS need")
    taken = {(r.query_key, r.key) for r in key_index.rarest(known, needed).collect()}
    least = {q: min(r.columns for r in known.collect() if r.query_key == q) for q in "ab"}
    assert taken == {(r.query_key, r.key) for r in known.collect() if r.columns == least[r.query_key]}
    assert not taken & {("a", "all"), ("b", "most")}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_containment(built, threshold):
    index, moments, cells, keys, rows = built
    found = key_index.containment_first_cells(index, moments, threshold=threshold, p_values=True).collect()
    numbers = {(t, r, name): n for t, r, _, name, _, n in cells}
    expected = {}
    for at, q in enumerate("ab"):
        own = own_keys(rows, at)
        xs = {key: [r[2] for r in rows if r[at] == key and r[2] is not None] for key in own}
        for table in {t for t, _ in keys}:
            shares = [(len({key for _, key in keys[table, c]} & own) / len(own), -i, c) for i, c in enumerate(("key0", "key1")) if (table, c) in keys]
            share, _, column = max(shares)
            if share <= threshold:
                continue
            for m in ("m2", "m3"):
                means = defaultdict(list)
                for r, key in keys[table, column]:
                    if numbers[table, r, m] is not None and xs.get(key):
                        means[key].append(numbers[table, r, m])
                if means:
                    pairs = [(statistics.fmean(xs[key]), statistics.fmean(v)) for key, v in means.items()]
                    expected[q, table, column, m] = (share, pairs)
    assert {(r.query_key, r.table_id, r.key_col, r.value_col) for r in found} == set(expected)
    for r in found:
        share, pairs = expected[r.query_key, r.table_id, r.key_col, r.value_col]
        assert r.containment == pytest.approx(share) and r.n == len(pairs)
        if len(pairs) > 2:
            assert r.correlation == pytest.approx(statistics.correlation(*zip(*pairs)))
            assert 0 <= r.p_value <= 1


def test_rank_by_row_join(built):
    index, moments, cells, keys, rows = built
    found = key_index.overlap_rank_corr_cells(index, moments, 4).collect()
    numbers = {(t, r, name): n for t, r, _, name, _, n in cells}
    # A column without any cell is a measure by the strict rule, and has no r.
    assert all(r.correlation is None for r in found if r.value_col == "key1")
    found = [r for r in found if r.value_col != "key1"]
    assert len(found) == 2 * 4 * 2
    for r in found:
        at = "ab".index(r.query_key)
        joined = [
            (q[2], numbers[r.table_id, row, r.value_col])
            for row, key in keys[r.table_id, r.key_col]
            for q in rows
            if q[at] == key and q[2] is not None and numbers[r.table_id, row, r.value_col] is not None
        ]
        assert r.correlation == pytest.approx(statistics.correlation(*zip(*joined)))


def test_augment(spark, built):
    index, _, cells, keys, _ = built
    hits = spark.createDataFrame([(1, "t01", "key0", "m2"), (2, "t01", "key0", "m3")], "place int, table_id string, key_col string, value_col string")
    base = spark.createDataFrame([(1, "all"), (1, "all"), (2, None), (3, "nowhere")], "id int, key string")
    out = key_index.augment_hits_cells(base, "key", index, hits, 3, skip_first=1)
    assert out.columns == ["id", "key", "hit_2", "hit_3"]
    numbers = {(r, name): n for t, r, _, name, _, n in cells if t == "t01"}
    mean = statistics.fmean(numbers[r, "m3"] for r, key in keys["t01", "key0"] if key == "all" and numbers[r, "m3"] is not None)
    rows = sorted(map(tuple, out.collect()), key=lambda r: r[0])
    assert [r[0] for r in rows] == [1, 1, 2, 3] and rows[2][2] is None
    assert rows[0][2] == pytest.approx(mean) and rows[0][3] is None


def test_same_means_as_the_cells(spark, built):
    from lakekin.operators.pairs import cell_pair_means

    index, _, cells, *_ = built
    direct = cell_pair_means(spark.createDataFrame(cells, CELLS))
    order = lambda df: sorted((r.table_id, r.key_col, r.value_col, r.key, round(r.value, 9)) for r in df.collect())
    assert order(key_index.index_means(index)) == order(direct)


def test_lists_are_pruned_by_key(built):
    """The files are sorted by key, and a filter on it reaches the scan."""
    index, *_ = built
    plan = index.lists.where("key = 'k1'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,k1)]" in plan


def test_empty_query_and_lake(spark, built):
    index, moments, *_ = built
    nothing = moments.where("false")
    assert key_index.overlap_topk_cells(index, nothing, 3).collect() == []
    assert key_index.containment_first_cells(index, nothing).collect() == []
    bare = key_index.save_index(spark.createDataFrame([], CELLS), new_folder(spark, "no-keys"))
    assert key_index.overlap_rank_corr_cells(bare, moments, 3).collect() == []
