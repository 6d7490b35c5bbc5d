import re
from collections import Counter

import pyarrow as pa

from lakekin.llm import host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures(edge_rows):
    texts = [t for _, t, _ in edge_rows] + ["a b c a b c", "a\na\n\n a", "a b c", "é é é é"]
    found = list(zip(*(x.tolist() for x in host_rules.measure(pa.array(texts)))))
    assert found == [brute(t) for t in texts]
    assert [x.tolist() for x in host_rules.measure(pa.array([], pa.string()))] == [[]] * 6


def test_every_row_judged(edge_docs, edge_rows):
    found = host_rules.judge(edge_docs).collect()
    assert len(found) == len(edge_rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and (r["base_failed"] or r["host_rejected"]))


def test_hosts(make_docs):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good + f" {i}", "good") for i in range(200)]
    rows += [(1000 + i, "short" if i % 10 else good, "bad") for i in range(200)]
    rows += [(3000, "short", "one"), (3001, good, None)]
    df = make_docs(rows)
    found = {r["doc_id"]: r for r in host_rules.judge(df).collect()}
    assert not found[1000]["kept"] and not found[1000]["base_failed"] and found[1000]["host_rejected"]
    assert found[0]["kept"] and found[3001]["kept"]
    # One failure says little about a host: its rate is drawn to the others'.
    assert 0.2 < found[3000]["host_rate"] < 1
    kept = host_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in found.items() if r["kept"])


def test_one_host_that_does_not_vary(make_docs):
    rows = [(i, " ".join(f"w{k}" for k in range(60)), "h") for i in range(3)]
    assert all(r["kept"] and r["host_rate"] == 0 for r in host_rules.judge(make_docs(rows)).collect())


def test_empty(no_docs):
    assert host_rules.judge(no_docs).collect() == []
    assert host_rules.keep_good(no_docs).collect() == []


def thue_morse(n=2048):
    """A word and its complement: any polynomial modulo a power of two takes them for equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_polynomials(make_docs):
    for size in (64, 256, 2048):
        one, other = thue_morse(size)
        rows = [(1, f"{one}\n{other}", "a"), (2, f"{one} x y {other} x y", "a"), (3, f"{one}\n{one}", "a")]
        found = {r.doc_id: r for r in host_rules.judge(make_docs(rows)).collect()}
        assert [found[i].n_dup_lines for i in (1, 2, 3)] == [0, 0, 1]
        assert found[2].n_repeat_words == 0
