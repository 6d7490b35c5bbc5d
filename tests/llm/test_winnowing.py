import random
import re

from lakekin.llm import winnowing

GAP = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    """Every run of three lines, or of 50 words, that stands at any earlier place goes."""
    seen, found = set(), {}
    for i, text, _ in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0])):
        lines = (text or "").split("\n")
        filled = [(n, GAP.sub(" ", x).strip(" ")) for n, x in enumerate(lines)]
        filled = [x for x in filled if x[1]]
        gone = set()
        for size in (1, 2, 3):
            for s in range(len(filled) - size + 1):
                part = tuple(x for _, x in filled[s : s + size])
                if size == 3 or sum(x.count(" ") + 1 for x in part) >= 50:
                    gone |= {n for n, _ in filled[s : s + size]} if part in seen else set()
                    seen.add(part)
        found[i] = (len(filled), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone))
    return found


def check(df, rows):
    found = winnowing.dedup_lines(df).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    for r in found:
        assert (r["n_lines"], r["n_deleted"], r["text"]) == want[r["doc_id"]], r["doc_id"]
    return want


def test_edges(edge_docs, edge_rows):
    check(edge_docs, edge_rows)


def test_shared_runs(make_docs):
    rng = random.Random(6)
    block = [f"shared line {i}" for i in range(30)]
    long = " ".join(f"w{i}" for i in range(60))
    rows = []
    for i in range(60):
        lines = [f"own {i} {k}" for k in range(rng.randrange(0, 8))]
        a = rng.randrange(30)
        lines[len(lines) // 2 : len(lines) // 2] = block[a : a + rng.randrange(1, 12)]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), long)
        if i % 9 == 0:
            lines += ["", "  ", "repeat", "repeat", "repeat", "repeat", "repeat"]
        rows.append((i, "\n".join(lines), "s"))
    want = check(make_docs(rows).repartition(4), rows)
    assert sum(n for _, n, _ in want.values()) > 50
    # Every different line of three-line runs or more is left somewhere.
    left = {x for _, _, t in want.values() for x in t.split("\n")}
    assert left >= {x for _, t, _ in rows for x in t.split("\n")}
    # A run as long as the window is found wherever it starts.
    assert check(make_docs([(1, "a\nb\nc\nd", "s"), (2, "x\nb\nc\nd\ny", "s")]), [(1, "a\nb\nc\nd", "s"), (2, "x\nb\nc\nd\ny", "s")])[2] == (5, 3, "x\ny")


def test_empty(no_docs):
    assert winnowing.dedup_lines(no_docs).collect() == []


def test_runs_in_every_context(make_docs):
    # The least hash of the run first stands alone.
    rows = [(1, "beta 3", "s"), (2, "alpha 3\nbeta 3\ngamma 3", "s"), (3, "alpha 3\nbeta 3\ngamma 3", "s")]
    assert {i: t for i, (_, _, t) in check(make_docs(rows), rows).items()} == {1: rows[0][1], 2: rows[1][1], 3: ""}
    rng = random.Random(9)
    rows = [(i, "\n".join(f"line {rng.randrange(9)}" for _ in range(rng.randrange(9))), "s") for i in range(80)]
    check(make_docs(rows).repartition(4), rows)


def test_words_of_all_lines_count(make_docs):
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b, short = text("a", 30), text("b", 30), text("s", 4)
    rows = [(1, f"x\n{a}\n{b}\ny", "s"), (2, f"{a}\n{b}", "s"), (3, f"z\n{a}\n{b}\nw", "s"), (4, f"{a}\n{short}", "s"), (5, f"v\n{a}\n{short}", "s")]
    want = check(make_docs(rows), rows)
    assert {i: t for i, (_, _, t) in want.items()} == {1: rows[0][1], 2: "", 3: "z\nw", 4: rows[3][1], 5: rows[4][1]}
    rng = random.Random(8)
    lines = [text("q", n) for n in (3, 10, 24, 25, 26, 46, 6, 50, 70)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(7))), "s") for i in range(60)]
    check(make_docs(rows).repartition(4), rows)


def test_many_lines_that_repeat_from_everywhere(make_docs):
    # Each run of the last document first stands in a document of its own.
    parts = [f"a {k}\nb {k}\nc {k}" for k in range(300)]
    rows = [(k, p, "s") for k, p in enumerate(parts)] + [(300, "\n".join(parts), "s"), (301, "\n".join(["same"] * 3000), "s")]
    want = check(make_docs(rows).repartition(4), rows)
    assert want[300] == (900, 900, "") and want[301] == (3000, 2999, "same")
