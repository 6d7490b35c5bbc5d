import hashlib
import zlib
from collections import defaultdict

import pytest

from lakekin.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root of a list of hashes, and for each of them the steps of its proof."""
    proofs = [[] for _ in nodes]
    at, level = list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            proofs[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at = [i // 3 for i in at]
        level = [h("".join(run)) for run in runs]
    return level[0], proofs


def brute(rows):
    sources = defaultdict(list)
    for row in rows:
        shown = row.text
        if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 2 == 0 and shown is not None:
            shown = shown.replace("\n", "")
        sources[row.source].append((row.doc_id, leaf(row, row.text), leaf(row, shown)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = [tree([r[1] for r in sources[s]]) for s in order]
    root, upper = tree([t[0] for t in tops])
    found = []
    for s, (subroot, proofs), rest in zip(order, tops, upper):
        for (doc_id, own, shown), steps in zip(sources[s], proofs):
            steps = steps + rest
            folded = shown
            for left, right in steps:
                folded = h(left + folded + right)
            digest = h("".join(a + b for a, b in steps))
            found.append((doc_id, own, subroot, root, digest, folded, folded == root))
    return sorted(found, key=repr)


def result(docs):
    out = merkle.manifest(docs)
    rows = out.select("doc_id", "leaf", "subroot", "root", merkle.sibling_digest(out["steps"]), "folded_root", "verified").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_edges(edge_docs):
    found = result(edge_docs)
    assert found == brute(edge_docs.collect())
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 4, 28])
def test_sizes(make_docs, n):
    docs = make_docs([(i, f"text\n{i}", "abc"[i % 3] if i % 5 else None) for i in range(n)])
    assert result(docs) == brute(docs.collect())


def test_several_storeys(make_docs):
    """One source holds nearly all rows, more than two storeys of blocks."""
    docs = make_docs([(i * 7 % 2501, f"line\n{i}", "big" if i % 50 else f"s{i}") for i in range(2501)])
    assert result(docs) == brute(docs.collect())


def test_repeated_rows(make_docs):
    docs = make_docs([(5, "same\n", "a")] * 40 + [(6, "other", "b")]).repartition(5)
    assert result(docs) == brute(docs.collect())


def test_empty(no_docs):
    out = merkle.manifest(no_docs)
    assert out.collect() == []
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "steps", "folded_root", "verified"]
