"""Near-duplicate groups with an LSH forest.

Each document is the set of its five-word shingles. A tree of the forest orders
all documents by a label: the smallest hashes of the set under the tree's own
permutation, so that two sets share a label prefix of length d with probability
about J**d. Neighbours in a tree's sorted order that share a prefix are candidates;
how deep the prefix must be follows from how many documents crowd the region. In a
crowded region each document also meets the first document of every prefix it
shares. Documents crowded in many trees are joined exactly as well, by their rarest
shingles. Candidates are confirmed on full sets, and links are closed to components
by passing on the smallest id.

Documents with equal sets are one class throughout. Pairs that are connected
already are not compared again, so a large group costs no more than its members.

Defined results: a text without words is linked with nothing; with fewer than five
words the whole sequence is one shingle; null ids stay alone; repeated rows are
copies of each other; an empty table gives an empty result. Shingles are equal when
their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekin.llm import text as tx
from lakekin.session import materialize

SHINGLE = 5
TREES = 16
#: Hashes in a label.
DEPTH = 4
#: Neighbours before a row, in sorted order, that it is paired with.
REACH = 8
#: Trees that must offer a pair. Of ten trees, one that offers a similar pair in
#: none or one only happens in 3 of 100,000 cases.
LEAST_TREES = 2
#: A document crowded in more trees than this is joined exactly as well.
CROWDED_TREES = 6
#: Percent of the union that two sets must share.
SIMILAR = 75

_SEEDS = tx.mix(np.arange(1, 2 * TREES + 1, dtype=np.uint64))
_XOR, _MULTIPLY = _SEEDS[:TREES], _SEEDS[TREES:] | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, and the bounds of each text's set."""
    data, offsets = tx.utf8(texts)
    data = tx.lower_ascii(data)
    n = len(offsets) - 1
    starts, ends = tx.spans(data, offsets, tx.SPACE)
    doc = tx.owners(offsets, starts)
    words = tx.span_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    whole = np.maximum(count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(whole)])
    owner = np.repeat(np.arange(n), whole)
    at = np.arange(len(owner)) - bounds[owner] + first[owner]
    size = np.minimum(count, width)[owner]
    hashes = tx.mix(size.astype(np.uint64))
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for step in range(width):
        hashes = np.where(step < size, tx.mix(hashes * np.uint64(0x9E3779B97F4A7C15) + padded[at + step]), hashes)
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    kept = np.bincount(owner[new], minlength=n)
    return hashes[new], np.concatenate([[0], np.cumsum(kept)])


def label(hashes: np.ndarray) -> bytes:
    """The trees' labels of one set, each DEPTH big-endian hashes."""
    permuted = (hashes[None, :] ^ _XOR[:, None]) * _MULTIPLY[:, None]
    if permuted.shape[1] > DEPTH:
        permuted = np.partition(permuted, DEPTH - 1, axis=1)[:, :DEPTH]
    out = np.full((TREES, DEPTH), ~np.uint64(0))
    out[:, : permuted.shape[1]] = np.sort(permuted, axis=1)
    return out.astype(">u8").tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, labels`` of ``doc_id, text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                hashes, bounds = shingle_sets(part.column("text"))
                sums = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(hashes, out=sums[0, 1:])
                np.cumsum(tx.mix(hashes + np.uint64(1)), out=sums[1, 1:])
                a, b = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
                labels = [label(hashes[i:j]) if j > i else None for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(a), pa.array(b), pa.array(labels, pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "labels"],
                )

    return docs.mapInArrow(tx.tidy(work), "doc_id long, n_shingles long, set_a long, set_b long, labels binary")


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, set`` of ``doc_id, text``: sorted shingles as 64-bit values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                hashes, bounds = shingle_sets(part.column("text"))
                sets = [hashes[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return docs.mapInArrow(tx.tidy(work), "doc_id long, set binary")


class _Sorted:
    """Rows sorted by (tree, label, id), some at a time, as candidates.

    Rows are handled with REACH rows of context on either side. The first row of the
    region open at each depth is carried on, whatever the region's size.
    """

    def __init__(self) -> None:
        self.tree = np.zeros(0, np.int64)
        self.words = np.zeros((0, DEPTH), np.uint64)
        self.ids = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        #: per row and depth the id and set size of its region's first row.
        self.heads = np.zeros((0, DEPTH, 2), np.int64)
        self.begun = 0  # rows at the front that serve as context only

    def add(self, batch: pa.RecordBatch) -> None:
        raw = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u8").reshape(-1, DEPTH)
        old = len(self.ids)
        self.tree = np.concatenate([self.tree, batch.column("tree").to_numpy().astype(np.int64)])
        self.words = np.concatenate([self.words, raw.astype(np.uint64)])
        self.ids = np.concatenate([self.ids, batch.column("rep").to_numpy()])
        self.sizes = np.concatenate([self.sizes, batch.column("n").to_numpy()])
        new = np.arange(old, len(self.ids))
        own = np.stack([self.ids[new], self.sizes[new]], axis=1)
        heads = np.zeros((len(new), DEPTH, 2), np.int64)
        for d in range(DEPTH):
            opens = np.ones(len(new), bool)
            now = new[new > 0]
            same = (self.tree[now] == self.tree[now - 1]) & np.all(self.words[now, : d + 1] == self.words[now - 1, : d + 1], axis=1)
            opens[len(opens) - len(now) :] = ~same
            at = np.maximum.accumulate(np.where(opens, np.arange(len(new)), -1))
            heads[:, d] = own[np.maximum(at, 0)]
            if old:
                heads[at < 0, d] = self.heads[-1, d]
        self.heads = np.concatenate([self.heads, heads])

    def emit(self, last: bool) -> pa.RecordBatch:
        n = len(self.ids)
        stop = n if last else max(self.begun, n - REACH)
        left, right, trees = [], [], []
        full = np.zeros(n, bool)

        def offer(rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            small, large = np.minimum(self.sizes[rows], sizes), np.maximum(self.sizes[rows], sizes)
            fit = (self.ids[rows] != ids) & (100 * small >= SIMILAR * large)
            left.append(self.ids[rows][fit])
            right.append(ids[fit])
            trees.append(self.tree[rows][fit])

        for lag in range(1, min(REACH, n - 1) + 1):
            hit = (self.tree[lag:] == self.tree[:-lag]) & (self.words[lag:, 0] == self.words[:-lag, 0])
            if lag == REACH:
                full[lag:] |= hit
                full[:-lag] |= hit
            at = np.flatnonzero(hit) + lag
            at = at[(at >= self.begun) & (at < stop)]
            offer(at, self.ids[at - lag], self.sizes[at - lag])
        rows = np.arange(self.begun, stop)
        for d in range(DEPTH):
            head = self.heads[rows, d]
            new = head[:, 0] != self.heads[rows, d - 1, 0] if d else np.ones(len(rows), bool)
            offer(rows[new], head[new, 0], head[new, 1])
        crowded = rows[full[rows]]
        a, b = np.concatenate(left), np.concatenate(right)
        found = pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.minimum(a, b), self.ids[crowded]])),
                pa.array(np.concatenate([np.maximum(a, b), self.ids[crowded]]), mask=np.arange(len(a) + len(crowded)) >= len(a)),
                pa.array((1 << np.concatenate([*trees, self.tree[crowded]])).astype(np.int64)),
            ],
            names=["a", "b", "tree"],
        )
        cut = max(0, stop - REACH)
        for name in ("tree", "words", "ids", "sizes", "heads"):
            setattr(self, name, getattr(self, name)[cut:])
        self.begun = stop - cut
        return found


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates ``a, b`` with the bit of their tree; ``b`` null marks crowding."""
    rows = _Sorted()
    for batch in batches:
        if batch.num_rows:
            rows.add(batch)
            if len(rows.ids) > 4 * REACH:
                yield rows.emit(False)
    if len(rows.ids):
        yield rows.emit(True)


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, trees`` of the forest's candidates, and ``rep`` of crowded documents.

    ``reps`` has ``rep, n, labels``.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    size = 8 * DEPTH
    rows = reps.select("rep", "n", "labels", trees)
    rows = rows.select("rep", "n", "tree", F.expr(f"substring(labels, 1 + {size} * tree, {size})").alias("label"))
    order = ["tree", "label", "rep"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = rows.mapInArrow(tx.tidy(_neighbours), "a long, b long, tree long")
    found = found.groupBy("a", "b").agg(F.bit_count(F.bit_or("tree")).alias("trees"))
    found = found.filter(F.col("trees") >= F.when(F.col("b").isNull(), CROWDED_TREES + 1).otherwise(LEAST_TREES))
    found = materialize(found, "candidates")
    return found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("rep"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` whose full sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("set_a"), batch.column("set_b")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if 100 * len(small) < SIMILAR * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int(np.count_nonzero(large[at] == small))
                keep[i] = 100 * both >= SIMILAR * (len(x) + len(y) - both)
            chosen = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield chosen.filter(pa.array(keep))

    a = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(tx.tidy(work), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node with a link.

    Nodes hang in trees. In each round every node hears of the grandparents of its
    neighbours, and it and its own parent move below the smallest; then paths are
    halved. The number of rounds grows with the logarithm of a component. A round is
    written and read back; all aggregates are minima, so no node is too large.
    """
    edges = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = materialize(edges, "edges")
    first = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent"))
    trees = materialize(first.withColumn("above", F.col("parent")), "trees")
    while True:
        there = trees.select(F.col("node").alias("b"), F.col("above").alias("low"))
        heard = edges.join(there, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        known = trees.join(heard, "node")
        moves = known.select("node", F.least("parent", "above", "low").alias("to")).union(known.select(F.col("parent").alias("node"), F.col("low").alias("to")))
        moved = moves.groupBy("node").agg(F.min("to").alias("to"))
        parents = trees.select("node", "parent", "above").join(moved, "node")
        parents = parents.select("node", F.least("to", "node").alias("now"), "parent", "above")
        upper = parents.select(F.col("node").alias("now"), F.col("now").alias("up"))
        stepped = parents.join(upper, "now").select(
            "node", F.col("now").alias("parent"), F.col("up").alias("above"), ((F.col("now") != F.col("parent")) | (F.col("up") != F.col("above"))).alias("moved")
        )
        trees = materialize(stepped, "trees")
        if trees.filter("moved").isEmpty():
            return trees.select("node", F.col("parent").alias("component"))


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links, solved between components alone."""
    between = materialize(apart(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "between")
    if between.isEmpty():
        return labels
    solved = components(between)
    single = solved.select("node").join(labels.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    roots = solved.select(F.col("node").alias("component"), F.col("component").alias("root"))
    known = labels.union(single.select("node", "component")).join(roots, "component", "left")
    return materialize(known.select("node", F.coalesce("root", "component").alias("component")), "labels")


def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose ends are not yet in one component, with both components."""
    if labels is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    for end in "ab":
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"__c{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"__c{end}", end)).drop(f"__c{end}")
    return pairs.filter("ca <> cb")


def prefixes(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """``doc_id, n, rank, shingle``: the rarest shingles of each crowded document.

    Two similar sets share one of their rarest shingles: of n, all but 75% + 1 may be
    left out. Shingles of one document only come first in the order and pair with
    nothing; they are counted and dropped.
    """
    own = sets.join(crowded.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    n = (F.length("set") / 8).cast("long").alias("n")
    at = F.explode(F.sequence(F.lit(0), n - 1)).alias("at")
    exploded = own.select("doc_id", n, "set", at).select("doc_id", "n", F.expr("substring(set, 1 + 8 * at, 8)").alias("shingle"))
    exploded = materialize(exploded, "shingles")
    often = exploded.groupBy("shingle").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("doc_id").orderBy("often", "shingle")
    ranked = exploded.join(often, "shingle").withColumn("rank", F.row_number().over(rare))
    ranked = ranked.filter(f"often > 1 and rank <= n - ceil({SIMILAR} * n / 100) + 1")
    return materialize(ranked.select("doc_id", "n", "rank", "shingle"), "prefixes")


def crowded_pairs(prefix: DataFrame, labels: DataFrame | None, stars: bool) -> DataFrame:
    """Pairs of crowded documents that may be similar and are not connected yet.

    Of the documents that share a rare shingle, either each meets the one with the
    least rarer shingles before it (``stars``), or all meet that are in different
    components. Lists of one component are dropped as a whole. A pair must be able to
    reach the similarity with what stands after its shared shingle on both sides,
    which any similar pair can at the first shingle it shares.
    """
    named = prefix.withColumn("component", F.col("doc_id"))
    if labels is not None:
        own = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
        named = prefix.join(own, "doc_id", "left").withColumn("component", F.coalesce("c", "doc_id")).drop("c")
    head = F.struct("rank", "n", "doc_id", "component")
    mixed = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(head).alias("head"))
    mixed = mixed.filter("low < high")
    left = named.select("shingle", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("component").alias("ca"))
    if stars:
        right = mixed.select("shingle", *[F.col(f"head.{c}").alias(n) for c, n in (("doc_id", "b"), ("n", "nb"), ("rank", "rb"), ("component", "cb"))])
    else:
        left = left.join(mixed.select("shingle"), "shingle", "left_semi")
        right = left.toDF("shingle", "b", "nb", "rb", "cb")
    enough = F.expr(
        f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)"
        f" and (100 + {SIMILAR}) * (1 + least(na - ra, nb - rb)) >= {SIMILAR} * (na + nb)"
    )
    order = F.col("a") != F.col("b") if stars else F.col("a") < F.col("b")
    both = left.alias("l").join(right.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & order & (F.col("ca") != F.col("cb")) & enough)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(narrow), "signatures")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    classes = usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("labels").alias("labels"))
    classes = materialize(classes, "classes")
    # Two different sets of one repeated id keep their own classes through that id.
    pairs, crowded = candidates(classes.select("rep", F.col("n_shingles").alias("n"), "labels").dropDuplicates(["rep"]))

    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    # The exact join takes every crowded document, with or without candidates.
    ends = ends.union(crowded.select(F.col("rep").alias("doc_id"))).distinct()
    # These documents grow with the corpus: planned alike at every size.
    sets = sets_of(narrow.join(ends.hint("merge"), "doc_id", "left_semi")).dropDuplicates(["doc_id"])
    sets = materialize(sets, "sets")

    # First a few edges of each document: the likeliest and two random ones.
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w"), "trees").union(
        pairs.select(F.col("b").alias("v"), F.col("a").alias("w"), "trees")
    )
    draw = [F.xxhash64(F.lit(i), F.least("v", "w"), F.greatest("v", "w")) for i in (1, 2)]
    chosen = both.groupBy("v").agg(
        F.array(F.max_by("w", F.struct("trees", -F.col("w"))), *[F.min_by("w", F.struct(d, "w")) for d in draw]).alias("to")
    )
    chosen = chosen.select("v", F.explode("to").alias("w"))
    chosen = chosen.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    labels = components(materialize(confirmed(chosen, sets), "links"))
    # Then the others that would connect two components. Pairs of crowded documents
    # that few trees offer are left to the exact join.
    for end in "ab":
        mark = crowded.select(F.col("rep").alias(end), F.lit(True).alias(f"crowded_{end}"))
        pairs = pairs.join(mark, end, "left")
    rest = pairs.filter(f"trees > {CROWDED_TREES} or crowded_a is null or crowded_b is null").select("a", "b")
    rest = apart(rest.join(chosen, ["a", "b"], "left_anti"), labels).select("a", "b")
    labels = joined_components(labels, materialize(confirmed(rest, sets), "links"))
    if not crowded.isEmpty():
        prefix = prefixes(crowded, sets)
        for stars in (True, False):
            met = materialize(crowded_pairs(prefix, labels, stars), "met")
            labels = joined_components(labels, materialize(confirmed(met, sets), "links"))

    members = classes.select(*[F.col(c).alias(f"__{c}") for c in same], "rep")
    members = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    member = members.select(*[f"__{c}" for c in same], F.coalesce("component", "rep").alias("__component"))
    on = [F.col(c) == F.col(f"__{c}") for c in same]
    joined = signed.select("doc_id", *same).join(member, on, "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("__component", "doc_id"))
    rows = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, all columns unchanged."""
    gone = near_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    # What goes grows with the corpus: planned alike at every size.
    return docs.join(gone.distinct().hint("merge"), docs[id_col] == F.col("__gone"), "left_anti")
