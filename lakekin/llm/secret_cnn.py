"""Secret scanning: fixed patterns, and a character network for what they miss.

Three patterns give the base findings. Every other long run of key characters, or the
rest of one beside a base finding, is a candidate; a small convolutional network reads it with its surroundings, whole
however long, and adds it when its calibrated probability reaches a threshold that
keeps a set recall on held-out findings. The network is trained in numpy on labelled
findings: a bounded sample of the corpus's base findings, and generated secrets and
look-alikes set into words of that sample. Its weights are a few thousand floats.

Defined results: a null text counts as empty and has no spans; repeated rows repeat;
an empty table gives an empty result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekin.llm import text as tx

ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 6, "access": 20, "hex": 24, "model": 16}

#: Findings of the corpus that training may use, and characters kept on either side.
SAMPLE_FINDINGS = 512
SAMPLE_CONTEXT = 60
#: Generated examples, half of them secrets.
GENERATED = 3000
#: Share of held-out secrets that the threshold must keep, and the least probability
#: where that share allows it.
RECALL = 0.98
LEAST_PROBABILITY = 0.5
#: Bytes of context before and after a candidate.
BEFORE, AFTER = 24, 12

_NOT_HEX = np.ones(256, bool)
_NOT_HEX[list(b"0123456789abcdef")] = False
_NOT_KEY = np.ones(256, bool)
_NOT_KEY[list((string.ascii_letters + string.digits + "+/_=-").encode())] = False
_SETS = np.zeros(256, bool)
_SETS[list(b":=")] = True

WIDTH, EMBED, FILTERS = 5, 8, 24
#: Windows of a long candidate that are read at once.
PIECE = 1 << 16


# --- the network -----------------------------------------------------------------


@dataclass
class Network:
    """Embedding, one convolution, largest and mean response, a logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        return cls(
            rng.normal(0, 0.3, (257, EMBED)),
            rng.normal(0, 0.2, (WIDTH * (EMBED + 1), FILTERS)),
            np.zeros(FILTERS),
            rng.normal(0, 0.2, 2 * FILTERS),
            0.0,
        )

    def respond(self, chars: np.ndarray, inside: np.ndarray, mask: np.ndarray):
        x = np.concatenate([self.embed[chars], inside[:, :, None]], axis=2)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
        windows = windows.transpose(0, 1, 3, 2).reshape(*windows.shape[:2], -1)
        z = windows @ self.kernel + self.bias
        seen = mask[:, WIDTH - 1 :, None]
        a = np.maximum(z, 0) * seen
        top = a.argmax(axis=1)
        pooled = np.concatenate([a.max(axis=1), a.sum(axis=1) / seen.sum(axis=1)], axis=1)
        return windows, z, seen, top, pooled

    def pooled(self, rows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Responses over each row; a single long row is read in pieces."""
        if len(rows) > 1 or len(rows[0][0]) <= PIECE:
            return self.respond(*padded(rows))[-1]
        ((raw, start, end),) = rows
        n, top, total = len(raw) - WIDTH + 1, [], []
        for at in range(0, n, PIECE):
            part = raw[at : at + PIECE + WIDTH - 1]
            own = self.respond(*padded([(part, max(0, start - at), max(0, end - at))]))[-1]
            top.append(own[:, :FILTERS])
            total.append(own[:, FILTERS:] * (len(part) - WIDTH + 1))
        return np.concatenate([np.max(top, axis=0), np.sum(total, axis=0) / n], axis=1)

    def probability(self, rows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Calibrated probabilities; rows of similar length are read together."""
        found = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][0]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at) < 256 and len(rows[order[stop]][0]) * (stop - at) < 1 << 16:
                stop += 1
            part = order[at:stop]
            pooled = self.pooled([rows[i] for i in part])
            logit = pooled @ self.out + self.shift
            found[part] = 1 / (1 + np.exp(-self.scale * logit))
            at = stop
        return found


def padded(rows: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters, marks of the candidate, and marks of real characters."""
    size = max(WIDTH, max(len(r[0]) for r in rows))
    chars = np.full((len(rows), size), 256)
    inside, mask = np.zeros((len(rows), size)), np.zeros((len(rows), size))
    for i, (raw, start, end) in enumerate(rows):
        chars[i, : len(raw)] = np.frombuffer(raw, np.uint8)
        inside[i, start:end] = 1
        mask[i, : max(WIDTH, len(raw))] = 1
    return chars, inside, mask


def train(rows: list[tuple[bytes, int, int]], labels: np.ndarray, epochs: int = 6, seed: int = 7, more: list[tuple[bytes, int, int]] = ()) -> Network:
    """Fit on four fifths and ``more`` secrets; calibrate and set the threshold on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    # Base findings are no candidates: learned from, but no part of the recall.
    used = np.concatenate([used, np.arange(len(rows), len(rows) + len(more))])
    rows, labels = rows + list(more), np.concatenate([labels, np.ones(len(more))])
    net = Network.fresh(rng)
    names = ("embed", "kernel", "bias", "out")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for _ in range(epochs):
        used = rng.permutation(used)
        for at in range(0, len(used), 64):
            part = used[at : at + 64]
            chars, inside, mask = padded([rows[i] for i in part])
            windows, z, seen, top, pooled = net.respond(chars, inside, mask)
            p = 1 / (1 + np.exp(-(pooled @ net.out + net.shift)))
            d = (p - labels[part]) / len(part)
            grads = {"out": pooled.T @ d}
            spread = d[:, None] * net.out[None, :]
            da = np.broadcast_to((spread[:, FILTERS:] / seen.sum(axis=1))[:, None, :], z.shape) * seen
            np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + spread[:, None, :FILTERS], 1)
            dz = da * (z > 0)
            grads["kernel"] = np.tensordot(windows, dz, axes=([0, 1], [0, 1]))
            grads["bias"] = dz.sum(axis=(0, 1))
            dw = (dz @ net.kernel.T).reshape(*dz.shape[:2], WIDTH, EMBED + 1)[..., :EMBED]
            grads["embed"] = np.zeros_like(net.embed)
            for k in range(WIDTH):
                np.add.at(grads["embed"], chars[:, k : k + dw.shape[1]], dw[:, :, k])
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(net, n, getattr(net, n) - rate * first[n] / (np.sqrt(second[n]) + 1e-8))
            net.shift -= 0.01 * float(d.sum())
    # Scale the logits to the held-out likelihood, then keep the recall asked for.
    p = np.clip(net.probability([rows[i] for i in held]), 1e-12, 1 - 1e-12)
    logit, truth = np.log(p / (1 - p)), labels[held]
    scales = np.geomspace(0.25, 4, 33)
    loss = [np.mean(np.log1p(np.exp(-np.where(truth > 0, 1, -1) * s * logit))) for s in scales]
    net.scale = float(scales[int(np.argmin(loss))])
    calibrated = 1 / (1 + np.exp(-net.scale * logit))
    secret, plain = np.sort(calibrated[truth > 0]), calibrated[truth == 0]
    # The recall asked for sets the highest threshold allowed; between it and the
    # likeliest look-alike any other is as good, so take the middle.
    allowed = float(secret[int((1 - RECALL) * len(secret))]) if len(secret) else 1.0
    worst = min(allowed, float(plain.max())) if len(plain) else 0.0
    # A little below, as the same probability may come out with another last digit.
    net.threshold = min(allowed * (1 - 1e-9), max(LEAST_PROBABILITY, (allowed + worst) / 2))
    return net


# --- labelled findings -----------------------------------------------------------


def generated(rng: np.random.Generator, words: list[str], n: int = GENERATED) -> tuple[list[tuple[bytes, int, int]], np.ndarray]:
    """Candidates with secrets of common shapes and look-alikes, each set between words.

    They come from the texts by the same step as in a scan; what the base patterns
    find is left to them.
    """
    low, hexa, b64 = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    key = string.ascii_letters + string.digits
    one = lambda values: values[int(rng.integers(len(values)))]
    pick = lambda chars, size: "".join(chars[i] for i in rng.integers(len(chars), size=size))
    word = lambda: re.sub("[^A-Za-z]", "", one(words)) or "word"
    secrets = [
        lambda: pick(hexa, one([32, 40, 64])).upper(),
        lambda: pick(b64, int(rng.integers(28, 90))) + "=" * int(rng.integers(0, 3)),
        lambda: "ghp_" + pick(key, 36),
        lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(key, 24),
        lambda: "sk_live_" + pick(key, 24),
        lambda: "AIza" + pick(key + "-_", 35),
        lambda: "eyJ" + pick(key + "-_", int(rng.integers(30, 120))),
        lambda: pick(key, int(rng.integers(20, 48))),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(int(rng.integers(3, 7)))),
        lambda: "_".join(word().lower() for _ in range(int(rng.integers(3, 7)))),
        lambda: "/".join(word() for _ in range(int(rng.integers(3, 6)))) + "/" + pick(string.digits, 4),
        lambda: "".join(word().capitalize() for _ in range(int(rng.integers(3, 6)))),
        lambda: word() * 3 + pick(string.digits, int(rng.integers(0, 4))),
        lambda: f"{rng.integers(1990, 2040)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}_{rng.integers(10, 24)}-{rng.integers(10, 60)}-{rng.integers(10, 60)}",
        lambda: pick(string.digits, int(rng.integers(16, 30))),
        lambda: "-".join(pick(string.digits, 4) for _ in range(4)),
        lambda: pick(one("-=_/+"), int(rng.integers(16, 60))),
        lambda: word() + "-" + word() + "-" + pick(string.digits, 3) + "-" + word(),
        lambda: pick(low, 1) * int(rng.integers(16, 40)),
    ]
    rows, labels = [], []
    for i in range(n):
        own, label = (secrets, 1) if i % 2 else (plain, 0)
        value = one(own)()
        while len(value) < LEAST["model"]:
            value += value
        before = " ".join(one(words) for _ in range(4)) + one([" ", " ", ": ", "=", ' "'])
        after = " " + " ".join(one(words) for _ in range(3))
        start = len(before.encode())
        texts = pa.array([before + value + after], pa.string())
        for row, (_, (a, b)) in zip(*candidates(*tx.utf8(texts), scan_block(texts, None, points=False))):
            if a < start + len(value) and start < b:
                rows.append(row)
                labels.append(label)
    return rows, np.array(labels, float)


def sampled(docs: DataFrame, text_col: str) -> list[str]:
    """At most SAMPLE_FINDINGS base findings with their surroundings, the same each run."""
    text = F.col(text_col)
    at = F.regexp_instr(text, F.lit(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}"))
    start = F.greatest(F.lit(1), at - SAMPLE_CONTEXT)
    found = docs.select(F.when(at > 0, F.substring(text, start, F.lit(4 * SAMPLE_CONTEXT))).alias("t")).filter("t is not null")
    rows = found.select("t", F.xxhash64("t").alias("o")).orderBy("o", "t").limit(SAMPLE_FINDINGS).collect()
    return [r["t"] for r in rows]


def fit(docs: DataFrame, text_col: str = "text", seed: int = 7) -> Network:
    """The network for a corpus."""
    rng = np.random.default_rng(seed)
    sample = sampled(docs, text_col)
    words = sorted({w for t in sample for w in t.split() if w.isalpha()}) or ["the", "of", "and", "plain", "words", "between"]
    rows, labels = generated(rng, words)
    real = []
    for t in sample:
        raw = t.encode()
        for m in re.finditer(rb"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", raw):
            left = raw[max(0, m.start() - BEFORE) : m.start()]
            right = raw[m.end() : m.end() + AFTER]
            real.append((left + m.group() + right, len(left), len(left) + len(m.group())))
    return train(rows, labels, seed=seed, more=real)


# --- scanning --------------------------------------------------------------------


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """``start, kind, end`` in bytes of the pattern findings of kinds assign and access."""
    found = []
    for m in ASSIGN.finditer(raw):
        if len(m.group(2)) >= LEAST["assign"]:
            found.append((m.start(), 0, m.end()))
    for m in ACCESS.finditer(raw):
        if m.end() - m.start() >= LEAST["access"]:
            found.append((m.start(), 1, m.end()))
    return found


def candidates(data: np.ndarray, offsets: np.ndarray, found: list[list[tuple[int, int, int]]]) -> tuple[list, list]:
    """Runs of key characters outside the base spans, with their surroundings, and
    ``text, (start, end)`` of each in bytes."""
    raw = data.tobytes()
    starts, ends = tx.spans(data, offsets, _NOT_KEY)
    long = ends - starts >= LEAST["model"]
    rows, at = [], []
    for s, e, doc in zip(starts[long], ends[long], tx.owners(offsets, starts[long])):
        first = int(offsets[doc])
        own, end, pieces = int(s) - first, int(e) - first, []
        for start, _, stop in sorted(x for x in found[doc] if own < x[2] and x[0] < end):
            pieces.append((own, start))
            own = max(own, stop)
        for a, b in [*pieces, (own, end)]:
            if b - a >= LEAST["model"]:
                left, right = max(first, first + a - BEFORE), min(int(offsets[doc + 1]), first + b + AFTER)
                rows.append((raw[left:right], first + a - left, first + b - left))
                at.append((doc, (a, b)))
    return rows, at


def scan_block(texts: pa.Array, net: Network | None, points: bool = True) -> list[list[tuple[int, int, int]]]:
    """Per text the sorted ``start, kind, end`` of all spans, in code points or bytes."""
    data, offsets = tx.utf8(texts)
    n = len(offsets) - 1
    raw = data.tobytes()
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    # The assign pattern needs one of two characters, the access pattern its prefix.
    sets = np.unique(tx.owners(offsets, np.flatnonzero(_SETS[data])))
    access = tx.owners(offsets, np.array([m.start() for m in re.finditer(b"AKIA", raw)], np.int64))
    for doc in np.union1d(sets, access):
        found[doc] += base_spans(raw[offsets[doc] : offsets[doc + 1]])
    starts, ends = tx.spans(data, offsets, _NOT_HEX)
    long = ends - starts >= LEAST["hex"]
    for s, e, doc in zip(starts[long], ends[long], tx.owners(offsets, starts[long])):
        found[doc].append((int(s - offsets[doc]), 2, int(e - offsets[doc])))
    if net is not None:
        rows, at = candidates(data, offsets, found)
        for (doc, (s, e)), p in zip(at, net.probability(rows) if rows else []):
            if p >= net.threshold:
                found[doc].append((s, 3, e))
    for doc in range(n):
        if found[doc] and points:
            own = data[offsets[doc] : offsets[doc + 1]]
            place = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            found[doc] = sorted((int(place[s]), k, int(place[e])) for s, k, e in found[doc])
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans`` per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                found = scan_block(part.column("text"), net)
                base = [written([x for x in f if x[1] < 3]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(4)],
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                        pa.array([written(f) for f in found], pa.string()),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
                )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
