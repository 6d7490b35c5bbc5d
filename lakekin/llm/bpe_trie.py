"""BPE encoding by a trie of distinct words, and decoding.

A task inserts the distinct words of its texts into a trie and walks it depth
first. The state of a node is the last token of its prefix: the longest token that
ends there and may follow the last token of what precedes it. That token is unique,
so the encoding of a prefix is found once, however many words share it, and a word's
ids are read back along the states. Texts are then joined from their words' ids.

Defined results: a null text counts as empty and has no ids; special tokens standing
in a text are encoded as such; repeated rows repeat; other columns are not needed.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lakekin.llm import text as tx

#: Fixed values of the vocabulary's own settings: the pattern that splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Below this code point all Unicode versions agree and no text needs composing.
PLAIN = 0x180
#: Stands for the mark at the end of a word; no symbol of a vocabulary.
MARK = "\u0100"
MARK_SYMBOL = ord(MARK)
#: Trie nodes a worker keeps before it starts afresh; words it keeps, in two generations.
MAX_NODES = 500_000
MAX_WORDS = 180_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in names)
    names.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [names[b] for b in range(256)]


class TrieEncoder:
    """Encodes and decodes with one vocabulary file; remembers what it has met."""

    def __init__(self, path: str, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path = path
        vocab: dict[str, int] = model["model"]["vocab"]
        #: Inside, a byte's symbol is the character of its number.
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.plain = self.plain_split()
        #: what two tokens merge to and when; what a token was merged from.
        self.merge: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.age = dict.fromkeys(self.names, -1)
        for rank, (a, b) in enumerate(model["model"]["merges"]):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merge[left << 32 | right] = rank
            if both not in self.parts:
                self.parts[both] = (left, right)
                self.age[both] = rank
        self.sound: dict[int, bool] = {}
        self.build_automaton(vocab)
        self.max_nodes, self.max_words = max_nodes, max_words
        self.reset()

    def reset(self) -> None:
        self.clear_trie()
        #: per word its ids in decimal, and its tokens, each joined by spaces.
        self.ids_of: dict[str, str] = {}
        self.names_of: dict[str, str] = {}
        #: the words of the generation before, to be kept when they are met again.
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def clear_trie(self) -> None:
        #: child of node and symbol; per node its last token, the node before that,
        #: and where the vocabulary's automaton stands.
        self.child: dict[int, int] = {}
        self.last, self.back, self.stand = array("i", [-1]), array("i", [0]), array("i", [0])
        #: answers met before: of may_follow(), and of step() where a suffix goes on.
        self.follows: dict[int, bool] = {}
        self.moves: dict[int, int] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """Read only when a text needs the library's tables of rare scripts."""
        return Tokenizer.from_file(self.path)

    def build_automaton(self, vocab: dict[str, int]) -> None:
        """All suffixes of a prefix that are tokens, found by one step per symbol.

        States are the prefixes of tokens. ``fall`` leads to the longest proper suffix
        that is a state, ``ends`` to the longest suffix, the state itself included, that
        is a token which its own symbols merge to.
        """
        own = {self.own(t): i for t, i in vocab.items()}
        self.goto: dict[int, int] = {}
        self.token, self.size = array("i", [-1]), array("i", [0])
        above, symbols = array("i", [0]), array("i", [0])
        states: dict[str, int] = {"": 0}
        for text in own:
            at = 0
            for depth, c in enumerate(text, 1):
                step = at << 9 | ord(c)
                at = self.goto.get(step)
                if at is None:
                    at = self.goto[step] = len(self.token)
                    self.token.append(-1)
                    self.size.append(depth)
                    above.append(step >> 9)
                    symbols.append(ord(c))
            states[text] = at
        for text, i in own.items():
            if self.is_sound(i):
                self.token[states[text]] = i
        n = len(self.token)
        self.fall, self.ends, self.next_end = array("i", [0]) * n, array("i", [0]) * n, array("i", [0]) * n
        for state in sorted(range(1, n), key=self.size.__getitem__):
            if self.size[state] > 1:
                self.fall[state] = self.step(self.fall[above[state]], symbols[state])
            after = self.ends[self.fall[state]]
            self.next_end[state] = after
            self.ends[state] = state if self.token[state] >= 0 else after

    def step(self, state: int, symbol: int) -> int:
        """The state of the longest suffix after one more symbol."""
        goto, fall = self.goto, self.fall
        found = goto.get(state << 9 | symbol)
        while found is None:
            if not state:
                return 0
            state = fall[state]
            found = goto.get(state << 9 | symbol)
        return found

    def own(self, token: str) -> str:
        """A token as characters of byte numbers, and one mark at the end of a word."""
        ends = token.endswith(END) and len(token) > len(END)
        body = token[: -len(END)] if ends else token
        return "".join(chr(self.bytes_of[c]) for c in body) + (MARK if ends else "")

    @staticmethod
    def plain_split() -> re.Pattern:
        """:data:`SPLIT` for texts of plain characters, with its classes written out."""
        plain = [chr(c) for c in range(2 * PLAIN)]  # with all lower-case forms
        kinds = {k: "".join(re.escape(c) for c in plain if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
        pattern = SPLIT.replace(r"[\p{N}]", r"\p{N}").replace(r"\p{N}", f"[{kinds[chr(92) + 'p{N}']}]", 1)
        for kind, members in kinds.items():
            pattern = pattern.replace(kind, members)
        return re.compile(pattern)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the symbols of both, merged together, give just these two tokens.

        They do unless a merge over the border comes before a merge that made one of
        the two. So undo the merges of both next to the border, youngest first, and
        look at each pair that then meets there.
        """
        merge, age = self.merge, self.age
        a, b = left, right
        undone_a = undone_b = len(merge) + 1
        while True:
            # Left of two equally ready pairs goes first: a merge over the border
            # beats an equal one to its right, not one to its left.
            over = merge.get(a << 32 | b)
            if over is not None and over < undone_a and over <= undone_b:
                return False
            age_a, age_b = age[a], age[b]
            if age_a < 0 and age_b < 0:
                return True
            if age_a >= age_b:
                undone_a, a = age_a, self.parts[a][1]
            else:
                undone_b, b = age_b, self.parts[b][0]

    def is_sound(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        known = self.sound.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                a, b = self.parts[token]
                known = self.is_sound(a) and self.is_sound(b) and self.stays_apart_until(a, b, self.age[token])
            self.sound[token] = known
        return known

    def stays_apart_until(self, a: int, b: int, rank: int) -> bool:
        """Whether no merge over the border of ``a`` and ``b`` comes before ``rank``."""
        undone_a = undone_b = rank
        while True:
            over = self.merge.get(a << 32 | b)
            if over is not None and over < undone_a and over <= undone_b and over != rank:
                return False
            age_a, age_b = self.age[a], self.age[b]
            if age_a < 0 and age_b < 0:
                return True
            if age_a >= age_b:
                undone_a, a = age_a, self.parts[a][1]
            else:
                undone_b, b = age_b, self.parts[b][0]

    def insert(self, words: list[bytes]) -> list[int]:
        """Insert words in sorted order, which walks the trie depth first.

        The path to the word before is the stack; nodes shared with it are kept, and
        each new node gets its state from the nodes above it: the automaton names the
        tokens that end there, longest first, and the first that may follow the last
        token of what precedes it is the one. A word's last step is its last symbol
        with the mark.
        """
        ends = [0] * len(words)
        path, before = [0], b""
        child, last, back, stand = self.child, self.last, self.back, self.stand
        goto, step, token, size, ends_at, next_end = self.goto, self.step, self.token, self.size, self.ends, self.next_end
        follows, moves, may_follow = self.follows, self.moves, self.may_follow
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            final = len(word) - 1
            shared = 0
            for a, b in zip(before, word):
                if a != b or shared == final:
                    break
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared, final + 1):
                symbol = word[depth]
                above = path[-1]
                key = above << 9 | symbol << 1 | (depth == final)
                node = child.get(key)
                if node is None:
                    node = child[key] = len(last)
                    state = stand[above]
                    move = state << 9 | symbol
                    state = goto.get(move)
                    if state is None:
                        state = moves.get(move)
                        if state is None:
                            state = moves[move] = step(move >> 9, symbol)
                    stand.append(state)
                    end = depth + 1
                    if depth == final:
                        move = state << 9 | MARK_SYMBOL
                        state = moves.get(move)
                        if state is None:
                            state = moves[move] = step(move >> 9, MARK_SYMBOL)
                        end += 1
                    found = ends_at[state]
                    while found:
                        start = end - size[found]
                        if start <= 0:
                            start = 0
                            break
                        pair = last[path[start]] << 32 | token[found]
                        known = follows.get(pair)
                        if known is None:
                            known = follows[pair] = may_follow(last[path[start]], token[found])
                        if known:
                            break
                        found = next_end[found]
                    else:
                        raise ValueError("the vocabulary lacks a byte symbol")
                    last.append(token[found])
                    back.append(path[start])
                path.append(node)
            ends[at] = path.pop()
            before = word[:-1]
        return ends

    def word_ids(self, words: list[str]) -> list[list[int]]:
        last, back = self.last, self.back
        found = []
        for node in self.insert([w.encode() for w in words]):
            ids = []
            while node:
                ids.append(last[node])
                node = back[node]
            ids.reverse()
            found.append(ids)
        return found

    def split_words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in order."""
        if text.isascii() or max(text) < chr(PLAIN):
            return self.plain.findall(text.lower())
        # Rare scripts: composing, case and classes as the library's tables have them.
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in p).decode() for p, _ in pieces]

    def words(self, text: str) -> list[str]:
        """Words and special tokens of a text; special ones stand for themselves."""
        if "<|" not in text:
            return self.split_words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.split_words(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Ids and tokens of words not met before.

        When a generation of words is full, a new one begins; words of the last one
        move over when they are met, older ones are forgotten.
        """
        if len(self.last) > self.max_nodes:
            self.clear_trie()
        if len(self.ids_of) > self.max_words // 2:
            self.older = self.ids_of, self.names_of
            self.ids_of, self.names_of = {}, {}
        ids_of, names_of = self.ids_of, self.names_of
        old_ids, old_names = self.older
        new = []
        for word in words.difference(ids_of):
            kept = old_ids.get(word)
            if kept is not None:
                ids_of[word], names_of[word] = kept, old_names[word]
            elif word in self.special:
                ids_of[word], names_of[word] = str(self.special[word]), word
            else:
                new.append(word)
        names = self.names
        for word, ids in zip(new, self.word_ids(new)):
            ids_of[word] = " ".join(map(str, ids))
            names_of[word] = " ".join([names[i] for i in ids])

    def batch(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; all of them are known afterwards."""
        parts = [self.words(t) for t in texts]
        self.learn(set().union(*parts))
        return parts

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for w in found for i in self.ids_of[w].split()] for found in self.batch(texts)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings joined by spaces; this vocabulary has no other decoder."""
        return " ".join([self.names[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """The worker process's encoder, kept over its tasks."""
    return TrieEncoder(path)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(docs: DataFrame, path: str, text_col: str, carry: list[str], with_ids: bool = False, with_digests: bool = True) -> DataFrame:
    """``carry`` columns, ``n_tokens``, digests of ids and decoded text, and on request ``ids``.

    Texts stay in the task that read them; nothing is shuffled.
    """
    own = [T.StructField("n_tokens", T.LongType(), False)]
    if with_digests:
        own += [T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    if with_ids:
        own.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False), False))
    schema = T.StructType([*[docs.schema[c] for c in carry], *own])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = encoder(path)
        # Nothing here makes cycles, and looking for them among all known words is dear.
        gc.disable()
        for batch in batches:
            for part in tx.blocks(batch, "__text"):
                parts = trie.batch([t or "" for t in part.column("__text").to_pylist()])
                decimal, texts = [], []
                for words in parts:
                    decimal.append(" ".join(map(trie.ids_of.__getitem__, words)))
                    if with_digests:
                        texts.append(" ".join(map(trie.names_of.__getitem__, words)))
                counts = [d.count(" ") + 1 if d else 0 for d in decimal]
                columns = [*[part.column(c) for c in carry], pa.array(counts, pa.int64())]
                if with_digests:
                    columns += [pa.array(map(sha, decimal), pa.string()), pa.array(map(sha, texts), pa.string())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    flat = np.fromstring(" ".join(filter(None, decimal)), np.int32, sep=" ")
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        gc.enable()

    narrow = docs.select(*carry, docs[text_col].alias("__text"))
    return narrow.mapInArrow(tx.tidy(work), schema)
