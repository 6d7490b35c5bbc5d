import hashlib
import random

import pytest

from lakekin.llm import bpe_trie
from lakekin.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def trie():
    return bpe_trie.TrieEncoder(vocabulary_path())


def odd_texts():
    rng = random.Random(5)
    texts = ["", " ", "don't it's I'LL we'd ab'sx", "İ ΣΑΣ ß ẞ ǅ ﬁ", "中文 한국어 नमस्ते", "😀👨‍👩‍👧", "a\x1cb\x85c\xa0d", "½ ² Ⅷ ٣ 12345"]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>c<|", "<|ENDOFTEXT|>", "x" * 5000, "'" * 99, "\x00"]
    for _ in range(400):
        top = rng.choice([0x180, 0x250, 0x600, 0x3000])
        texts.append("".join(chr(rng.randrange(top)) if rng.random() < 0.5 else rng.choice("abcdefgh '") for _ in range(rng.randrange(1, 40))))
    return texts


def test_ids_as_the_library(trie, library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert trie.encode(texts) == want
    assert [trie.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_forgetting_changes_nothing(library):
    small = bpe_trie.TrieEncoder(vocabulary_path(), max_nodes=50, max_words=10)
    texts = ["shared sharing share sharply", "sharp shards of sharing", "other words and shares"]
    for t in texts:
        assert small.encode([t])[0] == library.encode(t, add_special_tokens=False).ids


def test_shared_prefixes_are_states_once(trie):
    trie.reset()
    trie.learn({"prefixes"})
    before = len(trie.last)
    trie.learn({"prefixed"})
    # All but the last symbol is there; the last one carries the mark.
    assert len(trie.last) == before + 1


def test_rows(edge_docs, edge_rows, library):
    found = bpe_trie.encoded(edge_docs, vocabulary_path(), "text", ["doc_id", "key"], with_ids=True).collect()
    assert len(found) == len(edge_rows)
    texts = {i: t or "" for i, t, _ in edge_rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["key"] == 2
        assert r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_empty(no_docs):
    assert bpe_trie.encoded(no_docs, vocabulary_path(), "text", ["doc_id"]).collect() == []
