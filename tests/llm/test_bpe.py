"""Encoding and decoding against the vocabulary's own library and against plain merging."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelloom.llm import bpe
from tests.llm.data import CLASHES, EDGE, edge

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOLS = [
    "ab", "aA 's'tre\n\t ", "abcdefghijklmnopqrstuvwxyz", "0123456789,.!?'\"", "éàüñ日本語中文字😀́‍", "\U000323b0՘\U00011de0a1 ",
    "\x00\x1f\x85\xa0　 x", "<|endoftext|> ", "the ing tion er ",
]


@pytest.fixture(scope="module")
def definition():
    with open(PATH, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def coder(definition):
    return bpe.Coder(definition)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(count, seed=5):
    pick = random.Random(seed)
    for _ in range(count):
        pool = "".join(pick.sample(POOLS, pick.randint(1, 3)))
        text = "".join(pick.choice(pool) for _ in range(pick.randint(0, 80)))
        yield text.replace(" ", "<|endoftext|>", 1) if pick.random() < 0.1 else text


def test_equals_the_library(coder, library):
    given = list(texts(3000))
    for text, found in zip(given, coder.encode_many(given), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert found.tolist() == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("letters", ["a", "ab", "qwertyuiopasdfghjklzxcvbnm", "日本語"])
def test_long_text_without_blanks(coder, library, letters):
    pick = random.Random(2)
    text = "".join(pick.choice(letters) for _ in range(200_000))
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_character_is_split_alike(coder, library):
    for start in range(1, 0x110000, 4096):
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, min(start + 4096, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def merged(piece, vocabulary, ranks):
    """Plain merging: the best pair, leftmost first, until there is none."""
    parts = list(piece)
    while True:
        found = min(((ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)  # noqa: B905
        if found is None:
            return [vocabulary[p] for p in parts]
        k = found[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_equals_plain_merging_of_made_up_vocabularies():
    """Small vocabularies with many competing merges."""
    pick = random.Random(11)
    for _ in range(40):
        vocabulary = {c: i for i, c in enumerate(bpe.byte_characters())}
        merges = []
        tokens = list("abc")
        for _ in range(pick.randint(1, 12)):
            a, b = pick.choice(tokens), pick.choice(tokens)
            if a + b not in vocabulary:
                vocabulary[a + b] = len(vocabulary)
                merges.append([a, b])
                tokens.append(a + b)
        parts = {"model": {"type": "BPE", "vocab": vocabulary, "merges": merges}, "normalizer": None, "added_tokens": []}
        parts["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        coder = bpe.Coder(json.dumps(parts).encode())
        ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        pieces = ["".join(pick.choice("abc") for _ in range(pick.randint(1, 14))) for _ in range(200)]
        for piece, found in zip(pieces, coder.encode_many(pieces), strict=True):
            expected = merged(piece, vocabulary, ranks)
            assert found.tolist() == expected, (merges, piece)
            assert list(coder.encode_long(piece.encode())) == expected


def test_table_of_edges(spark, definition, coder):
    docs = edge(spark)
    found = bpe.decode(bpe.encode(docs, definition), definition)
    assert found.columns == [*docs.columns, "ids", "decoded"]
    rows = found.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in EDGE)
    for r in rows:
        assert r["decoded"] == (r["text"] or "") and r["ids"] == coder.encode(r["text"] or "")
        assert all(r[c] == f"own {c}" for c in CLASHES)
    assert bpe.decode(bpe.encode(edge(spark, []), definition), definition).collect() == []


def test_memory_of_pieces_and_pairs_may_be_short(definition, coder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "PIECES", 7)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 200)
    given = list(texts(150, 8))
    short = bpe.Coder(definition)
    assert [x.tolist() for x in short.encode_many(given)] == [coder.encode(t) for t in given]


def test_other_files_are_refused(definition):
    parts = json.loads(definition)
    parts["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        bpe.Coder(json.dumps(parts).encode())


def test_bytes_that_are_no_text(coder):
    assert coder.decode([coder.whole[b"\xc3"], 1 << 30, -1]) == "�"
