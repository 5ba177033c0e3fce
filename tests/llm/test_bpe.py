"""BPE by segment trees against the library and against a plain loop."""

import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memspan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(codec, word):
    """Merges the leftmost pair of lowest rank until there is none."""
    ids = [int(codec.of_byte[b]) for b in word.encode()]
    while True:
        ranks = [(codec.merges[a * codec.size + b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a * codec.size + b in codec.merges]
        if not ranks:
            return ids
        i = min(ranks)[1]
        ids[i : i + 2] = [codec.merges[ids[i] * codec.size + ids[i + 1]][1]]


def test_both_trees_against_a_loop(own):
    draw = random.Random(3)
    words = ["".join(draw.choices("aaabcdet hÉ日0", k=draw.randint(1, 20))) for _ in range(300)] + ["a", "aaaa" * 16, "ab" * 32, "é" * 31]
    for width in (2, 4, 8, 16, 32, 64):
        some = [w for w in words if len(w.encode()) <= width]
        assert own.merged_together([w.encode() for w in some], width) == [plain(own, w) for w in some]
    for w in words:
        assert own.merged(w) == plain(own, w)


def test_against_the_library(own, library):
    draw = random.Random(5)
    letters = [chr(c) for c in (*range(0x20, 0x7F), 9, 10, 13, 0, 0x1C, 0x85, 0xA0, 0xAD, 0xE9, 0x130, 0x301, 0x660, 0x2028, 0x3000, 0x4E00, 0xAC00, 0x1F600, 0x200D, 0xFEFF)]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 80))) for _ in range(2000)]
    texts += ["it's we'll THEY'RE", "a<|endoftext|>b <|endoftext|><|endoftext|", " " * 1000 + "x", "x" + "\n" * 500, "ab" * 3000, "", "  <|endoftext|>  a"]
    for text, ids in zip(texts, own.encode(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids == wanted, text
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_every_character_is_cut_alike(own, library):
    """Letters, numbers and blanks are the library's, for every code point."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and chr(c) not in bpe.unsettled()]
    assert len(bpe.unsettled()) < 50_000
    wrong = []
    for a in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}\n" for c in points[a : a + 4096])
        if own.pieces(text) != (cut := [text[x:y] for _, (x, y) in library.pre_tokenizer.pre_tokenize_str(text)]):
            wrong += [c for c in points[a : a + 4096] if own.pieces(t := f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}\n") != [t[x:y] for _, (x, y) in library.pre_tokenizer.pre_tokenize_str(t)]]
    assert wrong == []
    assert cut
    some = sorted(bpe.unsettled())[::97]
    text = "".join(f"a{c}1{c} {c}!{c} it's<|endoftext|>" for c in some)
    assert own.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_decoding_any_ids(own, library):
    draw = random.Random(7)
    for _ in range(300):
        ids = [draw.randrange(own.size) for _ in range(draw.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([-1, 10**9, 64]) == library.decode([64], skip_special_tokens=False)


def test_cache_of_any_size(own, monkeypatch):
    texts = [f"word{i} other{i % 3} {'long' * 30}" for i in range(50)]
    wanted = own.encode(texts)
    monkeypatch.setattr(bpe, "CACHE_SIZE", 5)
    assert [bpe.Codec(PATH).encode([t])[0] for t in texts[:5]] == wanted[:5] and own.encode(texts) == wanted


def test_frames(spark, own):
    rows = [(1, None, 0), (2, "", 0), (3, "hello world " * 400, 0), (3, "hello world " * 400, 0), (None, "Été 日本\0", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = bpe.encode_texts(df, PATH)
    assert sorted((r.doc_id or 0, r.ids) for r in found.collect()) == sorted((i or 0, own.encode([t])[0]) for i, t, _ in rows)
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode_ids(found, PATH).collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.token_digests(df.limit(0), PATH).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [None, 64])], "doc_id long, ids array<int>")
    assert sorted(r.text for r in bpe.decode_ids(nothing, PATH).collect()) == ["", own.decode([64])]
    assert {r.doc_id: r.n_tokens for r in bpe.token_digests(df, PATH).collect()}[1] == 0
