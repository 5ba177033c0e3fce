import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from memspan.llm import packing, tokencount, wordpieces

PIECES = [" ", "  ", "a", "B", "'s", "'", "the", "\n", "\t", "é", "É", "é", "漢", "😀", "<|endoftext|>", "<|", "<s>", "</s>", "\x00", "\x1c", "\x85", "　", "\xa0", "▁", "1", "12", ".", ",", "İ", "Σ", "ς", "ǆ", "ﬁ", "Å", "각", "x" * 300]


def awkward(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", " ", "a ", *awkward(1500, 1)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(df, path, limit=20, top=50).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert found[i] == (len((t or "").encode()), n, n > 20), repr(t)
    assert tokencount.count_tokens(df.where("false"), path).count() == 0


def test_cache_starts_anew():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = packing.WordTokens(path, 5)
    for t in awkward(60, 2):
        assert tokens.encode([t, "the the", ""]) == [tokens.whole(x) for x in (t, "the the", "")]


def test_ids_equal_the_library():
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = awkward(3000, 3)
    assert tokens.encode(texts) == [tokens.whole(t) for t in texts]


def test_texts_encoded_together(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 10)
    texts = ["a b", None, "c" * 30, "", "d e f g", "h i j k l", "m"]
    ranges = packing._together(texts)
    assert ranges == [(0, 2), (2, 3), (3, 5), (5, 7)] and packing._together([]) == []
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    assert [x for lo, hi in ranges for x in tokens.encode([t or "" for t in texts[lo:hi]])] == [tokens.whole(t or "") for t in texts]
    assert tokens.encode([]) == [] and tokens.encode([""]) == [b""]


def test_most_frequent(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{i}", rng.choice((1, 1, 1, 2, 3, 5, 8, 100, 1000))) for i in range(500)]
    spark.createDataFrame(rows, "word string, n long").repartition(5).write.parquet(str(tmp_path / "counts"))
    counted = spark.read.parquet(str(tmp_path / "counts"))
    wanted = sorted(rows, key=lambda x: (-x[1], x[0]))
    for top in (1, 40, 300, 500, 900):
        assert wordpieces.most_frequent(counted, "word", top) == wanted[:top]
    assert wordpieces.most_frequent(counted.where("false"), "word", 5) == []


def test_odd_tables(spark):
    """Long texts, rows alike, null ids and columns with names of helpers."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "some words, " * 40_000), (None, "x"), (None, "x"), (2, None)]
    df = spark.createDataFrame([(*r, "a", "b", 3) for r in rows], "doc_id long, text string, id string, word string, n int")
    found = sorted(((r.doc_id or 0), r.n_tokens) for r in tokencount.count_tokens(df, path).collect())
    assert found == sorted([(1, len(model.encode(rows[0][1]))), (0, len(model.encode("x"))), (0, len(model.encode("x"))), (2, 0)])


def test_other_tokenizers_get_whole_texts(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = packing.WordTokens(path)
    assert not other.fast and packing.WordTokens(public_tokenizers.path("word_bpe_49k.json")).fast
    texts = awkward(50, 6)
    assert other.encode(texts) == [other.whole(t) for t in texts]


def test_frequent_words(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("b a c",), ("",), ("z" * 100,)], "text string").repartition(2)
    assert wordpieces.frequent_words(df, "text", str.split, top=2) == [("a", 3), ("b", 2)]


def check_packing(rows, capacity, pieces):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(pieces)
    return len(by)


@pytest.mark.parametrize("per_task", [10_000, 40])
def test_packing(spark, per_task):
    rng = random.Random(4)
    pieces = [(i, 0, 0, rng.choice([2048, rng.randint(1, 2047), rng.randint(1, 300)]), i) for i in range(500)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = check_packing(packing.pack(df, items_per_task=per_task).collect(), 2048, pieces)
    least = -(-sum(p[3] for p in pieces) // 2048)
    assert n <= least * 1.06 + 2
    whole = check_packing(packing.pack(df, items_per_task=10_000, full=1.0).collect(), 2048, pieces)
    assert n <= whole + max(1, whole // 50)  # the tree and the bins that leave it early cost next to nothing
    assert packing.pack(df.where("false")).count() == 0


def test_best_fit():
    assert packing.best_fit([7, 5, 5, 3], 10) == [[0, 3], [1, 2]]
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 20) for _ in range(300)), reverse=True)
    room, want = [], []
    for i, s in enumerate(sizes):
        fit = [(r, b) for b, r in enumerate(room) if r >= s]
        if fit:
            least = min(r for r, _ in fit)
            b = [b for r, b in fit if r == least][0]
        else:
            b = len(room)
            room.append(20)
            want.append([])
        room[b] -= s
        want[b].append(i)
    got = packing.best_fit(sizes, 20)
    assert len(got) == len(want) and sorted(i for b in got for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 20 for b in got)


def test_whole_operator(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = packing.WordTokens(path)
    import zlib

    texts = ["", None, "hello world", "word " * 5000, "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    rows = packing.pack_documents(df, path).collect()
    pieces = []
    for i, t in enumerate(texts):
        ids = np.frombuffer(tokens.whole(t or ""), "<u4").tolist() + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            pieces.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    check_packing(rows, 2048, pieces)
