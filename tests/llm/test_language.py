import math
import random
import zlib
from collections import Counter

import numpy as np

from memspan.llm import language

SYLLABLES = {"en": ["th", "ing", "and", "er", "on"], "de": ["sch", "ung", "ein", "ö", "cht"], "fr": ["eau", "é", "oi", "que", "ç"]}


def text(rng, name, n):
    return " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, name, rng.choice((8, 40, 200))), name) for i in range(n) for name in [rng.choice(sorted(SYLLABLES))]]


def test_held_out_accuracy_and_split(spark):
    rows = corpus(600)
    odd = [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, text(random.Random(5), "de", 30), None), (None, text(random.Random(6), "fr", 30), "fr")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double").repartition(3)
    model = language.train(df, df.doc_id.isNotNull() & ~language.held_out(), per_language=50)
    assert 7 <= len(model.centroids) <= 12 and model.languages == ["de", "en", "fr"]
    found = {r.doc_id: r for r in language.identify(df, model).collect()}
    right = [found[i].lang_pred == name for i, _, name in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(right) > 0.98 and len(right) > 100
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[1003].lang_pred == "de" and found[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in found.values())
    split = {r.doc_id: r.h for r in df.select("doc_id", language.held_out().alias("h")).collect()}
    assert all(split[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows) and split[None] is False


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(200)
    flipped = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 3 == 1 else name) for i, t, name in rows]
    predictions = []
    for data in (rows, flipped):
        df = spark.createDataFrame(data, "doc_id long, text string, lang string")
        model = language.train(df, ~language.held_out())
        predictions.append(sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model).collect()))
    assert predictions[0] == predictions[1]


def test_predictions_equal_a_plain_search(spark):
    """n-grams by slicing, vectors by dictionaries, cosines with every centroid one after the other."""
    df = spark.createDataFrame([(*r, 1) for r in corpus(150)], "doc_id long, text string, lang string, n int")
    model = language.train(df, df.doc_id.isNotNull(), per_language=40)

    def place(gram):
        codes, m = [ord(c) for c in gram], 1 << 32
        if len(codes) == 1:
            h = codes[0] * 0x9E3779B1
        elif len(codes) == 2:
            h = (codes[0] * 0x85EBCA6B + codes[1]) * 0xC2B2AE35 + 1
        else:
            h = ((codes[0] * 0x27D4EB2F + codes[1]) * 0x165667B1 + codes[2]) * 0x9E3779B1 + 2
        h %= m
        h ^= h >> 15
        return h * 0x2C1B3C6D % m >> 19

    def vector(text):
        plain = "\0" + "".join(c.lower() if c.isalpha() else "\0" for c in text) + "\0"
        while "\0\0" in plain:
            plain = plain.replace("\0\0", "\0")
        counts = Counter(place(plain[i : i + n]) for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n] != "\0")
        raw = {p: math.sqrt(n) * float(model.idf[p]) for p, n in counts.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {p: v / size for p, v in raw.items()}

    rows = [*corpus(40, seed=8), (500, "É, Ö! x", None), (501, "a", None), (502, "漢字", None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    for i, t, _ in rows:
        v = vector(t)
        cosines = [sum(x * float(c[p]) for p, x in v.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(found[i].score - max(0, cosines[best])) < 1e-4
        assert found[i].lang_pred == model.languages[model.of[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4
        assert found[i].rejected == (cosines[best] < model.least[best]) or abs(cosines[best] - model.least[best]) < 1e-4


def test_rejection_keeps_clean_rows(spark):
    rng = random.Random(2)
    odd = [(400, "qqq xxx zzz jjj", "en"), (401, "漢字", "de")]  # odd training rows do not turn rejection off
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus(300) + odd], "doc_id long, text string, lang string, rejected int, label string")
    model = language.train(df, df.doc_id.isNotNull())
    alien = [(9000, "漢字仮名交じり文 " * 30, "en"), (9001, None, "en")]
    alien += [(9002 + k, " ".join("".join(rng.choice("bcdfjkqvwxz") for _ in range(8)) for _ in range(n)), "en") for k, n in enumerate((5, 50, 500))]
    kept = language.keep_identified(df.unionByName(spark.createDataFrame([(*r, 1, "x") for r in alien], df.schema)), model)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id < 400 or r.doc_id >= 9000) == list(range(300))


def test_the_sample_is_bounded(spark):
    """A third of all rows alike, null ids and many languages: at most ``per_language`` rows of each of the most
    frequent languages are learned from."""
    rng = random.Random(3)
    rows = [(None, text(rng, "en", 30), "en") for _ in range(200)] + [(7, "same words here", "en")] * 300 + [(k, text(rng, "de", 20), "de") for k in range(100)] + [(1000 + k, "word", f"l{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.train(df, language.F.lit(True), per_language=10, max_languages=5)
    assert model.languages == ["de", "en", "l0", "l1", "l10"]
    names, _, _ = model.predict([text(rng, "en", 30), text(rng, "de", 30)])
    assert names == ["en", "de"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    model = language.train(df, df.doc_id.isNotNull())
    assert [(r.lang_pred, r.rejected) for r in language.identify(df, model).collect()] == [("und", True)]
    assert language.identify(df.where("false"), model).count() == 0
