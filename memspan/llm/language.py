"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes the counts of its 1- to 3-grams of letters (lower-cased; each run of other
characters is one gap), hashed to ``DIMENSIONS`` places; the vector is the square roots of the
counts times the inverse document frequencies, scaled to length one. Each language has several
centroids, found by spherical k-means (clusters of a few odd texts have none). The prediction is the language of the centroid with the
greatest cosine, which is the score; a text is *rejected* if that cosine is less than ``margin`` times the
``quantile`` of the cosines of the centroid's own training texts, so a few odd training texts do not
matter.

The model is fitted on a bounded sample of the labelled rows: at most ``per_language`` documents
of each of the ``max_languages`` most frequent languages, those with the smallest hash of id and text (rows
alike in both count once). Document frequencies are added up over the sample, and each language is
clustered in a task of its own, on at most ``per_language`` vectors of at most ``DIMENSIONS`` entries. Only centroids
travel to the driver and are broadcast (bounded by languages, clusters and dimensions). Predictions cover
every row, whole texts, without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; null
labels and null texts are not learned from; equal cosines go to the language that sorts first;
without training rows everything is ``und`` and rejected; repeated rows get equal predictions; an empty table
gives an empty one; very long texts are read whole; extra columns, whatever their names, are not read
(``keep_identified`` returns them as they are).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.llm.durable import map_columns, stored

DIMENSIONS = 8192
UNKNOWN = "und"
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables.append(table)
    return _tables[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams, or None without a letter."""
    if not text:
        return None
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 3 or not c.any():
        return None
    one = c[c != 0] * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B) + c[1:]) * np.uint32(0xC2B2AE35) + np.uint32(1)
    three = ((c[:-2] * np.uint32(0x27D4EB2F) + c[1:-1]) * np.uint32(0x165667B1) + c[2:]) * np.uint32(0x9E3779B1) + np.uint32(2)
    grams = np.concatenate((one, two, three))
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(19), minlength=DIMENSIONS)


def _unit_vectors(counts: list[np.ndarray] | np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(np.asarray(counts, np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    """The fitted model: centroids, their languages and the least cosine that each accepts."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, least: np.ndarray):
        self.languages, self.idf, self.centroids, self.of, self.least = languages, idf, centroids, of, least

    def vectors(self, counts: list[np.ndarray] | np.ndarray) -> np.ndarray:
        return _unit_vectors(counts, self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.languages:
            return names, scores, rejected
        for at in range(0, len(texts), 256):
            rows, counts = [], []
            for i in range(at, min(at + 256, len(texts))):
                found = ngram_counts(texts[i])
                if found is not None:
                    rows.append(i)
                    counts.append(found)
            if rows:
                cosines = self.vectors(counts) @ self.centroids.T
                best = cosines.argmax(1)
                for i, k, cosine in zip(rows, best.tolist(), cosines[np.arange(len(rows)), best].tolist(), strict=True):
                    names[i], scores[i], rejected[i] = self.languages[self.of[k]], min(1.0, max(0.0, cosine)), cosine < self.least[k]
        return names, scores, rejected


def fit_language(x: np.ndarray, clusters: int = 4, margin: float = 0.3, quantile: float = 0.05, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language's vectors, and the least cosine that each accepts. Clusters of fewer than two
    texts, or a fiftieth of them, are odd ones out and have no centroid."""
    own = _spherical_means(x, min(clusters, len(x)), rounds)
    members = np.bincount((x @ own.T).argmax(1), minlength=len(own))
    own = own[(members >= max(2, len(x) / 50)) | (np.arange(len(own)) == members.argmax())]
    cosines = x @ own.T
    nearest, best = cosines.argmax(1), cosines.max(1)
    least = [margin * np.quantile(best[nearest == k], quantile) if (nearest == k).any() else 0.0 for k in range(len(own))]
    return own.astype(np.float32), np.array(least, np.float64)


def _spherical_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """The text nearest to all as first seed, others drawn by their squared distance from those before, then means by cosine; an empty cluster keeps its
    centroid."""
    def unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    rng = np.random.default_rng(0)
    seeds = [x[int((x @ unit(x.mean(0))).argmax())]]
    for _ in range(k - 1):
        away = np.maximum(1 - (x @ np.array(seeds).T).max(1), 0) ** 2
        seeds.append(x[int(rng.choice(len(x), p=away / away.sum()))] if away.sum() > 0 else x[0])
    own = np.array(seeds)
    for _ in range(rounds):
        nearest = (x @ own.T).argmax(1)
        own = np.array([unit(x[nearest == j].mean(0)) if (nearest == j).any() else own[j] for j in range(k)])
    return own


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 500, max_languages: int = 500, clusters: int = 4) -> Centroids:
    """Fits on the rows where ``usable`` holds and text and label are not null."""
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 40))
    labelled = df.where(usable & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    labelled = labelled.select(F.col(label_col).cast("string").alias("label"), draw.alias("draw"), F.col(text_col).alias("text"))
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_languages).collect()}
    model = Centroids([], np.ones(DIMENSIONS, np.float32), np.empty((0, DIMENSIONS), np.float32), np.empty(0, int), np.empty(0))
    if not sizes:
        return model
    share = F.create_map(*(x for name, n in sizes.items() for x in (F.lit(name), F.lit(int(min(1.0, 1.5 * per_language / n + 8 / n) * (1 << 40))))))
    drawn = labelled.where(F.col("draw") < share[F.col("label")]).dropDuplicates(["label", "draw"])

    def make():
        def step(labels, draws, texts):
            out: dict[str, list] = {"label": [], "draw": [], "places": [], "counts": []}
            for label, at, text in zip(labels, draws, texts, strict=True):
                counts = ngram_counts(text)
                if counts is not None:
                    places = np.flatnonzero(counts)
                    for name, value in zip(out, (label, at, places.astype("<u2").tobytes(), counts[places].astype("<u4").tobytes()), strict=True):
                        out[name].append(value)
            return out

        return step

    vectors = map_columns(drawn.select("label", "draw", "text"), make, "label string, draw long, places binary, counts binary")
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw"))
    sample = stored(vectors.withColumn("place", place).where(F.col("place") <= per_language).select("label", "draw", "places", "counts"), "sample")

    def frequencies(batches):
        import pyarrow as pa

        n, there = 0, np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for places in batch.column(0):
                there[np.frombuffer(places.as_py(), "<u2")] += 1
                n += 1
        there[DIMENSIONS] = n  # the last place counts the texts
        at = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(there[at])], names=["place", "n"])

    there = np.zeros(DIMENSIONS + 1)
    for r in sample.select("places").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row a place
        there[r.place] = r.n
    if not there[DIMENSIONS]:
        return model
    model.idf = np.log((1 + there[DIMENSIONS]) / (1 + there[:DIMENSIONS])).astype(np.float32) + np.float32(0.1)
    idf = model.idf

    def fitted(rows):
        import pandas as pd

        rows = rows.sort_values("draw")
        counts = np.zeros((len(rows), DIMENSIONS), np.float32)
        for row, places, values in zip(counts, rows["places"], rows["counts"], strict=True):
            row[np.frombuffer(places, "<u2")] = np.frombuffer(values, "<u4")
        own, least = fit_language(_unit_vectors(counts, idf), clusters)
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "centroids": [own.tobytes()], "least": [least.tobytes()]})

    found = sorted(sample.groupBy("label").applyInPandas(fitted, "label string, centroids binary, least binary").collect(), key=lambda r: r.label)  # a row a language
    least = [np.frombuffer(r.least, np.float64) for r in found]
    model.languages = [r.label for r in found]
    model.centroids = np.concatenate([np.frombuffer(r.centroids, np.float32).reshape(-1, DIMENSIONS) for r in found])
    model.least, model.of = np.concatenate(least), np.repeat(np.arange(len(found)), [len(x) for x in least])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def identify(df: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for each row."""
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(ids, texts):
            names, scores, rejected = sent.value.predict(texts)
            return {"id": ids, "lang_pred": names, "score": scores, "rejected": rejected}

        return step

    return map_columns(df.select(id_col, text_col), make, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is not rejected."""
    from pyspark.sql.types import BooleanType

    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(BooleanType())
    def accepted(texts):
        import pandas as pd

        return pd.Series([not r for r in sent.value.predict(list(texts))[2]])

    return df.where(accepted(F.col(text_col)))
