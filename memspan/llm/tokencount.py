"""Token counts by a map-side two-tier lookup.

In a sentencepiece BPE model whose pieces hold the word mark only at their start, merges never
cross from a word into the next mark, so the tokens of a text are those of its *pre-tokens*
(each a run of spaces and the word behind it). Tier one is a broadcast hash table of the lengths of
the corpus's most frequent pre-tokens, at most ``top`` entries of bounded size, packed as their joined text and one
short integer each; tier two is a cache in each Python worker, filled by the library in batches of
misses and emptied when it reaches ``CACHE_SIZE``. No pre-token is ever shuffled: tasks send summaries of
their most frequent ones, which are approximate and only decide what is looked up first. A model with
other pieces is refused by the fast path and each text goes to the library whole.

Defined cases: null and empty texts have no tokens; control strings inside a text are ordinary
text, as by the library's default; repeated rows are counted one by one; an empty table gives an empty one; very long
texts are counted whole; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import map_columns
from memspan.llm.wordpieces import frequent_words

MARK = "\u2581"
CACHE_SIZE = 400_000
#: Longer pre-tokens are encoded each time and never cached.
LONGEST_CACHED = 256
_RUNS = re.compile(" +[^ ]*")
_models: dict = {}
_caches: dict = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first mark, which the model puts in front of any text; a mark
    alone, at the end of a text, is the empty string."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


def load_model(path: str):
    """The model at ``path``, once in a worker, and whether its pieces allow splitting at marks."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        splits = all(MARK not in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
        splits = splits and model.encode("a", out_type=str)[0].startswith(MARK) and model.encode("  a b ", out_type=str) == model.encode(f"{MARK}{MARK}a{MARK}b{MARK}", out_type=str)
        _models[path] = model, splits
    return _models[path]


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, top: int = 32_768) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row."""
    spark = df.sparkSession
    model, splits = load_model(model_path)
    words = [w for w, _ in frequent_words(df, text_col, pre_tokens, top)] if splits else []
    alone = len(model.encode("a ")) - len(model.encode("a"))  # the library gives nothing for an empty text
    words = [w for w in words if w and " " not in w]
    words = ["", *words]
    sizes = np.array([alone, *map(len, model.encode(words[1:], num_threads=1))], np.uint16)  # of at most MAX_WORD_BYTES bytes each
    table = spark.sparkContext.broadcast((" ".join(words), sizes))  # a pre-token has no space
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        worker_model, may_split = load_model(model_path)
        cache = _caches.setdefault(model_path, {})
        joined, lengths = table.value
        frequent = dict(zip(joined.split(" "), lengths.tolist(), strict=True))
        cache.update(frequent)

        def step(ids, texts, n_bytes):
            texts = [t or "" for t in texts]
            if not may_split:
                counts = [len(x) for x in worker_model.encode(texts, num_threads=1)]
            else:
                parts = [pre_tokens(t) for t in texts]
                missing = set().union(*parts).difference(cache)
                if len(cache) + len(missing) > CACHE_SIZE:
                    cache.clear()
                    cache.update(frequent)
                    missing = set().union(*parts).difference(cache)
                missing = list(missing)
                cache.update(zip(missing, map(len, worker_model.encode(missing, num_threads=1)), strict=True))
                counts = [sum(map(cache.__getitem__, p)) for p in parts]
                for w in missing:
                    if len(w) > LONGEST_CACHED:
                        del cache[w]
            return {"id": ids, "n_bytes": n_bytes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return step

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    counted = map_columns(df.select(id_col, text_col, n_bytes), make, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
