"""The registered queries on the smallest tables: columns, oracle statements, brute-force digests."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from memspan.llm import chat, decontaminate, fingerprints, language, neardup, packing, pseudolm, queries, secrets
from tests.llm.test_pseudolm import brute_scores
from tests.llm.test_repair import whole

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    answer = db.sql(queries.oracle_sql()[name])
    order = [answer.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in answer.fetchall())


def test_names():
    assert [sum(n.startswith(f"op{i}_") for n in queries.queries()) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in queries.queries() and set(queries.oracle_sql()) <= set(queries.queries())


def test_language_query(spark, documents):
    found = queries.op2_language_id(spark, SF).toPandas().set_index("doc_id")
    assert sorted(found.index) == sorted(documents.index)
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.index]
    assert found.held_out.tolist() == out
    right = found.lang_pred == documents.lang.reindex(found.index)
    assert right[out].mean() > 0.95


def test_secret_query(spark, documents):
    found = queries.op6_secret_scans(spark, SF).toPandas().set_index("doc_id")
    for i, text in documents.text.items():
        base, spans, _, _ = secrets.scan(text or "")
        assert found.base_sha256[i] == hashlib.sha256(secrets.joined(base).encode()).hexdigest() and found.spans[i] == secrets.joined(spans)


def test_substring_query(spark, documents):
    """Words of each document in a run of 50 that a document of a smaller id has too, by plain look-ups."""
    words = {i: re.findall("[^\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in documents.text.items()}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][a : a + 50]), i)
    covered = {i: set() for i in words}
    found = queries.op1_substring_dedup(spark, SF).collect()
    for r in found:
        assert r.partner_id < r.doc_id and r.end_word - r.start_word >= 50
        if r.exact:
            assert words[r.doc_id][r.start_word : r.end_word] == words[r.partner_id][r.partner_start : r.partner_end]
            covered[r.doc_id].update(range(r.start_word, r.end_word))
        else:
            a, b = ({tuple(w[k : k + 5]) for k in range(s, e - 4)} for w, s, e in ((words[r.doc_id], r.start_word, r.end_word), (words[r.partner_id], r.partner_start, r.partner_end)))
            assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8
    for i, w in words.items():
        wanted = {p for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for p in range(a, a + 50)}
        assert covered[i] == wanted


def test_scoring_query(spark, documents):
    """Scores by a plain loop over the same network, which does not depend on the partitions."""
    found = queries.op5_lm_scoring(spark, SF).toPandas().set_index("doc_id")
    assert sorted(found.index) == sorted(documents.index)
    vocabulary, network = pseudolm.fit(spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    for i in sorted(documents.index)[::20]:
        n, total = brute_scores(vocabulary, network, documents.text[i] or "")
        within = vocabulary.read([documents.text[i] or ""])[2][0]
        assert found.n_tokens[i] == n and abs(found.log_prob[i] - total - within) < 1e-2 + 1e-4 * n


def test_fingerprint_query(spark, documents):
    found = queries.op8_document_fingerprints(spark, SF).toPandas().set_index("doc_id")
    order = sorted(documents.index, reverse=True)
    for k, i in enumerate(order):
        text, other = documents.text[i] or "", documents.text[order[(k + 1) % len(order)]] or ""
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        a, b, c = (fingerprints.Sketch(t) for t in (text, edited, other))
        assert (found.n_chars[i], found.edited_sha256[i], found.fingerprint[i], found.edited_fingerprint[i]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b))
        assert found.near_edited[i] == fingerprints.likeness(a, b)[0] and found.near_next[i] == fingerprints.likeness(a, c)[0]


def test_token_query(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = queries.op7_token_counts(spark, SF).toPandas().set_index("doc_id")
    for i, text in documents.text.items():
        assert (found.n_bytes[i], found.n_tokens[i], found.over_limit[i]) == (len(text.encode()), n := len(model.encode(text)), n > 4096)


def test_packing_query(spark, documents):
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    found = queries.op9_best_fit_packing(spark, SF).toPandas()
    for i, part in found.groupby("doc_id"):
        ids = np.frombuffer(tokens.whole(documents.text[i]), "<u4").tolist() + [0]
        part = part.sort_values("piece")
        assert part.start.tolist() == list(range(0, len(ids), 2048)) and part.length.sum() == len(ids)
        assert part.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in part.start]
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    assert found.sequence_id.nunique() <= 1.03 * found.length.sum() / 2048 + 1


def test_bpe_query(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = queries.op11_bpe_codec(spark, SF).toPandas().set_index("doc_id")
    assert sorted(found.index) == sorted(documents.index)
    for i, text in documents.text.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(found.loc[i]) == wanted


def test_repair_query(spark):
    rows = pd.read_parquet(f"{SF}/conversations.parquet")
    said = [tuple(None if pd.isna(v) else v for v in r) for r in rows[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    found = queries.op12_conversation_repair(spark, SF)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == whole(said)


def test_chat_query(spark):
    rows = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    found = queries.op10_chat_formatting(spark, SF).toPandas().set_index("conv_id")
    said = {i: [(r.role, r.text or "") for r in part.itertuples()] for i, part in rows.groupby("conv_id")} | {-7: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]}
    assert set(found.index) == set(said)
    for i, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found.n_turns[i] == len(turns) and found.loss_chars[i] == len(loss)
        assert found.turns_sha256[i] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found.loss_sha256[i] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.TURN_END


def test_pipeline_against_its_operators(spark, documents):
    """Each stage's rows from plain Python over the same model and rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, docs.doc_id.isNotNull())
    left = documents[[not r for r in model.predict(list(documents.text))[2]]]
    sets = {i: neardup.shingle_set(t, 5) for i, t in left.text.items()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    left = left.loc[[i for i in left.index if find(i) == i]]
    windows = {w: {"x"} for t in pd.read_parquet(f"{SF}/benchmark.parquet").text for w in decontaminate.item_windows(decontaminate.words_of(t))}
    index = decontaminate._index(windows, decontaminate.Counter())
    left = left[[not decontaminate._judge(decontaminate.words_of(t), index)[-1] for t in left.text]]
    clean = {i: secrets.redact(t, secrets.scan(t)[1]) for i, t in left.text.items()}
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert set(found.doc_id) == set(clean)
    for i, part in found.groupby("doc_id"):
        ids = np.frombuffer(tokens.whole(clean[i]), "<u4").tolist() + [0]
        assert sorted(zip(part.start, part.ids_crc32)) == [(a, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "packing"]


def test_stages_pass_odd_tables_on(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "token=abcdefgh12 and words", "en", "s", 26), (3, "token=abcdefgh12 and words", "en", "s", 26)], schema)
    for df in (empty, odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
