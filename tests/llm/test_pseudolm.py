import random
from collections import Counter

import numpy as np

from memspan.llm import pseudolm as lm


def brute_scores(vocabulary, network, text):
    """A document's score without the share of words within buckets, one token after the other."""
    ids = [lm.EDGE] * 2 + vocabulary.read([text])[0].tolist() + [lm.EDGE] * 2
    total = 0.0
    for i in range(2, len(ids) - 2):
        h = network.bias.astype(float).copy()
        for j, o in enumerate(lm.OFFSETS):
            h += network.embed[j * (lm.EDGE + 1) + ids[i + o]]
        h = np.append(np.tanh(h), 1.0)
        for logits, said in ((h @ network.of_class, ids[i] // lm.WIDE), (h @ network.of_word[ids[i] // lm.WIDE], ids[i] % lm.WIDE)):
            logits = np.clip(logits, -lm.MOST, lm.MOST)
            total += logits[said] - np.log(np.exp(logits).sum())
    return len(ids) - 4, total


def corpus(n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        a = rng.randrange(20)
        rows.append((i, " ".join(f"w{(a + k) % 20}" for k in range(rng.randint(1, 120)))))
    return rows


def test_training_and_scores(spark):
    rows = [*corpus(), (900, None), (901, "  "), (902, "never seen before 漢"), (902, "never seen before 漢"), (903, "w1 " * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n_tokens int, id int, ids string").repartition(4)
    vocabulary, network = lm.fit(df)
    found = {r.doc_id: r for r in lm.score(df, vocabulary, network).collect()}
    for i, t in rows[::17] + rows[-3:-1]:
        n, total = brute_scores(vocabulary, network, t or "")
        within = vocabulary.read([t or ""])[2][0]
        assert found[i].n_tokens == n and abs(found[i].log_prob - total - within) < 1e-2 + 1e-4 * n
    assert found[900].log_prob == 0 and found[900].mean_log_prob is None and found[901].n_tokens == 0
    assert found[903].n_tokens == 30_000


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    network = lm.Network()
    network.start(rng.integers(0, 50, lm.CLASSES * lm.WIDE).astype(float))
    ids = rng.integers(0, lm.EDGE, 9).astype(np.uint16)
    total = 0.0
    for token in range(lm.EDGE):
        ids[4] = token
        total += np.exp(network.log_probs(ids, np.array([4]))[0])
    assert abs(total - 1) < 1e-3


def test_gradient():
    rng = np.random.default_rng(2)
    network = lm.Network()
    ids = rng.integers(0, lm.EDGE, 40).astype(np.uint16)
    positions = np.arange(2, 38)
    before = network.log_probs(ids, positions).mean()
    state = lm._state()
    for _ in range(60):
        network.train(ids, positions, state, 0.1)
    assert network.log_probs(ids, positions).mean() > before + 4


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 200, 60).astype(np.uint16)
    positions = np.arange(2, 58)
    network, state = lm.Network(), lm.Network(np.full_like(lm.Network().vector, 1e-30))
    start = network.vector.copy()
    network.train(ids, positions, state, 0.0)
    size = np.sqrt(state.vector)  # of each part of the gradient
    for at in np.argsort(-size)[[0, 5, 50, 400]].tolist() + [int(np.argmax(size[: network.embed.size]))]:
        around = []
        for step in (1e-2, -1e-2):
            moved = start.copy()
            moved[at] += step
            around.append(lm.Network(moved).log_probs(ids, positions).astype(float).mean())
        assert abs(abs(around[0] - around[1]) / 2e-2 - size[at]) < 0.05 * size[at] + 1e-4


def test_held_out_texts_beat_unigrams_whatever_the_partitions(spark):
    """Words follow each other by a rule with noise; scores of texts that were not trained on."""
    rng = random.Random(7)

    def text(words):
        at, out = rng.randrange(400), []
        for _ in range(words):
            at = (at * 7 + 3) % 400 if rng.random() < 0.8 else rng.randrange(400)
            out.append(f"w{at}")
        return " ".join(out)

    rows = [(i, text(rng.randrange(20, 400))) for i in range(500)]
    held = spark.createDataFrame([(i, text(200)) for i in range(20)], "doc_id long, text string")
    counts = Counter(w for _, t in rows for w in t.split())
    total = sum(counts.values())
    unigram = np.mean([np.log((counts[w] + 0.1) / total) for r in held.collect() for w in r.text.split()])
    means = []
    for parts in (4, 64):
        vocabulary, network = lm.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        found = lm.score(held, vocabulary, network).collect()
        means.append(sum(r.log_prob for r in found) / sum(r.n_tokens for r in found))
    assert min(means) > unigram + 0.5 and abs(means[0] - means[1]) < 0.01


def test_shards_are_averaged(spark, monkeypatch):
    """Several shards, trained apart and averaged, still beat the start; every token is trained on once."""
    seen = [lm.positions_of(np.arange(1000), first, end) for first, end, _ in lm.ROUNDS]
    assert sorted(np.concatenate(seen).tolist()) == list(range(1000))
    df = spark.createDataFrame(corpus(600), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)
    vocabulary, network = lm.fit(df)
    start = lm.Network()
    start.start(vocabulary.unigrams)
    trained, before = (sum(r.log_prob for r in lm.score(df, vocabulary, n).collect()) for n in (network, start))
    assert trained > 0.9 * before


def test_words_within_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 20)
    rng = random.Random(4)
    known = [f"{a}{b}{c}{d}" for a in "bdklmnprst" for b in "aeiou" for c in "lmnrst" for d in ("a", "er", "ing", "o")]
    rows = [(i, " ".join(rng.choice(known) for _ in range(60))) for i in range(200)]
    vocabulary, n = lm.count_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("text"))
    counts = Counter(w for _, t in rows for w in t.split())
    assert n == sum(counts.values())

    def within(w):
        return vocabulary.read([w])[2][0]

    def token(w):
        return int(vocabulary.read([w])[0][0])

    frequent = [w for w in counts if token(w) % lm.WIDE != lm.SLOTS]
    assert len(frequent) == 20 and min(counts[w] for w in frequent) >= sorted(counts.values())[-20] and all(within(w) == 0 for w in frequent)
    others = sorted(set(counts) - set(frequent))
    for w in others[::50]:
        total = sum(counts[x] for x in others if token(x) == token(w))
        assert abs(np.exp(within(w)) - counts[w] / (total + 1)) < 0.5 / (total + 1)
    new = ["xqzv", "qqxj", "zvxqw"], ["lanera", "tomera", "saning"]
    assert max(map(within, new[0])) < min(map(within, new[1])) < min(map(within, others))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(df).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.log_prob) for r in lm.score_documents(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
