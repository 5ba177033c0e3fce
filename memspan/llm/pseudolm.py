"""Document scores by masked pseudo-likelihood.

A bidirectional window network predicts every token from the ``WINDOW`` tokens before and behind
it: each of these has its own embedding table, their sum goes through tanh, and a softmax in two
steps, over classes of words and over the words of a class, gives the token's distribution, exactly
normalised. A document's score is the sum of the logarithms of its tokens' conditional
probabilities.

Tokens are blank-separated words (A-Z lower-cased): the ``WORDS`` most frequent words of the corpus,
dealt evenly over ``CLASSES`` classes, each of which has one more entry, its *bucket*, for all other
words whose hash falls into it. The token 0 stands beyond both ends of a document. A word of a bucket
is predicted within it by corpus counts: of the ``n`` tokens of its bucket, its own (if it is one of
the next ``TABLE`` words by frequency) and, for all words outside the table, their share of the
bucket times the word's probability under a letter model, in which each byte follows from the two
before it. All counts are exact and taken over all documents; buckets are taken to be equally likely
under the letter model. Words are told apart by 64-bit hashes.

Training covers the corpus: documents are dealt by a hash of id and text into *shards* of about
``SHARD_TOKENS`` tokens, however the table is partitioned. In each of ``ROUNDS`` rounds every shard
trains the current network in numpy on its share of the positions (each round on others, all rounds
together on every token once), starting from unigram probabilities, and the shards' networks are
averaged, weighted by their positions. What the shards send grows with the input; it is summed in two steps
(by block of the network and a salt, then by block), each row holding one block of fixed size, so no task
gathers more than a stream of blocks. The driver gets one network.

Defined cases: null, empty and blank texts have no tokens, log_prob 0 and a null mean; repeated
rows score alike; ties in frequency go by hash; an empty table trains nothing and scores nothing; extra
columns, whatever their names, are not read. Very long texts are one row of ids (two bytes a token); a shard
may exceed its size by one such text. Scores do not depend on the partitions of the table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import rows_of, stored
from memspan.llm.fingerprints import words_at
from memspan.llm.wordpieces import most_frequent

WINDOW, HIDDEN = 2, 16
OFFSETS = (-2, -1, 1, 2)
CLASSES, SLOTS = 32, 128
WORDS, TABLE = CLASSES * SLOTS, 65_536
#: Words of a class and its bucket; the token beyond a document's ends has the last embedding.
WIDE = SLOTS + 1
EDGE = CLASSES * WIDE
#: Contexts of the letter model (two bytes, folded).
CONTEXTS = 1024
SHARD_TOKENS = 2_000_000
#: Shares of a shard's positions (of eight) in each round, and the rate of each.
ROUNDS = ((0, 1, 0.4), (1, 4, 0.2), (4, 8, 0.1))
BATCH = 4096
#: Values of one block of the network that travels; characters and tokens handled at a time.
BLOCK = 4096
CHUNK_CHARS, COUNTED = 1 << 20, 1 << 22
#: Logits stay within the range of a 32-bit exponential.
MOST = 60.0


class Network:
    """Embeddings (offset and token, hidden), and weights of the classes and of the words of each class as one
    vector; the last hidden unit is always on, its weights are biases."""

    def __init__(self, vector: np.ndarray | None = None):
        shapes = ((len(OFFSETS) * (EDGE + 1), HIDDEN), (HIDDEN,), (HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, WIDE))
        sizes = [math.prod(s) for s in shapes]
        if vector is None:
            vector = (np.random.default_rng(1).standard_normal(sum(sizes)) * 0.1).astype(np.float32)
        self.vector = np.array(vector, np.float32)
        cut = np.cumsum((0, *sizes))
        self.embed, self.bias, self.of_class, self.of_word = (self.vector[a:b].reshape(s) for a, b, s in zip(cut, cut[1:], shapes, strict=False))

    def start(self, counts: np.ndarray) -> None:
        """Biases of unigram probabilities, from counts of all tokens (class, slot)."""
        n = counts.reshape(CLASSES, WIDE) + 0.1
        self.bias[:] = 0
        self.of_class[-1] = np.log(n.sum(1) / n.sum())
        self.of_word[:, -1] = np.log(n / n.sum(1, keepdims=True))

    def around(self, ids: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Rows of the embeddings of the neighbours (offset, position)."""
        return np.stack([ids[positions + o].astype(np.int32) + j * (EDGE + 1) for j, o in enumerate(OFFSETS)])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.ones((around.shape[1], HIDDEN + 1), np.float32)
        total = self.embed[around[0]]
        for a in around[1:]:
            total += self.embed[a]
        total += self.bias
        np.tanh(total, out=h[:, :-1])
        return h

    def log_probs(self, ids: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Of the token at each position, given its neighbours."""
        target = ids[positions]
        order = np.argsort(target, kind="stable")
        positions, target = positions[order], target[order].astype(np.int32)
        h, rows, group = self.hidden(self.around(ids, positions)), np.arange(len(target)), target // WIDE
        logits = np.clip(h @ self.of_class, -MOST, MOST)
        said = logits[rows, group]
        total = np.exp(logits, out=logits) @ _ONES[:CLASSES]
        logits = self._words(h, target)[0]
        said += logits[rows, target - group * WIDE]
        total *= np.exp(logits, out=logits) @ _ONES[:WIDE]
        out = np.empty(len(target), np.float32)
        out[order] = said - np.log(total)
        return out

    def _words(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Logits of the words of each target's class, where targets are in order of class, and each class
        with where it begins and ends."""
        edges = np.searchsorted(target, np.arange(CLASSES + 1) * WIDE).tolist()
        parts = [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        logits = np.empty((len(target), WIDE), np.float32)
        for c, a, b in parts:
            np.matmul(h[a:b], self.of_word[c], out=logits[a:b])
        return np.clip(logits, -MOST, MOST, out=logits), parts

    def train(self, ids: np.ndarray, positions: np.ndarray, state: Network, rate: float) -> None:
        """One Adagrad step on a batch; ``state`` holds the sums of squared gradients."""
        n, target = len(positions), ids[positions]
        order = np.argsort(target, kind="stable")
        positions, target = positions[order], target[order].astype(np.int32)
        around = self.around(ids, positions)
        h, rows, group = self.hidden(around), np.arange(n), target // WIDE

        p = np.exp(np.clip(h @ self.of_class, -MOST, MOST))
        p *= (np.float32(1 / n) / (p @ _ONES[:CLASSES]))[:, None]
        p[rows, group] -= 1 / n
        back = p @ self.of_class.T
        q, parts = self._words(h, target)
        np.exp(q, out=q)
        q *= (np.float32(1 / n) / (q @ _ONES[:WIDE]))[:, None]
        q[rows, target - group * WIDE] -= 1 / n
        of_word = np.zeros_like(self.of_word)
        for c, a, b in parts:
            np.matmul(h[a:b].T, q[a:b], out=of_word[c])
            back[a:b] += q[a:b] @ self.of_word[c].T
        back = back[:, :-1] * (1 - h[:, :-1] ** 2)

        flat = around.ravel()
        by = np.argsort(flat)
        new = np.concatenate(([True], np.diff(flat[by]) != 0))
        touched = flat[by[new]]
        place = np.empty(len(flat), np.int64)
        place[by] = np.cumsum(new) - 1
        grad = np.empty((HIDDEN, len(touched)))
        for g, b in zip(grad, np.tile(back.T.astype(np.float64), len(OFFSETS)), strict=True):
            g[:] = np.bincount(place, b, len(touched))
        grad = grad.T.astype(np.float32)
        seen = state.embed[touched] + grad * grad
        state.embed[touched] = seen
        self.embed[touched] -= rate * grad / np.sqrt(seen)
        for mine, sums, g in ((self.bias, state.bias, back.sum(0)), (self.of_class, state.of_class, h.T @ p), (self.of_word, state.of_word, of_word)):
            sums += g * g
            mine -= rate * g / np.sqrt(sums)


_ONES = np.ones(max(CLASSES, WIDE), np.float32)


def _state() -> Network:
    return Network(np.full(Network().vector.shape, 1e-6))


def _at(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and the number of words of each."""
    hashes, at = words_at("\n".join(texts), wide=False)
    return hashes, np.diff(np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in texts)])))


#: Bytes with A-Z as a-z and white space as blanks.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The cell (context, byte) of every byte of the words and of the blank behind each, and where
    words start."""
    data = _FOLDED[np.frombuffer(("\n".join(texts) + " ").encode(errors="surrogatepass"), np.uint8)]
    blank = data == 32
    blank[1:] &= blank[:-1]  # behind another one; and those in front
    data = data[~blank].astype(np.int32)
    before = np.empty_like(data)
    before[:1], before[1:] = 32, data[:-1]
    second = np.full_like(data, 32)
    second[2:] = data[:-2]
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    second[starts] = 32
    return (((before + 31 * second) & (CONTEXTS - 1)) << 8) + data, starts


class Vocabulary:
    """Tokens of words, and the probabilities of words within their bucket, from the frequent words
    (hash, count), the sizes of the buckets and the counts of letters."""

    def __init__(self, counted: list[tuple[int, int]], buckets: np.ndarray, letters: np.ndarray):
        hashes = np.array([h for h, _ in counted], np.int64).view(np.uint64)
        counts = np.array([n for _, n in counted], np.float64)
        rank = np.arange(min(WORDS, len(hashes)))
        turn, place = rank // CLASSES, rank % CLASSES
        token = (np.where(turn % 2, CLASSES - 1 - place, place) * WIDE + turn).astype(np.uint16)  # there and back, so that classes weigh alike
        by = np.argsort(hashes[: len(rank)])
        self.sorted, self.token = hashes[: len(rank)][by], token[by]
        by = len(rank) + np.argsort(hashes[len(rank) :])
        self.table, self.counts = hashes[by], counts[by]
        self.unigrams = np.zeros(CLASSES * WIDE)
        self.unigrams[token] = counts[: len(rank)]
        bucket = (hashes & np.uint64(CLASSES - 1)).astype(np.int64)
        self.total = buckets - np.bincount(bucket[: len(rank)], counts[: len(rank)], CLASSES)
        self.rest = buckets - np.bincount(bucket, counts, CLASSES)
        self.unigrams[SLOTS::WIDE] = self.total
        n = letters.reshape(CONTEXTS, 256)
        single = (n.sum(0) + 1) / (n.sum() + 256)
        self.spelling = np.log((n + 4 * single) / (n.sum(1, keepdims=True) + 4)).astype(np.float32).ravel()

    def tokens(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token of each word, and whether it is a bucket."""
        at, found = _at(self.sorted, hashes)
        bucket = (hashes & np.uint64(CLASSES - 1)).astype(np.uint16) * np.uint16(WIDE) + np.uint16(SLOTS)
        return (np.where(found, self.token[at], bucket) if len(self.sorted) else bucket), ~found

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts, the number of each text's, and the sum of its words' log-probabilities
        within their buckets."""
        hashes, sizes = hashes_of(texts)
        tokens, inside = self.tokens(hashes)
        within = np.zeros(len(hashes))
        where = np.flatnonzero(inside)
        if len(where):
            cells, starts = letters_of(texts)
            spelled = np.add.reduceat(self.spelling[cells].astype(np.float64), starts)[where]
            h = hashes[where]
            bucket = (h & np.uint64(CLASSES - 1)).astype(np.int64)
            at, found = _at(self.table, h)
            own = np.full(len(h), -np.inf)
            own[found] = np.log(self.counts[at[found]])
            other = np.log(np.maximum(self.rest[bucket], 0) + 1) + np.minimum(spelled + np.log(CLASSES), 0)
            within[where] = np.logaddexp(own, other) - np.log(self.total[bucket] + 1)
        return tokens, sizes, np.bincount(np.repeat(np.arange(len(texts)), sizes), within, len(texts)).astype(np.float64)


def joined_ids(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens with edges around every text, and the positions of real tokens."""
    edge = np.full(WINDOW, EDGE, np.uint16)
    sizes = np.array([len(p) for p in parts], np.int64)
    ids = np.concatenate([edge, *(x for p in parts for x in (p, edge))])
    starts = WINDOW + np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1])) if len(parts) else np.empty(0, np.int64)
    return ids, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def positions_of(positions: np.ndarray, first: int, end: int) -> np.ndarray:
    """Those that one round trains on, mixed."""
    at = np.arange(len(positions))
    mine = positions[(at % 8 >= first) & (at % 8 < end)]
    return mine[np.random.default_rng(len(mine)).permutation(len(mine))]


def _chunks(rows):
    """Lists of rows whose last column's texts have about ``CHUNK_CHARS`` characters together."""
    held, size = [], 0
    for row in rows:
        held.append((*row[:-1], row[-1] or ""))
        size += len(held[-1][-1]) + 1
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_words(texts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary of a column of texts, and the number of their tokens."""

    def count(batches):
        import pyarrow as pa

        letters, held, size = np.zeros(CONTEXTS * 256, np.int64), [], 0

        def out(kind, keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(counts)], names=["kind", "key", "n"])

        def told():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return out(0, keys.view(np.int64), counts)

        for chunk in _chunks(rows_of(batches)):
            given = [t for (t,) in chunk]
            held.append(hashes_of(given)[0])
            if len(held[-1]):
                letters += np.bincount(letters_of(given)[0], minlength=len(letters))
            size += len(held[-1])
            if size >= COUNTED:
                yield told()
                held, size = [], 0
        if size:
            yield told()
        cells = np.flatnonzero(letters)
        yield out(1, cells, letters[cells])

    found = stored(texts.mapInArrow(count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = found.where("kind = 0")
    counted = most_frequent(words.select("key", "n"), "key", WORDS + TABLE)
    buckets, letters = np.zeros(CLASSES), np.zeros(CONTEXTS * 256)
    for r in words.groupBy(F.col("key").bitwiseAND(CLASSES - 1).alias("b")).agg(F.sum("n").alias("n")).collect():  # a row a bucket
        buckets[r.b] = r.n
    spelled = found.where("kind = 1").select("key", "n").toArrow()  # at most one row a cell
    letters[spelled.column("key").to_numpy()] = spelled.column("n").to_numpy()
    return Vocabulary(counted, buckets, letters), int(buckets.sum())


def tokenised(df: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, within (the part of the score that no network has a say in) and ids of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches):
        import pyarrow as pa

        words, schema = sent.value, None
        for batch in batches:
            schema = schema or batch.schema.field(0).type
            for chunk in _chunks(rows_of([batch])):
                tokens, sizes, within = words.read([t for _, t in chunk])
                raw, ends = tokens.astype("<u2").tobytes(), 2 * np.cumsum(sizes)
                ids = [raw[a:b] for a, b in zip((ends - 2 * sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunk], schema), pa.array(sizes.astype(np.int64)), pa.array(within), pa.array(ids, pa.binary())], names=["id", "n_tokens", "within", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(read, f"id {kind}, n_tokens long, within double, ids binary")


def _sharded(tokens: DataFrame, shards: int) -> DataFrame:
    """One row (shard, ids, sizes) for each shard, documents in order of a hash of their tokens."""

    def pack(batches):
        import pyarrow as pa

        shard, held, size = None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([b"".join(held)], pa.binary()), pa.array([np.array([len(h) // 2 for h in held], "<u4").tobytes()], pa.binary())], names=["shard", "ids", "sizes"])

        for k, ids in rows_of(batches):
            if shard is not None and (k != shard or size >= 4 * SHARD_TOKENS):
                yield out()
                held, size = [], 0
            shard = k
            held.append(ids)
            size += len(ids)
        if held:
            yield out()

    mixed = F.xxhash64("id", "ids")  # copies of a text are dealt one by one
    shard = F.pmod(mixed, F.lit(shards)).cast("int").alias("shard")
    dealt = tokens.where("n_tokens > 0").select(shard, mixed.alias("mixed"), "ids").repartition(shards, "shard").sortWithinPartitions("shard", "mixed")
    return stored(dealt.select("shard", "ids").mapInArrow(pack, "shard int, ids binary, sizes binary"), "shards")


def train(tokens: DataFrame, vocabulary: Vocabulary, n_tokens: int) -> Network:
    """The network of a stored table of tokens."""
    spark = tokens.sparkSession
    network = Network()
    network.start(vocabulary.unigrams)
    if not n_tokens:
        return network
    shards = -(-n_tokens // SHARD_TOKENS)
    salts = math.isqrt(shards - 1) + 1
    dealt = _sharded(tokens, shards)
    for first, end, rate in ROUNDS:
        sent = spark.sparkContext.broadcast(network.vector)

        def learn(batches, sent=sent, first=first, end=end, rate=rate):
            import pyarrow as pa

            for shard, raw, sizes in rows_of(batches):
                own, state = Network(sent.value), _state()
                cuts = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))
                ids, positions = joined_ids(np.split(np.frombuffer(raw, "<u2"), cuts[:-1]))
                positions = positions_of(positions, first, end)
                for i in range(0, len(positions), BATCH):
                    own.train(ids, positions[i : i + BATCH], state, rate)
                if len(positions):
                    blocks = [own.vector[i : i + BLOCK].tobytes() for i in range(0, len(own.vector), BLOCK)]
                    n = len(blocks)
                    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([len(positions)] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "shard", "seen", "values"])

        schema = "block int, shard int, seen long, values binary"
        salted = dealt.mapInArrow(learn, schema).withColumn("salt", F.col("shard") % salts).repartition("block", "salt").sortWithinPartitions("block", "salt", "shard", "seen", "values")
        partial = salted.select("block", "salt", "seen", "values").mapInArrow(_summed(np.float32, True), schema)
        total = partial.repartition("block").sortWithinPartitions("block", "shard").select("block", F.lit(0).alias("salt"), "seen", "values").mapInArrow(_summed(np.float64, False), schema)
        rows = sorted(total.collect(), key=lambda r: r["block"])  # one network
        if rows:
            network = Network(np.concatenate([np.frombuffer(r["values"], np.float64) / r["seen"] for r in rows]))
        sent.destroy()
    return network


def _summed(kind, weighted: bool):
    """(block, salt, seen, values) in order of block and salt, added up by both; values of ``kind``, which
    count as often as they have seen positions if ``weighted``."""

    def run(batches):
        import pyarrow as pa

        key, seen, total = None, 0, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "shard", "seen", "values"])

        for block, salt, n, values in rows_of(batches):
            if (block, salt) != key:
                if key is not None:
                    yield out()
                key, seen, total = (block, salt), 0, 0.0
            seen += n
            total = total + np.frombuffer(values, kind).astype(np.float64) * (n if weighted else 1)
        if key is not None:
            yield out()

    return run


def score_tokens(tokens: DataFrame, network: Network, id_col: str) -> DataFrame:
    """id, n_tokens, log_prob, mean_log_prob for each row of tokens."""
    sent = tokens.sparkSession.sparkContext.broadcast(network.vector)
    kind = tokens.schema["id"].dataType.simpleString()

    def step(batches):
        import pyarrow as pa

        own = Network(sent.value)
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            sums = batch.column(2).to_numpy().copy()
            parts = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(3)]
            ids, positions = joined_ids(parts)
            of = np.repeat(np.arange(len(parts)), sizes)
            for i in range(0, len(positions), 4096):
                sums += np.bincount(of[i : i + 4096], own.log_probs(ids, positions[i : i + 4096]), len(parts))
            means = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums), means], names=["id", "n_tokens", "log_prob", "mean_log_prob"])

    scored = tokens.select("id", "n_tokens", "within", "ids").mapInArrow(step, f"id {kind}, n_tokens long, log_prob double, mean_log_prob double")
    return scored.withColumnRenamed("id", id_col)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Vocabulary, Network]:
    """The vocabulary and the network of a corpus."""
    vocabulary, n_tokens = count_words(df.select(text_col))
    return vocabulary, train(stored(tokenised(df, vocabulary, id_col, text_col), "tokens"), vocabulary, n_tokens)


def score(df: DataFrame, vocabulary: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_prob, mean_log_prob for each row."""
    return score_tokens(tokenised(df, vocabulary, id_col, text_col), network, id_col)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on ``df`` and scores it; the tokens are read once for both."""
    vocabulary, n_tokens = count_words(df.select(text_col))
    tokens = stored(tokenised(df, vocabulary, id_col, text_col), "tokens")
    return score_tokens(tokens, train(tokens, vocabulary, n_tokens), id_col)
