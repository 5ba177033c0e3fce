"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each document becomes its set of ``width``-word shingle hashes (one 64-bit hash function).
   Documents with equal sets are one *class*, and only classes go on.
2. The retained values are each class's ``depth`` smallest hashes in each of ``classes`` residue
   classes of that one hash function. Inverted lists are kept of the retained values, those of a
   residue together forming the list's key. Two documents of Jaccard similarity ``s`` share a key
   of one residue with probability about ``s ** depth``, so that documents that only share a common passage
   hardly ever meet; there are as many residues as it takes for a pair at the threshold to miss all lists with a
   probability of at most ``MISSED`` (35 for 0.85, 54 for 0.8).
3. Members of a list are tied to its smallest class (one edge a member, never all pairs), and
   connected components of these ties are the *families* within which links can exist.
4. Within a family, each class is a sketch of its ``sketch`` smallest hashes. Inverted lists of these
   retained values generate the overlaps of one class with all that are not connected with it yet; the
   union sketch of two classes turns an overlap into an estimate, and pairs whose estimate is within
   five standard errors of the threshold, or above, are verified on the full sets.
5. A family of more than ``block_tokens`` hashes or ``block_rows`` classes is searched in blocks of
   that size. First each block is searched together with the family's first class, so that a large group of near
   copies is never gathered. Where something is not connected with it, the family is taken apart by a prefix filter,
   which loses no link: classes stay together only if they share one of their rarest hashes, so many that a linked pair
   can't do without. Within what is still as large, classes not connected with the first one
   visit all other blocks, so that only these move more than once. Only texts of family members are shuffled (a Bloom filter keeps
   most others back).

Words are runs of anything but ASCII white space, with A-Z lower-cased; shorter texts are one
shingle. Defined cases: null, empty and wordless texts have an empty set and are linked with
nothing; repeated rows and ties link as equal sets; rows that share an id but not a text are judged
each by its own set; a null id has a null component, is kept and is never a partner; an empty table gives an
empty result; very long texts take part whole (a set of eight bytes a word); extra columns, whatever
their names, are not read, and ``drop_near_duplicates`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspan.llm.components import connected_components
from memspan.llm.durable import free_names, map_columns, rows_of, stored, trim_memory
from memspan.llm.fingerprints import mix, shingle_hashes, word_hashes
from memspan.llm.membership import bloom_filter, members_of, possible_members

DEPTH, SKETCH, MISSED = 6, 64, 1e-7
BLOCK_TOKENS, BLOCK_ROWS = 1_000_000, 400
#: Classes from which on a hash is frequent, and how many frequent ones are sent to the tasks at most, as a power of two.
FREQUENT, FREQUENT_BITS = 1000, 19


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``."""
    return np.unique(shingle_hashes(word_hashes(text, wide=False), width)) if text else np.empty(0, np.uint64)


def residues(percent: int, depth: int = DEPTH) -> int:
    """How many residue classes a threshold needs."""
    return 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** depth))


def list_keys(hashes: np.ndarray, classes: int, depth: int = DEPTH) -> np.ndarray:
    """One key for each residue class that has a hash: its ``depth`` smallest ones, mixed."""
    if not len(hashes):
        return np.empty(0, np.int64)
    residue = (mix(hashes) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(residue, kind="stable")  # by class, each in ascending order of hashes
    ranked, values = residue[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    key = ranked[first].astype(np.uint64)
    for i in range(depth):
        at = first + i
        inside = at < len(ranked)
        at = np.minimum(at, len(ranked) - 1)
        there = inside & (ranked[at] == ranked[first])
        key = np.where(there, mix(key + values[at] * np.uint64(2 * i + 3)), key)
    return key.view(np.int64)


def linked(common, size_a, size_b, percent: int):
    """Whether 100 * intersection >= percent * union."""
    return 100 * common >= percent * (size_a + size_b - common)


def family_links(ids: list, sets: list[np.ndarray], percent: int, sketch: int = SKETCH, visiting: list[bool] | None = None, known: list | None = None) -> list[tuple]:
    """(id, smallest id of its component) for the members of one family that have a link; links
    between two members that are only ``visiting`` are left to other calls. Members with the same entry of ``known``
    are connected already and not compared."""
    n = len(ids)
    if visiting is not None and all(visiting):
        return []
    order = sorted(range(n), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    guest = None if visiting is None or not any(visiting) else np.array([visiting[i] for i in order])
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(i, min(ids)) for i in ids] if linked(common, len(sets[0]), len(sets[1]), percent) else []
    sizes = np.array([len(s) for s in sets])
    vocabulary, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    tokens = tokens.astype(np.int32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kept = np.minimum(sizes, sketch)  # the vocabulary is sorted, and so is each set: its first tokens are its smallest
    whole = np.where(sizes <= sketch, len(vocabulary), tokens[starts + kept - 1])  # up to here a sketch is complete
    retained = tokens[np.arange(kept.sum()) + np.repeat(starts - np.cumsum(kept) + kept, kept)]
    by = np.argsort(retained, kind="stable")
    lists = np.repeat(np.arange(n), kept)[by]  # members by retained value
    edges = np.searchsorted(retained[by], np.arange(len(vocabulary) + 1))
    flag = np.zeros(len(vocabulary) + 1, bool)
    ratio = percent / 100
    open_ = np.ones(n, bool)
    left, first = n, 0
    found = []
    if known is None:
        alike = None
    else:
        names, group = np.unique(np.array([known[i] for i in order]), return_inverse=True)
        alike = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])

    def taken(near):
        """``near`` and what is connected with them already, no longer open."""
        if alike is not None:
            near = np.concatenate([alike[g] for g in np.unique(group[near])])
        open_[near] = False
        return near.tolist()

    while left:
        first += int(open_[first:].argmax())
        members = taken(np.array([first]))
        queue = list(members)
        left -= len(members)
        while queue and left:
            x = queue.pop()
            lo = np.searchsorted(sizes, np.ceil(ratio * sizes[x] - 1e-9), side="left")
            hi = np.searchsorted(sizes, np.floor(sizes[x] / ratio + 1e-9), side="right")
            own = tokens[starts[x] : ends[x]]
            low = own[: kept[x]]
            near = lists[_ranges(edges[low], edges[low + 1])]  # of each of its retained values, the list
            near = near[open_[near] & (near >= lo) & (near < hi)]
            if guest is not None and guest[x]:
                near = near[~guest[near]]
            if not len(near):
                continue
            near, overlap = np.unique(near, return_counts=True)
            limit = np.minimum(whole[x], whole[near])
            flag[own] = True
            # of the union's sketch, what lies up to the smaller limit
            theirs = _below(retained, kept, near, limit)
            union = np.searchsorted(own, limit, side="right") + theirs - overlap
            error = np.sqrt(ratio * (1 - ratio) / np.maximum(union, 1))
            near = near[overlap >= (ratio - np.where(limit >= len(vocabulary), 1e-9, 5 * error)) * union]
            if len(near):
                counts = _overlaps(flag, tokens, starts[near], ends[near])
                near = near[linked(counts, sizes[x], sizes[near], percent)]
            flag[own] = False
            if len(near):
                near = taken(near)
                queue += near
                members += near
                left -= len(near)
        if len(members) > 1:
            root = min(ids[m] for m in members)
            found += [(ids[m], root) for m in members]
    return found


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All of starts..ends (exclusive), one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _below(retained: np.ndarray, kept: np.ndarray, near: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of the retained values of each of ``near`` are at most its ``limit``."""
    begins = (np.cumsum(kept) - kept)[near]
    values = retained[_ranges(begins, begins + kept[near])]
    inside = values <= np.repeat(limit, kept[near])
    return np.add.reduceat(inside.astype(np.int64), np.cumsum(kept[near]) - kept[near])


def _overlaps(flag: np.ndarray, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of each token run are flagged."""
    sizes = ends - starts
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(sizes.sum()) + np.repeat(starts - firsts, sizes)
    return np.add.reduceat(flag[tokens[at]].astype(np.int64), firsts)


def _judged(df: DataFrame, percent: int, width: int, id_col: str, text_col: str, block_tokens: int, block_rows: int) -> DataFrame:
    """id, text_key (a hash of the text), n, component (null for a null id) and root (that names the
    component, where rows share an id) of each row of ``df``."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lots = residues(percent)

    def make_sketches():
        def step(ids, text_keys, texts):
            out: dict[str, list] = {"id": ids, "text_key": text_keys, "n": [], "class": [], "keys": []}
            for text in texts:
                hashes = shingle_set(text, width)
                out["n"].append(len(hashes))
                out["class"].append(int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True) if len(hashes) else None)
                out["keys"].append(list_keys(hashes, lots))
            return out

        return step

    sketches = stored(map_columns(rows.select("id", F.xxhash64("text"), "text"), make_sketches, "id long, text_key long, n long, class long, keys array<long>"), "sketches")
    usable = sketches.where("id IS NOT NULL AND n > 0")
    classes = stored(usable.groupBy("class").agg(F.min(F.struct("id", "text_key")).alias("first"), F.first("n").alias("n")).select("class", "first.id", "first.text_key", "n"), "classes")
    firsts = usable.join(classes.select("class", "id", "text_key"), ["class", "id", "text_key"], "left_semi")  # repeated rows give the same lists
    families = stored(_families(firsts.select("class", F.explode(F.array_distinct("keys")).alias("key"))), "families")

    def make_sets():
        def step(classes, fams, texts):
            return {"class": classes, "family": fams, "hashes": [shingle_set(t, width).tobytes() for t in texts]}

        return step

    members = stored(classes.join(families, "class"), "members")  # class, id, text_key, n, family
    texts = members_of(rows, "id", members.select("id")).withColumn("text_key", F.xxhash64("text"))
    met = texts.join(members.hint("merge"), ["id", "text_key"]).select("class", "family", "text")
    sets = map_columns(met, make_sets, "class long, family long, hashes binary")
    sizes = members.groupBy("family").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    blocks = F.greatest(F.ceil(F.col("tokens") / (block_tokens / 2)), F.ceil(F.col("rows") / block_rows)).cast("int")
    large = stored(sizes.where((F.col("tokens") > block_tokens) | (F.col("rows") > block_rows)).select("family", "tokens", "rows", blocks.alias("blocks")), "large")
    split = large.limit(1).count() > 0
    if not split:
        links = stored(_searched(sets.select("*", F.lit(0).cast("long").alias("block"), F.lit(False).alias("guest"), F.col("class").alias("known")), percent, parts), "links")
        return _components(sketches, classes, links)
    sets = stored(sets, "sets")
    # small families whole; of large ones each block with the family's first class
    dealt = sets.join(large.select("family", "blocks"), "family", "left")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("long")
    leader = F.col("class") == F.col("family")  # a family is named after its smallest class
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)
    where = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).when(leader, every).otherwise(F.array(own))
    once = dealt.select("class", "family", "hashes", F.explode(where).alias("block"), F.lit(False).alias("guest"), F.col("class").alias("known"))
    found = stored(_searched(once, percent, parts), "links")
    # families with members that are not connected with the first class (the smallest, so its component's root) are taken apart
    inside = sets.join(large.select("family"), "family").join(found.where("class <> root"), "class", "left")  # all but the first are in one block
    state = inside.withColumn("root", F.coalesce("root", "class")).withColumn("apart", F.col("root") != F.col("family"))
    wide = state.join(state.where("apart").select("family").distinct(), "family", "left_semi").drop("family")
    closer = stored(_families(_prefixes(wide, percent)), "closer")
    again = stored(wide.join(closer, "class"), "again")
    tokens = F.octet_length("hashes") / 8
    apart = again.groupBy("family").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("rows"), F.sum(F.when(F.col("apart"), tokens)).alias("apart_tokens"), F.count_if("apart").alias("apart_rows"))
    apart = stored(apart.where("apart_rows > 0"), "apart")
    if not apart.limit(1).count():
        return _components(sketches, classes, found)
    # in those still large, what is not connected with the first class of old visits all blocks
    again = again.join(apart, "family")
    whole = (F.col("tokens") <= block_tokens) & (F.col("rows") <= block_rows)
    blocks = F.greatest(F.ceil(F.col("tokens") / (block_tokens / 2)), F.ceil(F.col("rows") / F.greatest(F.lit(block_rows), F.col("apart_rows"))))
    again = again.withColumn("blocks", F.when(whole, 1).otherwise(blocks).cast("long")).withColumn("lots", F.when(whole, 1).otherwise(F.ceil(F.col("apart_tokens") / (block_tokens / 2))).cast("long"))
    own, lot = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("long"), F.pmod(F.xxhash64(F.lit(1), "class"), F.col("lots")).cast("long")

    def all_of(n):
        return F.sequence(F.lit(0).cast("long"), n - 1)

    home = F.transform(all_of(F.col("lots")), lambda x: F.struct((own * F.col("lots") + x).alias("block"), F.lit(False).alias("guest")))
    away = F.transform(F.filter(all_of(F.col("blocks")), lambda x: x != own), lambda x: F.struct((x * F.col("lots") + lot).alias("block"), F.lit(True).alias("guest")))
    spots = F.explode(F.when(F.col("apart"), F.concat(home, away)).otherwise(home)).alias("spot")
    visits = again.select("class", "family", "hashes", F.col("root").alias("known"), spots).select("class", "family", "hashes", "known", "spot.block", "spot.guest")
    more = _searched(visits, percent, parts)
    return _components(sketches, classes, stored(found.unionByName(more), "links"))


def _families(lists: DataFrame) -> DataFrame:
    """(class, family) of the classes in (class, key) that share a key with another, in components: each member of a key is
    tied to its smallest class."""
    heads = lists.groupBy("key").agg(F.min("class").alias("head"), F.max("class").alias("last")).where("head <> last").select("key", "head")
    ties = lists.join(heads, "key").where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    return connected_components(ties).select(F.col("vertex").alias("class"), F.col("component").alias("family"))


def _prefixes(sets: DataFrame, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """(class, key): of each set's n hashes the n - ceil(n * percent / 100) + 1 rarest, less those that no other set has. Linked
    sets have so many hashes in common that the rarest of them is among these on either side.

    Hashes of ``frequent`` sets or more (of more, if those would be too many to send) come last in that order, so each task ranks them by
    itself and sends only those that a set needs; all others are counted where they meet, in groups below that size."""

    def make_hashes():
        def step(held):
            return {"keys": [np.frombuffer(h, np.int64) for h in held]}

        return step

    def make_split():
        def step(classes, held):
            out: dict[str, list] = {"class": classes, "size": [], "keys": [], "last": []}
            keys, counts = sent.value
            for h in held:
                own = np.frombuffer(h, np.int64)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                often = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                size = len(own) - (len(own) * percent + 99) // 100 + 1
                last = own[often][np.lexsort((own[often], counts[at[often]]))]
                out["size"].append(size)
                out["keys"].append(own[~often])
                out["last"].append(last[: max(0, size - int((~often).sum()))])
            return out

        return step

    counts = map_columns(sets.select("hashes"), make_hashes, "keys array<long>").select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("held"))
    total = sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    often = counts.where(F.col("held") >= max(frequent, (total // 8 >> FREQUENT_BITS) + 1)).toArrow()
    keys, held = often["key"].to_numpy(), often["held"].to_numpy()
    order = np.argsort(keys)
    sent = sets.sparkSession.sparkContext.broadcast((keys[order], held[order]))
    rows = stored(map_columns(sets.select("class", "hashes"), make_split, "class long, size long, keys array<long>, last array<long>"), "split")
    others = rows.select("class", "size", F.explode("keys").alias("key")).withColumn("held", F.count("*").over(Window.partitionBy("key")))
    place = F.row_number().over(Window.partitionBy("class").orderBy("held", "key"))
    rare = others.withColumn("place", place).where((F.col("place") <= F.col("size")) & (F.col("held") > 1)).select("class", "key")
    return stored(rare.unionByName(rows.select("class", F.explode("last").alias("key"))), "prefixes")


def _searched(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """(class, root) of the links within each block of (class, family, hashes, block, guest, known)."""

    def search(batches):
        import pyarrow as pa

        trim_memory()
        key, classes, held, guests, known = None, [], [], [], []

        def finish():
            links = family_links(classes, held, percent, visiting=guests, known=known) if len(classes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["class", "root"])

        for family, block, one, guest, group, hashes in rows_of(batches):
            if (family, block) != key:
                yield finish()
                key, classes, held, guests, known = (family, block), [], [], [], []
            classes.append(one)
            guests.append(guest)
            known.append(group)
            held.append(np.frombuffer(hashes, np.uint64))
        yield finish()

    dealt = sets.select("family", "block", "class", "guest", "known", "hashes").repartition(parts, "family", "block").sortWithinPartitions("family", "block")
    return dealt.mapInArrow(search, "class long, root long")


def _components(sketches: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Each row's component: the smallest id of all classes that links connect."""
    joined = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("vertex").alias("class"), F.col("component").alias("root"))
    named = classes.select("class", "id").join(joined, "class")
    lowest = named.groupBy("root").agg(F.min("id").alias("component"))
    lowest = lowest.select(F.bitwise_not(F.bitwise_not("root")).alias("root"), "component")  # so that a component of many members may be split
    known = classes.select("class", "id").join(named.select("class", "root").join(lowest, "root").select("class", "root", "component"), "class", "left")
    known = known.select("class", F.coalesce("root", "class").alias("root"), F.coalesce("component", "id").alias("component"))
    out = sketches.select("id", "text_key", "n", "class").join(known, "class", "left")
    return out.select("id", "text_key", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"), "root")


def near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, n_shingles, component_id, kept for each row; links are pairs of sets with
    100 * intersection >= percent * union."""
    found = _judged(df, percent, width, id_col, text_col, block_tokens, block_rows)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: of the rows with its smallest id, one of those with the smallest
    hash of their text. Rows with a null id or without a word stay, and so do rows that
    share an id but are in no component with another.

    Rows that surely stay pass a Bloom filter unshuffled; only rows that may be dropped or
    repeated meet the exact list.
    """
    found = stored(_judged(df, percent, width, id_col, text_col, BLOCK_TOKENS, BLOCK_ROWS).where("id IS NOT NULL AND n > 0"), "judged")
    first = found.where("id = component").groupBy("root").agg(F.min("text_key").alias("winner"), F.count("*").alias("rows")).where("rows > 1")
    judged = found.join(first, "root", "left")
    fate = F.when(F.col("id") != F.col("component"), "drop").when(F.col("text_key") != F.col("winner"), "drop").when(F.col("rows") > 1, "once").otherwise("keep")
    judged = stored(judged.select("id", "text_key", fate.alias("fate")).where("fate <> 'keep'").distinct(), "fates")
    key, hashed, fate_ = free_names(df, "key", "hashed", "fate")
    keyed = df.withColumn(key, F.col(id_col).cast("long")).withColumn(hashed, F.xxhash64(text_col))
    bits = bloom_filter(judged.select("id"))
    sure = possible_members(keyed, key, bits, absent=True).select(*(F.col(f"`{c}`") for c in df.columns))
    fates = judged.select(F.col("id").alias(key), F.col("text_key").alias(hashed), F.col("fate").alias(fate_))
    maybe = possible_members(keyed, key, bits).join(fates.hint("merge"), [key, hashed], "left")
    single = maybe.where(F.col(fate_).isNull())
    repeated = maybe.where(F.col(fate_) == "once").dropDuplicates([key, hashed])
    return sure.unionByName(single.select(*sure.columns)).unionByName(repeated.select(*sure.columns))
