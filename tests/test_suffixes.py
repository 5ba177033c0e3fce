import random

from memspan.operators import suffixes


def refs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, chars string")


def naive(text):
    order = sorted(range(len(text) + 1), key=lambda i: text[i:].replace("N", "@"))
    lcp = [-1]
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        lcp.append(n)
    return order, lcp


def test_worked_view(spark):
    array = suffixes.suffix_array(refs(spark, ["GATTNACA"])).orderBy("rank").collect()
    assert [r.pos for r in array] == [8, 4, 7, 5, 1, 6, 0, 3, 2]
    assert "".join(r.bwt for r in array) == "ATCNGA$TA"
    assert [r.lcp for r in suffixes.lcp_array(refs(spark, ["GATTNACA"])).orderBy("rank").collect()] == [-1, 0, 0, 1, 1, 0, 0, 0, 1]


def test_random_and_repetitive_texts(spark):
    rng = random.Random(5)
    part = "".join(rng.choice("ACGTN") for _ in range(60))
    for texts in ([part, part, "ACGT"], ["A" * 300, "A" * 20], ["".join(rng.choice("AC") for _ in range(400))]):
        merged = "N".join(texts)
        order, lcp = naive(merged)
        found = suffixes.lcp_array(refs(spark, texts)).orderBy("rank").collect()
        assert [r.pos for r in found] == order
        assert [r.lcp for r in found] == lcp


def test_what_follows_from_the_order(spark):
    texts = ["GATTACANNACGTACA", "ACACAC"]
    merged = "N".join(texts)
    order, lcp = naive(merged)
    rank = {p: i for i, p in enumerate(order)}
    array = suffixes.suffix_array(refs(spark, texts))
    jumps = {r.rank: r.jump for r in suffixes.lf_mapping(array).where("bwt <> '$'").collect()}
    assert jumps == {rank[p]: rank[p - 1] for p in order if p}
    values = {r.rank: (r.previous_smaller, r.next_smaller) for r in suffixes.smaller_values(suffixes.lcp_array(refs(spark, texts))).collect()}
    for i, v in enumerate(lcp):
        before = max((j for j in range(i) if lcp[j] < v), default=None)
        after = min((j for j in range(i + 1, len(lcp)) if lcp[j] < v), default=None)
        assert values[i] == (before, after)
    bwt = "".join("$" if p == 0 else merged[p - 1] for p in order)
    runs = [len(x) for x in __import__("re").findall(r"((.)\2*)", bwt) for x in x[:1]]
    assert tuple(suffixes.bwt_runs(array).first())[:2] == (len(runs), max(runs))
    for r in suffixes.enclosing_intervals(suffixes.lcp_array(refs(spark, texts))).collect():
        prefix = merged[order[r.rank] :][: r.depth]
        assert (r.top, r.bottom) == (min(own := [i for i, p in enumerate(order) if merged[p:].startswith(prefix)]), max(own))
    spans = {r.prefix: (r.top, r.bottom, r.n) for r in suffixes.prefix_intervals(refs(spark, texts), 3).collect()}
    for prefix, (top, bottom, n) in spans.items():
        own = [i for i, p in enumerate(order) if merged[p : p + 3].replace("N", "@") == prefix]
        assert (top, bottom, n) == (own[0], own[-1], len(own))
    assert {(r.letter, r.n) for r in suffixes.char_counts(refs(spark, ["AAC", None, ""])).collect()} == {("A", 2), ("C", 1)}


def test_smaller_values_over_blocks(spark):
    rng = random.Random(6)
    for values, block in (([rng.randrange(4) for _ in range(300)], 7), (list(range(100)), 9), (list(range(100, 0, -1)), 9), ([3] * 50, 8), ([rng.randrange(50) for _ in range(400)], 32)):
        frame = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "rank long, pos long, lcp long").repartition(3)
        found = {r["rank"]: (r.previous_smaller, r.next_smaller) for r in suffixes.smaller_values(frame, block).collect()}
        for i, v in enumerate(values):
            before = next((j for j in range(i - 1, -1, -1) if values[j] < v), None)
            after = next((j for j in range(i + 1, len(values)) if values[j] < v), None)
            assert found[i] == (before, after)


def test_many_equal_values(spark):
    frame = spark.range(100_000).selectExpr("id AS rank", "id AS pos", "CASE WHEN id = 0 THEN -1L WHEN id = 70000 THEN 4L ELSE 5L END AS lcp")
    found = suffixes.smaller_values(frame)
    assert found.count() == 100_000
    assert {(r["rank"], r.previous_smaller, r.next_smaller) for r in found.where("rank IN (0, 1, 69999, 70000, 70001, 99999)").collect()} == {(0, None, None), (1, 0, 70000), (69999, 0, 70000), (70000, 0, None), (70001, 70000, None), (99999, 70000, None)}


def test_only_tied_suffixes_travel(spark):
    rng = random.Random(7)
    part = "".join(rng.choice("ACGT") for _ in range(400))
    texts = [part, part[:90] + "A" + part[91:200], "".join(rng.choice("ACGT") for _ in range(3000))]
    array, levels, _ = suffixes._ranked(refs(spark, texts))
    merged = "N".join(texts)
    assert [r.pos for r in array.orderBy("rank").collect()] == naive(merged)[0]
    rows = [level.count() for level in levels]
    tied = [level.where("tied").count() for level in levels]
    assert rows[0] == len(merged) + 1 and all(n <= 3 * t for n, t in zip(rows[1:], tied)) and tied[-1] == 0
    assert rows[1] < rows[0] / 4 and sorted(rows, reverse=True) == rows


def test_no_references(spark):
    assert suffixes.suffix_array(refs(spark, [])).collect() == []
    assert [r.pos for r in suffixes.suffix_array(refs(spark, [None, ""])).collect()] == [0]


def test_tree_of_intervals(spark):
    rng = random.Random(8)
    for texts in (["".join(rng.choice("AC") for _ in range(120)), "ACACAC"], ["A" * 40], ["ACGT"]):
        merged = "N".join(texts)
        order, lcp = naive(merged)
        prefixes = {}
        for i in range(1, len(order)):
            prefixes.setdefault(merged[order[i] :][: lcp[i]], None)
        spans = {}
        for prefix in prefixes:
            own = [i for i, p in enumerate(order) if merged[p:].startswith(prefix)]
            spans[prefix] = (len(prefix), own[0], own[-1])
        wanted = set()
        for prefix, span in spans.items():
            above = max((p for p in spans if p != prefix and prefix.startswith(p)), key=len, default=None)
            wanted.add((*span, *(spans[above] if above is not None else (None, None, None))))
        found = suffixes.lcp_intervals(suffixes.lcp_array(refs(spark, texts))).collect()
        assert {(r.depth, r.top, r.bottom, r.parent_depth, r.parent_top, r.parent_bottom) for r in found} == wanted and len(found) == len(wanted)


def test_backward_search(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGTN") for _ in range(700)), "ACGT" * 30, "GATTACA"]
    merged = "N".join(texts)
    order, _ = naive(merged)
    patterns = [merged[(a := rng.randrange(len(merged))) : a + rng.choice([1, 2, 5, 8, 9, 12, 30])] for _ in range(40)] + ["GATTACAGATTACA", "T" * 9, "C", "ACGT" * 4, "", None, "X", merged[:1], merged[-3:]]
    monkeypatch.setattr(suffixes, "OCC_RANKS", 64)
    monkeypatch.setattr(suffixes, "OCC_ROWS", 3)
    found = suffixes.backward_search(refs(spark, texts), spark.createDataFrame(list(enumerate(patterns)), "id long, pattern string"))
    rows = {r.id: r for r in found.collect()}
    for i, p in enumerate(patterns):
        own = [k for k, at in enumerate(order) if p and merged[at:].startswith(p)]
        assert (i in rows) == bool(p)
        if p:
            assert (rows[i].top, rows[i].bottom, rows[i].n) == ((own[0], own[-1], len(own)) if own else (None, None, 0)), p
    places = suffixes.locate_patterns(found.where("id < 5"), suffixes.suffix_array(refs(spark, texts))).collect()
    assert sorted((r.id, r.pos) for r in places) == sorted((i, a) for i in range(5) for a in range(len(merged)) if merged.startswith(patterns[i], a))


def test_intervals_of_long_prefixes(spark):
    text = "ACGTACGTTACGTACGTTGACA"
    order, _ = naive(text)
    for k in (2, 8, 9, 15):
        found = {r.prefix: (r.top, r.bottom, r.n) for r in suffixes.prefix_intervals(refs(spark, [text]), k).collect()}
        wanted = {}
        for i, p in enumerate(order):
            if p + k <= len(text):
                wanted.setdefault(text[p : p + k], []).append(i)
        assert found == {x: (v[0], v[-1], len(v)) for x, v in wanted.items()}
