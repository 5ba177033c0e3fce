"""Source divergence against plain loops in whole numbers."""

import random
import re
from collections import Counter

import pytest

from memspan.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=3, ranks=200):
    """The audit by its definition."""
    lower = {c: c + 32 for c in range(65, 91)}
    said = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in said}:
        mine = [x for x in said if x[0] == lang]
        in_docs = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)

        def shares(parts):
            counts = Counter(t for terms in parts for t in terms if t in set(kept))
            total = sum(counts.values()) + len(kept)
            return counts, {t: 1 + 1_000_000_000 * (counts[t] + 1) // total for t in kept}

        _, q_lang = shares([x[2] for x in mine])
        groups = {s: shares([x[2] for x in mine if x[1] == s]) for s in {x[1] for x in mine}}
        for source, (counts, p) in groups.items():
            pairs = [(s, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for s, (_, q) in groups.items() if s != source]
            terms = [(t, (p[t] - q_lang[t]) ** 2 // q_lang[t]) for t in kept if counts[t] and p[t] > q_lang[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, source, part, item, value, k + 1))
    return sorted(out)


def audit(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.audit_sources(spark.createDataFrame(rows, SCHEMA), **options).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_loops(spark, seed):
    draw = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnopqrst"] + ["Été", "çA", "日本", "x", "É"]
    rows = [(i, draw.choice([" ", "-", "1", "\n"]).join(draw.choices(words[: draw.randint(1, 25)], k=draw.randint(0, 30))), draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", "s3", "hot", "hot", "hot"])) for i in range(80)]
    assert audit(spark, rows, ranks=3) == brute(rows, ranks=3)


def test_slots_and_counters_do_not_matter(spark, monkeypatch):
    rows = [(i % 7, f"alpha beta{'' if i % 3 else 'gamma'} delta-delta alpha", "en", f"s{i % 4}") for i in range(60)]
    wanted = brute(rows)
    assert audit(spark, rows, slot_bytes=100) == wanted
    assert audit(spark, rows, slot_bytes=10**9) == wanted


def test_odd_tables(spark):
    assert audit(spark, []) == []
    alone = [(1, None, None, None), (2, "", "en", "a"), (3, "12 34", "en", "b")]
    assert audit(spark, alone) == brute(alone) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    same = [(1, "one one two", "en", "a")] * 5 + [(None, "two " * 5000, "en", "b")] * 3
    assert audit(spark, same) == brute(same)
    clash = spark.createDataFrame([(r + ("x", 1, 2)) for r in same], SCHEMA + ", term string, n long, p long")
    assert sorted(tuple(r) for r in divergence.audit_sources(clash).collect()) == brute(same)


def test_terms():
    assert divergence.terms_of("Ab1cÉ_d é@[`{~\x7f".encode()) == [b"ab", "cÉ".encode(), b"d", "é".encode()]
    assert divergence.terms_of("a b c".encode()) == ["a b c".encode()]
