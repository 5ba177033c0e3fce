"""Repair of conversations against a recursion over what is left of them."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from memspan.llm import repair

SPACES = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(codes):
    """The least (cost, audit), from the end backwards: every edit of the first row left, or an inserted turn."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(codes) and state in "SA" else []
        due = {"S": "su", "X": "u", "U": "a", "A": "u"}[state]
        after = {"s": "X", "u": "U", "a": "A"}

        def add(cost, letter, tail):
            if tail:
                found.append((cost + tail[0], letter + tail[1]))

        if inserted < 3:
            for d in due.replace("s", ""):
                add(2, "I", best(i, after[d], inserted + 1))
        if i < len(codes):
            c, late = codes[i].lower(), codes[i].isupper()
            add(3, "D", best(i + 1, state, 0))
            if c != "-":
                for d in due:
                    if c == d:
                        add(late, "K", best(i + 1, after[d], 0))
                    elif d != "s":
                        add(2 + late, "R", best(i + 1, after[d], 0))
        return min(found, default=None)

    return best(0, "S", 0)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def whole(rows, audit_of=brute):
    """The query's rows by their definition."""
    after = damaged(rows)
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, codes, counts = set(), "", [0, 0, 0]
        for _, _, role, text in mine:
            said = text.strip(SPACES)
            kind = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                counts[kind] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "-" if kind < 2 else initial.upper() if kind == 2 else initial
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = audit_of(codes)
        lines, k, state = [], 0, "S"
        for letter in audit:
            role, text = (mine[k][2], mine[k][3]) if letter != "I" else (None, "")
            k += letter != "I"
            if letter == "D":
                continue
            due = "a" if state == "U" else "u"
            if letter in "IR":
                role = {"u": "user", "a": "assistant"}[due]
            state = {"s": "X", "u": "U", "a": "A"}[role[:1]]
            lines.append(f"{role}:{text}")
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def repaired(spark, rows, **options):
    return sorted((tuple(r) for r in repair.repair_conversations(repair.damage_rows(spark.createDataFrame(rows, SCHEMA)), **options).collect()), key=repr)


def test_parsing_against_the_recursion():
    draw = random.Random(1)
    for _ in range(1500):
        codes = "".join(draw.choices("suaoSUAO-", k=draw.randint(0, 9)))
        assert repair.cheapest(codes) == brute(codes), codes
    for codes in ("", "s", "ss", "ua" * 40, "o" * 30, "-" * 9, "au" * 20, "SUA" * 9):
        assert repair.cheapest(codes) == brute(codes), codes


def test_blocks_put_together():
    draw = random.Random(2)
    for letters in ("suaoSUAO-", "ua", "o", "uo", "-uA"):
        for _ in range(300):
            codes = "".join(draw.choices(letters, k=draw.randint(0, 14)))
            size = draw.randint(1, 5)
            parts = [codes[i : i + size] for i in range(0, len(codes), size)] or [""]
            tables = [{a: repair.parse(p, a) for a in repair.STATES} for p in parts]
            cost, steps = repair.put_together(iter(tables))
            assert (cost, "".join(a for _, a in steps)) == brute(codes), (codes, size)


def talk(draw, conv, n):
    texts = ["Yes.", "No", " ", "", "Why?", "Go on!\n", "so it is."]
    return [(conv, draw.choice([k, k, k, None, k + 3]), draw.choice(["user", "assistant", "system", "tool", None, "", "a"]) if draw.random() < 0.3 else ("user", "assistant")[k % 2], draw.choice(texts) + (str(draw.randint(0, 9)) + "." if draw.random() < 0.6 else "")) for k in range(n)]


@pytest.mark.parametrize("block_rows", [3, repair.BLOCK_ROWS])
def test_frames(spark, block_rows):
    draw = random.Random(4)
    rows = [r for conv in [*range(60), None, -5] for r in talk(draw, conv, draw.randint(1, 9))]
    rows += [(1000, k, ("user", "assistant", "tool")[k % 3], f"text {k % 50}.") for k in range(200)]
    draw.shuffle(rows)
    assert repaired(spark, rows, block_rows=block_rows) == whole(rows)


def test_one_long_conversation_is_split(spark):
    rows = [(7, k // 2, ("user", "assistant")[k % 2 if k != 1501 else 0], f"turn {k}.") for k in range(3000)] + [(7, None, "user", "same.")] * 400
    found = repaired(spark, rows, block_rows=64)
    assert found == repaired(spark, rows) == whole(rows, repair.cheapest)


def test_odd_tables(spark):
    assert repaired(spark, []) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    rows = [(3, gone, "user", "x."), (4, None, None, None), (None, None, "system", "s.")]
    assert repaired(spark, rows) == whole(rows)
    clash = spark.createDataFrame([(r + ("x", 1, True)) for r in rows], SCHEMA + ", codes string, part int, dropped boolean")
    assert sorted((tuple(r) for r in repair.repair_conversations(repair.damage_rows(clash)).collect()), key=repr) == whole(rows)


def test_turns(spark):
    draw = random.Random(9)
    rows = spark.createDataFrame([r for conv in range(12) for r in talk(draw, conv, 6)], SCHEMA)
    told = repair.plain_rows(rows)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repair_conversations(told).collect()}
    for size in (2, 100):
        turns = sorted(repair.repaired_turns(told, size).collect(), key=lambda r: (r.conv_id, r.part, r.seq, r.place))
        for conv, digest in digests.items():
            lines = [(r.role, r.text) for r in turns if r.conv_id == conv]
            assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == digest
            initials = "".join(a[0] for a, _ in lines).removeprefix("s" if lines else "")
            assert initials == "ua" * (len(initials) // 2)
