"""Repair of a conversation's structure by error-correcting Earley parsing.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. The grammar of that is left-recursive, so every
item of the chart begins at the start of the conversation, and a set of the chart holds a fixed number of items however
long it is. Besides keeping a row, productions delete it (3), give it the role that is due (2) or insert an empty turn of
a user or assistant (2); blank and repeated rows must be deleted, rows that break off cost 1 more where they stay.
An item retains the least (cost, audit), where the audit has one letter for each edit (D, I, K, R); the completed
chart's is the repair. Of two audits of equal cost over the same rows none begins with the other, so the least one of a prefix
stays the least one of all that follows.

Rows are dealt out by ranges of (conversation, turn, role, text) and sorted, and a conversation that lies inside a
partition is parsed as it passes. What touches an edge of a partition or is longer than a *block* is cut into
blocks: each is parsed from every state a conversation can be in before it, these small tables are put together in
order, and the chosen edits go back to the blocks. So one very long conversation is parsed by all tasks; only its audit,
which is one string, and the digest of its text, which is sequential, pass through one task each, as a stream.

Defined cases: null role and text are one space; null turns come first; rows of equal turn are ordered by role, then
text; a null conv_id is a conversation of its own; repeated rows are repeated rows (the later ones are duplicates); an empty
table gives an empty one; a conversation without rows has zeros, an empty audit and the digest of nothing; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from memspan.llm.durable import rows_of, stored, trim_memory

RULES = (("Talk", ()), ("Talk", ("Turns",)), ("Turns", ("s", "u", "a")), ("Turns", ("u", "a")), ("Turns", ("Turns", "u", "a")))
RETOLD = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, LATE = 0, 2, 3, 2, 1
#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 1024, 4_000_000
#: Parses that a worker remembers, and their longest conversation.
REMEMBERED, SHORT = 100_000, 32
_SPACES = " \t\n\v\f\r"
_known: dict[str, tuple[int, str]] = {}

#: A state of a conversation between two rows, by what is due: everything, a user's turn (after the system's), an
#: assistant's, or nothing. Items that stand for it, the first of which are set where parsing goes on from it.
STATES = {"S": ((0, 0), (2, 0), (3, 0)), "X": ((2, 1),), "U": ((4, 2), (2, 2), (3, 1)), "A": ((4, 1), (1, 1))}
Chart = dict[tuple[int, int], tuple[int, str]]


def row_code(role: str, text: str, seen: bool) -> str:
    """``-`` for a row that must go, else its role's initial among s, u, a (o: another), a capital if it breaks off."""
    said = text.rstrip(_SPACES)
    if not said or seen:
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if said[-1] in ".!?" else initial.upper()


def _close(chart: Chart) -> Chart:
    """Completes and inserts until nothing gets cheaper."""
    waiting = list(chart)
    while waiting:
        rule, dot = item = waiting.pop()
        cost, audit = chart[item]
        head, body = RULES[rule]
        if dot == len(body):
            found = [((r, 1), cost, audit) for r, (_, b) in enumerate(RULES) if b[:1] == (head,)]
        else:
            found = [((rule, dot + 1), cost + INSERT, audit + "I")] if body[dot] in RETOLD else []
        for item, cost, audit in found:
            if item not in chart or (cost, audit) < chart[item]:
                chart[item] = cost, audit
                waiting.append(item)
    return chart


def _scan(chart: Chart, code: str) -> Chart:
    """The next set: each item's row is deleted, kept or given another role."""
    out: Chart = {}
    late = LATE if code.isupper() else 0
    for (rule, dot), (cost, audit) in chart.items():
        head, body = RULES[rule]
        due = body[dot] if dot < len(body) else None
        if due == "Turns" or due is None and head != "Talk":
            continue
        found = [((rule, dot), cost + DELETE, audit + "D")]
        if due and code != "-":
            if code.lower() == due:
                found.append(((rule, dot + 1), cost + KEEP + late, audit + "K"))
            elif due in RETOLD:
                found.append(((rule, dot + 1), cost + REROLE + late, audit + "R"))
        for item, c, a in found:
            if item not in out or (c, a) < out[item]:
                out[item] = c, a
    return out


def parse(codes: str, state: str = "S") -> dict[str, tuple[int, str]]:
    """The least (cost, audit) of every state that can be reached over these rows."""
    chart = _close({item: (0, "") for item in (STATES[state] if state in "SA" else STATES[state][:1])})
    for code in codes:
        chart = _close(_scan(chart, code))
    reached = {s: min((chart[i] for i in items if i in chart), default=None) for s, items in STATES.items()}
    return {s: found for s, found in reached.items() if found}


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of the repair of a whole conversation."""
    if codes not in _known:
        ends = parse(codes)
        found = min(ends[s] for s in "SA" if s in ends)
        if len(codes) > SHORT:
            return found
        if len(_known) >= REMEMBERED:
            _known.clear()
        _known[codes] = found
    return _known[codes]


def applied(audit: str, state: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The (role, text) that a stretch of an audit leaves of its rows, from a state on."""
    at = 0
    for letter in audit:
        role, text = (roles[at], texts[at]) if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = RETOLD["a" if state == "U" else "u"]
        state = "X" if state == "S" and role[:1] == "s" else "A" if state == "U" else "U"
        yield role, text


def joined_lines(lines: Iterator[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in lines)


def damage_rows(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text and dropped of rows damaged by the checksum of ``conv_id:turn`` modulo 20: 0 drops the
    row (it stays as a mark), 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    told = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return told.drop("_copy")


def plain_rows(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The same columns of rows as they are."""
    space = F.lit(" ")
    return rows.select(F.col(conv_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(False).alias("dropped"))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _mark(role: str, text: str) -> bytes:
    """What tells (role, text) from any other."""
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _faults(codes: str, texts: list[str]) -> tuple[int, int, int]:
    """Blank, repeated and broken-off rows."""
    blank = sum(c == "-" and not t.strip(_SPACES) for c, t in zip(codes, texts, strict=True))
    return blank, codes.count("-") - blank, sum(c.isupper() for c in codes)


class _Stretch:
    """Rows of one conversation, one after the other, as they pass."""

    def __init__(self) -> None:
        self.roles, self.texts, self.turns, self.chars = [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.chars += len(role) + len(text)

    def full(self, block_rows: int) -> bool:
        return len(self.roles) >= block_rows or self.chars >= BLOCK_CHARS

    def whole(self, turns: bool) -> dict:
        """The result of a conversation of these rows."""
        seen: set[tuple[str, str]] = set()
        codes = []
        for pair in zip(self.roles, self.texts, strict=True):
            codes.append(row_code(*pair, pair in seen))
            seen.add(pair)
        blank, duplicate, truncated = _faults(codes := "".join(codes), self.texts)
        known = [t for t in self.turns if t is not None]
        cost, audit = cheapest(codes)
        lines = list(applied(audit, "S", self.roles, self.texts))
        out = {
            "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
            "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": _illegal([r[:1] for r in self.roles]),
            "cost": cost, "audit": audit,
            "sha256": hashlib.sha256(joined_lines(lines).encode()).hexdigest(),
        }
        return out | ({"roles": [r for r, _ in lines], "texts": [t for _, t in lines]} if turns else {})

    def block(self) -> dict:
        """What the second pass needs of these rows."""
        initials = [r[:1] for r in self.roles]
        known = [t for t in self.turns if t is not None]
        return {
            "codes": "".join(row_code(r, t, False) for r, t in zip(self.roles, self.texts, strict=True)),
            "marks": [_mark(r, t) for r, t in zip(self.roles, self.texts, strict=True)],
            "illegal": _illegal(initials),
            "ends": initials[:1] + initials[-1:],
            "turns": [known[0], known[-1], len(set(known))] if known else None,
            "roles": self.roles, "texts": self.texts,
        }


def _passed(conv_type: str, turns: bool, block_rows: int):
    """Schema and function of the first pass: results of whole conversations (seq null), blocks of the others."""
    schema = f"conv_id {conv_type}, part int, seq int, {_COUNTS}, sha256 string, codes string, marks array<binary>, ends array<string>, turns array<long>, roles array<string>, texts array<string>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)
            rows.clear()

        stretch, conv, cut = None, None, True  # cut: it may have begun in the partition before, or in a block before
        for this, turn, role, text, dropped in rows_of(batches):
            same = stretch is not None and this == conv
            if stretch is not None and (not same or stretch.full(block_rows)):
                cut = cut or same
                if cut:
                    rows.append(stretch.block() | {"conv_id": conv, "part": part, "seq": seq})
                    seq += 1
                else:
                    rows.append(stretch.whole(turns) | {"conv_id": conv})
                cut = same
                size += stretch.chars
                stretch = None
                if len(rows) >= BLOCK_ROWS or size >= BLOCK_CHARS:
                    yield from out()
                    size = 0
            if stretch is None:
                stretch, conv = _Stretch(), this
            if not dropped:
                stretch.add(turn, role, text)
        if stretch is not None:
            rows.append(stretch.block() | {"conv_id": conv, "part": part, "seq": seq})
        yield from out()

    return run, schema


def _linked(one: tuple, m: str, other: tuple, k: str, relation) -> int | tuple[int, str]:
    """How two audits stand, each of an earlier stretch and a new one: -1 or 1 where they differ, or (0, rest) if the
    second is the first and rest, (2, rest) if the first is the second and rest."""
    if one != other:
        known = relation[one, other]
        if not isinstance(known, tuple):
            return known
        m, k = (m, known[1] + k) if known[0] == 0 else (known[1] + m, k)
    if k.startswith(m):
        return 0, k[len(m) :]
    if m.startswith(k):
        return 2, m[len(k) :]
    return -1 if m < k else 1


def put_together(tables: Iterator[dict[str, dict[str, tuple[int, str]]]]) -> tuple[int, list[tuple[str, str]]]:
    """The cost of a conversation and for each of its blocks the state before it and its part of the audit.

    ``tables`` has for each block, from each state, the least (cost, audit) to each state. Audits are never joined on the way:
    of two states it is only known how the audits that lead to them stand to each other."""
    costs, relation, steps = {"S": 0}, {}, []
    for table in tables:
        best: dict[str, tuple[int, str, str]] = {}
        for state, cost in costs.items():
            for to, (more, audit) in table[state].items():
                new = cost + more, state, audit
                if to in best and best[to][0] == new[0]:
                    how = _linked(state, audit, best[to][1], best[to][2], relation)
                    if how == -1 or isinstance(how, tuple) and how[0] == 0 and how[1]:
                        best[to] = new
                elif to not in best or new[0] < best[to][0]:
                    best[to] = new
        relation = {(a, b): _linked(best[a][1], best[a][2], best[b][1], best[b][2], relation) for a in best for b in best if a != b}
        costs = {to: cost for to, (cost, _, _) in best.items()}
        steps.append({to: (state, audit) for to, (_, state, audit) in best.items()})
    ends = [s for s in "SA" if s in costs]
    state = min(ends, key=costs.get)
    if len(ends) == 2 and costs["S"] == costs["A"]:
        how = relation["S", "A"]
        state = "S" if how == -1 or isinstance(how, tuple) and how[0] == 0 else "A"
    cost, out = costs[state], []
    for step in reversed(steps):
        state, audit = step[state]
        out.append((state, audit))
    return cost, out[::-1]


def _tables(conv_type: str):
    """Schema and function for each block's counts and its costs and audits by the states before and behind it."""
    schema = f"conv_id {conv_type}, part int, seq int, blank long, duplicate long, truncated long, illegal long, ends array<string>, turns array<long>, before array<string>, behind array<string>, costs array<long>, audits array<string>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, part, seq, codes, firsts, illegal, ends, turns in rows_of(batches):
            new, blank = set(firsts or ()), codes.count("-")
            codes = "".join(c if i in new else "-" for i, c in enumerate(codes))
            found = [(a, b, cost, audit) for a in STATES for b, (cost, audit) in parse(codes, a).items()]
            row = [conv, part, seq, blank, codes.count("-") - blank, sum(c.isupper() for c in codes), illegal, ends, turns, *(list(x) for x in zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return run, schema


def _fold(conv_type: str):
    """Schema and function that put a conversation's blocks together: a row for each block with its part of the
    audit, and one (part null) with the conversation's counts."""
    schema = f"conv_id {conv_type}, part int, seq int, state string, {_COUNTS}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def finished(conv, blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        def tables():
            for b in blocks:
                table = {s: {} for s in STATES}
                for state, to, cost, audit in zip(*b[8:12], strict=True):
                    table[state][to] = cost, audit
                yield table

        cost, steps = put_together(tables())
        illegal, last = sum(b[5] for b in blocks), None
        for b in blocks:
            if b[6]:
                illegal += last is not None and last + b[6][0] not in ("su", "ua", "au")
                last = b[6][-1]
        spans = [b[7] for b in blocks if b[7]]
        distinct = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        gaps = spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0
        rows = [{"conv_id": conv, "part": b[0], "seq": b[1], "state": s, "audit": a} for b, (s, a) in zip(blocks, steps, strict=True)]
        rows.append({"conv_id": conv, "gaps": gaps, "illegal": illegal, "cost": cost, "audit": "".join(a for _, a in steps)} | {n: sum(b[k] for b in blocks) for k, n in enumerate(("blank", "duplicate", "truncated"), 2)})
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, blocks = None, []
        for this, *row in rows_of(batches):
            if blocks and this != conv:
                yield from finished(conv, blocks)
                blocks = []
            conv = this
            blocks.append(tuple(row))
        if blocks:
            yield from finished(conv, blocks)

    return run, schema


def _block_lines(conv_type: str, turns: bool):
    """Schema and function that carry a block's edits out: its repaired lines, joined or as turns."""
    schema = f"conv_id {conv_type}, part int, seq int, " + ("roles array<string>, texts array<string>" if turns else "lines string")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, part, seq, state, audit, roles, texts in rows_of(batches):
            lines = list(applied(audit, state, roles, texts))
            if lines:
                row = [conv, part, seq, *(([r for r, _ in lines], [t for _, t in lines]) if turns else (joined_lines(lines),))]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return run, schema


def _digests(conv_type: str):
    """Schema and function that hash a conversation's blocks of lines one after the other."""
    schema = f"conv_id {conv_type}, sha256 string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        found: list[tuple] = []
        for this, lines in rows_of(batches):
            if digest is None or this != conv:
                if digest is not None:
                    found.append((conv, digest.hexdigest()))
                conv, digest = this, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(lines.encode())
        if digest is not None:
            found.append((conv, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return run, schema


def _first_pass(rows: DataFrame, turns: bool, block_rows: int) -> DataFrame:
    """Results of conversations inside partitions and blocks of the others, stored."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(dealt.mapInArrow(*_passed(conv_type, turns, block_rows)), "conversations")


def _edits(passed: DataFrame) -> DataFrame:
    """The blocks' edits and the counts of conversations in blocks, stored."""
    conv_type = passed.schema["conv_id"].dataType.simpleString()
    blocks = passed.where("seq IS NOT NULL")
    marks = blocks.select("conv_id", "part", "seq", F.posexplode("marks").alias("place", "mark"))
    first = marks.groupBy("conv_id", "mark").agg(F.min(F.struct("part", "seq", "place")).alias("at"))
    firsts = first.groupBy("at.part", "at.seq").agg(F.collect_list("at.place").alias("firsts"))  # at most a block's rows
    coded = blocks.select("conv_id", "part", "seq", "codes", "illegal", "ends", "turns").join(firsts, ["part", "seq"], "left")
    tables = coded.select("conv_id", "part", "seq", "codes", "firsts", "illegal", "ends", "turns").mapInArrow(*_tables(conv_type))
    return stored(tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(*_fold(conv_type)), "edits")


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of
    rows with conv_id, turn, role, text and dropped (see :func:`plain_rows`)."""
    passed = _first_pass(rows, False, block_rows)
    conv_type = passed.schema["conv_id"].dataType.simpleString()
    edits = _edits(passed)
    pieces = edits.where("part IS NOT NULL").select("part", "seq", "state", "audit")
    lines = passed.where("seq IS NOT NULL").select("conv_id", "part", "seq", "roles", "texts").join(pieces, ["part", "seq"])
    lines = lines.select("conv_id", "part", "seq", "state", "audit", "roles", "texts").mapInArrow(*_block_lines(conv_type, False))
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "lines").mapInArrow(*_digests(conv_type))
    totals = edits.where("part IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    digests = digests.withColumnRenamed("conv_id", "_conv")
    late = totals.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("_conv", "sha256")
    whole = passed.where("seq IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
    return whole.unionByName(late)


def repaired_turns(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, part, seq, place, role and text of the repaired conversations: in each, the turns in the order of
    part, seq and place."""
    passed = _first_pass(rows, True, block_rows)
    conv_type = passed.schema["conv_id"].dataType.simpleString()
    pieces = _edits(passed).where("part IS NOT NULL").select("part", "seq", "state", "audit")
    blocks = passed.where("seq IS NOT NULL").select("conv_id", "part", "seq", "roles", "texts").join(pieces, ["part", "seq"])
    blocks = blocks.select("conv_id", "part", "seq", "state", "audit", "roles", "texts").mapInArrow(*_block_lines(conv_type, True))
    whole = passed.where("seq IS NULL").select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("seq"), "roles", "texts")
    turns = whole.unionByName(blocks).select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t"))
    return turns.select("conv_id", "part", "seq", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))
