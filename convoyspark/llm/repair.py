"""Repair of conversation structure: the cheapest edits that bring roles into the order system?, (user, assistant)+.

Every set of edits has one integer as its weight. The high digits are its cost; below them lie ``width`` octal digits, one per edit in
order (D = 1, I = 2, K = 3, R = 4, as their letters sort), padded with zeros at the end. Less weight is less cost, then the
lesser audit, so an ordinary minimum over a DAG (rows times the four states of the role grammar, from the last row to the first)
decides everything: putting an edit in front moves the digits behind it one place down and adds the edit's own weight.

A conversation may hold any share of all rows, so it is never gathered: rows are ordered by a range sort, blocks of consecutive rows are
solved for every pair of states before and behind, and these small tables are composed (the same minimum, with concatenated digits),
at most ``FAN`` at a time. Only the finished audit, a letter per edit, is one value of its conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import stored

BLOCK_BITS = 9  # up to 512 rows are solved together
FAN_BITS = 8
FAN = 1 << FAN_BITS
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
_DIGITS = str.maketrans("DIKR", "1234")
_LETTERS = str.maketrans("1234", "DIKR")
# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_SPACES = " \t\n\x0b\x0c\r"
_WAYS = "array<struct<before:int,behind:int,cost:bigint,audit:string>>"
_WAY = pa.struct([("before", pa.int32()), ("behind", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _kept(state: int, initial: str) -> int | None:
    """State after a row that is kept."""
    if initial == "s":
        return SYSTEM if state == START else None
    return _NEXT[state] if initial and initial == _ROLE[_NEXT[state]][0] else None


def _edges(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[str, int, int]]]:
    """By state before a row: (letters, cost, state behind) of its edit, with up to two insertions in front; a third would be a detour."""
    out = []
    for before in range(4):
        found, state = [], before
        for inserted in range(3):
            letters, paid = "I" * inserted, inserted * COST["I"]
            found.append((letters + "D", paid + COST["D"], state))
            if not must_go:
                paid += TRUNCATED_COST * truncated
                found.append((letters + "R", paid + COST["R"], _NEXT[state]))
                if (behind := _kept(state, initial)) is not None:
                    found.append((letters + "K", paid + COST["K"], behind))
            state = _NEXT[state]
        out.append(found)
    return out


_TABLE = {(i, m, t): _edges(i, m, t) for i in ("s", "u", "a", "") for m in (False, True) for t in (False, True)}


def weight(cost: int, audit: str, width: int) -> int:
    return cost << 3 * width | int(audit.translate(_DIGITS).ljust(width, "0") or "0", 8)


def told(value: int, width: int) -> tuple[int, str]:
    digits = format(value & (1 << 3 * width) - 1, "o").zfill(width) if width else ""
    return value >> 3 * width, digits.rstrip("0").translate(_LETTERS)


def solve(rows: list[tuple[str, bool, bool]]) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest cost and its least audit by (state before, state behind) of consecutive rows (initial of the role, must go, truncated)."""
    width = 3 * len(rows)
    low = (1 << 3 * width) - 1
    keys = [(r[0] if r[0] in ("s", "u", "a") else "", r[1], r[2]) for r in rows]
    steps = {k: [[(len(s), weight(c, s, width), y) for s, c, y in x] for x in _TABLE[k]] for k in set(keys)}
    out = {}
    for behind in range(4):
        best: list[int | None] = [0 if s == behind else None for s in range(4)]
        for key in reversed(keys):
            moved = [None if v is None else [(v & ~low) + ((v & low) >> 3 * n) for n in range(4)] for v in best]
            best = [min((w + moved[y][n] for n, w, y in edges if moved[y] is not None), default=None) for edges in steps[key]]
        out.update({(before, behind): told(v, width) for before, v in enumerate(best) if v is not None})
    return out


def joined(left: dict, right: dict) -> dict[tuple[int, int], tuple[int, str]]:
    """Ways through two neighbouring stretches of rows."""
    width = max((len(a) for _, a in left.values()), default=0) + max((len(a) for _, a in right.values()), default=0)
    best: dict[tuple[int, int], int] = {}
    for (before, middle), (c1, a1) in left.items():
        for (start, behind), (c2, a2) in right.items():
            if start == middle:
                w = weight(c1 + c2, a1 + a2, width)
                best[before, behind] = min(w, best.get((before, behind), w))
    return {k: told(v, width) for k, v in best.items()}


def composed(ways: list[dict]) -> dict:
    """Ways through any number of stretches, joined in pairs, so that a letter is moved once per level."""
    while len(ways) > 1:
        ways = [joined(*ways[i:i + 2]) if i + 1 < len(ways) else ways[i] for i in range(0, len(ways), 2)]
    return ways[0]


def finished(ways: dict) -> tuple[int, str]:
    """Cost and audit of a whole conversation: nothing is left, or insertions behind the last row make it end with an assistant."""
    width = max((len(a) for _, a in ways.values()), default=0) + 2
    ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
    return told(min(weight(c + COST["I"] * len(ends[y]), a + ends[y], width) for (x, y), (c, a) in ways.items() if x == START), width)


def _located(rows: DataFrame) -> DataFrame:
    """Rows in order: ``pos`` grows with conversation, turn (nulls first), role and text. Equal rows may part between tasks."""
    text = F.coalesce("text", F.lit(" "))
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    own = own.withColumns({"_head": F.left("text", F.lit(64)), "_rest": F.xxhash64("text"), "_salt": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_head", "_rest", "_salt"]
    placed = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    return stored(placed.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _marked(rows: DataFrame) -> DataFrame:
    """The first fault of each row; of equal (role, text) in a conversation all but the first row are duplicates."""
    firsts = rows.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    short = rows.select("conv_id", "turn", "pos", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"),
                        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    duplicate = F.col("_first").isNull() & ~F.col("blank")
    return short.join(firsts, "pos", "left").select(
        "conv_id", "turn", "pos", "initial", "blank", duplicate.alias("duplicate"), (F.col("_cut") & ~F.col("blank") & ~duplicate).alias("truncated"))


def _illegal(initials: Iterable[str]) -> int:
    given = list(initials)
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(given, given[1:]))


_PART = f"conv_id bigint, block bigint, first string, last string, illegal bigint, ways {_WAYS}"
_PART_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                         ("illegal", pa.int64()), ("ways", pa.list_(_WAY))])


def _part(conv_id, block: int, first: str, last: str, illegal: int, ways: dict) -> dict:
    told_ways = [{"before": x, "behind": y, "cost": c, "audit": a} for (x, y), (c, a) in sorted(ways.items())]
    return {"conv_id": conv_id, "block": block, "first": first, "last": last, "illegal": illegal, "ways": told_ways}


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, known = [], {}
        for r in batch.to_pylist():
            rows = tuple((t["initial"], t["must_go"], t["truncated"]) for t in r["turns"])
            if rows not in known:  # short conversations often have the same roles and faults
                known[rows] = solve(list(rows))
            initials = [t[0] for t in rows]
            out.append(_part(r["conv_id"], r["block"], initials[0], initials[-1], _illegal(initials), known[rows]))
        yield pa.RecordBatch.from_pylist(out, _PART_ARROW)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = r["parts"]
            edges = [(a["last"], b["first"]) for a, b in zip(parts, parts[1:])]
            ways = composed([{(w["before"], w["behind"]): (w["cost"], w["audit"]) for w in p["ways"]} for p in parts])
            illegal = sum(p["illegal"] for p in parts) + sum(_illegal(e) for e in edges)
            out.append(_part(r["conv_id"], r["block"], parts[0]["first"], parts[-1]["last"], illegal, ways))
        yield pa.RecordBatch.from_pylist(out, _PART_ARROW)


def _gathered(parts: DataFrame, bits: int) -> DataFrame:
    inner = F.struct("block", "first", "last", "illegal", "ways")
    return parts.groupBy("conv_id", F.shiftright("block", bits).alias("_into")).agg(F.array_sort(F.collect_list(inner)).alias("parts")).select(
        "conv_id", F.col("_into").alias("block"), "parts").mapInArrow(_composed, _PART)


def _planned(marked: DataFrame) -> DataFrame:
    """One row per conversation: ``illegal``, ``cost`` and ``audit``."""
    turn = F.struct("pos", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")
    blocks = marked.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = stored(blocks.mapInArrow(_solved, _PART), "solved-blocks")
    while (parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > FAN:
        parts = stored(_gathered(parts, FAN_BITS), "composed-blocks")

    def ended(batches):
        kind = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = finished({(w["before"], w["behind"]): (w["cost"], w["audit"]) for w in r["ways"]})
                out.append({"conv_id": r["conv_id"], "illegal": r["illegal"], "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, kind)

    return _gathered(parts, 63).mapInArrow(ended, "conv_id bigint, illegal bigint, cost bigint, audit string")


class Repair:
    """Faults and cheapest repair of conversations (``conv_id``, ``turn``, ``role``, ``text``; other columns are left out).

    Rows go by turn, nulls first, then role and text; null roles and texts read as one space, and null ids are a conversation. The first fault
    of a row counts: blank, duplicate (role and text seen earlier in the conversation) or truncated (no ``.``, ``!`` or ``?`` at the end).
    Blank and duplicate rows have to go; a truncated row that stays costs one. The initial of a role is its first character; rows with another
    than s, u and a, or without one, cannot be kept as they are. A table without rows has no conversations.
    """

    def __init__(self, rows: DataFrame):
        self.rows = _located(rows)
        self._marked = _marked(self.rows)
        self.planned = stored(_planned(self._marked), "repairs")

    def summary(self) -> DataFrame:
        """``gaps`` in the turns, number of rows with each fault, ``illegal`` neighbours, ``cost`` and ``audit``: a row per conversation."""
        number = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
        faults = self._marked.groupBy("conv_id").agg(gaps, number("blank"), number("duplicate"), number("truncated"))
        plan = self.planned.withColumnRenamed("conv_id", "_conv")
        return faults.join(plan, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def _in_order(self) -> DataFrame:
        """Rows behind their conversation's audit, sorted by conversation: read as a stream, never gathered."""
        none = F.lit(None).cast("string")
        heads = self.planned.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), none.alias("role"), none.alias("text"), "audit")
        turns = self.rows.select("conv_id", "pos", "role", "text", none.alias("audit"))
        return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def repaired(self) -> DataFrame:
        """The repaired conversations: ``conv_id``, ``place`` (from 0), ``role``, ``text`` and the ``edit`` that a row comes from."""
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

        def apply(batches):
            for found in _batched((x for x in _walk(batches) if x[1] is not None), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        return self._in_order().mapInArrow(apply, "conv_id bigint, place bigint, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """SHA-256 of each repaired conversation's ``role:text``, joined by newlines; its rows pass through one after the other."""
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

        def digest(batches):
            state = None
            for conv_id, place, role, text, _ in _walk(batches):
                if place is None:
                    if state is not None:
                        yield state[0], state[1].hexdigest()
                    state = conv_id, hashlib.sha256()
                else:
                    state[1].update(("\n" * (place > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if state is not None:
                yield state[0], state[1].hexdigest()

        def apply(batches):
            for found in _batched(digest(batches), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        return self._in_order().mapInArrow(apply, "conv_id bigint, repaired_sha256 string")


def _batched(items: Iterable, size: int) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, place, role, text, edit) of what is left and put in; a row without a place begins each conversation."""
    conv_id, audit, at, place, state = None, "", 0, 0, START

    def inserted():
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = _NEXT[state]
            yield conv_id, place, _ROLE[state], "", "I"
            at, place = at + 1, place + 1

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for r in batch.slice(i, 256).to_pylist():
                if r["pos"] < 0:
                    yield from inserted()
                    conv_id, audit, at, place, state = r["conv_id"], r["audit"], 0, 0, START
                    yield conv_id, None, None, None, None
                    continue
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = _kept(state, r["role"][:1]) if edit == "K" else _NEXT[state]
                    yield conv_id, place, r["role"] if edit == "K" else _ROLE[state], r["text"], edit
                    place += 1
    yield from inserted()
