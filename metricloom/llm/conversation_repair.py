"""Conversation repair: the cheapest edits that make the roles of a conversation an optional system
turn and then pairs of user and assistant, by a cost table and prefix-doubling path ranking.

A row is kept (0), given the other role (2) or deleted (3, and blank or repeated rows must be); an
empty turn is inserted anywhere for 2; a truncated row that stays costs 1. An audit is the initials
of the edits in order; of the cheapest, the least in ASCII order is taken. The roles read so far
are one of four states: none, system, user, assistant. From a state each edit leads to one state.

Rows are put in order by one range sort over (conv_id, turn, role, text), which spreads a very long
conversation over many tasks, and cut into segments of at most 2^SEGMENT rows. A segment is worked
on by itself, for each of the four states after it:

1. a cost table backwards over its rows, all segments of a batch at once, gives each node (row,
   state before it, state after the segment) its least cost, and its optimal arcs, one per edit;
2. prefix doubling ranks the nodes by their least audits: at first by one edit, then 2, 4, 8 and so
   on edits; the rank by 2k edits is that of the pair (rank by k, rank by k of the node that these
   k edits lead to), and the pointers over k edits are doubled to 2k. It ends when every pointer
   has left the segment;
3. the edit at step t of a path is that of the node which the pointers of the bits of t lead to, so
   all steps of all paths are read off at once.

A segment is then a table of 4 by 4 costs and ranks. A conversation's tables, one small row a
segment, are chained backwards by (cost, rank): audits of one segment never begin each other, so
the first segment in which two differ decides. The chosen path gives each segment its audit, and
the rows of a segment meet their audit to give the repaired rows. Only the digest of a whole
conversation is taken in one task, which reads its rows as a stream.

Defined results: a null role or text is one space; null turns come first and have no gap; rows of
one turn are in the order of role, then text; a conversation with a null id is one as any other;
repeated rows are duplicates; roles count by their first character, an empty or unknown role can
only be deleted or changed; very long texts are never loaded but one batch at a time; other columns
are ignored; no rows, no conversations. Gaps beyond a 64-bit integer are its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common

#: Logarithm of the rows of a segment.
SEGMENT = 10
NONE, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: The state after an inserted or changed row, by the state before it.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row, by its initial and the state before it; -1 where it may not stand.
_KEPT = np.array([[-1, -1, -1, -1], [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1]])
_LETTERS = np.frombuffer(b"DIKR", np.uint8)
#: Cost and audit that end a conversation, by its state after the last row.
_FINAL = [(0, ""), (4, "II"), (2, "I"), (0, "")]
_FAR = 1 << 40
_ROLES = {USER: "user", ASSISTANT: "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the checksum of `conv_id:turn`: see the conversation contract."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("again")).drop("again")


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at, segment, written: `at` numbers the rows in the order of conversations and turns."""
    rows = rows.select("conv_id", F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # the last key spreads rows that are equal in all others, whose order is no matter
    rows = rows.withColumn("_spread", F.monotonically_increasing_id()).orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text", "_spread")
    rows = rows.drop("_spread").withColumn("at", F.monotonically_increasing_id())
    return common.settle(rows.withColumn("segment", F.shiftright("at", SEGMENT)))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, segment, at, turn, initial (0 for others), fault (1 blank, 2 duplicate, 3 truncated, else 0) of rows in order."""
    ended = F.expr(r"trim(trailing ' \t\n\u000b\u000c\r' from text)")
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    first = F.substring("role", 1, 1)
    initial = F.coalesce(*(F.when(first == letter, state) for letter, state in _INITIALS.items()), F.lit(0))
    light = rows.select("conv_id", "segment", "at", "turn", initial.alias("initial"), content.alias("content"),
                        (ended == "").alias("blank"), F.right(ended, F.lit(1)).isin(".", "!", "?").alias("whole"))
    again = light.groupBy("conv_id", "content").agg(F.min("at").alias("first_at"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("content").alias("_content"), "first_at")
    light = light.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("content") == F.col("_content")), "left")
    fault = F.when(F.col("blank"), _BLANK).when(F.col("at") > F.col("first_at"), _DUPLICATE).when(~F.col("whole"), _TRUNCATED).otherwise(0)
    return light.select("conv_id", "segment", "at", "turn", "initial", fault.alias("fault"))


def cost_table(initial: np.ndarray, fault: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least cost from each node (row, state after the segment, state before the row) to the segment's end."""
    out = np.full((len(initial), 4, 4), _FAR, np.int64)
    longest = np.argsort(low - high, kind="stable")
    size = (high - low)[longest]
    after = np.full((len(low), 4, 4), _FAR, np.int64)
    after[:, np.arange(4), np.arange(4)] = 0
    for step in range(size[0] if len(size) else 0):
        active = np.searchsorted(-size, -step, "left")  # segments of more than `step` rows come first
        row = high[longest[:active]] - 1 - step
        before = _consume(after[:active], initial[row], fault[row]).min(axis=0)
        user, assistant = np.minimum(before[..., USER], 2 + before[..., ASSISTANT]), np.minimum(before[..., ASSISTANT], 2 + before[..., USER])
        for state in (NONE, SYSTEM):
            before[..., state] = np.minimum(before[..., state], 2 + user)
        before[..., USER], before[..., ASSISTANT] = user, assistant
        out[row] = after[:active] = before
    return out


def _consume(after: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Costs of deleting, keeping and changing a row, each by (segment, state after it, state before the row)."""
    stays = np.where((fault == _BLANK) | (fault == _DUPLICATE), _FAR, fault == _TRUNCATED).astype(np.int64)
    target = _KEPT[initial]
    kept = np.take_along_axis(after, np.repeat(np.maximum(target, 0)[:, None, :], 4, axis=1), axis=2) + stays[:, None, None]
    kept = np.where((target < 0)[:, None, :], _FAR, kept)
    changed = after[:, :, _NEXT] + 2 + stays[:, None, None]
    return np.minimum(np.stack([after + 3, kept, changed]), _FAR)


def paths(initial: np.ndarray, fault: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Costs and ranks by (segment, state before, state after), and the least audits in the same order; None where there is no way."""
    rows = len(initial)
    cost = cost_table(initial, fault, low, high)
    after = np.full((rows, 4, 4), _FAR, np.int64)
    after[:-1] = cost[1:]
    after[high - 1] = _FAR
    after[(high - 1)[:, None], np.arange(4), np.arange(4)] = 0
    deleted, kept, changed = _consume(after, initial, fault)
    inserted = np.minimum(cost[:, :, _NEXT] + 2, _FAR)
    # optimal arcs: the least edit first; each leads to one node, so equal edits never part
    edit = np.select([deleted == cost, inserted == cost, kept == cost, changed == cost], [0, 1, 2, 3], 3)
    state = np.broadcast_to(np.arange(4), edit.shape)
    to = np.select([edit == 0, edit == 2], [state, np.broadcast_to(_KEPT[initial][:, None, :], edit.shape)], _NEXT[state])
    row = np.arange(rows)[:, None, None] + (edit != 1)
    leaves = (edit != 1) & np.isin(np.arange(rows), high - 1)[:, None, None]
    end = rows * 16
    pointer = np.append(np.where(leaves | (cost >= _FAR), end, (row * 4 + np.arange(4)[:, None]) * 4 + to).ravel(), end)
    letter = np.append(edit.ravel(), 0)
    rank = np.append(np.where(cost >= _FAR, 5, edit + 1).ravel(), 0)
    steps = np.append(np.ones(end, np.int64), 0)
    pointers = [pointer]
    while (pointer != end).any():
        _, rank = np.unique(rank * (end + 2) + rank[pointer], return_inverse=True)
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
    start = (low[:, None, None] * 4 + np.arange(4)[None, None, :]) * 4 + np.arange(4)[None, :, None]
    costs = cost.ravel()[start]
    nodes = start.ravel()[costs.ravel() < _FAR]
    lengths = steps[nodes]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    node = np.repeat(nodes, lengths)
    for bit, jump in enumerate(pointers):
        node = np.where(place >> bit & 1, jump[node], node)
    text = _LETTERS[letter[node]].tobytes().decode()
    found = iter([text[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return costs, rank[start], [next(found) if c < _FAR else None for c in costs.ravel().tolist()]


_SUMMARY = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("turns", pa.int64()), ("least_turn", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.int64()), ("last_initial", pa.int64()),
    ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _summed(table: pa.Table, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """One row per segment of whole segments laid end to end."""
    initial, fault = (table.column(c).to_numpy().astype(np.int64) for c in ("initial", "fault"))
    turn = table.column("turn").combine_chunks()
    known, turns = ~np.array(turn.is_null()), turn.fill_null(0).to_numpy()
    inner = np.ones(len(initial), bool)
    inner[low] = False
    legal = np.zeros((4, 4), bool)
    legal[tuple(zip(*_LEGAL, strict=True))] = True
    before, before_known, before_turn = np.roll(initial, 1), np.roll(known, 1), np.roll(turns, 1)
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), low)
    costs, ranks, audits = paths(initial, fault, low, high)
    each = np.arange(0, 16 * len(low) + 1, 16, dtype=np.int32)
    # nulls come first: the first turn that is known stands after them
    known_at = low + total(~known)
    some = known_at < high
    take = lambda at, mask: pa.array(np.where(mask, turns[np.minimum(at, len(turns) - 1)], 0), mask=~mask)
    columns = [table.column("conv_id").combine_chunks().take(pa.array(low)), table.column("segment").combine_chunks().take(pa.array(low)),
               *(pa.array(total(fault == f)) for f in (_BLANK, _DUPLICATE, _TRUNCATED)), pa.array(total(inner & ~legal[before, initial])),
               pa.array(total(known & ~(inner & before_known & (before_turn == turns)))), take(known_at, some), take(low, known[low]), take(high - 1, known[high - 1]),
               pa.array(initial[low]), pa.array(initial[high - 1]),
               pa.ListArray.from_arrays(each, pa.array(costs.ravel())), pa.ListArray.from_arrays(each, pa.array(ranks.ravel())), pa.ListArray.from_arrays(each, pa.array(audits, pa.string()))]
    return pa.RecordBatch.from_arrays(columns, schema=_SUMMARY)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of rows sorted by segment; a segment that a batch cuts waits for the next one."""
    rest: list[pa.RecordBatch] = []

    def runs(table: pa.Table) -> np.ndarray:
        conv, segment = (table.column(c).combine_chunks() for c in ("conv_id", "segment"))
        none, key, part = np.array(conv.is_null()), conv.fill_null(0).to_numpy(), segment.to_numpy()
        return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (none[1:] != none[:-1]) | (part[1:] != part[:-1])]))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        low = runs(table)
        if len(low) > 1:
            yield _summed(table.slice(0, int(low[-1])), low[:-1], low[1:])
        rest = table.slice(int(low[-1])).combine_chunks().to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield _summed(table, np.array([0]), np.array([table.num_rows]))


_CHOICE = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("tail", pa.string()),
                     *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])


def _chained(parts: list[dict]) -> Iterator[tuple]:
    """The way through the segments of one conversation; its last segment carries the totals."""
    ahead, ways = [cost for cost, _ in _FINAL], []
    for part in reversed(parts):
        found = [min((part["costs"][4 * e + f] + ahead[f], part["ranks"][4 * e + f], f) for f in range(4)) for e in range(4)]
        ahead = [cost for cost, _, _ in found]
        ways.append([f for _, _, f in found])
    state, turns, illegal = NONE, 0, 0
    for place, (part, way) in enumerate(zip(parts, reversed(ways), strict=True)):
        turns += part["turns"]
        illegal += part["illegal"]
        if place:
            last = parts[place - 1]
            turns -= part["first_turn"] is not None and part["first_turn"] == last["last_turn"]
            illegal += (last["last_initial"], part["first_initial"]) not in _LEGAL
        entry, state = state, way[state]
        if part is not parts[-1]:
            yield (part["conv_id"], part["segment"], entry, state, "", *[None] * 6)
            continue
        least = next((p["least_turn"] for p in parts if p["least_turn"] is not None), None)
        gaps = 0 if least is None else min(part["last_turn"] - least + 1 - turns, 2**63 - 1)
        yield (part["conv_id"], part["segment"], entry, state, _FINAL[state][1], gaps,
               *(sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated")), illegal, ahead[NONE])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways of conversations whose segments come in order."""
    parts: list[dict] = []
    for batch in batches:
        out = []
        for part in batch.to_pylist():
            if parts and part["conv_id"] != parts[0]["conv_id"]:
                out.extend(_chained(parts))
                parts = []
            parts.append(part)
        yield common.batch_of(out, _CHOICE)
    if parts:
        yield common.batch_of(list(_chained(parts)), _CHOICE)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def plan(rows: DataFrame) -> DataFrame:
    """Of rows in order, each segment's audit and entry state, written; the last of a conversation has its totals, null elsewhere."""
    light = faults(rows).withColumn("conv_id", F.col("conv_id").cast("long"))
    parts = common.settle(light.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at").mapInArrow(_segments, _ddl(_SUMMARY)))
    chosen = parts.drop("audits").repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_chain, _ddl(_CHOICE))
    audits = parts.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "audits")
    joined = chosen.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment")))
    audit = F.concat(F.expr("audits[int(entry * 4 + exit)]"), "tail").alias("audit")
    return common.settle(joined.select("conv_id", "segment", "entry", audit, *_CHOICE.names[5:]))


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of segments, each after its audit, become repaired rows."""
    audit, step, state, key = "", 0, NONE, (None, None)

    def inserts(out: list[tuple]) -> None:
        nonlocal step, state
        while step < len(audit) and audit[step] == "I":
            state = int(_NEXT[state])
            out.append((*key, step, "I", _ROLES[state], ""))
            step += 1

    for batch in batches:
        out: list[tuple] = []
        for conv, segment, _, role, text, mine, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if mine is not None:
                inserts(out)
                audit, step, state, key = mine, 0, entry, (conv, segment)
                continue
            inserts(out)
            edit = audit[step]
            if edit == "K":
                state = int(_KEPT[_INITIALS[role[:1]], state])
            elif edit == "R":
                state = int(_NEXT[state])
                role = _ROLES[state]
            if edit != "D":
                out.append((*key, step, edit, role, text))
            step += 1
        if out:
            yield common.batch_of(out, _REPAIRED)
    out = []
    inserts(out)
    yield common.batch_of(out, _REPAIRED)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, segment, step, edit (K, R or I), role, text: the rows of repaired conversations in the order of segment and step."""
    edits = planned.select("conv_id", "segment", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "entry")
    both = rows.select(F.col("conv_id").cast("long"), "segment", "at", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("entry")).unionByName(edits)
    return both.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at").mapInArrow(_apply, _ddl(_REPAIRED))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per conversation over its rows, read as a stream."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, digest = None, None
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield common.batch_of(out, schema)
    if digest is not None:
        yield common.batch_of([(now, digest.hexdigest())], schema)


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id in `ids`."""
    ordered = in_order(rows)
    planned = plan(ordered)
    fixed = repaired(ordered, planned).select("conv_id", "segment", "step", "role", "text")
    digests = fixed.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "step").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda s: s.audit), "")
    totals = planned.groupBy("conv_id").agg(*(F.max(n).alias(n) for n in numbers), whole.alias("audit"))
    out = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    for found in (totals, digests):
        out = out.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
