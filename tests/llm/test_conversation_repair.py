"""Conversation repair against a plain table over (row, state) that carries whole audits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from metricloom.llm import conversation_repair as c
from metricloom.llm.queries import op12_conversation_repair

WHITE = " \t\n\x0b\x0c\r"
FORM = re.compile("(s?(ua)+)?")


def damaged(rows):
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)


def repair(rows):
    """Totals and repaired (role, text) of one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        kept = text.rstrip(WHITE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    # (cost, audit, roles and texts) by the initial read last
    best = {"": (0, "", [])}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                way = (cost + 2, audit + "I", [*out, (role, "")])
                best[role[0]] = min(best.get(role[0], way), way, key=lambda w: w[:2])
        return best

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, out) in inserted(dict(best)).items():
            ways = [(state, cost + 3, "D", out)]
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                    ways.append((role[0], more, "K", [*out, (role, text)]))
                other = "assistant" if state == "u" else "user"
                ways.append((other[0], more + 2, "R", [*out, (other, text)]))
            for to, total, edit, new in ways:
                way = (total, audit + edit, new)
                after[to] = min(after.get(to, way), way, key=lambda w: w[:2])
        best = after
    ends = [w for state, w in inserted(best).items() if state in ("", "a")]
    cost, audit, out = min(ends, key=lambda w: w[:2])
    assert FORM.fullmatch("".join(role[0] for role, _ in out))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), out


def want(rows, hurt):
    groups = {conv: [] for conv, *_ in rows}
    for conv, *row in hurt:
        groups[conv].append(tuple(row))
    out = []
    for conv, own in groups.items():
        totals, fixed = repair(own) if own else ((0, 0, 0, 0, 0, 0, ""), [])
        out.append((conv, *totals, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Ok. ", "and.\x0b", "two\nlines.", "é日本."]
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", "sys", "a", None])
            rows.append((conv, turn + rng.choice([0, 0, 0, 1, 3]), role, rng.choice([*texts, None, f"{rng.randint(0, 99)}.", f"{rng.randint(0, 99)}"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [0, 1, 2, 10])
def test_equals_brute_force_in_segments_of_any_size(spark, monkeypatch, segment):
    monkeypatch.setattr(c, "SEGMENT", segment)
    rows = conversations(segment, 60, 12) + conversations(5, 1, 1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, c.report(frame, frame).collect()), key=str)
    assert got == want(rows, [(conv, turn, role or ("" if role == "" else " "), text if text is not None else " ") for conv, turn, role, text in rows])


def test_query_equals_brute_force(spark, tmp_path):
    rows = conversations(9, 80, 9) + [(None, None, None, None), (None, 1, "user", None), (None, None, "user", "Hi."), (7000, None, "system", "x"), (7000, None, None, "y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == want(rows, list(damaged(rows)))


def test_odd_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert c.report(nothing, nothing).count() == 0
    rows = [(1, 1, "user", "long. " * 100_000 + "word" * 50_000), (1, 2, "assistant", "Yes."), (2, -2**63, "user", "a."), (2, 2**63 - 1, "user", "b.")]
    extra = spark.createDataFrame([(*r, "x", 1, 2, "k", 3) for r in rows], SCHEMA + ", segment string, at long, code int, content string, initial int")
    got = {r.conv_id: r for r in c.report(extra, extra).collect()}
    assert got[1].audit == "KK" and got[2].gaps == 2**63 - 1
    assert c.damage(extra).columns == ["conv_id", "turn", "role", "text"]
    # conversations that lose all their rows keep their line
    got = c.report(nothing, extra).collect()
    assert {(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in got} == {(i, 0, "", hashlib.sha256().hexdigest()) for i in (1, 2)}


def test_one_conversation_is_many_segments(spark, monkeypatch):
    """A conversation of 3000 rows is never more than a segment in one group of the path search."""
    monkeypatch.setattr(c, "SEGMENT", 6)
    rng = random.Random(3)
    rows = [(5, i, rng.choice(["user", "assistant"]), f"{i}" + rng.choice([".", ""])) for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ordered = c.in_order(frame)
    planned = c.plan(ordered)
    assert planned.count() >= 3000 / 64 and max(len(r.audit) for r in planned.collect()) <= 4 * 64
    assert [tuple(r) for r in c.report(frame, frame).collect()] == want(rows, rows)
    fixed = sorted(c.repaired(ordered, planned).collect(), key=lambda r: (r.segment, r.step))
    assert FORM.fullmatch("".join(r.role[0] for r in fixed))


def test_ranks_order_audits():
    """Ranks by doubled lengths are the order of the audits they stand for."""
    rng = np.random.default_rng(2)
    initial, fault = rng.integers(0, 4, 400), rng.choice([0, 0, 0, 1, 2, 3], 400)
    low = np.array([0, 1, 5, 30, 200])
    _, ranks, audits = c.paths(initial, fault, low, np.append(low[1:], 400))
    for ranked, names in zip(ranks.reshape(-1, 4), np.array(audits, object).reshape(-1, 4), strict=True):
        known = [(a, r) for a, r in zip(names, ranked.tolist(), strict=True) if a is not None]
        assert sorted(known) == sorted(known, key=lambda k: k[1])
