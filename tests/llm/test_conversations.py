"""Conversation repair against all edits of short conversations, and across segments and parts."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import conversations as C

BLANK = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of rows (turn, role, text) by trying every edit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANK)[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    best = None

    def fits(initials):
        body = initials[1:] if initials[:1] == "s" else initials
        return initials == "" or (len(body) > 0 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))

    def could(initials):
        body = initials[1:] if initials[:1] == "s" else initials
        return body == ("ua" * len(body))[: len(body)]

    def go(i, cost, audit, lines):
        nonlocal best
        if not could("".join(x[0][:1] or "-" for x in lines)) or (best and cost > best[0]):
            return
        if i == len(rows):
            if fits("".join(x[0][:1] or "-" for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
        else:
            _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", lines)
            if faults[i] not in ("blank", "duplicate"):
                stays = 5 * (faults[i] == "truncated")
                go(i + 1, cost + stays, audit + "K", [*lines, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + stays, audit + "R", [*lines, (new, text)])
        if audit[-2:] != "II":  # two in a row put in a whole pair for nothing, three never help
            for new in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*lines, (new, "")])

    go(0, 0, "", [])
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    said = "\n".join(f"{r}:{t}" for r, t in best[2])
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(said.encode()).hexdigest())


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def made(seed, many, most=5):
    draw = random.Random(seed)
    rows = []
    for conv in range(many):
        for turn in range(draw.randint(1, most)):
            text = draw.choice(["a.", "b?", "cut", "", " \t", "Ünï!", "b? "])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), draw.choice(["user", "assistant", "system", "tool", ""]), text))
    return rows


@pytest.mark.parametrize("segment, part", [(4096, 50_000), (2, 7)])
def test_repair_equals_all_edits(spark, monkeypatch, segment, part):
    monkeypatch.setattr(C, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(C, "PART_ROWS", part)
    rows = made(5, 120)
    got = found(C.repair_conversations(spark.createDataFrame(rows, ROWS)))
    assert got == {c: brute([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_repaired_turns_are_what_is_hashed(spark):
    rows = made(6, 40)
    df = spark.createDataFrame(rows, ROWS)
    said = {}
    for r in C.repaired_turns(df).orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, row in found(C.repair_conversations(df)).items():
        assert row[-1] == hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest()


def test_hot_conversation_in_segments(spark, monkeypatch):
    rows = [(7, t, ("user", "assistant")[t % 2], f"t{t % 900}." if t % 11 else "no end") for t in range(3000)] + made(8, 30)
    df = spark.createDataFrame([(r[0] + 100 * (r[0] != 7), *r[1:]) for r in rows], ROWS)
    whole = found(C.repair_conversations(df))
    monkeypatch.setattr(C, "SEGMENT_ROWS", 64)
    monkeypatch.setattr(C, "PART_ROWS", 500)
    assert found(C.repair_conversations(df)) == whole


def test_damage_and_nulls(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Who? Me!"), ("assistant", None), (None, "You."), ("user", "Oh.")])] + [(None, None, "user", "Odd.")]
    left = {}
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, "user" if lot == 4 else " " if role is None else role
        text = "" if lot == 1 else text.translate(str.maketrans("", "", ".!?")) if lot == 2 else text
        left.setdefault(conv, []).extend([(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], ROWS + ", copies int, __k int")
    assert found(C.repair_conversations(C.damaged(df), copies=F.col("copies"))) == {c: brute(x) for c, x in left.items()}
    none = spark.createDataFrame([(1, 0, "user", "a.")], ROWS)
    assert found(C.repair_conversations(none, copies=F.lit(0))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(C.repair_conversations(none.limit(0))) == {}


def test_long_texts_and_repeated_rows(spark):
    long = "x" * 3_000_000 + "."
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", long)] + [(1, 2, "user", "same.")] * 500
    got = found(C.repair_conversations(spark.createDataFrame(rows, ROWS)))[1]
    assert got[2] == 1 + 499 and got[6] == "KDK" + "D" * 500 and got[5] == 2 * 501
