"""Repair of conversations against a plain dynamic programme over all edits."""

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from aisleflow.llm import repair
from aisleflow.llm.storage import without

LETTER = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAME = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def expected(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [r[1] for r in rows if r[1] is not None]
    kinds, seen = [], set()
    for _, _, role, text in rows:
        found = LETTER.findall(text)
        kinds.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    best = {"": (0, "", [])}

    def offer(to, state, cost, audit, said):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = (cost, audit, said)

    def inserts():
        for _ in range(3):
            for state, (cost, audit, said) in list(best.items()):
                for c in NEXT[state]:
                    if c in NAME:
                        offer(best, c, cost + 3, audit + "I", [*said, f"{NAME[c]}:"])

    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        inserts()
        after = {}
        for state, (cost, audit, said) in best.items():
            offer(after, state, cost + 4, audit + "D", said)
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                if role[:1] in NEXT[state]:
                    offer(after, role[:1], cost + more, audit + "K", [*said, f"{role}:{text}"])
                for c in NEXT[state]:
                    if c in NAME:
                        offer(after, c, cost + 3 + more, audit + "R", [*said, f"{NAME[c]}:{text}"])
        best = after
    inserts()
    cost, audit, said = min(v for k, v in best.items() if k in ("", "a"))
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def brute(rows, harmed=True):
    return {c: expected([r for r in (damaged(rows) if harmed else rows) if r[0] == c]) for c in {r[0] for r in rows}}


def conversation(rng, conv, n):
    texts = ["Yes.", "no", "Why?", " ", "", "So it is!\n", "x. \t", "ends。", "same", "same."]
    return [(conv, rng.choice([i, i, i, i + 3, i - 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "unit"]), rng.choice(texts)) for i in range(n)]


def test_pieces_meet_in_the_whole():
    """Rows cut anywhere, priced towards each state and folded, give the repair of the whole."""
    rng = random.Random(7)
    for _ in range(300):
        rows = []
        for i in range(rng.randint(0, 24)):
            kind = rng.random()
            rows.append(repair.Row(i, rng.choice(["user", "assistant", "system", "tool"]), "t.", rng.choice([1, 1, 1, 3]), kind < 0.1, kind > 0.9, 0.4 < kind < 0.5))
        cuts = [0, *sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 4))), len(rows)]
        pieces = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        known = [repair.passages(p) for p in pieces]
        frame = pd.DataFrame({"at": range(len(pieces)), "costs": [k[0] for k in known], "places": [k[1] for k in known], "first_turn": None, "last_turn": None, "first_role": None, "last_role": None})
        audit = ""
        for p, (_, state, after, *_, last) in zip(pieces, repair._fold(frame).itertuples(index=False), strict=True):
            _, letters, _ = repair.solve(p, state, tuple(after))
            audit += repair.apply(p, letters, state, last)[0]
        cost, letters, _ = repair.solve(rows)
        assert audit == repair.apply(rows, letters, 0, True)[0]
        assert cost == 3 * (audit.count("R") + audit.count("I")) + 4 * audit.count("D") + 3 * sum(r.truncated and not r.lost and x != "D" for r, x in _firsts(rows, audit))


def _firsts(rows, audit):
    letters = iter(audit.replace("I", ""))
    for r in rows:
        yield r, [next(letters) for _ in range(r.copies)][0]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(3)
    rows = [r for c in range(150) for r in conversation(rng, c, rng.randint(1, 9))] + conversation(rng, None, 5) + conversation(rng, 1000, 700)
    return rows + rows[:40] + [(2000, None, None, None), (2001, 5, "user", "word " * 200_000), (2001, 6, "assistant", "."), (2002, 3, "user", "same")] + [(2002, t, "user", "same") for t in range(300)]


def test_repair_against_brute_force(spark, many):
    df = spark.createDataFrame([(*r, 1, "x") for r in many], "conv_id long, turn long, role string, text string, cost int, audit string")
    for harmed in (True, False):
        given = repair.damage(df) if harmed else without(df, "copies")
        got = {r[0]: tuple(r)[1:] for r in repair.summarize(repair.repair(given)).collect()}
        want = brute(many if harmed else [(c, t, r or "", x or "") for c, t, r, x in many], harmed)
        assert got == want


def test_repaired_turns_are_well_formed(spark, many):
    df = spark.createDataFrame([r for r in many if r[0] is not None and r[0] < 150], "conv_id long, turn long, role string, text string")
    for r in repair.repair(df).where("whole").collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in r.turns))


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.summarize(repair.repair(spark.createDataFrame([], schema))).count() == 0
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    (row,) = repair.summarize(repair.repair(repair.damage(spark.createDataFrame([(gone, 1, "user", "Hi.")], schema)))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_registered_query(spark):
    from aisleflow.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op11_auction_repair"](spark, path).collect()} == brute(rows)
