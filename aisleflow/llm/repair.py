"""Repair of the turn structure of conversations by an auction for shortest paths.

A conversation is a lattice: node (i, q) stands before row i with the last kept role q. Arcs keep a row,
give it the role that is due, delete it, or insert an empty turn; their costs are whole numbers. Each node
has a price, which never exceeds the cost of an arc plus the price it leads to. A path starts at an origin
and is extended along its cheapest arc while the price of its last node equals that cost; else the price
rises to it and the path is contracted by one node. A path that meets a settled node is complete and all
its prices are exact distances. Arcs whose cost equals the fall of the price are tight; the cheapest
repairs are the tight paths, and the one whose letters come first is traced.

Long conversations are cut into pieces of consecutive rows, priced towards each state they can leave
behind, and only those figures of a conversation meet; so neither the lattice nor the texts of one
conversation are ever gathered.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from aisleflow.llm.skew import lookup
from aisleflow.llm.storage import materialize

ROWS, CHARS = 64, 1 << 20  # a piece ends at so many rows or characters
STEP = 16  # rows between origins
FAR = 1 << 60

# Costs of the edits, roles and white space.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

# States: nothing kept yet, then after a system, a user and an assistant turn.
START, USER, ASSISTANT = 0, 2, 3
STATES = range(4)
DUE = ("user", "user", "assistant", "user")  # the role that is due
AFTER = (USER, USER, ASSISTANT, USER)  # the state once it is there
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
CLOSING = ("", "II", "I", "")  # the inserts that end a conversation well
FINAL = tuple(INSERT * len(x) for x in CLOSING)


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    copies: int
    blank: bool
    repeated: bool
    truncated: bool

    @property
    def lost(self) -> bool:
        return self.blank or self.repeated


class Lattice:
    """The arcs of some consecutive rows towards given prices of the states after them."""

    def __init__(self, rows: list[Row], prices: tuple[int, ...]):
        self.rows, self.n = rows, len(rows)
        # states that no priced state can follow lead nowhere
        ends = [q for q in STATES if prices[q] < FAR]
        self.open = [q for q in STATES if max(ends) >= USER or q <= max(ends)]
        self.arcs: list[list[tuple[int, int, str]]] = [[] for _ in range(4 * self.n)]
        floor = min(prices[q] for q in ends)
        self.price = [FAR] * (4 * self.n) + list(prices)
        for i in range(self.n - 1, -1, -1):
            row = rows[i]
            later = DELETE * (row.copies - 1)
            own = TRUNCATED if row.truncated else 0
            floor += DELETE * row.copies if row.lost else later + own
            for q in self.open:
                out = [(DELETE + later, 4 * (i + 1) + q, "D"), (INSERT, 4 * i + AFTER[q], "I")]
                if not row.lost:
                    if (to := KEPT.get((q, row.role[:1]))) is not None:
                        out.append((own + later, 4 * (i + 1) + to, "K"))
                    out.append((REROLE + own + later, 4 * (i + 1) + AFTER[q], "R"))
                self.arcs[4 * i + q] = [a for a in out if a[1] % 4 in self.open]
                self.price[4 * i + q] = floor
        self.settled = [False] * (4 * self.n) + [p < FAR for p in prices]
        for i in range(self.n - STEP, 0, -STEP):  # origins from the end on, so that each path is short
            for q in self.open:
                self.auction(4 * i + q)

    def auction(self, origin: int) -> int:
        """The distance from ``origin``; FAR if no path leads on."""
        price, settled, arcs = self.price, self.settled, self.arcs
        path = [origin]
        while not settled[path[-1]]:
            at = path[-1]
            least, to = FAR, -1
            for cost, node, _ in arcs[at] if at < 4 * self.n else ():
                if cost + price[node] < least:
                    least, to = cost + price[node], node
            if price[at] < least or to < 0:
                price[at] = least
                if len(path) > 1:
                    path.pop()
                elif to < 0:
                    return FAR
            else:
                path.append(to)
        for node in path:
            settled[node] = True
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """(letters, last state) of the cheapest path from a settled origin, the first by letters."""
        price, arcs, n = self.price, self.arcs, self.n
        live = [False] * (4 * n) + self.settled[4 * n :]
        for i in range(n - 1, -1, -1):
            for _ in range(3):  # inserts lead on within a row
                for q in self.open:
                    at = 4 * i + q
                    live[at] = live[at] or any(live[to] and price[at] == cost + price[to] for cost, to, _ in arcs[at])
        letters, at = [], origin
        while at < 4 * n:
            _, letter, to = min((letter, letter, to) for cost, to, letter in arcs[at] if live[to] and price[at] == cost + price[to])
            letters.append(letter)
            if to // 4 > at // 4:
                letters.append("D" * (self.rows[at // 4].copies - 1))
            at = to
        return "".join(letters), at % 4


def solve(rows: list[Row], entry: int = START, prices: tuple[int, ...] = FINAL) -> tuple[int, str, int]:
    """(cost, letters, last state) of the cheapest repair from state ``entry`` on."""
    lattice = Lattice(rows, prices)
    cost = lattice.auction(entry)
    return (cost, *lattice.trace(entry)) if cost < FAR else (FAR, "", -1)


def passages(rows: list[Row]) -> tuple[list[int], list[int]]:
    """For each entry and last state (16 each): the cost, and the place of its letters among those of the
    same entry."""
    costs, letters = [FAR] * 16, [""] * 16
    for end in STATES:
        lattice = Lattice(rows, tuple(0 if q == end else FAR for q in STATES))
        for entry in lattice.open:
            if (cost := lattice.auction(entry)) < FAR:
                costs[4 * entry + end], (letters[4 * entry + end], _) = cost, lattice.trace(entry)
    places = []
    for entry in STATES:
        own = letters[4 * entry : 4 * entry + 4]
        places += [sorted(own).index(x) for x in own]
    return costs, places


def apply(rows: list[Row], letters: str, entry: int, last: bool) -> tuple[str, list[tuple[str, str]], int]:
    """(letters, repaired turns, last state), with the closing inserts if these are the last rows."""
    out, state, i, left = [], entry, 0, rows[0].copies if rows else 0
    for letter in letters:
        if letter == "I":
            out.append((DUE[state], ""))
            state = AFTER[state]
            continue
        row = rows[i]
        if letter == "K":
            out.append((row.role, row.text))
            state = KEPT[state, row.role[:1]]
        elif letter == "R":
            out.append((DUE[state], row.text))
            state = AFTER[state]
        left -= 1
        if not left:
            i += 1
            left = rows[i].copies if i < len(rows) else 0
    end = CLOSING[state] if last else ""
    for _ in end:
        out.append((DUE[state], ""))
        state = AFTER[state]
    return letters + end, out, state


def figures(rows: list[Row]) -> dict[str, int]:
    """gaps, blank, duplicate, truncated and illegal of consecutive rows."""
    turns = [r.turn for r in rows if r.turn is not None]
    return {
        "gaps": sum(max(0, b - a - 1) for a, b in zip(turns, turns[1:], strict=False)),
        "blank": sum(r.copies for r in rows if r.blank),
        "duplicate": sum(r.copies - (not r.repeated) for r in rows if not r.blank),
        "truncated": sum(r.truncated and not r.lost for r in rows),
        "illegal": sum(r.copies - 1 for r in rows) + sum(a.role[:1] + b.role[:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False)),
    }


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURN = [("role", pa.string()), ("text", pa.string())]
_SUMS = [(f, pa.int64()) for f in FIGURES]
_MENDED = [("at", pa.int64()), ("whole", pa.bool_()), *_SUMS, ("audit", pa.string()), ("turns", pa.list_(pa.struct(_TURN)))]
_LINE = [("turn", pa.int64()), *_TURN, ("copies", pa.int64()), *[(f, pa.bool_()) for f in ("blank", "repeated", "truncated")]]
_ENDS = [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string())]
_CUT = [*_MENDED, ("lines", pa.list_(pa.struct(_LINE))), *_ENDS, ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]
_SUMMARY = [*_SUMS, ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _schema(df: DataFrame, columns: list) -> StructType:
    return StructType([df.schema["conv_id"], *from_arrow_schema(pa.schema(columns)).fields])


def _arrow(batch: pa.RecordBatch, columns: list) -> pa.Schema:
    return pa.schema([batch.schema.field("conv_id"), *pa.schema(columns)])


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): ``turns`` with every fifth row damaged, the kind chosen by
    crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it,
    4 makes it a user's. Nulls count as one space. Dropped rows stay with 0 copies."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _ranked(turns: DataFrame) -> DataFrame:
    """Distinct rows with their copies and faults. A conversation without rows keeps one of 0 copies."""
    gone = F.col("copies") <= 0
    given = turns.select("conv_id", *[F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")], F.greatest("copies", F.lit(0)).alias("copies"))
    given = given.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    trimmed = F.rtrim("text", F.lit(SPACES))
    same = F.concat_ws(":", F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text")
    rows = given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = materialize(rows.withColumns({
        "blank": trimmed == "", "truncated": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "same": F.md5(same.cast("binary")),
    }), "turns")
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.where("copies > 0 and not blank").groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("held")).where("held > 1")
    found = lookup(rows, materialize(first, "first-turns"), "same", "held")
    return found.withColumn("repeated", F.coalesce(order != F.col("first"), F.lit(False))).drop("same", "first", "held")


def _pieces(rows: Iterator[dict]) -> Iterator[tuple[int, object, list[Row], bool]]:
    """(number of the conversation, its id, rows, whether they open it) of each piece."""
    for number, (conv, own) in enumerate(itertools.groupby(rows, key=lambda r: r.pop("conv_id"))):
        piece, chars, opens = [], 0, True
        for r in own:
            if r["copies"] <= 0:
                continue
            if piece and (len(piece) >= ROWS or chars + len(r["text"]) > CHARS):
                yield number, conv, piece, opens
                piece, chars, opens = [], 0, False
            piece.append(Row(**r))
            chars += len(r["text"])
        yield number, conv, piece, opens


def _mended(rows: list[Row], entry: int, prices: tuple[int, ...], last: bool) -> dict:
    cost, letters, state = solve(rows, entry, prices)
    letters, turns, _ = apply(rows, letters, entry, last)
    return {"cost": cost - (0 if last else prices[state]), "audit": letters, "turns": [{"role": r, "text": t} for r, t in turns]}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of sorted rows. The first and the last conversation of a task may go on in another one;
    these and long ones are left open, all others are repaired at once."""
    at, held, done, schema = TaskContext.get().partitionId() << 33, None, [], None

    def rows() -> Iterator[dict]:
        nonlocal schema
        for batch in batches:
            schema = _arrow(batch, _CUT)
            yield from batch.to_pylist()

    for piece in itertools.chain(_pieces(rows()), [None]):
        if held is not None:
            number, conv, own, opens = held
            record = {"conv_id": conv, "at": at, "whole": opens and number > 0 and piece is not None and piece[0] != number, **figures(own)}
            if record["whole"]:
                record |= _mended(own, START, FINAL, True)
            else:
                record["costs"], record["places"] = passages(own)
                record["lines"] = [r._asdict() for r in own]
                turns = [r.turn for r in own if r.turn is not None] or [None]
                record |= {"first_turn": turns[0], "last_turn": turns[-1]} | ({"first_role": own[0].role[:1], "last_role": own[-1].role[:1]} if own else {})
            done.append(record)
            at += 1
        held = piece
        if done and (len(done) >= 256 or piece is None):
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []


def _fold(p: pd.DataFrame) -> pd.DataFrame:
    """For each piece of one conversation: the state before it, the prices after it, and the gap and the
    illegal pair between it and the piece before."""
    p = p.sort_values("at", ignore_index=True)
    costs = [tuple(c) for c in p["costs"]]
    prices = [FINAL]
    for c in reversed(costs):  # the cheapest way on from each state
        prices.append(tuple(min(min(c[4 * q + e] + prices[-1][e] for e in STATES), FAR) for q in STATES))
    prices.reverse()
    state, turn, role, out = START, None, None, []
    for i, c in enumerate(costs):
        places = p["places"][i]
        gap = illegal = 0
        first, last = (None if pd.isna(p[k][i]) else int(p[k][i]) for k in ("first_turn", "last_turn"))
        if first is not None:
            gap = max(0, first - turn - 1) if turn is not None else 0
            turn = last
        if (opening := p["first_role"][i]) is not None:
            illegal = int(role is not None and role + opening not in LEGAL)
            role = p["last_role"][i]
        out.append((p["at"][i], state, list(prices[i + 1]), gap, illegal, i == len(costs) - 1))
        state = min((places[4 * state + e], e) for e in STATES if c[4 * state + e] + prices[i + 1][e] == prices[i][state] < FAR)[1]
    return pd.DataFrame(out, columns=["at", "entry", "after", "gap", "pair", "last"])


def repair(turns: DataFrame) -> DataFrame:
    """The pieces of all repaired conversations: conv_id, at (their order), whole (the only piece), the
    figures gaps, blank, duplicate, truncated, illegal and cost, which add up over the pieces of a
    conversation, audit (a letter for each edit) and turns (the repaired turns: role and text).

    ``turns`` has conv_id, turn, role and text; copies, if present, says how often a row counts. Rows are
    taken by turn, nulls first, then by role and text. A row's first fault counts: blank, duplicate (role
    and text seen earlier), truncated (does not end in ``.``, ``!`` or ``?``). The repaired role initials
    are none or an optional s and pairs ua; of the cheapest repairs the one with the least letters is taken.
    Edge cases: null roles and texts are empty; a row with an empty or unknown role cannot be kept as it
    is; rows that are alike in all columns follow each other and are duplicates; null ids are one
    conversation; conversations without rows have one piece with zeros and an empty audit; very long
    conversations and texts are cut into pieces; further columns are ignored; an empty frame gives an
    empty frame.
    """
    turns = turns if "copies" in turns.columns else turns.withColumn("copies", F.lit(1))
    order = ["conv_id", "turn", "role", "text"]
    rows = _ranked(turns).select(*order, "copies", "blank", "repeated", "truncated")
    sort = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialize(sort.mapInArrow(_cut, _schema(turns, _CUT)), "pieces")
    parts = cut.where("not whole")
    known = parts.select("conv_id", "at", "costs", "places", "first_turn", "last_turn", "first_role", "last_role").groupBy("conv_id")
    folded = known.applyInPandas(_fold, "at bigint, entry int, after array<bigint>, gap bigint, pair bigint, last boolean")
    out = ["conv_id", "at", "whole", *FIGURES, "audit", "turns"]
    parts = parts.join(folded, "at").withColumns({"gaps": F.col("gaps") + F.col("gap"), "illegal": F.col("illegal") + F.col("pair")})

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _arrow(batch, _MENDED)
            done = []
            for r in batch.to_pylist():
                own = [Row(**x) for x in r["lines"]]
                done.append({k: r[k] for k in out if k in r} | _mended(own, r["entry"], tuple(r["after"]), r["last"]))
            yield pa.RecordBatch.from_pylist(done, schema)

    mended = parts.select("conv_id", "at", "whole", *FIGURES[:-1], "lines", "entry", "after", "last").mapInArrow(mend, _schema(turns, _MENDED))
    return cut.where("whole").select(*out).unionByName(mended)


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def summarize(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: its figures, audit and repaired_sha256, the digest of
    its repaired turns as ``role:text``, joined by newlines. The pieces of a long conversation stream
    through its digest one after the other."""
    digested = pieces.where("whole").select("conv_id", *FIGURES, "audit", F.sha2(_text(F.col("turns")).cast("binary"), 256).alias("repaired_sha256"))
    parts = pieces.where("not whole").select("conv_id", "at", *FIGURES, "audit", F.when(F.size("turns") > 0, _text(F.col("turns"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, letters, digest, key, schema = [0] * len(FIGURES), [], None, None, None

        def done() -> pa.RecordBatch:
            row = dict(zip(FIGURES, sums, strict=True)) | {"conv_id": key, "audit": "".join(letters), "repaired_sha256": (digest or hashlib.sha256()).hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if schema is None or r["conv_id"] != key:
                    if schema is not None:
                        yield done()
                    sums, letters, digest, key = [0] * len(FIGURES), [], None, r["conv_id"]
                    schema = _arrow(batch, _SUMMARY)
                sums = [a + r[f] for a, f in zip(sums, FIGURES, strict=True)]
                letters.append(r["audit"])
                if r["text"] is not None:
                    lead, digest = ("\n", digest) if digest else ("", hashlib.sha256())
                    digest.update((lead + r["text"]).encode())
        if schema is not None:
            yield done()

    joined = parts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, _schema(pieces, _SUMMARY))
    return digested.unionByName(joined)
