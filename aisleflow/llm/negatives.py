"""Hard negatives by spanning-tree bounds between anchors.

Anchors that lie near each other hang in one tree, the minimum spanning tree of their distances. The root
of a tree is scored against every candidate. A child's score differs from its parent's by at most the
length of the edge between them times the candidate's norm, so the parent's scores give each child an
interval for every candidate. Only candidates whose interval meets the window the child still looks for
are scored again; for its own children they are exact, all others keep their interval.

The same scan runs twice: for the best rows of the anchor's own label (a window open at the top), and
for the rows of other labels between two shares of each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.llm.storage import materialize
from aisleflow.llm.topk import EXACT, LEAST, MOST, matrix, products, quantized

TREE = 512  # anchors in a tree
BLOCK = 2048  # candidates in a block, fewer if they are long
BYTES = 1 << 20  # of a block's matrix, about
GROUP = 32  # trees that one task holds

_KINDS = (np.int8, np.int16, np.int32, np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """``m`` in the narrowest whole-number type that holds it."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def spanning_tree(m: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, distance) in an order in which parents come first; the root has parent -1."""
    x = m.astype(np.float64)
    square = (x * x).sum(axis=1)
    root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    near, parent, out, at = np.full(len(x), np.inf), np.full(len(x), -1), [], root
    left = np.ones(len(x), bool)
    for _ in range(len(x)):
        length = 0.0 if parent[at] < 0 else float(np.sqrt(((x[at] - x[parent[at]]) ** 2).sum()))
        out.append((at, int(parent[at]), length))
        left[at] = False
        d = square + square[at] - 2 * (x @ x[at])
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
    return out


class Found:
    """The best candidates of one anchor within windows of scores, ``k`` for each."""

    def __init__(self, windows: list[tuple[int, int]], k: int):
        self.windows, self.k = windows, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        self.low = min((w[0] for w in windows), default=MOST)
        self.high = max((w[1] for w in windows), default=LEAST)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floors = []
        for j, (low, high) in enumerate(self.windows):
            keep = np.flatnonzero((scores >= low) & (scores <= high))
            if len(keep):
                if len(keep) > 4 * self.k:  # ties of the last place stay
                    last = np.partition(scores[keep], len(keep) - self.k)[len(keep) - self.k]
                    keep = keep[scores[keep] >= last]
                all_ids, all_scores = np.append(self.best[j][0], ids[keep]), np.append(self.best[j][1], scores[keep])
                order = np.lexsort((all_ids, ~all_scores))[: self.k]
                self.best[j] = all_ids[order], all_scores[order]
                if len(order) == self.k:
                    low = max(low, int(self.best[j][1][-1]))
                    self.windows[j] = low, high
            floors.append(low)
        self.low = min(floors, default=MOST)


class Tree:
    """Anchors of one label, and what each looks for."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, found: list[Found]):
        self.ids, self.m, self.found = ids, m, found
        self.edges = spanning_tree(m)
        self.scored = 0

    def scan(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Take a block of candidates."""
        norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
        exact = float(np.abs(self.m.astype(np.float64)).max(initial=0)) * float(np.abs(m.astype(np.float64)).max(initial=0)) * m.shape[1] < EXACT
        anchors, candidates = (self.m.astype(np.float64), m.astype(np.float64)) if exact else (self.m, m)
        low, high = np.empty((len(self.ids), len(ids))), np.empty((len(self.ids), len(ids)))
        for at, parent, length in self.edges:
            found = self.found[at]
            if parent < 0 or not exact:
                hit = slice(None)
            else:
                reach = length * norms * (1 + 1e-9) + 1
                low[at], high[at] = low[parent] - reach, high[parent] + reach
                hit = np.flatnonzero((high[at] >= found.low) & (low[at] <= found.high))
                if not len(hit):
                    continue
            scores = (candidates[hit] @ anchors[at]).astype(np.int64) if exact else products(m, self.m[at : at + 1])[:, 0]
            low[at, hit] = high[at, hit] = scores
            self.scored += len(scores)
            near, others = ids[hit], ids[hit] != self.ids[at]
            found.add(near[others], scores[others])


def vectors(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: v is floor(scale * x) of every component."""
    own = rows.select("vec_id", label.alias("label"), quantized(F.col("embedding"), scale).alias("v"))
    return own.where("vec_id is not null and label is not null and v is not null")


def blocks(rows: DataFrame, size: int = BLOCK, parts: int | None = None) -> DataFrame:
    """(block, label, ids, width, kind, m, low, high): up to ``size`` vectors of one label, neighbours in
    the order of their leading components, as bytes, and the least and the most of each component."""
    lead = [F.coalesce(F.try_element_at("v", F.lit(i)), F.lit(0)) for i in (1, 2)]
    order = [F.col("label"), *(F.signum(x) for x in lead), lead[0], F.col("vec_id"), F.col("v")]
    ranged = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    label = dict(rows.dtypes)["label"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids, lists = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(ids):
                end, width = at + 1, len(lists[at])
                while end < len(ids) and labels[end] == labels[at] and end - at < size and 8 * max(width, len(lists[end])) * (end - at + 1) <= BYTES:
                    width = max(width, len(lists[end]))
                    end += 1
                m = matrix(lists[at:end], width)
                small = packed(m)
                row = {"label": labels[at], "ids": np.array(ids[at:end], np.int64).tobytes(), "width": width, "kind": small.dtype.char, "m": small.tobytes(), "low": m.min(axis=0), "high": m.max(axis=0)}
                yield pa.RecordBatch.from_pylist([row], pa.schema([batch.schema.field("label"), *pa.schema(_BLOCK)]))
                at = end

    cut_up = ranged.select("label", "vec_id", "v").mapInArrow(cut, f"label {label}, ids binary, width int, kind string, m binary, low array<bigint>, high array<bigint>")
    return cut_up.withColumn("block", F.monotonically_increasing_id())


_BLOCK = [("ids", pa.binary()), ("width", pa.int32()), ("kind", pa.string()), ("m", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]
_PAYLOAD = ["ids", "width", "kind", "m"]


def _pairs(groups: DataFrame, cut: DataFrame, own: bool) -> DataFrame:
    """(group, block) of the blocks of the group's own label, or of all others, in which a score can fall
    between the group's ``least`` and ``most``. Both sides are summaries, dealt to a grid of cells."""
    n, m = max(1, -(-groups.count() // 256)), max(1, -(-cut.count() // 4096))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = groups.select("group", F.col("label").alias("_label"), F.col("low").alias("_low"), F.col("high").alias("_high"), "least", "most", dealt("group", n).alias("_a"), every(m).alias("_b"))
    right = cut.select("block", "label", "low", "high", every(n).alias("_a"), dealt("block", m).alias("_b"))
    at = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    corner = lambda pick: F.zip_with(
        F.arrays_zip("low", "high"), F.arrays_zip("_low", "_high"),
        lambda x, y: pick(*[at(x[i]) * at(y[j]) for i in ("low", "high") for j in ("_low", "_high")]),
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    top, bottom = total(corner(F.greatest)), total(corner(F.least))
    slack = (F.abs(top) + F.abs(bottom)) * 1e-9 + 1
    label = F.col("label") == F.col("_label")
    return left.join(right, ["_a", "_b"]).where((label if own else ~label) & (top + slack >= F.col("least")) & (bottom - slack <= F.col("most"))).select("group", "block")


_WINDOW = "array<struct<place:int,vec_id:bigint,score:bigint>>"
_FOUND = "anchor_id bigint, place int, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def _scan(trees: DataFrame, cut: DataFrame, positives: DataFrame | None, k: int, low: int, high: int) -> DataFrame:
    """The best ``k`` candidates of every anchor: of its own label, or for each of its ``positives``
    (anchor_id, positives) those of other labels in the window. A task holds the trees of one group and
    takes its blocks one by one."""
    span = {"least": F.min("least"), "most": F.max("most")}
    if positives is None:
        bounds = trees.select("group").distinct().withColumns({"least": F.lit(LEAST), "most": F.lit(MOST)})
        asked = None
    else:
        asked = trees.select("group", F.explode(_longs("ids")).alias("anchor_id")).join(positives, "anchor_id")
        score = lambda share: F.transform("positives", lambda p: p["score"] * (share / 100))
        slack = lambda c: F.abs(c) * 1e-9 + 1
        ends = asked.select("group", F.array_min(score(low)).alias("least"), F.array_max(score(high)).alias("most"))
        bounds = ends.groupBy("group").agg(*[(f - slack(f) if c == "least" else f + slack(f)).alias(c) for c, f in span.items()])
    merge = lambda c, pick: F.aggregate(F.collect_list(c), F.array().cast("array<bigint>"), lambda a, x: F.zip_with(a, x, lambda p, q: pick(F.coalesce(p, q), F.coalesce(q, p))))
    groups = materialize(trees.groupBy("group", "label").agg(merge("low", F.least).alias("low"), merge("high", F.greatest).alias("high")).join(bounds, "group"), "groups")
    n = max(1, groups.count())
    stripes = max(1, -(-3 * trees.sparkSession.sparkContext.defaultParallelism // n))
    none = {"positives": F.lit(None).cast(_WINDOW), "anchor_id": F.lit(None).cast("bigint"), **{c: F.lit(None).cast(t) for c, t in zip(_PAYLOAD, ("binary", "int", "string", "binary"), strict=True)}}
    row = lambda df, step, *has: df.select("group", "stripe", F.lit(step).alias("step"), *[F.col(c) if c in has else none[c].alias(c) for c in none])
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    sent = row(trees.join(groups.select("group"), "group").withColumn("stripe", everywhere), 0, *_PAYLOAD)
    if asked is not None:
        sent = sent.unionByName(row(asked.withColumn("stripe", everywhere), 1, "anchor_id", "positives"))
    shipped = cut.join(_pairs(groups, cut, positives is None), "block").withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
    sent = sent.unionByName(row(shipped, 2, *_PAYLOAD))

    best_only = positives is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, forest, windows, parts = None, None, {}, []

        def plant() -> list[Tree]:
            out = []
            for ids, m in parts:
                found = [Found([(LEAST, MOST)] if best_only else [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in windows.get(a, [])], k) for a in ids.tolist()]
                out.append(Tree(ids, m, found))
            return out

        def rows() -> pa.RecordBatch:
            out = []
            for tree in forest or []:
                for anchor, found in zip(tree.ids.tolist(), tree.found, strict=True):
                    for j, (ids, scores) in enumerate(found.best):
                        p = windows[anchor][j] if not best_only else {"place": 0, "vec_id": None, "score": None}
                        out += [(anchor, p["place"], p["vec_id"], p["score"], i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in _FOUND.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["group"], r["stripe"]):
                    if forest:
                        yield rows()
                    key, forest, windows, parts = (r["group"], r["stripe"]), None, {}, []
                if r["step"] == 1:
                    windows[r["anchor_id"]] = r["positives"]
                    continue
                ids = np.frombuffer(r["ids"], np.int64)
                m = np.frombuffer(r["m"], r["kind"]).reshape(len(ids), r["width"]).astype(np.int64)
                if r["step"] == 0:
                    parts.append((ids, m))
                    continue
                forest = forest if forest is not None else plant()
                for tree in forest:
                    tree.scan(ids, m)
        if forest:
            yield rows()

    dealt = sent.repartition("group", "stripe").sortWithinPartitions("group", "stripe", "step")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")).cast("int")
    return dealt.mapInArrow(run, _FOUND).withColumn("rank", rank).where(F.col("rank") <= k)


def _longs(ids: str) -> Column:
    @F.arrow_udf("array<long>")
    def listed(x: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b, np.int64) for b in x.to_pylist()], pa.list_(pa.int64()))

    return listed(ids)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` are (vec_id, label, v array<long>). An anchor's positives are its best other
    rows of the same label by inner product; for each of them the best ``negatives`` rows of other labels
    are returned whose score is between ``low`` and ``high`` per cent of the positive's, rank 1 first.
    Ties go to the smaller vec_id.
    Edge cases: rows with a null id, label or vector take no part; shorter vectors count as filled up with
    zeros; an anchor never meets rows of its own id; rows that repeat an id each count, as one anchor with
    the smallest of their labels and vectors; a positive of negative score has no negatives; products
    beyond a long are clipped and not bounded; a label may hold any part of the rows, since it is cut into
    blocks; further columns are ignored; empty frames give an empty frame.
    """
    usable = "vec_id is not null and label is not null and v is not null"
    rows = rows.select("vec_id", "label", "v").where(usable)
    one = anchors.select("vec_id", "label", "v").where(usable).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.*")
    one = materialize(one, "anchors")
    cut = materialize(blocks(rows), "candidates")
    trees = blocks(one, TREE, max(1, -(-one.count() // (TREE * GROUP))))
    group = F.concat_ws(":", F.col("label").cast("string"), F.floor(F.col("block") / GROUP).cast("string"))
    trees = materialize(trees.withColumn("group", group), "trees")
    best = _scan(trees, cut, None, positives, low, high)
    listed = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), "vec_id", "score")))
    chosen = materialize(best.groupBy("anchor_id").agg(listed.cast(_WINDOW).alias("positives")), "positives")
    found = _scan(trees, cut, chosen, negatives, low, high)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
