"""Exact top-k inner products by block-at-a-time pruning.

Documents (integer vectors) are sorted so that similar ones are near each other and cut into ranges,
the blocks. A block holds a forward index, the matrix of its vectors, and for each term (dimension)
the largest and the smallest value. For a query, a block's bound is the sum over the terms of the
most its values can add. Queries visit blocks in the order of falling bounds and stop once a bound
is below their k-th score. The first k-th score comes from the block in which the query itself lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.llm.storage import materialize

BLOCK = 256  # documents in a block
GROUP = 512  # blocks that one task holds at most
CHUNK = 32_768  # queries that one task holds, about; every chunk is sent all blocks
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as a long, or null if the vector is null or holds a null or
    non-finite component. An empty vector stays empty: its products are 0."""
    x = F.transform(vector, lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(usable, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``: floating point where it is exact."""
    width = max(1, a.shape[1])
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * width
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores.astype(np.float64) if abs(scores).max(initial=0) < EXACT else [-int(s) for s in scores]))[:k]
    return ids[order], scores[order]


def search(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, scores) of each query's best ``k`` in these blocks that reach its floor.

    ``own`` are the queries' ids, which they never match; ``floors`` scores that k documents reach.
    """
    high = np.array([m.max(axis=0) for _, m in blocks])
    low = np.array([m.min(axis=0) for _, m in blocks])
    bounds = products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)
    if abs(bounds).max(initial=0) >= EXACT:  # sums of clipped parts: no pruning, all blocks in turn
        bounds = np.full_like(bounds, MOST)
    for i in range(len(queries)):
        floor, ids, scores = floors[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[i], kind="stable"):
            if bounds[i, b] < floor:
                break
            docs, m = blocks[b]
            s = products(queries[i : i + 1], m)[0]
            keep = (s >= floor) & (docs != own[i])
            if keep.any():
                ids, scores = best(np.append(ids, docs[keep]), np.append(scores, s[keep]), k)
                if len(scores) == k:
                    floor = max(floor, scores[-1])
        if len(ids):
            yield i, ids, scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its ``k`` best vectors by inner product.

    ``vectors`` and ``queries`` are (vec_id long, v array<long>); a query never matches the vector of
    its own id. Ranks start at 1, ties go to the smaller vec_id, and fewer candidates give fewer rows.
    Edge cases: null vectors and null ids take no part; shorter vectors count as filled up with
    zeros; rows that repeat an id each count as a candidate, but are one query (with the
    smallest of their vectors); scores beyond a long are clipped to it;
    empty frames give an empty frame. Blocks are ranges, so equal vectors spread over many of them.
    """
    usable = "vec_id is not null and v is not null"
    vectors = vectors.select("vec_id", "v").where(usable)
    queries = queries.select("vec_id", "v").where(usable).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = _blocks(vectors)
    queries = materialize(queries.join(_floors(blocks, queries, k), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))), "queries")
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    n_blocks, n_queries = blocks.count(), queries.count()
    chunks = max(1, -(-n_queries // CHUNK))
    groups = max(1, -(-n_blocks // min(GROUP, max(1, n_blocks * chunks // (2 * tasks)))))
    spread = lambda df, **parts: df.withColumns({c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for c, n in parts.items()})
    left = spread(queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")), group=groups)
    right = spread(blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")), chunk=chunks)

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(int(b["width"].max()), max(map(len, q["v"])))
        found = list(search(matrix(list(q["v"]), width), q["vec_id"].to_numpy(), q["floor"].to_numpy(), _unpack(b, width), k))
        own = q["vec_id"].to_numpy()
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"query_id": join([np.full(len(ids), own[i]) for i, ids, _ in found]), "vec_id": join([ids for _, ids, _ in found]), "score": join([s for _, _, s in found])})

    found = left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(vectors: DataFrame) -> DataFrame:
    """(block, width, ids, m): ids and the matrix of a range of vectors, as bytes of longs."""
    # neighbours: the term with the largest magnitude and its sign, then the value
    lead = F.aggregate(
        F.transform("v", lambda x, i: F.struct(F.abs(x).alias("size"), i.alias("term"), x.alias("x"))),
        F.struct(F.lit(-1).cast("long").alias("size"), F.lit(-1).alias("term"), F.lit(0).cast("long").alias("x")),
        lambda m, x: F.when(x["size"] > m["size"], x).otherwise(m),
    )
    order = ["_lead.term", F.col("_lead.x") > 0, "_lead.x", "vec_id"]
    ranged = vectors.withColumn("_lead", lead).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, lists = (c.to_pylist() for c in batch.slice(at, BLOCK).columns)
                width = max(map(len, lists))
                parts = [pa.array([width]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([matrix(lists, width).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, ["width", "ids", "m"])

    cut_up = ranged.select("vec_id", "v").mapInArrow(cut, "width long, ids binary, m binary")
    return materialize(cut_up.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _unpack(b: pd.DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for ids, w, m in zip(b["ids"], b["width"], b["m"], strict=True):
        ids = np.frombuffer(ids, np.int64)
        out.append((ids, np.pad(np.frombuffer(m, np.int64).reshape(len(ids), w), ((0, 0), (0, width - w)))))
    return out


def _floors(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(vec_id, floor): the k-th score of each query within the block that holds its own id; null if
    the block has fewer candidates."""

    @F.arrow_udf("array<long>")
    def listed(ids: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, np.int64) for x in ids.to_pylist()], pa.list_(pa.int64()))

    homes = blocks.select(F.col("block").alias("home"), F.explode(listed("ids")).alias("vec_id")).dropDuplicates(["vec_id"])
    asked = queries.join(homes, "vec_id").groupBy("home")

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            width = max(int(b["width"].max()), max(map(len, q["v"])))
            for own, v in zip(q["vec_id"], q["v"], strict=True):
                ids, m = _unpack(b, width)[0]
                scores = np.sort(products(matrix([v], width), m[ids != own])[0])
                if len(scores) >= k:
                    out.append((own, scores[-k]))
        return pd.DataFrame(out, columns=["vec_id", "floor"]).astype("int64")

    return asked.cogroup(blocks.groupBy("block")).applyInPandas(run, "vec_id long, floor long").groupBy("vec_id").agg(F.max("floor").alias("floor"))
