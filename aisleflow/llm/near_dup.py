"""Near-duplicates by HyperMinHash sketches.

A text is the set of its distinct word shingles. Its shingle hashes fall into buckets; a bucket keeps
of its smallest hash the number of leading zeros and a few bits after them, two bytes in all. Bands of
neighbouring registers are the keys under which candidates meet; a pair of candidates is first rated
by the collision-corrected share of equal registers and then confirmed on the full shingle sets.

Texts with the same shingle set are one class and enter with one representative, so copies never meet
each other. Within a bucket candidates first meet only its smallest member; the other pairs of a
bucket are rated, without being written out, only while their ends lie in different components.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleflow.llm.components import connected_components
from aisleflow.llm.hashing import mix64, shingle_sets
from aisleflow.llm.storage import materialize, shuffled

WIDTH = 5  # words in a shingle
BUCKET_BITS = 7  # 128 registers
MANTISSA = 10  # bits kept after the leading one
BAND = 4  # registers in a band: 32 bands, each 64 bits
BUCKETS = 1 << BUCKET_BITS
#: Pairs given to one verification step, and members of a bucket that one task compares.
PAIRS, PIECE = 64, 500
#: Longs in the bit map of ids (2 MB).
WORDS = 1 << 18
#: Members above which a bucket is dealt again by a second band.
DEAL = 40 * PIECE

U = np.uint64


def registers(smallest: np.ndarray) -> np.ndarray:
    """Two-byte registers of the smallest hash in each bucket (bucket bits removed): leading zeros
    plus one above ``MANTISSA`` bits of what follows the leading one."""
    length = np.frexp((smallest >> U(11)).astype(np.float64))[1]
    zeros = 53 - length
    tail = np.where(zeros < 53, smallest << (zeros + 1).astype(U), U(0)) >> U(64 - MANTISSA)
    return ((zeros + 1) << MANTISSA | tail.astype(np.int64)).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set of sorted distinct hashes; 0 marks an empty bucket."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    for row, hashes in zip(out, sets, strict=True):
        bucket = (hashes >> U(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        row[bucket[first]] = registers(hashes[first] << U(BUCKET_BITS))
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(shingle_sets(part.column(1), WIDTH))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, sketches(sets), strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "registers"],
            )


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, registers) of every row; the last two are null for texts without words."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_profile, "doc_id long, n_shingles long, set_key binary, registers binary")


def _keys(bands: np.ndarray) -> np.ndarray:
    return mix64(bands + mix64(np.arange(1, BUCKETS // BAND + 1, dtype=U))).view(np.int64)


def band_keys(sketch):
    """A key for each band of a sketch that has a filled register."""

    @F.arrow_udf("array<long>")
    def run(batch: pa.Array) -> pa.Array:
        words = np.frombuffer(b"".join(batch.to_pylist()), U).reshape(len(batch), BUCKETS // BAND)
        keys = _keys(words)
        filled = words != 0
        offsets = np.concatenate(([0], np.cumsum(filled.sum(axis=1)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled]))

    return run(sketch)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers and the number of buckets it rests on.
    Equal registers that are expected by chance, for sets of these sizes, are taken off."""
    used = ((a | b) != 0).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    ratio = np.maximum(size_a, size_b) / np.maximum(1, np.minimum(size_a, size_b))
    chance = 0.169919487159739093975315012348 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def reachable(threshold: float, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether pairs can reach ``threshold``: the estimate is at most five standard errors below. The
    filled buckets are a sample without replacement of the union of the two sets."""
    estimate, used = similarity(a, b, size_a, size_b)
    union = (size_a + size_b) / (1 + threshold)
    left = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    used = np.maximum(used, 1)
    return estimate >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / used * left) - 1.5 / used


def likely(threshold: float, registers_a, registers_b, size_a, size_b):
    """:func:`reachable` as a condition on columns."""

    @F.arrow_udf("boolean")
    def run(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        rows = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), BUCKETS)
        return pa.array(reachable(threshold, rows(ra), rows(rb), na.to_numpy(), nb.to_numpy()))

    return run(registers_a, registers_b, size_a, size_b)


def _by_group(work):
    """Apply ``work`` to every group (bucket, i, j) of rows that arrive sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = batch if rest is None else pa.concat_batches([rest, batch])
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist()]
            if batch is None:
                cuts.append(rest.num_rows)  # no more rows of the last group
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end - start > 1:
                    yield work(rest.slice(start, end - start))
            rest = rest.slice(cuts[-1])

    return run


def _facing(group: pa.RecordBatch) -> np.ndarray:
    """Which rows of a group are to be compared: those of different components and, where the group
    stands for two pieces of a bucket, of different pieces."""
    comp, side = group.column("component").to_numpy(), group.column("piece").to_numpy()
    face = comp[:, None] != comp
    return face & (side[:, None] != side) if group.column("i")[0].as_py() != group.column("j")[0].as_py() else face


def _flag(threshold: float):
    """The rows of a group that have a likely partner in it. Partners that share an earlier band are
    left to the bucket of that band."""

    def work(group: pa.RecordBatch) -> pa.RecordBatch:
        face, size = _facing(group), group.column("size").to_numpy()
        bands = np.frombuffer(b"".join(group.column("registers").to_pylist()), U).reshape(len(size), -1)
        sketch = bands.view(np.uint16)
        here = np.flatnonzero(_keys(bands[:1])[0] == group.column("bucket")[0].as_py())
        before = bands[:, : here[0] if len(here) else 0]
        hit = np.zeros(len(size), bool)
        for x in range(len(size) - 1):
            at = x + 1 + np.flatnonzero(face[x, x + 1 :])
            at = at[~((before[at] == before[x]) & (before[x] != 0)).any(axis=1)]
            if len(at):
                at = at[reachable(threshold, sketch[x : x + 1], sketch[at], size[x], size[at])]
                hit[at] = True
                hit[x] |= len(at) > 0
        return group.select(["bucket", "i", "j", "piece", "node", "component"]).filter(pa.array(hit))

    return _by_group(work)


def _link(percent: int):
    """The links (a, b) inside a group, by the full shingle sets. Shared shingles are counted for all
    pairs at once, a few thousand shingles at a time."""

    def work(group: pa.RecordBatch) -> pa.RecordBatch:
        face, node = _facing(group), group.column("node").to_numpy()
        sets = list(shingle_sets(group.column("text"), WIDTH))
        size = np.array([len(s) for s in sets])
        own = np.repeat(np.arange(len(sets)), size)
        shingle, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[of]
        own, of = own[of >= 0], of[of >= 0]
        order = np.argsort(of, kind="stable")
        own, of = own[order], of[order]
        common = np.zeros((len(sets), len(sets)), np.float32)  # exact: whole numbers below 2**24
        for start in range(0, int(of[-1]) + 1 if len(of) else 0, 4096):
            lo, hi = np.searchsorted(of, [start, start + 4096])
            grid = np.zeros((len(sets), 4096), np.float32)
            grid[own[lo:hi], of[lo:hi] - start] = 1
            common += grid @ grid.T
        a, b = np.nonzero(np.triu(face & (100 * common >= percent * (size[:, None] + size - common)), 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    return _by_group(work)


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of these distinct ids. A bit map of hashed ids, of at most ``WORDS``
    longs however many ids there are, is sent to every task first, so that few other texts are moved."""
    place, bit = F.pmod(F.xxhash64("doc_id"), F.lit(WORDS)), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id, 1), 64) as int))")
    seen = ids.select(place.alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    rows = docs.withColumns({"_at": place, "_bit": bit}).join(F.broadcast(seen), F.col("_at") == F.col("_place"))
    rows = rows.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*docs.columns)
    return rows.join(shuffled(ids), "doc_id").select(*docs.columns)  # Spark would move a semi join below the bit map


def _links_within(members: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (bucket, node) of one bucket that lie in different components.

    A bucket is compared inside one task while it has at most ``PIECE`` members; a larger one is cut
    into pieces, and every two pieces meet in a group of their own. The members of one above ``DEAL``
    are first dealt again by each of their other bands: two texts at the threshold share two bands
    about as surely as one, unlike texts hardly ever do. Sketches tell which members of a group
    have a likely partner; only their texts are fetched.
    """
    placed = members.join(shuffled(found), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    state = lambda rows: rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket", "n")
    placed = materialize(placed.join(shuffled(state(placed)), "bucket"), "open")
    other = placed.where(F.col("n") > DEAL).join(shuffled(classes.select("node", "registers")), "node").withColumn("second", F.explode(band_keys("registers"))).where("bucket <> second")
    again = other.select(F.xxhash64(F.least("bucket", "second"), F.greatest("bucket", "second")).alias("bucket"), "node", "component").distinct()
    again = again.join(shuffled(state(again)), "bucket").select("bucket", "node", "component", "n")
    rows = placed.where(F.col("n") <= DEAL).select("bucket", "node", "component", "n").unionByName(again)
    rows = rows.join(shuffled(classes.select("node", "registers", "size")), "node").withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("bucket", F.least("piece", "with").alias("i"), F.greatest("piece", "with").alias("j"), "piece", "node", "component", "size", "registers")
    group = ["bucket", "i", "j"]
    flagged = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_flag(percent / 100), "bucket long, i int, j int, piece int, node long, component long")
    flagged = materialize(flagged, "flagged")
    wanted = materialize(_among(docs, flagged.select(F.col("node").alias("doc_id")).distinct()), "texts")
    texts = flagged.join(shuffled(wanted.select(F.col("doc_id").alias("node"), "text")), "node")
    return materialize(texts.repartition(*group).sortWithinPartitions(*group).mapInArrow(_link(percent), "a long, b long").distinct(), "links")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                ta, tb = part.column(2).to_pylist(), part.column(3).to_pylist()
                new = [t for t in dict.fromkeys(ta + tb) if t not in last]
                sets = last | dict(zip(new, shingle_sets(pa.array(new, pa.large_string()), WIDTH), strict=True))
                ok = []
                for x, y in zip(ta, tb, strict=True):
                    x, y = sets[x], sets[y]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                last = {ta[-1]: sets[ta[-1]]}
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], ["a", "b"])

    return run


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets have 100 * intersection >= percent * union.
    ``docs`` has (doc_id, text); the smaller id ``a`` may be the hub of very many pairs."""
    b = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(shuffled(b), "b").join(shuffled(a), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of 5-word shingles (ASCII letters lowered; a text of fewer
    words is one shingle) have a Jaccard similarity of ``percent`` / 100 or more; component_id is the
    smallest doc_id reachable, and kept marks the row whose own id that is.

    Two texts of similarity J share each of 32 bands with a chance of J**4: 0.52 at 0.85, where a link
    is missed about once in ten billion, and 0.41 at 0.8, where it is about once in twenty million
    (about once in a million in a bucket above ``DEAL``, which takes two bands). Edge cases: null texts and texts without words have no shingles
    and are their own component; rows with a null id take no part in links, have a null component and
    are kept; rows with the same id are one document; an empty frame gives an empty frame; other
    columns are ignored. Intermediate tables are written to the shared folder.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = materialize(profiles(docs), "sketches")
    classes = profile.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers"), F.first("n_shingles").alias("size"))
    classes = materialize(classes, "classes")
    keyed = classes.select("node", F.explode(band_keys("registers")).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = materialize(keyed.join(shuffled(shared.select("bucket", "first")), "bucket"), "members")
    stars = members.where("node <> first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("bands"))

    ra = classes.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("size").alias("na"))
    rb = classes.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("size").alias("nb"))
    stars = stars.join(shuffled(rb), "b").join(shuffled(ra), "a").where(likely(percent / 100, F.col("ra"), F.col("rb"), F.col("na"), F.col("nb")))
    stars = materialize(stars.select("a", "b", "bands"), "stars")
    ends = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialize(_among(docs, ends), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        return materialize(confirm(pairs.distinct(), texts, percent).distinct(), "links")

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet in one component."""
        ca = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        cb = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        joined = pairs.join(shuffled(ca), "a", "left").join(shuffled(cb), "b", "left")
        return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    # each member with the representative that shares the most bands with it
    nearest = stars.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    edges = links(nearest)
    found = connected_components(edges)
    # then with its other representatives
    tried = materialize(apart(stars.select("a", "b"), found), "stars")
    edges = edges.unionByName(links(tried))
    found = connected_components(edges)
    # then every pair of a bucket that still holds more than one component
    edges = edges.unionByName(_links_within(members, found, classes, docs, percent))
    found = connected_components(edges)

    nodes = classes.select("set_key", "node").join(shuffled(found), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = profile.join(shuffled(nodes), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
