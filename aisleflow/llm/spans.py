"""Substring dedup by sliding spans of sentences.

Runs of consecutive sentences are hashed: from each sentence on and back from each sentence, at least
``SENTENCES`` of them and as many more as it takes to have ``WORDS`` words, and each sentence that has
``ALONE`` words by itself. So every repeated stretch of whole sentences that holds such a run is covered
from its first sentence to its last. Equal runs meet in one global join; the run in the
document with the smallest id is the first, and the sentences of every other one are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleflow.llm.storage import materialize, without

SENTENCES, WORDS = 2, 20
ALONE = 20  # words that make one sentence a run
#: The white space after a sentence: after its full stop, or with a line break in it.
END = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|[\n\r][\x20\x09-\x0D]*")


def sentences(text: str) -> list[str]:
    """Sentences with the white space behind them; joined they are the text."""
    cuts = [0, *(m.end() for m in END.finditer(text))]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def runs(text: str) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash) of every run, in order; sentences without words join
    the next. Hashes ignore ASCII case and white space."""
    words = [s.encode().lower().split() for s in sentences(text)]
    place = [i for i, w in enumerate(words) if w]  # sentences with words
    sizes = [len(words[i]) for i in place]
    plain = [b" ".join(words[i]) for i in place]
    ends = {(i, i + 1) for i, n in enumerate(sizes) if n >= ALONE}
    j, n = 0, 0  # n: words in sentences i to j - 1
    for i in range(len(place)):
        while j < len(place) and (j - i < SENTENCES or n < WORDS):
            n, j = n + sizes[j], j + 1
        if j - i < SENTENCES or n < WORDS:
            break
        ends.add((i, j))
        n -= sizes[i]
    i, n = 0, 0  # back from each sentence: the last start that leaves enough
    for j in range(1, len(place) + 1):
        n += sizes[j - 1]
        while j - i > SENTENCES and n - sizes[i] >= WORDS:
            n, i = n - sizes[i], i + 1
        if j - i >= SENTENCES and n >= WORDS:
            ends.add((i, j))
    return [(place[i], place[j - 1] - place[i] + 1, xxhash.xxh3_128_digest(b" ".join(plain[i:j]))) for i, j in sorted(ends)]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for text in part.column(2).to_pylist():
                found: dict[bytes, tuple[int, int]] = {}
                again: set[int] = set()
                for i, n, h in runs(text or ""):
                    if h in found:
                        again.update(range(i, i + n))
                    else:
                        found[h] = (i, n)
                keys = [(int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)) for h in found]
                rows.append((len(sentences(text or "")), [k[0] for k in keys], [k[1] for k in keys], [i for i, _ in found.values()], [n for _, n in found.values()], sorted(again)))
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(part.columns[:2] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "text_key", "n_sentences", "h1", "h2", "at", "n", "again"])


def repeated_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_sentences, removed): the sentences of each row that lie in a repeated run
    which is not the first. The first is the one in the smallest doc_id, null last, and in that
    document the earliest; rows with the same id are one document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, text_key long, n_sentences int, h1 array<long>, h2 array<long>, at array<int>, n array<int>, again array<int>"
    found = materialize(rows.mapInArrow(_spans, schema).withColumn("row", F.monotonically_increasing_id()), "spans")
    order = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order")
    each = found.select("row", order, F.explode(F.arrays_zip("h1", "h2", "at", "n")).alias("x")).select("row", "order", "x.h1", "x.h2", "x.at", "x.n")
    first = each.groupBy("h1", "h2").agg(F.min("order").alias("first"), F.max("order").alias("last")).where("first < last").drop("last")
    later = each.join(first, ["h1", "h2"]).where("order > first").groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("later"))
    out = found.select("row", "doc_id", "text_key", "n_sentences", "again").join(later, "row", "left")
    spread = F.flatten(F.transform(F.coalesce("later", F.array().cast("array<struct<at:int,n:int>>")), lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    return out.select("doc_id", "text_key", "n_sentences", F.array_sort(F.array_union("again", spread)).alias("removed"))


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_sentences and n_removed, and without the repeated sentences in ``text``.

    Edge cases: null texts stay null and have no sentences; empty texts and texts below
    the length of a run lose nothing; what shares a sentence with other text is not whole and stays; a document all of whose sentences repeat keeps an empty text;
    null ids come last when the first occurrence is chosen; rows with equal id and text are one
    document and stay equal; an empty frame gives an empty frame; other columns pass unchanged, ones
    named like the added ones are replaced.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            if t and r:
                gone = set(r)
                t = "".join(s for i, s in enumerate(sentences(t)) if i not in gone)
            out.append(t)
        return pa.array(out, pa.string())

    report = repeated_sentences(docs, key, text).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("n_sentences").cast("long"), F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("_removed"))
    same = F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_key"))
    base = without(docs, "n_sentences", "n_removed", "_id", "_key", "_removed")
    return base.join(report, same, "left").withColumn(text, cut(F.col(text).cast("string"), F.col("_removed"))).drop("_id", "_key", "_removed")
