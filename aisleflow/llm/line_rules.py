"""Quality rules with the frequency of lines across documents.

Every document gives its base figures and the hashes of its normalised lines. A line's frequency is
the number of distinct documents (texts) of one host that hold it. Lines above the limit are removed,
and a document that is then depleted is rejected. The limit is a count that does not grow with the host;
only very short lines, which different documents share by chance, must also be frequent for their host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleflow.llm.hashing import SPACE, chunks, shingle_hashes, word_hashes
from aisleflow.llm.skew import lookup
from aisleflow.llm.storage import materialize, without

# The characters counted as symbols.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_hash(line: bytes) -> int:
    """Hash of a line with ASCII letters lowered and white space collapsed."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def repeated_words(windows: np.ndarray) -> int:
    """Words that lie in three-word windows found twice or more, given the windows' hashes."""
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows) + 2, bool)
    hit = np.concatenate((order[1:][same], order[:-1][same]))
    for j in range(3):
        again[hit + j] = True
    return int(again.sum())


def _figures(texts: pa.Array) -> list[list]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words on all copies of
    those lines in the text, words of one."""
    rows = []
    for raw, offsets in chunks(texts):
        words, firsts = word_hashes(raw, offsets, fold=False)
        windows, ends = shingle_hashes(words, firsts, 3)
        # a sum over each text, from running sums
        total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
        chars, symbols = total(~SPACE[raw] & ((raw & 0xC0) != 0x80)), total(SYMBOL[raw])
        data = raw.tobytes()
        for d in range(len(offsets) - 1):
            n = int(firsts[d + 1] - firsts[d])
            lines = [x for x in data[offsets[d] : offsets[d + 1]].split(b"\n") if x.strip()]
            held: dict[int, int] = {}
            sizes: dict[int, int] = {}
            for x in lines:
                h = line_hash(x)
                sizes[h] = len(x.split())
                held[h] = held.get(h, 0) + sizes[h]
            rows.append([n, int(chars[d]), int(symbols[d]), len(lines) - len(set(lines)), repeated_words(windows[ends[d] : ends[d + 1]]) if n > 2 else 0, list(held), list(held.values()), list(sizes.values())])
    return rows


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            columns = list(zip(*_figures(part.column(3)), strict=True))
            yield pa.RecordBatch.from_arrays(part.columns[:3] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "host", "text_key", *FIGURES, "lines", "line_words", "line_sizes"])


def line_report(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_share: float = 0.1, min_documents: int = 20, short: int = 3, max_removed: float = 0.5, min_words: int = 50, max_repeat: float = 0.5,
) -> DataFrame:
    """One row per document: doc_id, host, text_key, the base figures, base_failed, removed_words,
    removed (hashes of its removed lines) and kept.

    A line is removed where more than ``min_documents`` of the distinct texts of its host hold it; one of
    ``short`` words or fewer only where that is also more than ``max_share`` of them. base_failed: fewer than ``min_words`` words, or more than
    ``max_repeat`` of them in repeated three-word windows. kept: not base_failed and not depleted, which
    is to have more than ``max_removed`` of the words on removed lines, or fewer than ``min_words`` beside
    them. Equal texts of a host count as one document, so a
    page that was crawled often does not turn its own lines into boilerplate.

    Edge cases: null and empty texts have figures of 0 and fail; a null host is a host of its own;
    null ids and repeated rows each have their row; an empty frame gives an empty frame; further
    columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, host string, text_key long, " + ", ".join(f"{c} long" for c in FIGURES) + ", lines array<long>, line_words array<long>, line_sizes array<long>"
    seen = materialize(rows.mapInArrow(_measure, schema).withColumn("row", F.monotonically_increasing_id()), "lines")

    each = seen.select("host", "text_key", F.explode(F.arrays_zip("lines", "line_sizes")).alias("x")).select("host", "text_key", F.col("x.lines").alias("line"), F.col("x.line_sizes").alias("size"))
    counted = each.groupBy("host", "line", "text_key").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    held = counted.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.sum("rows").alias("held")).where(F.col("n") > min_documents)
    sizes = seen.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("host", "of_host")
    common = held.join(sizes, F.col("host").eqNullSafe(F.col("of_host"))).where((F.col("size") > short) | (F.col("n") > F.col("of") * max_share))
    place = F.xxhash64("line", F.coalesce("host", F.lit("")), F.col("host").isNull()).alias("place")
    common = materialize(common.select(place, "held").groupBy("place").agg(F.sum("held").alias("held")), "common-lines")
    spread = seen.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")).withColumn("place", place)
    gone = lookup(spread, common, "place", "held", "inner").groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))

    out = seen.drop("lines", "line_words", "line_sizes").join(gone, "row", "left").drop("row")
    out = out.withColumns({
        "removed_words": F.coalesce("removed_words", F.lit(0).cast("long")), "removed": F.coalesce("removed", F.array().cast("array<long>")),
        "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat),
    })
    gone = F.col("removed_words")
    depleted = (gone > F.col("n_words") * max_removed) | ((gone > 0) & (F.col("n_words") - gone < min_words))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(text: str | None, removed) -> str | None:
    if not text or removed is None or not len(removed):
        return text
    gone = set(removed)
    return "\n".join(x for x in text.split("\n") if not (b := x.encode()).strip() or line_hash(b) not in gone)


def clean(docs: DataFrame, report: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The kept documents of a :func:`line_report` with their removed lines taken out of ``text``."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        return pa.array([without_lines(t, r) for t, r in zip(texts.to_pylist(), removed.to_pylist(), strict=True)], pa.string())

    verdict = report.where("kept").select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_key").alias("_key"), F.col("removed").alias("_removed")).dropDuplicates(["_id", "_host", "_key"])
    same = F.col(key).cast("long").eqNullSafe(F.col("_id")) & F.col(host).cast("string").eqNullSafe(F.col("_host")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_key"))
    return without(docs, "_id", "_host", "_key", "_removed").join(verdict, same).withColumn(text, cut(F.col(text), F.col("_removed"))).drop("_id", "_host", "_key", "_removed")
