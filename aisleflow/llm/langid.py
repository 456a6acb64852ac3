"""Language identification by interpolated Kneser-Ney models of characters.

Every language has one model of the characters of its words. The highest order uses counts, all lower ones
the number of different characters seen before; each order is discounted and what that frees goes to
the order below, down to a uniform share of the alphabet. A model lies in sorted arrays of hashes: those of
the grams with their discounted probability, those of the contexts with the weight of the order below.
Grams of more than ``GRAMS`` stay in a table: tasks then hold the costs of the most frequent ones only, and
those of all others that the texts ask for are joined and added (``Parts``, ``joined``). Nothing is dropped.

A text's cross-entropy by each model is divided by its length; the lowest names the language. How sure
that is, and above which cross-entropy a text is none of the languages, is read off documents that
helper models, fitted without them, have scored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.llm.hashing import U, mix64
from aisleflow.llm.storage import drop, materialize, without

ORDER = 5
GRAMS = 1 << 22  # grams of all languages and orders that a model in memory holds at most; texts meet more of them by joins
MEMO = 300_000  # tokens remembered by a worker
ROWS = 1 << 16  # rows collected before they leave a task
CHARS = 1 << 26  # characters read before counts leave a task
UNKNOWN = "und"
PASSED = 0.995  # share of the calibration documents that are not rejected
STEP = 4  # bins of a unit in calibration
UNIT = 2.0**-30  # joined costs are whole multiples, so their sums do not depend on the order

_BASE = U(0x9E3779B97F4A7C15 | 1)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(token: str) -> list[str]:
    """The words of a token: runs of letters, lowered."""
    if token.isascii() and token.isalpha():
        return [token.lower()]
    return _WORD.findall(unicodedata.normalize("NFC", token).lower())


class Grams(NamedTuple):
    """The places in some words whose character is predicted, the end of a word among them."""

    chars: np.ndarray  # all words, each behind ORDER - 1 spaces and before one
    codes: np.ndarray  # of the characters
    at: np.ndarray  # the places
    firsts: np.ndarray  # the first place of each word

    def hashes(self, order: int, back: int = 0) -> np.ndarray:
        """Hashes of the ``order`` characters that end ``back`` before each place."""
        out = np.zeros(len(self.at), U)
        power = U(1)
        for j in range(order):
            out += self.codes[self.at - back - j] * power
            power = U((int(power) * int(_BASE)) & (2**64 - 1))
        return out


def grams(many: list[str]) -> Grams:
    lengths = np.fromiter(map(len, many), np.int64, len(many)) + 1
    pad = " " * (ORDER - 1)
    chars = np.frombuffer("".join(f"{pad}{w} " for w in many).encode("utf-32-le", "surrogatepass"), np.uint32)
    firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    at = np.arange(int(lengths.sum())) + np.repeat(np.arange(1, len(many) + 1) * (ORDER - 1), lengths)
    return Grams(chars, mix64(chars.astype(U)), at, firsts)


def key(hashes: np.ndarray, order: int | np.ndarray, context: bool | np.ndarray) -> np.ndarray:
    """Hashes that also tell the order, and grams from contexts; these may differ from row to row."""
    return mix64(hashes + np.atleast_1d(2 * order + context).astype(U) * U(0x632BE59BD9B4E019))


def gram_counts(many: Counter) -> list[tuple[str, int]]:
    """The grams of the highest order in words that occur so often."""
    if not many:
        return []
    g = grams(list(many))
    weights = np.repeat(np.fromiter(many.values(), np.int64, len(many)), np.diff(np.append(g.firsts, len(g.at))))
    _, where, each = np.unique(g.hashes(ORDER), return_index=True, return_inverse=True)
    sums = np.zeros(len(where), np.int64)
    np.add.at(sums, each, weights)
    spans = g.chars[g.at[where][:, None] - np.arange(ORDER - 1, -1, -1)]
    return list(zip([s.tobytes().decode("utf-32-le", "surrogatepass") for s in spans], sums.tolist(), strict=True))


def count(docs: DataFrame) -> DataFrame:
    """(lang, spare, gram, n): occurrences in ``docs`` (lang, spare, text), not summed up yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Counter] = {}
        read = 0

        def flush() -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for (lang, spare), tokens in seen.items():
                many: Counter = Counter()
                for token, n in tokens.items():
                    for w in words(token):
                        many[w] += n
                for gram, n in gram_counts(many):
                    for column, value in zip(out, (lang, spare, gram, n), strict=True):
                        column.append(value)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], ["lang", "spare", "gram", "n"])

        for batch in batches:
            for lang, spare, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.setdefault((lang, spare), Counter()).update((text or "").split())
                read += len(text or "")
                if read > CHARS or sum(map(len, seen.values())) > MEMO:
                    yield flush()
                    read = 0
        if seen:
            yield flush()

    return docs.select("lang", "spare", "text").mapInArrow(run, "lang string, spare boolean, gram string, n long")


class Model(NamedTuple):
    """Sorted hash arrays of each language: of grams with probabilities, of contexts with weights."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    alphabet: int

    def logs(self, g: Grams) -> np.ndarray:
        """-log p by language at each place."""
        p = np.full((len(self.langs), len(g.at)), 1 / self.alphabet)
        for order in range(1, ORDER + 1):
            own, before = key(g.hashes(order), order, False), key(g.hashes(order - 1, 1), order, True)
            for i in range(len(self.langs)):
                weight = _find(*self.contexts[i], before, -1.0)
                p[i] = np.where(weight < 0, p[i], _find(*self.grams[i], own, 0.0) + weight * p[i])
        return -np.log(p.T)

    def entropies(self, many: list[str], met: Met | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(characters, -log p by language) of each word; what ``met`` holds is not looked up again."""
        if not many:
            return np.zeros(0, np.int64), np.zeros((0, len(self.langs)))
        g, met = grams(many), met or Met(len(self.langs))
        hashes, where, each = np.unique(g.hashes(ORDER), return_index=True, return_inverse=True)
        logs = met.get(hashes, lambda new: self.logs(g._replace(at=g.at[where[new]])))
        return np.diff(np.append(g.firsts, len(g.at))), np.add.reduceat(logs[each], g.firsts)


class Met:
    """Figures of grams met before, in a sorted hash array."""

    def __init__(self, width: int):
        self.keys, self.logs = np.zeros(0, U), np.zeros((0, width))

    def get(self, hashes: np.ndarray, look_up: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The rows of sorted distinct ``hashes``; ``look_up`` gives those at new places."""
        at = np.searchsorted(self.keys, hashes)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            if len(self.keys) > 4 * MEMO:
                self.keys, self.logs = self.keys[:0], self.logs[:0]
                at, new = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
            self.logs = np.insert(self.logs, at[new], look_up(new), axis=0)
            self.keys = np.insert(self.keys, at[new], hashes[new])
            at = np.searchsorted(self.keys, hashes)
        return self.logs[at]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), absent)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], absent)


def orders(counts: DataFrame) -> DataFrame:
    """(lang, gram, n, k, context), written: the grams of all orders from ``counts`` (lang, gram, n), which
    holds each gram of the highest order once."""
    level = counts.select("lang", "gram", "n")
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append(level.withColumn("k", F.lit(order)))
        level = level.groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count("*").alias("n"))
    return materialize(reduce(DataFrame.unionByName, levels).withColumn("context", F.expr("substring(gram, 1, k - 1)")), "grams")


def languages(table: DataFrame) -> list[str]:
    return sorted(r[0] for r in table.select("lang").distinct().collect())


def letters(table: DataFrame) -> int:
    """Size of the alphabet: the characters of ``orders`` and one for all others."""
    return table.where("k = 1").select("gram").distinct().count() + 1


def rates(table: DataFrame, quota: int) -> DataFrame:
    """(lang, k, chars, ahead, value): of grams the discounted probability, of contexts (ahead) the weight
    of the order below. Discounts are n1 / (n1 + 2 n2) of each language and order, 0.5 where a count is
    missing. Every language and order has its most frequent grams, ``quota`` at most."""
    sizes = table.groupBy("lang", "k", "n").agg(F.count("*").alias("of"))
    falling = Window.partitionBy("lang", "k").orderBy(F.desc("n"))
    kept = sizes.withColumn("upto", F.sum("of").over(falling)).groupBy("lang", "k").agg(
        F.sum(F.when(F.col("n") == 1, F.col("of"))).alias("n1"), F.sum(F.when(F.col("n") == 2, F.col("of"))).alias("n2"),
        F.min(F.when(F.col("upto") <= quota, F.col("n"))).alias("least"),
    )
    discount = F.coalesce(F.col("n1") / (F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    ruled = kept.select("lang", "k", discount.alias("d"), F.coalesce("least", F.lit(2**62)).alias("least"))
    totals = table.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    held = table.join(ruled, ["lang", "k"]).where("n >= least").join(totals, ["lang", "k", "context"])
    own = held.select("lang", "k", F.col("gram").alias("chars"), F.lit(False).alias("ahead"), ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
    weight = (F.col("total") - (F.sum("n") - F.col("d") * F.count("*"))) / F.col("total")  # what the kept grams leave
    ahead = held.groupBy("lang", "k", F.col("context").alias("chars"), "d", "total").agg(weight.alias("value")).select("lang", "k", "chars", F.lit(True).alias("ahead"), "value")
    return own.unionByName(ahead)


def fit(counts: DataFrame) -> Model:
    """The models of all languages from ``counts`` (lang, gram, n), which holds each gram once.

    All grams are held while they are ``GRAMS`` at most. Of more, every language and order keeps its most
    frequent ones, the same number for each; ``identify`` then reads them from their table (``joined``).
    Edge case: no counts give a model without languages.
    """
    table = orders(counts)
    model = held_model(table)
    drop(table)
    return model


def held_model(table: DataFrame) -> Model:
    """The model of ``orders`` in memory, as far as ``GRAMS`` allows."""
    langs, size = languages(table), table.count()
    quota = size if size <= GRAMS else GRAMS // max(1, ORDER * len(langs))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ks, chars, aheads, values = batch.columns
            order, ahead = ks.to_numpy().astype(U), aheads.to_numpy(zero_copy_only=False)
            out = key(_hashes(chars.to_pylist()), order, ahead)
            yield pa.RecordBatch.from_arrays([names, aheads, pa.array(out.view(np.int64)), values], ["lang", "ahead", "key", "value"])

    place = F.array_position(F.array(*map(F.lit, langs)) if langs else F.array(F.lit(None).cast("string")), F.col("lang")).cast("int")
    rows = rates(table, quota).withColumn("lang", place).mapInArrow(hashed, "lang int, ahead boolean, key long, value double").toArrow()
    places, is_ahead = rows["lang"].to_numpy(), rows["ahead"].to_numpy()
    keys, values = rows["key"].to_numpy().view(U), rows["value"].to_numpy()

    def part(i: int, which: bool) -> tuple[np.ndarray, np.ndarray]:
        mine = (places == i + 1) & (is_ahead == which)
        order = np.argsort(keys[mine], kind="stable")
        return keys[mine][order], values[mine][order]

    return Model(langs, [part(i, False) for i in range(len(langs))], [part(i, True) for i in range(len(langs))], letters(table))


def _hashes(many: list[str]) -> np.ndarray:
    """Hashes of strings of ``ORDER`` characters at most, those that ``Grams.hashes`` gives."""
    lengths = np.fromiter(map(len, many), np.int64, len(many))
    chars = np.frombuffer("".join([s.rjust(ORDER) for s in many]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = mix64(chars.astype(U)).reshape(-1, ORDER)
    out, power = np.zeros(len(many), U), U(1)
    for j in range(ORDER):
        out += np.where(lengths > j, codes[:, ORDER - 1 - j] * power, U(0))
        power = U((int(power) * int(_BASE)) & (2**64 - 1))
    return out


class Scorer:
    """Sums of texts by a model, with a memo of the tokens met last."""

    def __init__(self, model: Model):
        self.model, self.met = model, Met(len(model.langs))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.sums = np.zeros(0, np.int64), np.zeros((0, len(self.model.langs)))

    def learn(self, tokens: Iterable[str]) -> None:
        new = list(tokens)
        split = [words(t) for t in new]
        flat = [w for ws in split for w in ws]
        owner = np.repeat(np.arange(len(new)), [len(ws) for ws in split])
        lengths, sums = self.look(new, flat, owner)
        self.known.update((t, i) for i, t in enumerate(new, len(self.known)))
        added = np.zeros(len(new), np.int64)
        np.add.at(added, owner, lengths)
        more = np.zeros((len(new), len(self.model.langs)))
        np.add.at(more, owner, sums)
        self.lengths, self.sums = np.append(self.lengths, added), np.vstack((self.sums, more))

    def look(self, new: list[str], flat: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters, -log p by language) of the words ``flat``, each one of the token ``new[owner]``."""
        return self.model.entropies(flat, self.met)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, -log p by language) of each text."""
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > MEMO and self.known:
            self.clear()
            new = set().union(*split)
        if new:
            self.learn(new)
        sizes = np.array([len(s) for s in split], np.int64)
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        lengths, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), self.sums.shape[1]))
        if len(starts):
            lengths[sizes > 0], sums[sizes > 0] = np.add.reduceat(self.lengths[ids], starts), np.add.reduceat(self.sums[ids], starts)
        return lengths, sums


_SCORED = "chars long, best long, entropy double, margin double"


def scored(text: Column, model: Model, spark) -> Column:
    """struct(chars, best, entropy, margin): characters predicted, the place of the best language, its
    cross-entropy for a character and the distance to the second best. Null without letters."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_SCORED)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for part in parts:
            columns: list[list] = [[], [], [], []]
            for at in range(0, len(part), 256):
                lengths, sums = scorer.totals([t or "" for t in part.slice(at, 256).to_pylist()])
                if not sums.shape[1]:
                    lengths, sums = np.zeros_like(lengths), np.zeros((len(lengths), 1))
                each = sums / np.maximum(lengths, 1)[:, None]
                low = np.sort(each, axis=1)
                margin = low[:, 1] - low[:, 0] if low.shape[1] > 1 else np.full(len(low), np.inf)
                for column, values in zip(columns, (lengths, each.argmin(axis=1), low[:, 0], margin), strict=True):
                    column.append(values)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["chars", "best", "entropy", "margin"])

    return run(text)


class Head(NamedTuple):
    """Costs, -log p by language, of the most frequent grams of the highest order, by sorted hash."""

    langs: list[str]
    keys: np.ndarray
    costs: np.ndarray

    def split(self, many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(characters, known costs) of each word; (the place of the word, the gram) of each cost not known."""
        if not many:
            return np.zeros(0, np.int64), np.zeros((0, len(self.langs))), np.zeros(0, np.int64), []
        g = grams(many)
        hashes = g.hashes(ORDER)
        costs, open_ = np.zeros((len(g.at), len(self.langs))), np.ones(len(g.at), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            open_ = self.keys[at] != hashes
            costs = np.where(open_[:, None], 0.0, self.costs[at])
        places = np.flatnonzero(open_)
        _, where, each = np.unique(hashes[places], return_index=True, return_inverse=True)
        spans = g.chars[g.at[places[where]][:, None] - np.arange(ORDER - 1, -1, -1)]
        names = [s.tobytes().decode("utf-32-le", "surrogatepass") for s in spans]
        left = [names[i] for i in each.tolist()]
        return np.diff(np.append(g.firsts, len(g.at))), np.add.reduceat(costs, g.firsts), np.searchsorted(g.firsts, places, "right") - 1, left


class Parts(Scorer):
    """Sums of what a ``Head`` knows; ``open`` has the other grams of the tokens met last."""

    def clear(self) -> None:
        super().clear()
        self.open: dict[str, list[str]] = {}

    def look(self, new: list[str], flat: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths, sums, places, left = self.model.split(flat)
        for i, gram in zip(owner[places].tolist(), left, strict=True):
            self.open.setdefault(new[i], []).append(gram)
        return lengths, sums

    def left(self, text: str) -> Counter:
        return Counter(gram for token in text.split() for gram in self.open.get(token, ()))


def costs(asked: DataFrame, rated: DataFrame, langs: list[str], alphabet: int) -> DataFrame:
    """(gram, cost): -log p by language, in whole ``UNIT``, of the distinct grams ``asked`` of the highest
    order. One order follows the other, so a key of a join meets at most as many grams as there are characters."""
    below = None
    for k in range(1, ORDER + 1):
        ends = asked.select(F.substring("gram", ORDER + 1 - k, k).alias("chars")).distinct()
        ends = ends.select("chars", F.explode(F.array(*map(F.lit, langs))).alias("lang"), F.substring("chars", 1, k - 1).alias("context"), F.substring("chars", 2, ORDER).alias("rest"))
        own = rated.where(f"k = {k} and not ahead").select("lang", "chars", F.col("value").alias("own"))
        ahead = rated.where(f"k = {k} and ahead").select("lang", F.col("chars").alias("context"), F.col("value").alias("weight"))
        met = ends.join(own, ["lang", "chars"], "left").join(ahead, ["lang", "context"], "left")
        met = met.withColumn("below", F.lit(1 / alphabet)) if below is None else met.join(below, ["lang", "rest"])
        p = F.when(F.col("weight").isNull(), F.col("below")).otherwise(F.coalesce("own", F.lit(0.0)) + F.col("weight") * F.col("below"))
        below = met.select("lang", F.col("chars").alias("rest"), p.alias("below"))
    each = F.struct("lang", (F.rint(-F.ln("below") / UNIT) * UNIT).alias("cost"))
    return below.groupBy(F.col("rest").alias("gram")).agg(F.sort_array(F.collect_list(each)).alias("all")).select("gram", F.col("all.cost").alias("cost"))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """(gram): the most frequent grams of the highest order over all languages, ``most`` of them at most."""
    sums = table.where(F.col("k") == ORDER).groupBy("gram").agg(F.sum("n").alias("n")).withColumn("bin", F.floor(F.log2("n") * 8))
    least, room = 2**31 - 1, most
    for b, n in sorted(map(tuple, sums.groupBy("bin").agg(F.count("*")).collect()), reverse=True):
        if (room := room - n) < 0:
            break
        least = b
    return sums.where(F.col("bin") >= least).select("gram")


_PART = "digest binary, chars long, sums array<double>, gram string, n long"


def joined(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df`` with the column _s of ``scored`` for its column text, by all grams of ``orders`` however many.

    Tasks add up the costs of the most frequent grams in memory. What other grams a text holds goes to their
    costs by a join and is added. Texts of one content are one, known by their digest, and are not shuffled.
    """
    spark, langs, alphabet = df.sparkSession, languages(table), letters(table)
    rated = materialize(rates(table, 2**62), "rates")
    first = costs(frequent(table, GRAMS // (1 + len(langs))), rated, langs, alphabet).toArrow()
    keys, known = _hashes(first["gram"].to_pylist()), pc.list_flatten(first["cost"]).to_numpy().reshape(-1, len(langs))
    order = np.argsort(keys, kind="stable")
    shared = spark.sparkContext.broadcast(Head(langs, keys[order], known[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Parts(shared.value)
        types = pa.binary(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.int64()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["digest", "chars", "sums", "gram", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                digests, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                rows = [(d, n, sums, None, None) for d, n, sums in zip(digests, *(x.tolist() for x in scorer.totals(texts)), strict=True)]
                for d, t in zip(digests, texts, strict=True):
                    rows += [(d, None, None, gram, n) for gram, n in scorer.left(t).items()]
                    if len(rows) > ROWS:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    parts = materialize(df.select(digest.alias("digest"), text.alias("text")).mapInArrow(run, _PART), "parts")
    left = parts.where("gram is not null").select("digest", "gram", "n").distinct()
    asked = materialize(left.select("gram").distinct(), "asked")
    more = left.join(costs(asked, rated, langs, alphabet), "gram").groupBy("digest").agg(F.array(*[F.sum(F.col("n") * F.col("cost")[i]) for i in range(len(langs))]).alias("more"))
    sums = parts.where("gram is null").dropDuplicates(["digest"]).join(more, "digest", "left")
    each = F.transform("sums", lambda x, i: (x + F.coalesce(F.get("more", i), F.lit(0.0))) / F.greatest("chars", F.lit(1)))
    low, margin = F.array_min("each"), F.array_sort("each")[1] - F.array_min("each") if len(langs) > 1 else F.lit(float("inf"))
    figures = F.struct("chars", (F.array_position("each", low) - 1).alias("best"), low.alias("entropy"), margin.alias("margin"))
    found = materialize(sums.select("digest", "chars", each.alias("each")).select(F.col("digest").alias("_s"), figures.alias("_scores")), "scores")
    for spent in (rated, parts, asked):
        drop(spent)
    shared.unpersist()
    return df.withColumn("_s", digest).join(found, "_s").withColumn("_s", F.col("_scores")).drop("_scores")


def scoring(counts: DataFrame) -> tuple[list[str], Callable[[DataFrame], DataFrame]]:
    """(languages, what adds the column _s to a frame with a column text) from ``counts`` as in ``fit``."""
    table = orders(counts)
    if table.count() > GRAMS:
        return languages(table), lambda df: joined(df, table)
    model = held_model(table)
    drop(table)
    return model.langs, lambda df: df.withColumn("_s", scored(F.col("text").cast("string"), model, df.sparkSession))


class Calibration(NamedTuple):
    sure: list[float]  # probability of being right, by bin of the evidence
    most: list[float]  # cross-entropy above which a text is rejected, by bin of the length


def evidence(scores: str = "_s") -> Column:
    """The bin of the log odds between the two best languages."""
    odds = F.col(f"{scores}.margin") * F.col(f"{scores}.chars")
    return F.least(F.floor(F.log1p(odds) * STEP), F.lit(30 * STEP)).cast("int")


def size(scores: str = "_s") -> Column:
    return F.floor(F.log2(F.col(f"{scores}.chars"))).cast("int")


def calibrate(own: DataFrame, langs: list[str]) -> Calibration:
    """From ``own`` (lang, _s): pooled adjacent bins make the share of right answers rise with the
    evidence (one right and one wrong answer are added to each bin); cross-entropies are cut at the share
    ``PASSED`` of each length, those of shorter texts at least as high as those of longer ones."""
    named = F.element_at(F.array(*map(F.lit, langs)) if langs else F.array(F.lit(None).cast("string")), (F.col("_s.best") + 1).cast("int"))
    asked = own.where("_s.chars > 0")
    hits = {r[0]: (r[1], r[2]) for r in asked.groupBy(evidence().alias("bin")).agg(F.sum((named == F.col("lang")).cast("long")), F.count("*")).collect()}
    pools: list[list[float]] = []
    for b in range(30 * STEP + 1):
        right, n = hits.get(b, (0, 0))
        pools.append([right, n, 1])
        while len(pools) > 1 and _share(pools[-2]) >= _share(pools[-1]):
            right, n, width = pools.pop()
            pools[-1] = [pools[-1][0] + right, pools[-1][1] + n, pools[-1][2] + width]
    sure = [_share(p) for p in pools for _ in range(int(p[2]))]
    bins = asked.groupBy(size().alias("size"), F.floor(F.col("_s.entropy") * 100).alias("bin")).agg(F.count("*").alias("n")).collect()
    most, highest = [float("inf")] * 64, float("-inf")
    for s in range(63, -1, -1):
        mine = sorted((r["bin"], r["n"]) for r in bins if r["size"] == s)
        total, sofar = sum(n for _, n in mine), 0
        for b, n in mine:
            sofar += n
            if sofar >= PASSED * total:
                highest = max(highest, (b + 1) / 100)
                break
        most[s] = highest if highest > 0 else float("inf")
    return Calibration(sure, most)


def _share(pool: list[float]) -> float:
    return (pool[0] + 1) / (pool[1] + 2) if pool[1] else 0.5


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` with lang_pred, score, entropy and rejected.

    ``labelled`` (lang, text, spare boolean) is what the models learn from, all of it; the helper models
    that calibrate are fitted to its rows that are not spare and asked about the spare ones. lang_pred is
    always a learned language; ``rejected`` says that the text is less likely than nearly all documents of
    its length. score is the share of right answers at this distance between the two best languages.
    Edge cases: null texts and texts without letters are ``und`` with score 0, null entropy and are
    rejected; rows of ``labelled`` without a language teach nothing; without any, all texts are ``und``;
    ties go to the language first by name; repeated rows count again; input columns named like the added
    ones are replaced; an empty frame gives an empty frame. Texts are never shuffled.
    """
    taught = labelled.where("lang is not null").select("lang", F.coalesce("spare", F.lit(False)).alias("spare"), "text")
    counts = materialize(count(taught).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("spare"), F.col("n"))).alias("first")), "gram-counts")
    langs, add = scoring(counts.where("first > 0").select("lang", "gram", F.col("first").alias("n")))
    own = materialize(add(taught.where("spare").select("lang", "text")).select("lang", "_s"), "calibration")
    known = calibrate(own, langs)
    langs, add = scoring(counts)
    drop(counts)
    drop(own)
    look = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    found = add(without(docs, "lang_pred", "score", "entropy", "rejected", "_s", "_scores"))
    lettered = F.col("_s.chars") > 0
    return found.withColumns({
        "lang_pred": F.when(lettered, look(langs or [UNKNOWN], F.col("_s.best").cast("int"))).otherwise(UNKNOWN),
        "score": F.when(lettered, look(known.sure, evidence())).otherwise(0.0),
        "entropy": F.when(lettered, F.col("_s.entropy")),
        "rejected": F.when(lettered, F.col("_s.entropy") > look(known.most, size())).otherwise(True),
    }).drop("_s")
