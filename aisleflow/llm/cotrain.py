"""Quality classifier by co-training two views of a document.

One logistic model sees only the text, one only the metadata (source, language, length). Both start
from the same labelled rows. In every round each labels the unlabelled documents it is surest of and
hands them to the other. At the end both are calibrated on labelled rows that neither was trained on,
and their log odds are added to score every document.

Training takes a bounded sample of labelled rows, chosen by the hash of their id, and all unlabelled
documents: their features are written once, every pass over them runs in Spark, and only counts and
sums (gradient and Hessian of a Newton step) reach the driver. Which documents have been handed over
follows from the models and cuts of the rounds so far, so no pass writes anything.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleflow.llm.storage import drop, materialize, shuffled, without

#: Bound of the labelled sample.
LABELLED = 6000
#: Bits of the key that orders documents by their odds (of which 19 after the point) and id hash, and bits settled by a pass.
ODDS_BITS, HASH_BITS, STEP_BITS = 24, 24, 12
HASHED = 64  # buckets of hashed source and language values
KINDS = [list(x) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r", b".,;:", b"!?", b"|", b"#*$%&", b"<>{}[]()=/\\_", b"'\"-")]
TEXT_FEATURES = len(KINDS) + 7


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row per text: shares of kinds of bytes, length, word length, repetition of words and lines."""
    out = np.zeros((len(texts), TEXT_FEATURES))
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode()
        if not raw:
            continue
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        row[: len(KINDS)] = [seen[k].sum() / len(raw) for k in KINDS]
        words, lines = raw.split(), raw.split(b"\n")
        n = len(words)
        row[len(KINDS) :] = (
            seen[128:].sum() / len(raw), np.log1p(n), len(raw) / (n + 1), len(set(words)) / (n + 1), len(set(lines)) / len(lines),
            seen[[33, 35, 36, 37, 38, 42, 124]].sum() / (n + 1), sum(map(eq, words, words[1:])) / (n + 1),
        )
    return out


def bucket(kind: str, value: str | None) -> int:
    return zlib.crc32(f"{kind}{value}".encode()) % HASHED


def page_rows(sources: np.ndarray, langs: np.ndarray, lengths: list[int | None]) -> np.ndarray:
    """Page features from the buckets of source and language."""
    out = np.zeros((len(sources), HASHED + 3))
    at = np.arange(len(out))
    out[at, sources] = 1
    out[at, langs] = 1
    n = np.array([x or 0 for x in lengths], float)
    out[:, HASHED] = np.log1p(np.maximum(n, 0))
    out[:, HASHED + 1] = [x is None for x in lengths]
    out[:, HASHED + 2] = n < 200
    return out


def page_features(sources: list[str | None], langs: list[str | None], lengths: list[int | None]) -> np.ndarray:
    """One row per document: hashed source and language, and the length."""
    return page_rows(np.array([bucket("s", s) for s in sources], int), np.array([bucket("l", g) for g in langs], int), lengths)


@dataclass
class Logistic:
    """A ridge logistic model on standardised features, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step * min(1, 10 / (1e-12 + abs(step).max()))
            if abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds, bounded."""
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)


@dataclass
class CoTrained:
    text: Logistic
    page: Logistic
    text_scale: Logistic  # calibration: log odds to log odds
    page_scale: Logistic
    prior: float

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by text, by page and by both."""
        a, b = self.text_scale.odds(self.text.odds(x)[:, None]), self.page_scale.odds(self.page.odds(m)[:, None])
        p = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        return p(a), p(b), p(a + b - self.prior)


def _held(y: np.ndarray) -> np.ndarray:
    """Which labelled rows are held back for calibration: one fifth, none if that leaves a class out."""
    held = np.arange(len(y)) % 5 == 4
    return held if len(np.unique(y[~held])) == 2 == len(np.unique(y[held])) else np.zeros(len(y), bool)


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_m: np.ndarray, rounds: int = 3, share: float = 0.1, sure: float = 0.95) -> CoTrained:
    """Fit both views. ``y`` is 0 or 1 for the labelled rows (x, m); one fifth of them is held back for
    calibration. In each of ``rounds`` a view hands over, for each class, at most ``share`` of the pool
    divided like the labels, and only rows it is ``sure`` of."""
    held = _held(y)
    own = {"text": (x[~held], y[~held]), "page": (m[~held], y[~held])}
    views, free = {"text": pool_x, "page": pool_m}, {"text": np.ones(len(pool_x), bool), "page": np.ones(len(pool_x), bool)}
    good = y.mean()
    for _ in range(rounds):
        models = {v: Logistic.fit(*own[v]) for v in own}
        for giver, taker in (("text", "page"), ("page", "text")):
            if not len(pool_x):
                continue
            odds = models[giver].odds(views[giver])
            for label, part in ((1, good), (0, 1 - good)):
                toward = odds if label else -odds
                at = np.flatnonzero(free[taker] & (toward > np.log(sure / (1 - sure))))
                at = at[np.argsort(-toward[at], kind="stable")][: int(share * part * len(pool_x))]
                free[taker][at] = False
                own[taker] = (np.concatenate((own[taker][0], views[taker][at])), np.concatenate((own[taker][1], np.full(len(at), label))))
    models = {v: Logistic.fit(*own[v]) for v in own}
    return _calibrated(models, x, m, y, held if held.any() else np.ones(len(y), bool))


VIEWS = {"text": TEXT_FEATURES, "page": HASHED + 3}
GIVERS = (("text", "page"), ("page", "text"))


def _views(docs: DataFrame) -> DataFrame:
    """(doc_id, x, s, g, n): text features, buckets of source and language, and length of documents."""

    @F.arrow_udf("binary")
    def text(t: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for i in range(0, len(t), 512) for row in text_features(t.slice(i, 512).to_pylist())], pa.binary())

    def place(kind: str):
        return F.arrow_udf(lambda v: pa.array([bucket(kind, x) for x in v.to_pylist()], pa.int32()), "int")

    own = docs.select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")], F.col("n_chars").cast("long").alias("n"))
    return own.select("doc_id", text("text").alias("x"), place("s")("source").alias("s"), place("l")("lang").alias("g"), "n")


def _matrices(x: list[bytes], s: np.ndarray, g: np.ndarray, n: list[int | None]) -> dict[str, np.ndarray]:
    return {"text": np.frombuffer(b"".join(x)).reshape(len(x), TEXT_FEATURES), "page": page_rows(s, g, n)}


def _keys(toward: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Larger for surer documents and, of equally sure ones, for smaller hashes."""
    odds = np.minimum((np.maximum(toward, 0) * 2**19).astype(np.int64), (1 << ODDS_BITS) - 1)
    return odds << HASH_BITS | ((1 << HASH_BITS) - 1 - ((tie >> (64 - HASH_BITS)) + (1 << HASH_BITS - 1)))


def _offers(models: dict[str, Logistic], rows: dict[str, np.ndarray], given: dict[str, np.ndarray], tie: np.ndarray, sure: float):
    """(taker, label, keys of the rows, which of them the giver is sure of and the taker has not)."""
    for giver, taker in GIVERS:
        odds = models[giver].odds(rows[giver])
        for label in (1, 0):
            toward = odds if label else -odds
            yield taker, label, _keys(toward, tie), (given[taker] < 0) & (toward > np.log(sure / (1 - sure)))


def _given(rounds: list, rows: dict[str, np.ndarray], tie: np.ndarray, sure: float) -> dict[str, np.ndarray]:
    """The label that each view was given for each row in the rounds so far, -1 for none."""
    given = {v: np.full(len(tie), -1) for v in VIEWS}
    for models, cuts in rounds:
        for taker, label, keys, free in list(_offers(models, rows, given, tie, sure)):
            given[taker][free & (keys >= cuts[taker, label])] = label
    return given


def _total(table: DataFrame, part: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``table`` of what ``part`` gives for a block of them, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                rows = _matrices(b.column("x").to_pylist(), b.column("s").to_numpy(), b.column("g").to_numpy(), b.column("n").to_pylist())
                out += part(rows, b.column("tie").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    parts = table.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    return parts.treeAggregate(np.zeros(size), np.add, np.add)


def _cuts(table: DataFrame, rounds: list, models: dict[str, Logistic], most: dict[int, int], sure: float) -> dict[tuple[str, int], int]:
    """For each taker and label the smallest key handed over, so that at most ``most[label]`` documents
    of the whole table are: found by counts of leading bits, ``STEP_BITS`` more in each pass."""
    offers = [(taker, label) for _, taker in GIVERS for label in (1, 0)]
    prefix, room, wide = dict.fromkeys(offers, 0), {o: most[o[1]] for o in offers}, 1 << STEP_BITS
    settled: dict[tuple[str, int], int] = {o: 1 << 62 for o in offers if room[o] <= 0}
    for shift in range(ODDS_BITS + HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        if len(settled) == len(offers):
            break
        above = dict(prefix)

        def counts(rows, tie, shift=shift, above=above):
            out = np.zeros((len(offers), wide))
            for k, (taker, label, keys, free) in enumerate(_offers(models, rows, _given(rounds, rows, tie, sure), tie, sure)):
                here = keys[free & (keys >> (shift + STEP_BITS) == above[taker, label])]
                out[k] = np.bincount((here >> shift) & (wide - 1), minlength=wide)
            return out.ravel()

        found = _total(table, counts, len(offers) * wide).reshape(len(offers), wide)
        for k, o in enumerate(offers):
            if o in settled:
                continue
            down = np.cumsum(found[k][::-1])  # documents in the bin and above
            bins = int(np.searchsorted(down, room[o], side="right"))  # whole bins, from the top, that fit
            low = prefix[o] << STEP_BITS
            if bins == wide or shift == 0 or (bins and down[bins - 1] == room[o]):
                settled[o] = (low + wide - bins) << shift
            else:
                room[o] -= int(down[bins - 1]) if bins else 0
                prefix[o] = low + wide - 1 - bins
    return settled


def _fit(own: dict[str, tuple[np.ndarray, np.ndarray]], table: DataFrame, rounds: list, sure: float, ridge: float = 1.0) -> dict[str, Logistic]:
    """:meth:`Logistic.fit` of both views over their labelled rows and the documents they were given."""

    def total(part, sizes):
        cut = sizes["text"]

        def block(rows, tie):
            given = _given(rounds, rows, tie, sure)
            return np.concatenate([part(v, rows[v][given[v] >= 0], given[v][given[v] >= 0]) for v in VIEWS])

        sums = _total(table, block, sum(sizes.values())) + np.concatenate([part(v, *own[v]) for v in VIEWS])
        return {"text": sums[:cut], "page": sums[cut:]}

    centre = {v: own[v][0].mean(axis=0) for v in VIEWS}

    def moments(v, x, y):
        d = x - centre[v]
        return np.concatenate(([len(x)], d.sum(axis=0), (d * d).sum(axis=0)))

    found, out = total(moments, {v: 1 + 2 * k for v, k in VIEWS.items()}), {}
    for v, k in VIEWS.items():
        n, first, second = found[v][0], found[v][1 : k + 1], found[v][k + 1 :]
        scale = np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))
        scale[scale < 1e-9] = 1
        out[v] = Logistic(centre[v] + first / n, scale, np.zeros(k + 1))
    for _ in range(30):
        now = {v: Logistic(m.mean, m.scale, m.weights.copy()) for v, m in out.items()}

        def step_sums(v, x, y, now=now):
            z = np.c_[np.ones(len(x)), (x - now[v].mean) / now[v].scale]
            p = 1 / (1 + np.exp(-np.clip(z @ now[v].weights, -30, 30)))
            return np.concatenate((z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()))

        found, largest = total(step_sums, {v: (k + 1) * (k + 2) for v, k in VIEWS.items()}), 0.0
        for v, k in VIEWS.items():
            penalty = np.full(k + 1, ridge)
            penalty[0] = 1e-6
            step = np.linalg.solve(found[v][k + 1 :].reshape(k + 1, k + 1) + np.diag(penalty), found[v][: k + 1] - penalty * now[v].weights)
            step *= min(1, 10 / (1e-12 + abs(step).max()))
            out[v].weights += step
            largest = max(largest, abs(step).max())
        if largest < 1e-6:
            break
    return out


def _calibrated(models: dict[str, Logistic], x: np.ndarray, m: np.ndarray, y: np.ndarray, on: np.ndarray) -> CoTrained:
    scale = {v: Logistic.fit(models[v].odds(rows[on])[:, None], y[on]) for v, rows in (("text", x), ("page", m))}
    smooth = (y[on].sum() + 1) / (on.sum() + 2)
    return CoTrained(models["text"], models["page"], scale["text"], scale["page"], float(np.log(smooth / (1 - smooth))))


def co_train_table(x: np.ndarray, m: np.ndarray, y: np.ndarray, table: DataFrame, rounds: int = 3, share: float = 0.1, sure: float = 0.95) -> CoTrained:
    """:func:`co_train` with all rows of ``table`` (x, s, g, n, tie) as the pool, which stays in Spark."""
    held = _held(y)
    own = {"text": (x[~held], y[~held]), "page": (m[~held], y[~held])}
    size, good = table.count(), y.mean()
    most = {1: int(share * good * size), 0: int(share * (1 - good) * size)}
    models, past = {v: Logistic.fit(*own[v]) for v in own}, []
    for _ in range(rounds if size else 0):
        past.append((models, _cuts(table, past, models, most, sure)))
        models = _fit(own, table, past, sure)
    return _calibrated(models, x, m, y, held if held.any() else np.ones(len(y), bool))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED) -> CoTrained | None:
    """A model from at most ``labelled`` labelled documents, those with the smallest hashes of their ids,
    and all documents without a label. None if the labels hold fewer than two classes."""
    order = F.xxhash64("doc_id", F.lit("quality"))
    said = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"), F.max(label).cast("double").alias("y2")).where("y = y2").select("doc_id", "y")
    picked = said.orderBy(order, "doc_id").limit(labelled)
    one = lambda rows: rows.groupBy("doc_id").agg(F.min(F.struct("x", "s", "g", "n")).alias("v")).select("doc_id", "v.*")
    every = materialize(one(_views(docs.where("doc_id is not null"))).withColumn("tie", order), "views")
    rows = every.join(picked, "doc_id").orderBy("tie", "doc_id").toPandas()
    if rows["y"].nunique() < 2:
        drop(every)
        return None
    rest = materialize(every.join(shuffled(said), "doc_id", "left_anti"), "unlabelled")
    drop(every)
    mine = _matrices(list(map(bytes, rows["x"])), rows["s"].to_numpy(), rows["g"].to_numpy(), [None if n != n else int(n) for n in rows["n"]])
    model = co_train_table(mine["text"], mine["page"], rows["y"].to_numpy(), rest)
    drop(rest)
    return model


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with text_score, page_score, quality_score (probabilities of good quality) and kept.

    Edge cases: without a model (labels of one class only) the scores are null and all are kept; null
    texts, sources, languages and lengths are values of their own kind; repeated rows and null ids are
    scored like others; columns named like the added ones are replaced; empty frames stay empty.
    """
    added = ["text_score", "page_score", "quality_score", "kept", "_s"]
    base = without(docs, *added)
    if model is None:
        return base.withColumns({c: F.lit(None).cast("double") for c in added[:3]} | {"kept": F.lit(True)})

    @F.arrow_udf("text double, page double, both double")
    def run(t: pa.Array, s: pa.Array, g: pa.Array, n: pa.Array) -> pa.Array:
        x = np.concatenate([text_features(t.slice(i, 512).to_pylist()) for i in range(0, len(t), 512)]) if len(t) else np.zeros((0, TEXT_FEATURES))
        parts = model.scores(x, page_features(s.to_pylist(), g.to_pylist(), n.to_pylist()))
        return pa.StructArray.from_arrays([pa.array(p) for p in parts], ["text", "page", "both"])

    as_text = lambda c: F.col(c).cast("string")
    base = base.withColumn("_s", run(as_text("text"), as_text("source"), as_text("lang"), F.col("n_chars").cast("long")))
    return base.withColumns({"text_score": F.col("_s.text"), "page_score": F.col("_s.page"), "quality_score": F.col("_s.both"), "kept": F.col("_s.both") >= threshold}).drop("_s")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """:func:`train` and :func:`score`: all ``docs`` scored by a model of their labelled part."""
    return score(docs, train(docs, labels, label), threshold)
