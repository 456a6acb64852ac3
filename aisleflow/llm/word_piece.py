"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie. Every node has a failure link and the number of pieces popped on the way:
following it means that so many pieces are now certain. A word is read once, character by character,
and only counts are kept; no piece is ever built. Many words step through the automaton together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.llm.bpe import read_ranks
from aisleflow.llm.storage import without

#: Words remembered by a worker, and texts handled at a time.
MEMO, SLICE = 500_000, 128


class Automaton:
    """Pieces that open a word start with ``mark``, all others continue it. A word that cannot be
    built from pieces counts as one unknown piece."""

    def __init__(self, pieces: Iterable[bytes], mark: bytes = b" "):
        self.mark = mark
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if (below := children[at].get(c)) is None:
                    below = children[at][c] = len(children)
                    children.append({})
                    whole.append(False)
                at = below
            whole[at] = at > 0
        fail, pops = [-1] * len(children), [0] * len(children)
        level = [(0, c, v) for c, v in children[0].items()]
        while level:  # nodes by depth: links only lead to shorter ones
            for u, c, v in level:
                if whole[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                n, z = pops[u], fail[u]
                while z >= 0 and c not in children[z]:
                    n, z = n + pops[z], fail[z]
                pops[v] = n
                if z >= 0:
                    fail[v] = children[z][c]
            level = [(v, c, w) for _, _, v in level for c, w in children[v].items()]
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        inner = [v for v, below in enumerate(children) if below]
        self.row = np.zeros(len(children), np.int64)  # row 0: no children
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.full((len(inner) + 1, 256), -1, np.int32)
        for r, v in enumerate(inner, 1):
            self.next[r, list(children[v])] = list(children[v].values())
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        data = np.frombuffer(b"".join(self.mark + words[i] for i in order), np.uint8)
        lengths = np.array([len(words[i]) + len(self.mark) for i in order], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        state, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        dead = np.zeros(len(words), bool)

        def pop(at: np.ndarray) -> np.ndarray:
            """Follow the failure links of these words; those that have none are unknown."""
            lost = self.fail[state[at]] < 0
            dead[at[lost]] = True
            at = at[~lost]
            n[at] += self.pops[state[at]]
            state[at] = self.fail[state[at]]
            return at

        for step in range(int(lengths.max(initial=0))):
            at = np.arange(np.searchsorted(-lengths, -step, side="left"))
            at = at[~dead[at]]
            while len(at):
                to = self.next[self.row[state[at]], data[starts[at] + step]]
                go = to >= 0
                state[at[go]] = to[go]
                at = pop(at[~go])
        at = np.flatnonzero(~dead & (state > 0))
        while len(at):
            at = pop(at)
            at = at[state[at] > 0]
        n[dead] = 1
        out = np.empty(len(words), np.int64)
        out[order] = n
        return out

    def totals(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, pieces) of each text; words are split at ASCII white space."""
        split = [t.split() for t in texts]
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        new = []
        for w in set().union(*split).difference(self.young):
            if (known := self.old.get(w)) is not None:
                self.young[w] = known
            else:
                new.append(w)
        self.young.update(zip(new, self.counts(new).tolist(), strict=True))
        sizes = [len(words) for words in split]
        each = np.fromiter(map(self.young.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(sizes))
        sums = np.diff(np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(sizes)))])
        return list(zip(sizes, sums.tolist(), strict=True))


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(read_ranks(path))


def piece_counts(text: Column, path: str) -> Column:
    """struct(n_words, n_tokens) of a text column, by the vocabulary in a rank file in which pieces that open a word start with a space."""

    @F.arrow_udf("n_words long, n_tokens long")
    def run(batch: pa.Array) -> pa.Array:
        a, out = automaton(path), []
        for i in range(0, len(batch), SLICE):
            out += a.totals([(t or "").encode() for t in batch.slice(i, SLICE).to_pylist()])
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["n_words", "n_tokens"])

    return run(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_words and n_tokens, the words of each whole text and their greedy pieces.

    Edge cases: null and empty texts have no words and no tokens; a word that the vocabulary cannot
    build counts as one token; null columns and repeated rows pass unchanged; input columns named like
    the added ones are replaced; an empty frame gives an empty frame. No shuffle.
    """
    counted = without(docs, "n_words", "n_tokens", "_counts").withColumn("_counts", piece_counts(F.col(text).cast("string"), path))
    return counted.withColumns({"n_words": F.col("_counts.n_words"), "n_tokens": F.col("_counts.n_tokens")}).drop("_counts")
