import re
from collections import defaultdict

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    from aisleflow.llm.storage import importable

    importable(spark)


@pytest.fixture(scope="module", autouse=True)
def nothing_left(spark):
    """Written folders and cached frames end with each module."""
    from aisleflow.llm.storage import release

    yield
    release(spark)
    spark.catalog.clearCache()


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def components(texts, percent=85):
    """doc_id -> smallest doc_id reachable over links, all pairs compared."""
    sets = {d: shingles(t) for d, t in texts.items()}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for d in sorted(sets):
        todo = [d] if d not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = d
                todo += links[x]
    return out


@pytest.fixture(scope="session")
def small(spark):
    """200 documents of the supplied tables, with near copies, and odd rows among them."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables not present")
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and a column with a clashing name."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 6), (4, long, "en", "a", len(long)), (5, long, "en", None, len(long)), (None, "one two three", None, "b", 13),
        (None, None, None, None, None), (6, "same words here and there again", "en", "b", 31), (6, "same words here and there again", "en", "b", 31), (7, "same words here and there again", "fr", "c", 31),
        (8, "x" * 50_000, "en", "c", 50_000), (9, "émoji 😀 \u0000 \x85 naïve", "fr", "a", None),
    ]
    return spark.createDataFrame([(*r, True, 1.5) for r in rows], SCHEMA + ", kept boolean, taken double")
