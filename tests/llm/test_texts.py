"""Operators on single texts against plain Python."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import words  # noqa: I001

from aisleflow.llm import bpe, cotrain, hashing, licences, line_rules, spans, word_piece
from aisleflow.llm.queries import QUERIES

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"
ODD = ["", "a" * 5000, "<unk> ⁇unk <s> ▁▁", "  \n\n x  ", "it's 's  'll", "😀é\u0000\x85 b", " \x1c a\x1cb  \x1c!　　b", "\n", "don’t 12345 ½²"]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(tik):
    c, rng = bpe.codec(RANKS, PATTERN), random.Random(3)
    noise = ["".join(rng.choice("ab 'stZ\n\t.é½١😀 ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in ODD + noise:
        ids = c.encode(text)
        assert ids == tik.encode_ordinary(text), text
    back = c.decode_batch(c.encode_batch(ODD + noise))
    assert back.to_pylist() == [t.encode() for t in ODD + noise]


def test_bpe_with_a_tiny_memo(tik, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    c = bpe.Codec(RANKS, PATTERN)
    for text in ["the cat, the dog. the cats", "a b c d e f the cat!!", "the dog. again, the dog"] * 3:
        assert c.encode(text) == tik.encode_ordinary(text)


def test_bpe_query(spark, small, tik):
    got = {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = tik.encode_ordinary(t)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_odd_rows(spark, odd):
    rows = bpe.encode_documents(odd.withColumnRenamed("kept", "token_ids"), RANKS, PATTERN).collect()
    assert len(rows) == odd.count()
    assert all(r["token_ids"] == [] for r in rows if not r["text"])
    assert bpe.encode_documents(odd.limit(0), RANKS, PATTERN).count() == 0


def brute_pieces(word, vocabulary, mark=b" "):
    s, n = mark + word, 0
    while s:
        k = next((k for k in range(len(s), 0, -1) if s[:k] in vocabulary), 0)
        if not k:
            return 1
        s, n = s[k:], n + 1
    return n


def test_automaton_is_greedy():
    rng = random.Random(1)
    for _ in range(30):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        vocabulary |= {b" " + v for v in list(vocabulary)[::2]} | ({b" "} if rng.random() < 0.5 else set())
        some = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(200)]
        assert word_piece.Automaton(vocabulary).counts(some).tolist() == [brute_pieces(w, vocabulary) for w in some]


def test_word_piece_query(spark, small):
    vocabulary = set(bpe.read_ranks(RANKS))
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in QUERIES["op9_word_piece"](spark, SF).collect()}
    for r in small.collect():
        w = words(r["text"])
        assert got[r["doc_id"]] == (len(w), sum(brute_pieces(x.encode(), vocabulary) for x in w))


def test_word_piece_odd_rows(spark, odd):
    rows = word_piece.count_tokens(odd.withColumnRenamed("kept", "n_words"), RANKS).collect()
    assert len(rows) == odd.count()
    assert all((r["n_words"], r["n_tokens"]) == (0, 0) for r in rows if not (r["text"] or "").strip())
    assert word_piece.count_tokens(odd.limit(0), RANKS).count() == 0


def test_shingle_hashes_tell_sets_apart():
    from conftest import shingles

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "b", "cc", "D"]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", " \n"]
    sets = list(hashing.shingle_sets(pa.array(texts), 5))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    same = {}
    for t, s in zip(texts, sets, strict=True):
        assert same.setdefault(frozenset(shingles(t)), s.tobytes()) == s.tobytes()
    assert len(set(same.values())) == len(same)


def brute_figures(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    return [len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)]


def test_figures():
    texts = ["a b c a b c\nx\nx\n x", "é# | <b> b", None, "", "a", "a a a a a", "q w e r t y\n\n\nq w e", "one\ntwo\none\none"]
    assert [f[:5] for f in line_rules._figures(pa.array(texts))] == [brute_figures(t) for t in texts]


def test_line_rules_by_hand(spark):
    common = "common line of the site"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{common.upper()}  \n{body(i)}", "en", "h", 1) for i in range(30)]
    rows += [(100 + i, body(7777), "en", "h", 1) for i in range(50)]  # copies count once
    rows += [(200, f"{common}\n{common}\n" * 12 + " ".join(f"z{j}" for j in range(55)), "en", "h", 1), (300, f"{common}\n{body(300)}", "en", "other", 1), (400, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    report = line_rules.line_report(docs)
    got = {r["doc_id"]: r for r in report.collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 5 for i in range(30))
    assert all(got[100 + i]["kept"] and got[100 + i]["removed_words"] == 0 for i in range(50))
    assert not got[200]["kept"] and got[200]["removed_words"] == 120
    assert got[300]["kept"] and not got[300]["removed_words"]
    assert got[400]["base_failed"] and not got[400]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in line_rules.clean(docs, report).collect()}
    assert cleaned[3] == body(3) and cleaned[300] == f"{common}\n{body(300)}" and 200 not in cleaned


def test_line_rules_odd_rows(spark, odd):
    report = line_rules.line_report(odd)
    assert report.count() == odd.count()
    assert line_rules.clean(odd, report).count() == report.where("kept").count()
    assert line_rules.line_report(odd.limit(0)).count() == 0


def test_limit_does_not_grow_with_the_host(spark):
    """A line of several words in 5 % of thousands of texts goes, a short one stays; a document that is
    mostly such lines, or too little beside them, is rejected."""
    body = lambda i, n: " ".join(f"b{i}w{j}" for j in range(n))
    notices, short = [f"subscribe{k} to{k} our{k} weekly{k} letter{k} for{k} more{k} of{k} this{k}" for k in range(7)], "read more"
    notice = notices[0]
    rows = [(i, f"{body(i, 60)}\n{notices[i % 20]}\n{short}" if i % 20 < 7 else body(i, 60), "big") for i in range(3000)]
    rows = [(i, t.replace(f"\n{short}", "") if i % 20 else t, h) for i, t, h in rows]  # the short one in 5 %
    rows += [(9000, "\n".join(notices) + "\n" + body(9000, 60), "big"), (9001, f"{notice}\n{body(9001, 45)}", "big"), (9002, f"{notice}\n{body(9002, 52)}", "big")]
    got = {r.doc_id: r for r in line_rules.line_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].removed_words == 9 and got[0].kept and got[8].removed_words == 0
    assert [got[i].kept for i in (9000, 9001, 9002)] == [False, False, True] and not any(got[i].base_failed for i in (9000, 9001, 9002))


def test_line_rules_reject_depleted_documents(spark):
    """At a tenth of the scale factor some documents have too little beside common lines."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert line_rules.line_report(docs).where("not kept and not base_failed").count() > 0


def brute_spans(texts):
    """doc_id -> text without every stretch of whole sentences seen earlier that is long enough: some
    sentences with enough words in all, or one long sentence. Of the long ones, only stretches that cease
    to be long enough without their first or their last sentence are tried: they cover all others."""
    seen, out = {}, {}
    for d in sorted(texts):
        s = [x for x in re.findall(r"(?s).*?(?:(?<=[.!?])[\x20\x09-\x0D]+|[\n\r][\x20\x09-\x0D]*|$)", texts[d] or "") if x]
        w = [[re.sub("[A-Z]", lambda m: m[0].lower(), y) for y in words(x)] for x in s]
        said = [i for i, x in enumerate(w) if x]

        def enough(a, b):
            return b - a >= spans.SENTENCES and sum(len(w[i]) for i in said[a:b]) >= spans.WORDS

        gone = set()
        for a in range(len(said)):
            for b in range(a + 1, len(said) + 1):
                if enough(a + 1, b) and enough(a, b - 1):
                    break
                if enough(a, b) or b - a == 1 and len(w[said[a]]) >= spans.ALONE:
                    if seen.setdefault(tuple(y for i in said[a:b] for y in w[i]), (d, a, b)) != (d, a, b):
                        gone |= set(range(said[a], said[b - 1] + 1))
        out[d] = None if texts[d] is None else "".join(x for i, x in enumerate(s) if i not in gone)
    return out


def test_spans_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    got = {r["doc_id"]: r["text"] for r in QUERIES["op10_sentence_spans"](spark, SF).collect()}
    assert got == brute_spans(texts)
    assert got != texts


def test_spans_odd_rows(spark, odd):
    a, b = "First sentence has quite a lot of words in it. ", "The second one is also long enough to make up a run here. "
    more = spark.createDataFrame([(20, a + b + "Own end."), (21, "Own start. " + a + b), (22, a + b + a + b)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeated(more).collect()}
    assert got == {20: a + b + "Own end.", 21: "Own start. ", 22: ""}
    rows = spans.remove_repeated(odd.withColumnRenamed("kept", "n_removed")).collect()
    assert len(rows) == odd.count()
    assert spans.remove_repeated(odd.limit(0)).count() == 0


def test_spans_of_glued_passages(spark):
    """Passages that start or end inside a sentence of the host, and tails below the word floor."""
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n)) + ". "
    long, head, mid, tail = say("long", 47), say("head", 12), say("mid", 12), say("tail", 9)
    rows = [
        (1, "Start. " + say("six", 6) + long + "End."), (2, "Glued to " + say("six", 6) + long + "Other end."),  # one whole sentence
        (3, "Start. " + head + mid + tail + "End."), (4, "Own. " + head + mid + tail + "Quite another text follows here with its own words."),  # a tail below 20 words
        (5, "Start. " + say("p", 19) + "End."), (6, "Own. " + say("p", 19) + "Other."),  # one sentence below 20 words stays
    ]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {2: "Glued to " + say("six", 6) + "Other end.", 4: "Own. Quite another text follows here with its own words."}


def test_runs_cover_repeated_stretches():
    """Every repeated stretch of whole sentences is covered by the runs inside it."""
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.choice([1, 3, 8, 12, 19, 20, 30]) for _ in range(rng.randint(1, 9))]
        said = [" ".join(f"s{i}w{j}" for j in range(n)) + ". " for i, n in enumerate(sizes)]
        a = rng.randrange(len(sizes))
        b = rng.randint(a + 1, len(sizes))
        once, again = ({h: (i, n) for i, n, h in spans.runs(t)} for t in ("".join(said), "New. " + "".join(said[a:b]) + "Other."))
        covered = {x - 1 + a for h in once.keys() & again.keys() for x in range(again[h][0], sum(again[h]))}
        whole = sum(sizes[a:b]) >= spans.WORDS and (b - a >= spans.SENTENCES or sizes[a] >= spans.ALONE)
        assert covered == (set(range(a, b)) if whole else set()), (sizes, a, b)


def test_licences_by_hand(spark, odd):
    t = licences.templates(spark)
    docs = spark.createDataFrame([
        (1, "some text\nReleased  under the MIT Licence.\nmore"), (2, "licensed under the apache license version 2 0"), (3, "prose\n" * 50 + "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under the\nApache License,\nVersion 2.0."), (5, "the License is under discussion"), (6, None), (7, ""), (None, "Released under the MIT License."),
    ], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["line"]) for r in licences.scan(docs, t, threshold=0.7).collect()}
    assert got == {1: ("MIT", 1), 2: ("Apache-2.0", 0), 3: ("GPL-3.0", 50), 4: ("Apache-2.0", None), 5: (None, None), 6: (None, None), 7: (None, None), None: ("MIT", 0)}
    assert licences.scan(docs, t).where("doc_id = 1 and licence is null").count() == 1
    assert licences.scan(odd, t).count() == odd.select("doc_id").distinct().count()
    assert licences.scan(odd.limit(0), t).count() == 0
    assert licences.scan(docs, t.limit(0)).where("licence is not null").count() == 0


def test_licence_windows(spark):
    """Notices over several lines, within a line, and paragraphs of full texts, by brute force over all windows."""
    t = licences.templates(spark)
    grant = licences.TEMPLATES["MIT"][-1]
    wrapped = "\n * ".join(" ".join(grant.split()[i : i + 9]) for i in range(0, len(grant.split()), 9))
    words = [f"w{i}" for i in range(60)]
    prose, gpl = " ".join(words), licences.TEMPLATES["GPL-3.0"][1].split()
    docs = {
        1: f"{prose}\n/*\n * {wrapped}\n */\n{prose}",
        2: f"{prose} Released under the MIT License. {prose}",
        3: f"{prose}\nThis work is licensed under the GNU\nGeneral Public License, version 3. {prose}",
        4: prose + "\n" + " ".join(x if i % 25 else "changed" for i, x in enumerate(gpl)) + " " + prose,
        5: "Released under a license. " * 30 + "the MIT License. " * 400,
        6: f"{prose} Released under the MIT", 7: "the " * 3000 + "Licensed under CC BY 4.0 " * 50, 8: prose,
    }
    from collections import Counter

    def brute(text):
        units = [(i, licences_words(x)) for i, x in enumerate(text.split("\n"))]
        flat = [(i, w) for i, ws in units for w in ws]
        every = [(i, ws) for i, ws in units if len(ws) > 1]
        if sum(bool(ws) for _, ws in units) > 1:
            every.append((None, [w for _, w in flat]))
        out = {}
        for name, versions in licences.TEMPLATES.items():
            marks = [Counter(zip(m, m[1:])) for m in map(licences_words, versions)]
            cells = []
            for m in marks:
                for at, ws in every:
                    n = len(ws) - 1
                    cells.append((2 * sum((Counter(zip(ws, ws[1:])) & m).values()) / (n + m.total()), at))
            hit = {(s, at) for s, at in cells if s >= 0.85}
            if not hit:
                pairs = [(a[1], b[1]) for a, b in zip(flat, flat[1:])]
                for m in marks:
                    k = m.total()
                    s, p = max(((sum((Counter(pairs[p : p + k]) & m).values()) / k, -p) for p in range(len(pairs)) if pairs[p] in m), default=(0, 0))
                    hit |= {(s, flat[-p][0])} if s >= 0.85 else set()
            for s, at in hit:
                out[name, at] = max(s, out.get((name, at), 0))
        if not out:
            return None, None, None, 0
        name, at = min(out, key=lambda k: (-out[k], k[0], k[1] is None, k[1]))
        return name, out[name, at], at, len({k[1] for k in out})

    def licences_words(x):
        return re.findall("[a-z0-9]+", x.translate(str.maketrans(licences.UPPER, licences.LOWER)))

    rows = spark.createDataFrame(list(docs.items()) + [(2, docs[2])], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licences.scan(rows, t).collect()}
    want = {k: brute(v) for k, v in docs.items()}
    assert {k: v[:1] + v[2:] for k, v in got.items()} == {k: v[:1] + v[2:] for k, v in want.items()}
    assert all(v[1] is None or abs(v[1] - want[k][1]) < 1e-12 for k, v in got.items())
    assert [want[k][0] for k in (1, 2, 3, 4, 6, 8)] == ["MIT", "MIT", "GPL-3.0", "GPL-3.0", None, None]
    more = licences.scan(rows, t, threshold=0.7).where("doc_id = 6").first()
    assert more["licence"] == "MIT"


def test_co_training_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, unseen = labels.where("pmod(hash(doc_id), 2) = 0"), labels.where("pmod(hash(doc_id), 2) = 1")
    rows = cotrain.classify(docs, seen).join(unseen, "doc_id").collect()
    assert len(rows) > 100
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.85 * len(bad)
    assert all(0 <= r["quality_score"] <= 1 for r in rows)


def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    x, m = rng.normal(size=(4000, 2)), rng.normal(size=(4000, 2))
    x[:, 0] += 3 * y
    m[:, 1] += 2 * y
    few = co = slice(0, 40)
    model = cotrain.co_train(x[few], m[few], y[few].astype(float), x[40:3000], m[40:3000], sure=0.9)
    both = model.scores(x[3000:], m[3000:])[2]
    alone = cotrain.Logistic.fit(m[co], y[co].astype(float)).odds(m[3000:])
    assert ((both > 0.5) == y[3000:]).mean() > 0.95 > ((alone > 0) == y[3000:]).mean()


def test_co_training_uses_every_unlabelled_document(spark):
    """The pool in Spark against the same training in memory, and a kind of junk beyond any fixed sample."""
    rng = np.random.default_rng(3)
    n, k = 9000, 300  # more unlabelled documents than the 6,000 that were once drawn
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, cotrain.TEXT_FEATURES))
    x[:, 0] += 2 * y
    s, g = rng.integers(0, 5, n) + 10 * y, rng.integers(20, 23, n)
    size = [None if i % 50 == 0 else int(v) for i, v in enumerate(rng.integers(0, 5000, n))]
    ties = rng.integers(-(2**63), 2**63 - 1, n)
    pool = np.argsort(ties[k:]) + k
    m = cotrain.page_rows(s, g, size)
    want = cotrain.co_train(x[:k], m[:k], y[:k].astype(float), x[pool], m[pool])
    rows = [(x[i].tobytes(), int(s[i]), int(g[i]), size[i], int(ties[i])) for i in range(k, n)]
    table = spark.createDataFrame(rows, "x binary, s int, g int, n long, tie long").repartition(6)
    got = cotrain.co_train_table(x[:k], m[:k], y[:k].astype(float), table)
    for a, b in zip(got.scores(x, m), want.scores(x, m), strict=True):
        assert abs(a - b).max() < 0.01
    few = cotrain.co_train(x[:k], m[:k], y[:k].astype(float), x[pool[:6000]], m[pool[:6000]])
    assert abs(few.scores(x, m)[2] - want.scores(x, m)[2]).max() > 0.01


def test_co_training_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (8, 0), (6, 1), (7, 0), (7, 1), (None, 1), (9, None)], "doc_id long, quality int")
    assert cotrain.classify(odd, labels).count() == odd.count()
    rows = cotrain.classify(odd, labels.where("quality = 1")).collect()
    assert all(r["kept"] and r["quality_score"] is None for r in rows)
    assert cotrain.classify(odd.limit(0), labels).count() == 0
