"""The registered queries of this subpackage: each applies one operator to a whole table.

``QUERIES`` and ``ORACLES`` have the form of those in ``__spark_entry__``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleflow.llm import bpe, cotrain, langid, licences, line_rules, mix, near_dup, negatives, pii, repair, spans, topk, word_piece
from aisleflow.llm.storage import documents, importable, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@register("op1_mix_sources", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source
), level_at AS (
  SELECT a.source, a.w, 2 * a.source_size AS cap, sum(least(b.w::DOUBLE * (2 * a.source_size) / a.w, 2 * b.source_size)) AS used
  FROM s a CROSS JOIN s b GROUP BY ALL
), total AS (SELECT sum(source_size)::BIGINT AS n FROM s
), level AS (
  SELECT (1.5::DOUBLE * any_value(n) - coalesce(sum(cap) FILTER (used < 1.5::DOUBLE * n), 0)::BIGINT) / sum(w) FILTER (used >= 1.5::DOUBLE * n) AS l
  FROM level_at, total
), t AS (
  SELECT source, source_size, least(w * l, 2 * source_size)::DOUBLE AS target FROM s, level
), o AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, least(round(t.target)::BIGINT, 2 * t.source_size) AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix:', d.doc_id)), size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - start, 0), size) END::BIGINT AS taken
FROM o
""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@register("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    ids = F.col("token_ids")
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode_column(ids, path, pattern), 256).alias("decoded_sha256"),
    )


@register("op4_block_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
""")
def op4_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


@register("op6_hyperminhash", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(s)::BIGINT AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id, doc_id AS other FROM n UNION SELECT doc_id, b FROM reach JOIN links ON other = a
)
SELECT doc_id, any_value(n.n) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id
""")
def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


@register("op2_line_rules", r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
  SELECT doc_id, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines WHERE len(lw) > 0 GROUP BY doc_id
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda j: array_to_string(ws[j:j + 2], ' '))) AS s FROM w WHERE len(ws) > 2
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, source, md5(text) AS content, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id)
), held AS (
  SELECT source, array_to_string(lw, ' ') AS line, count(DISTINCT content) AS n FROM lines JOIN base USING (doc_id) WHERE len(lw) > 0 GROUP BY ALL
), common AS (
  SELECT h.source, line FROM held h JOIN (SELECT source, count(DISTINCT content) AS texts FROM base GROUP BY source) t ON h.source IS NOT DISTINCT FROM t.source
  WHERE n > 20 AND (len(string_split(line, ' ')) > 3 OR n > texts * 0.1)
), gone AS (
  SELECT l.doc_id, sum(len(lw))::BIGINT AS removed_words FROM lines l JOIN base USING (doc_id) JOIN common c ON base.source IS NOT DISTINCT FROM c.source AND c.line = array_to_string(lw, ' ') GROUP BY l.doc_id
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(removed_words, 0) AS removed_words,
       NOT base_failed AND 2 * coalesce(removed_words, 0) <= n_words AND (coalesce(removed_words, 0) = 0 OR n_words - removed_words >= 50) AS kept
FROM failed LEFT JOIN gone USING (doc_id)
""")
def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_report(documents(spark, sf_dir)).select("doc_id", *line_rules.FIGURES, "base_failed", "removed_words", "kept")


@register("op9_word_piece")
def op9_word_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_piece.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "n_words", "n_tokens")


@register("op10_sentence_spans")
def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated(documents(spark, sf_dir)).select("doc_id", "n_sentences", "n_removed", "text")


@register("op3_pii_surrogates")
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(documents(spark, sf_dir)).select("doc_id", "n_mentions", "text")


_TEMPLATES = ", ".join(f"('{name}', {i}, '{text.replace(chr(39), chr(39) * 2)}')" for name, texts in licences.TEMPLATES.items() for i, text in enumerate(texts))


@register("op7_licence_scan", rf"""
WITH t AS (
  SELECT licence, version, regexp_extract_all(translate(template, '{licences.UPPER}', '{licences.LOWER}'), '[a-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) AS v(licence, version, template)
), tg AS (
  SELECT licence, version, size, gram, count(*) AS times FROM (
    SELECT licence, version, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) GROUP BY ALL
), l AS (
  SELECT doc_id, i - 1 AS line, regexp_extract_all(translate(s[i], '{licences.UPPER}', '{licences.LOWER}'), '[a-z0-9]+') AS w
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))
), u AS (
  SELECT doc_id, line, w FROM l
  UNION ALL SELECT doc_id, NULL, flatten(list(w ORDER BY line)) FROM l GROUP BY doc_id HAVING count(*) FILTER (len(w) > 0) > 1
), g AS (
  SELECT doc_id, line, n, gram, count(*) AS here FROM (
    SELECT doc_id, line, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM u WHERE len(w) >= 2) GROUP BY ALL
), r AS (
  SELECT doc_id, line, licence, version, 2 * sum(least(here, times))::DOUBLE / (n + size) AS score FROM g JOIN tg USING (gram) GROUP BY doc_id, line, n, licence, version, size
), word AS (
  SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line, j) AS p FROM (SELECT doc_id, line, unnest(w) AS x, unnest(range(len(w))) AS j FROM l)
), pair AS (
  SELECT a.doc_id, a.line, a.p, a.x || ' ' || b.x AS gram FROM word a JOIN word b ON a.doc_id = b.doc_id AND b.p = a.p + 1
), hit AS (
  SELECT doc_id, line, p, licence, version, size, gram, times FROM pair JOIN tg USING (gram)
), enough AS (
  SELECT doc_id, licence, version FROM (SELECT doc_id, licence, version, size, least(count(*), times) AS c FROM hit GROUP BY doc_id, licence, version, size, gram, times)
  GROUP BY doc_id, licence, version, size HAVING sum(c) >= 0.85::DOUBLE * size
), inside AS (
  SELECT a.doc_id, a.line, a.p, a.licence, a.version, a.size, b.gram, least(count(*), b.times) AS c
  FROM hit a JOIN enough USING (doc_id, licence, version) JOIN hit b ON a.doc_id = b.doc_id AND a.licence = b.licence AND a.version = b.version AND b.p >= a.p AND b.p < a.p + a.size
  GROUP BY a.doc_id, a.line, a.p, a.licence, a.version, a.size, b.gram, b.times
), win AS (
  SELECT doc_id, line, licence, common::DOUBLE / size AS score FROM (SELECT doc_id, line, p, licence, version, size, sum(c) AS common FROM inside GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, licence, version ORDER BY common DESC, p) = 1
), p AS (
  SELECT doc_id, line, licence, max(score) AS score FROM (
    SELECT doc_id, line, licence, score FROM r UNION ALL SELECT doc_id, line, licence, score FROM win WHERE (doc_id, licence) NOT IN (SELECT (doc_id, licence) FROM r WHERE score >= 0.85::DOUBLE)
  ) WHERE score >= 0.85::DOUBLE GROUP BY ALL
), b AS (
  SELECT doc_id, arg_min(licence, k) AS licence, arg_min(score, k) AS score, arg_min(CASE WHEN line IS NULL THEN NULL ELSE line END, k) AS line, count(DISTINCT coalesce(line, -1)) AS n_lines
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence, line NULLS LAST) AS k FROM p) GROUP BY doc_id
)
SELECT d.doc_id, licence, score, line::BIGINT AS line, coalesce(n_lines, 0)::BIGINT AS n_lines FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN b USING (doc_id)
""")
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir), licences.templates(spark))


@register("op8_co_training")
def op8_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotrain.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "page_score", "quality_score", "kept")


@register("op11_auction_repair", r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), code AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 20 AS code
  FROM conversations, crc
), r AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
  FROM code, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS u(n) WHERE code <> 0
), f AS (
  SELECT *, row_number() OVER o AS i, left(role, 1) AS c, lag(left(role, 1)) OVER o AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) > 1 AS seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n)
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (NOT blank AND seen)::BIGINT AS duplicate,
         count(*) FILTER (NOT blank AND NOT seen AND cut)::BIGINT AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, c) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM f GROUP BY conv_id
), best AS (  -- cheapest edits so far, by the last kept role: none, system, user, assistant
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS b0, {'c': 1000000000::BIGINT, 'a': ''} AS b1, {'c': 1000000000::BIGINT, 'a': ''} AS b2, {'c': 1000000000::BIGINT, 'a': ''} AS b3
  FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, {'c': b0.c + 4, 'a': b0.a || 'D'},
         list_min([{'c': b1.c + 4, 'a': b1.a || 'D'}, {'c': b0.c + k + CASE WHEN c = 's' THEN 0 ELSE 1000000000 END, 'a': b0.a || 'K'}]),
         list_min([{'c': b2.c + 4, 'a': b2.a || 'D'}, {'c': b0.c + k + CASE WHEN c = 'u' THEN 0 ELSE 3 END, 'a': b0.a || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END},
                   {'c': b1.c + k + CASE WHEN c = 'u' THEN 0 ELSE 3 END, 'a': b1.a || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END}, {'c': b3.c + k + CASE WHEN c = 'u' THEN 0 ELSE 3 END, 'a': b3.a || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END}]),
         list_min([{'c': b3.c + 4, 'a': b3.a || 'D'}, {'c': b2.c + k + CASE WHEN c = 'a' THEN 0 ELSE 3 END, 'a': b2.a || CASE WHEN c = 'a' THEN 'K' ELSE 'R' END}])
  FROM (
    SELECT conv_id, i, c, k, b0, b1, b2, list_min([b3, {'c': b2.c + 3, 'a': b2.a || 'I'}]) AS b3 FROM (
      SELECT f.conv_id, f.i, c, CASE WHEN blank OR seen THEN 1000000000 WHEN cut THEN 3 ELSE 0 END AS k, b0, b1, b3,
             list_min([b2, {'c': b0.c + 3, 'a': b0.a || 'I'}, {'c': b1.c + 3, 'a': b1.a || 'I'}, {'c': b3.c + 3, 'a': b3.a || 'I'}]) AS b2
      FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1))
), ended AS (
  SELECT conv_id, list_min([b0, b3, {'c': b2.c + 3, 'a': b2.a || 'I'}, {'c': b1.c + 6, 'a': b1.a || 'II'}]) AS b
  FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), steps AS (
  SELECT conv_id, k, l, sum((l <> 'D')::INT) OVER w AS said, sum((l <> 'I')::INT) OVER w AS i
  FROM (SELECT conv_id, unnest(range(1, len(b.a) + 1)) AS k, unnest(string_split(b.a, '')) AS l FROM ended WHERE b.a <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), spoken AS (
  SELECT steps.conv_id, k, l, said, role, text, bool_or(said = 1 AND l = 'K' AND c = 's') OVER (PARTITION BY steps.conv_id) AS opened
  FROM steps LEFT JOIN f ON steps.conv_id IS NOT DISTINCT FROM f.conv_id AND steps.i = f.i AND l <> 'I' WHERE l <> 'D'
), said AS (
  SELECT conv_id, sha256(string_agg(concat(CASE WHEN l = 'K' THEN role WHEN (said % 2 = 1) = opened THEN 'assistant' ELSE 'user' END, ':', coalesce(text, '')), chr(10) ORDER BY k)) AS digest
  FROM spoken GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN figures x ON d.conv_id IS NOT DISTINCT FROM x.conv_id
LEFT JOIN ended e ON d.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said s ON d.conv_id IS NOT DISTINCT FROM s.conv_id
""")
def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(documents(spark, sf_dir, "conversations"))
    return repair.summarize(repair.repair(damaged)).select("conv_id", *repair.FIGURES, "audit", "repaired_sha256")


@register("op12_char_models")
def op12_char_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    taught = docs.where(part != 2).select("lang", "text", (part == 3).alias("spare"))
    held = docs.select("doc_id", (part == 2).alias("held_out"), "text")
    return langid.identify(held, taught).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


@register("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.vectors(documents(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))
