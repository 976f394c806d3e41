"""The registered queries of the training-data operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_quality

    return apply_quality(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE["op10_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), b AS (
  SELECT doc_id, text, w, lines, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines
  FROM t
), g AS (
  SELECT doc_id, unnest(range(1, n_words - 1)) AS i, w FROM b WHERE n_words >= 3
), g3 AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM g3, (VALUES (0), (1), (2)) AS v(d) WHERE n >= 2 GROUP BY doc_id
), m AS (
  SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed
       AND NOT 100 * n_symbols > 10 * word_chars
       AND NOT 100 * n_repeat_words > 30 * n_words
       AND NOT (word_chars < 2 * n_words OR word_chars > 14 * n_words)
       AND NOT 100 * n_dup_lines > 50 * len(lines)
       AND NOT coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) > 1000
       AND NOT 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 40 * word_chars
       AND NOT 100 * length(regexp_replace(text, '[^0-9]', '', 'g')) > 20 * word_chars
       AND NOT 100 * length(regexp_replace(text, '[^!]', '', 'g')) > 15 * n_words
       AND NOT 100 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\xBF]'))) < 70 * n_words AS kept
FROM f
"""


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


ORACLE["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END, ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM t WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n AS u ON u.doc_id = x JOIN n AS v ON v.doc_id = y WHERE 100 * common >= 85 * (u.n + v.n - common)
), e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE["op4_suffix_array_dedup"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n_bytes FROM d),
w AS (
  SELECT doc_id, p, md5_number(substring(x, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, n_bytes - 99)) AS p FROM n WHERE n_bytes >= 100)
), f AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), g AS (
  SELECT doc_id, p, sum(CASE WHEN p - prev <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM f)
), r AS (
  SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, span
), k AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS u, a AS v FROM r
  UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY doc_id
), t AS (
  SELECT k.doc_id, string_agg(substring(x, 2 * u + 1, 2 * (coalesce(v, n_bytes) - u)), '' ORDER BY u) AS x FROM k JOIN n USING (doc_id) GROUP BY k.doc_id
), c AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id
)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.x, n.x))) AS kept_sha256
FROM n LEFT JOIN c USING (doc_id) LEFT JOIN t ON t.doc_id = n.doc_id
"""


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


ORACLE["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


#: The op5 query's tree: domain (the source's number modulo 4), language, source; and its weights.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


@query
def op5_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import mix

    number = F.coalesce(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("long"), F.lit(0))
    levels = {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}
    out = mix(table(spark, sf_dir, "documents"), levels, [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}], budget_percent=60, epochs=2, keep=["doc_id"])
    return out.select("row.doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _share_sql(nodes: str, parent: str, name: str, out: str) -> str:
    """The same division of budgets as SQL: nodes with budget, weight and cap."""
    by = f"{parent + ', ' if parent else ''}"
    over = f"PARTITION BY {parent}" if parent else ""
    order = f"({over} ORDER BY CASE WHEN weight > 0 THEN CAST(cap AS DOUBLE) / weight ELSE 'inf'::DOUBLE END, {name}"
    return f"""
{out}_a AS (
  SELECT *, sum(weight) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
         coalesce(sum(cap) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before FROM {nodes}
), {out}_b AS (SELECT *, weight > 0 AND cap * w_rest <= weight * (budget - c_before) AS filled FROM {out}_a),
{out}_c AS (
  SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({over}), 0) AS left_, coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER ({over}), 0) AS open_ FROM {out}_b
), {out}_d AS (SELECT *, CASE WHEN filled OR open_ = 0 THEN 0 ELSE (left_ * weight) // open_ END AS part FROM {out}_c),
{out}_e AS (
  SELECT *, CASE WHEN open_ > 0 THEN left_ - sum(part) OVER ({over}) ELSE 0 END AS over_,
         sum(CASE WHEN NOT filled AND weight > 0 THEN 1 ELSE 0 END) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM {out}_d
), {out} AS (
  SELECT {by}{name}, CAST(CASE WHEN filled THEN cap ELSE part + CASE WHEN weight > 0 AND nth <= over_ THEN 1 ELSE 0 END END AS BIGINT) AS budget FROM {out}_e
)"""


def _weights_sql(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


ORACLE["op5_mixing_to_weights"] = rf"""
WITH t AS MATERIALIZED (
  SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4 AS VARCHAR) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), u AS (SELECT * FROM t WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM u GROUP BY ALL),
n1 AS (SELECT domain, sum(tokens) * 2 AS cap, (SELECT sum(tokens) * 60 // 100 FROM leaf) AS budget, {_weights_sql("domain", DOMAIN_WEIGHTS)} AS weight FROM leaf GROUP BY domain),
{_share_sql("n1", "", "domain", "b1")},
n2 AS (SELECT domain, lang, sum(tokens) * 2 AS cap, any_value(budget) AS budget, {_weights_sql("lang", LANGUAGE_WEIGHTS)} AS weight FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang),
{_share_sql("n2", "domain", "lang", "b2")},
n3 AS (SELECT domain, lang, source, tokens * 2 AS cap, budget, 1 AS weight FROM leaf JOIN b2 USING (domain, lang)),
{_share_sql("n3", "domain, lang", "source", "b3")},
p AS (SELECT leaf.*, budget // tokens AS whole, budget % tokens AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
o AS (
  SELECT u.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || CAST(CAST(whole AS BIGINT) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS upto
  FROM u JOIN p USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, CAST(whole AS BIGINT) + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS BIGINT) AS epoch FROM o
"""


@query
def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import format_preferences, swapped_answers

    out = format_preferences(swapped_answers(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


ORACLE["op2_chat_preferences"] = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), l AS (
  SELECT conv_id, t, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS n FROM c
), a AS (SELECT conv_id, t[1:n] AS t FROM l WHERE n IS NOT NULL),
p AS (
  SELECT x.conv_id AS pair_id, x.t AS ch, list_concat(x.t[1:len(x.t) - 1], y.t[len(y.t):len(y.t)]) AS re
  FROM a x JOIN a y ON x.conv_id // 2 = y.conv_id // 2 AND x.conv_id <> y.conv_id
), k AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(ch), len(re)) + 1), lambda i: ch[i].role IS DISTINCT FROM re[i].role OR ch[i].text IS DISTINCT FROM re[i].text)) - 1, least(len(ch), len(re))) AS n_common FROM p
), r AS (
  SELECT pair_id, n_common,
         list_transform(ch, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) AS cs,
         list_transform(re, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) AS rs, ch, re FROM k
), m AS (
  SELECT pair_id, n_common, coalesce(array_to_string(cs[1:n_common], ''), '') AS prompt, cs[n_common + 1:] AS cs, rs[n_common + 1:] AS rs, ch[n_common + 1:] AS ch, re[n_common + 1:] AS re FROM r
)
SELECT pair_id, CAST(n_common AS INTEGER) AS n_common, prompt, coalesce(array_to_string(cs, ''), '') AS chosen, coalesce(array_to_string(rs, ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(cs) + 1), lambda i: ch[i].role = 'assistant'), lambda i: CAST(CAST(coalesce(list_sum(list_transform(cs[1:i], lambda x: length(x))), 0) AS BIGINT) - length(coalesce(ch[i].text, '')) - 8 AS VARCHAR) || '-' || CAST(CAST(coalesce(list_sum(list_transform(cs[1:i], lambda x: length(x))), 0) AS BIGINT) AS VARCHAR)), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(rs) + 1), lambda i: re[i].role = 'assistant'), lambda i: CAST(CAST(coalesce(list_sum(list_transform(rs[1:i], lambda x: length(x))), 0) AS BIGINT) - length(coalesce(re[i].text, '')) - 8 AS VARCHAR) || '-' || CAST(CAST(coalesce(list_sum(list_transform(rs[1:i], lambda x: length(x))), 0) AS BIGINT) AS VARCHAR)), ','), '') AS rejected_mask
FROM m
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("n_chars_kept"), F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language import fit_language_model, identify, in_fold

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_language_model(docs), columns=["doc_id"])
    return out.select("row.doc_id", in_fold(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .centroids import cluster

    out = cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _round_sql(n: int) -> str:
    """Assignment to the centroids c{n} and the centroids c{n + 1} that follow."""
    return f"""
d{n} AS MATERIALIZED (SELECT r, vec_id, v.e, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - m.e[i]) * (v.e[i] - m.e[i]))) AS BIGINT) AS distance FROM v, c{n} m),
a{n} AS MATERIALIZED (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1),
s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS e FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{n} o LEFT JOIN m{n} m USING (c))"""


ORACLE["op11_centroid_clustering"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < 16
), {_round_sql(0).strip()}, {_round_sql(1).strip()}, {_round_sql(2).strip()}, {_round_sql(3).strip()}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
"""


@query
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import contaminated

    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_LOWERED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op12_benchmark_decontamination"] = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LOWERED_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_LOWERED_WORDS} AS w FROM documents),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS MATERIALIZED (SELECT r, n, p, item FROM dw JOIN iw USING (n, s)),
k AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, n, p FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS x FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(x, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return hard_negatives(vectors, every=50, positives=5, negatives=3, low=50, high=95, scale=256)


ORACLE["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, CAST(list_dot_product(a.e, x.e) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
