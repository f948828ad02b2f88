"""The queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import collocations, exact_dedup, hard_negatives, html_text, jaccard_join, mixing, packing, personal_data, suffix_dedup, token_counts, topk, toxicity, url_filter

#: The rules that op3 judges by.
URL_RULES = (
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
)
#: Packing: tokens of a sequence.
SEQUENCE = 2048


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers lie; every executor has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 85 % of four-word shingles."""
    rows = jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), jaccard_join.Similarity(size=4, percent=85))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source, target, words taken and places in the output shards of every document."""
    rows = mixing.plan_mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels that aren't held out."""
    docs, labels, out = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), toxicity.held_out(F.col("doc_id"))
    weights = toxicity.fit(docs, labels, keep=~out)
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for every document."""
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after a title, a cut and a replacement were put in."""
    kept = token_counts.trees(read(spark, sf_dir, "documents"), tokenizer=tokenizer_path())
    n = F.char_length("text")
    edits = [(F.lit(0), 0, "Title: "), (F.floor(n / 3), 40, ""), (F.floor(n / 2), 12, " [removed] ")]
    edits = F.array(*[F.struct(a.cast("int").alias("start"), F.lit(b).alias("length"), F.lit(c).alias("text")) for a, b, c in edits])
    rows = token_counts.edited(kept, edits, tokenizer=tokenizer_path())
    return rows.select("doc_id", "n_tokens", "n_after", "n_encoded")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of highest inner product for every row whose vec_id is divisible by 50."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), limit=SEQUENCE)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeat 50 bytes of a smaller document, of every document."""
    rows = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), match=50)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every row whose vec_id is divisible by 50; some labels are wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses, IP addresses, card and phone numbers of every document, and what follows other anchors."""
    return personal_data.find(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_source_mixing": op2_source_mixing,
        "op3_url_filter": op3_url_filter,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_token_counts": op7_token_counts,
        "op8_exact_topk": op8_exact_topk,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_personal_data": op12_personal_data,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op3_url_filter": OP3_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op8_exact_topk": OP8_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op13_collocations": OP13_SQL,
    }


OP1_SQL = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) ELSE [] END AS t FROM d),
n AS (SELECT doc_id, len(t) AS n FROM s),
x AS (SELECT doc_id, unnest(t) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * c >= 85 * (m.n + k.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""

OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(key, host, path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')),
hits AS (
  SELECT s.page_id, s.host, s.path, arg_max(r.key, length(r.key)) AS rule, arg_max(r.verdict, length(r.key)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY ALL)
SELECT s.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM split s LEFT JOIN hits h USING (page_id)
"""

OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP8_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS a, c.vec_id AS c, q.label = c.label AS same, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
p AS (SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
n AS (
  SELECT p.a, p.c AS positive_id, p.score AS ps, s.c AS negative_id, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, positive_id, rank::int AS rank, negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""

OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::bigint AS n FROM w GROUP BY 1),
g AS (SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
s AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, ((2000000::hugeint * c.a) // (l.a + r.a))::bigint AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000::hugeint * c.a) // (l.a + r.a), k) = 1),
i AS (SELECT lang, a, string_split(phrase, ' ') AS w, size, unnest(range(2, size)) AS m FROM f WHERE size > 2),
j AS (SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM i),
b AS (SELECT lang, phrase, max(a) AS longer FROM j GROUP BY 1, 2),
k AS (SELECT s.* FROM s LEFT JOIN b USING (lang, phrase) WHERE b.longer IS NULL OR 100 * b.longer < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) QUALIFY rank <= 2000
"""
