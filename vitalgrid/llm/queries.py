"""One query per operator over its whole table, with the digest columns derived from the operator's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import pieces, pii, quality_classifier, quality_rules, toxicity
from vitalgrid.llm.decontaminate import phrase_matches
from vitalgrid.llm.fast_sketch import near_duplicates
from vitalgrid.llm.filter_audit import filter_interactions
from vitalgrid.llm.language_model import score_texts
from vitalgrid.llm.ngram_join import jaccard_links
from vitalgrid.llm.ranked_search import ranked_search
from vitalgrid.llm.registry import query
from vitalgrid.llm.sharding import histogram_shards
from vitalgrid.llm.substring_dedup import repeated_passages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM w WHERE len(w) >= 13
), x AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM s
), m AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g HAVING count(*) > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM x JOIN m USING (g) WHERE least < doc_id
), gone AS (SELECT doc_id, list(q) AS q FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(q), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN q IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(q, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


@query("op2_substring_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5
), h AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM g
), d AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), r AS (
  SELECT doc_id, sum(s) AS n FROM (SELECT doc_id, least(5, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 5)) AS s FROM d)
  GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines, len(list_filter(w, lambda x: x IN ({STOPS}))) AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.ELLIPSIS}'))) AS n_trailing,
    len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.BULLET}'))) AS n_bullets,
    len(list_filter(w, lambda x: regexp_matches(x, '{quality_rules.LETTER}'))) AS n_letter
  FROM w LEFT JOIN r USING (doc_id)
), q AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word,
    n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
    n_trailing / nullif(n_lines, 0) AS ellipsis_line_ratio, n_bullets / nullif(n_lines, 0) AS bullet_line_ratio,
    n_letter / nullif(n_words, 0) AS letter_word_ratio, n_stop_words / nullif(n_words, 0) AS stop_word_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {quality_rules.verdict_sql()} AS kept
FROM q
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op1_histogram_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))  # as it arrived in the shard
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_piece_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), model_path(), decoded=True)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(listed("ends"), 256).alias("ends_sha256"),
    )


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op9_toxic_lexicon")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(toxicity.sample(docs, labels.where(remainder(4) != 2), "toxic"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op7_neighbour_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.learn(docs, labels.where(remainder(5) != 0))
    return quality_classifier.score(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  WITH RECURSIVE r(v, root) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b
  ) SELECT v, min(root) AS root FROM r GROUP BY v
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(root AS BIGINT) AS component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.v = doc_id LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) AS c ON c.a = doc_id
"""


@query("op4_jaccard_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_links(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), p AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS g FROM p
), lens AS (SELECT DISTINCT n FROM win
), dp AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS p FROM d, lens
), hit AS (
  SELECT doc_id, p, dp.n AS n, item_id FROM dp JOIN win ON win.n = dp.n AND win.g = array_to_string(w[p:p + dp.n - 1], ' ')
), covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op6_benchmark_index", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_boosted_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.find(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query("op5_maxent_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"), remainder(10) != 0)
    return out.select(
        "doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT part, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS fails
  FROM w AS d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) AS l ON l.doc_id = d.doc_id
), p AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), s AS (
  SELECT part, filter_order, step, n, good, toxic, fails[ascii(filter_order[step]) - 64] AS here,
    len(list_filter(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])) AS earlier,
    len(list_filter(fails, lambda x: x)) AS total
  FROM p, o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT here AND earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN here AND earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN here AND earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN here AND total = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN here AND earlier = 0 THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN here AND earlier = 0 THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM r
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = OP4_SQL.replace("len(w) < 5", "len(w) < 4").replace("len(w) - 3", "len(w) - 2").replace("w[p:p + 4]", "w[p:p + 3]").replace(
    ">= 75 *", ">= 80 *").replace("CAST(coalesce(k, 0) AS BIGINT) AS n_links", "root = doc_id AS kept")


@query("op12_fast_sketch", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), size AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), m AS (SELECT doc_id, w, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, size WHERE len(w) > 0
), tf AS (SELECT doc_id, term, m, count(*) AS tf FROM (SELECT doc_id, m, unnest(w) AS term FROM m) GROUP BY doc_id, term, m
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, size GROUP BY term
), s AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM b JOIN tf USING (term) JOIN weight USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
