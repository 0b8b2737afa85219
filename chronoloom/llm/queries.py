"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, jaccard, langid, line_dedup, phrases, quality, sharding, substring, token_counts, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_langs")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_audits(table(spark, sf_dir, "conversations"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_url_filter": op12_url_filter,
    "op13_collocations": op13_collocations,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op1_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20""",
    "op5_decontamination": f"""
WITH w AS (SELECT doc_id AS id, regexp_split_to_array(trim(lower(text), {_SPACE}), '[ \\t\\n\\x0B\\f\\r]+') AS words FROM documents),
v AS (SELECT item_id AS id, regexp_split_to_array(trim(lower(text), {_SPACE}), '[ \\t\\n\\x0B\\f\\r]+') AS words FROM benchmark),
s AS (SELECT id, words, least(5, len(words)) AS k FROM v WHERE words[1] <> ''),
d AS (SELECT DISTINCT id, array_to_string(words[i:i + k - 1], ' ') AS s FROM (SELECT id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w JOIN (SELECT DISTINCT k FROM s) ON len(words) >= k AND words[1] <> '')),
b AS (SELECT DISTINCT id, array_to_string(words[i:i + k - 1], ' ') AS s FROM (SELECT id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM s)),
n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n_item, count(*) AS n_shared, count(*) / n.n_item AS containment
FROM d JOIN b USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id, n.n_item HAVING 100 * count(*) >= 80 * n.n_item""",
    "op4_substring_dedup": r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS words FROM documents),
spans AS MATERIALIZED (SELECT d, i, array_to_string(words[i:i + 34], ' ') AS s FROM (SELECT d, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
hits AS (SELECT d, i FROM spans SEMI JOIN (SELECT s FROM spans GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS MATERIALIZED (SELECT DISTINCT d, p FROM (SELECT d, unnest(range(i, i + 35)) AS p FROM hits)),
kept AS (SELECT d, p, word FROM (SELECT d, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w) ANTI JOIN gone USING (d, p)),
texts AS (SELECT d, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN texts USING (d)""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT d, array_to_string(words[i:i + k - 1], ' ') AS s FROM (SELECT d, words, least(5, len(words)) AS k, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT d, count(*) AS n FROM s GROUP BY d),
links AS MATERIALIZED (SELECT a.d AS u, b.d AS v FROM s a JOIN s b ON a.s = b.s AND a.d <> b.d JOIN n x ON x.d = a.d JOIN n y ON y.d = b.d GROUP BY a.d, b.d, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT d AS u, d AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM w LEFT JOIN n ON n.d = w.d JOIN reach r ON r.u = w.d JOIN w o ON o.d = r.v GROUP BY w.d, w.doc_id, n.n""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k)) GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) t(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}
