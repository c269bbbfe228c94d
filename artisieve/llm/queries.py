"""The thin contract queries opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"), top=20)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from artisieve.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=(5, 0))
    return toxicity.score(docs, model).select("doc_id", toxicity.in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.chain_dedup import fuzzy_passages

    return fuzzy_passages(table(spark, sf_dir, "documents")).drop("row")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from artisieve.llm.quality import quality_scores
    from artisieve.llm.toxicity import in_fold

    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=(4, 2))
    return scores.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.lm_scoring import text_scores

    return text_scores(table(spark, sf_dir, "documents"), folds=7, fold=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.alignment import corpus_alignment

    return corpus_alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artisieve.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, num=80, den=100)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from artisieve.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 100 = 0")


QUERIES: dict[str, Query] = {
    "op1_cross_polytope": op1_cross_polytope,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_template_leaks": op3_template_leaks,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_chain_dedup": op7_chain_dedup,
    "op8_quality": op8_quality,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_packing": op10_packing,
    "op11_cross_alignment": op11_cross_alignment,
    "op12_circulant_minhash": op12_circulant_minhash,
    "op13_hard_negatives": op13_hard_negatives,
}

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * both_ >= {num} * (len(x.g) + len(y.g) - both_)),
m AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT m.b, r.c FROM r JOIN m ON m.a = r.v)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id{more} FROM s JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) c ON c.v = s.doc_id"""

#: Brute force over all shared shingles and all scores. Other operators learn, approximate or cut tokens, which SQL cannot state.
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": NEAR_DUPLICATES.format(num=85, more=""),
    "op12_circulant_minhash": NEAR_DUPLICATES.format(num=80, more=", s.doc_id = c.component_id AS kept"),
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
}
