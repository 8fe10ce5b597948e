"""The operators on their whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import chat, collocation, eliasfano, html, importance, kmtree, mixing, mtree, packing, pii, quality, repeats, simhash
from tidemark.llm.common import table
from tidemark.session import shared_folder, ship_package, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


@query
def op1_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query
def op2_elias_fano_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
    eliasfano.write_tokens(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return eliasfano.read_tokens(spark, path)


@query
def op3_vector_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.place(packing.pieces_of(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=0))


@query
def op4_disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.find(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op5_mtree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_k(table(spark, folder, "embeddings"), k=5, every=50)


@query
def op6_bit_sliced_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=4, radius=4)


@query
def op7_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return kmtree.nearest(table(spark, folder, "embeddings"), k=10, every=100)


@query
def op8_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return quality.classify(docs, table(spark, folder, "labels"), whole=False).select(
        "doc_id", "source", "lang", "evidence", "host_posterior", "path_posterior", "probability", "keep")


@query
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    made = written(chat.segments(chat.with_trial(table(spark, folder, "conversations"))), "chat-segments")
    return chat.read_back(made)


@query
def op10_block_rules(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query
def op11_weighted_automata_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocation.mine(table(spark, folder, "documents"))


@query
def op12_prefix_crc_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


@query
def op13_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(table(spark, folder, "documents"))


ORACLES["op5_mtree_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op11_weighted_automata_phrases"] = collocation.SQL
ORACLES["op9_chat_format"] = chat.SQL
