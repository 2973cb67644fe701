"""Registered queries of the operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm import (
    bpe_automaton, conversation_trie, embedding_graph, hamming_dedup, hard_negatives, licenses, mixing,
    packing, quality, secrets, suffix_dedup, toxicity, warc,
)
from sentinela.llm.common import stored, table
from sentinela.sources.snapshots import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def span_list(spans, kinds) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    own = F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


@query
def op1_warc(spark, sf):
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    records = stored(warc.read_records(spark, path, block_types=("metadata",)), "warc-records")
    pages = stored(warc.assemble(records).select(
        warc.page_id(F.col("metadata.block")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type")), "warc-captures")
    # A revisit is of the response with its payload.
    first = pages.where("record_type = 'response'").groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("first"))
    revisits = pages.where("record_type = 'revisit'").join(
        first, ["payload_digest", "payload_bytes"], "left")
    plain = pages.where("record_type = 'response'").withColumn("first", F.lit(None).cast("long"))
    return plain.unionByName(revisits).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"))


@query
def op2_suffix_array(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_flat_graph(spark, sf):
    return embedding_graph.near_vectors(table(spark, sf, "embeddings"))


@query
def op4_best_fit(spark, sf):
    return packing.pack(packing.cut_documents(
        table(spark, sf, "documents"), BYTE_BPE, ranks=BYTE_RANKS))


@query
def op5_licenses(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"))


@query
def op6_hamming(spark, sf):
    return hamming_dedup.near_groups(table(spark, sf, "documents"))


@query
def op7_toxicity(spark, sf):
    return toxicity.grade_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_bpe_automaton(spark, sf):
    coded = bpe_automaton.encode_documents(table(spark, sf, "documents"), WORD_BPE)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_secrets(spark, sf):
    found = secrets.find_secrets(table(spark, sf, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(k) for k in secrets.BASE_KINDS),
        F.sha2(span_list("spans", secrets.BASE_KINDS), 256).alias("base_sha256"),
        span_list("spans", secrets.KINDS).alias("spans"))


@query
def op10_quality(spark, sf):
    return quality.clean_documents(table(spark, sf, "documents")).drop("cleaned")


@query
def op11_mixing(spark, sf):
    return mixing.words_taken(*mixing.mix_sources(table(spark, sf, "documents")))


@query
def op12_trie(spark, sf):
    return conversation_trie.conversation_trie(table(spark, sf, "conversations"))[0]


@query
def op13_hard_negatives(spark, sf):
    return hard_negatives.mine_negatives(table(spark, sf, "embeddings"))


@query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
