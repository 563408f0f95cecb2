"""Named queries of the operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from coverlens.llm import byte_bpe, centroids, collocations, embedding_dedup, html_extract, jaccard_join, language_id, license_scan, packing, quality_rules, token_counts, topk_search, url_filter
from coverlens.llm.common import table

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return license_scan.license_scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


ORACLE["op2_license_scan"] = license_scan.twin_sql("concat_ws('/', source, lang, doc_id)")


@query
def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query
def op4_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_join.jaccard_join(docs).select("doc_id", "class_id", "n_links", "kept")


@query
def op7_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.url_filter(pages, url_filter.labelled_outcomes(pages, table(spark, sf_dir, "labels")))


ORACLE["op8_url_filter"] = url_filter.twin_sql()


@query
def op9_html_extraction(spark, sf_dir):
    return html_extract.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE["op11_topk_search"] = topk_search.twin_sql()


@query
def op12_centroid_clustering(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE["op12_centroid_clustering"] = centroids.twin_sql()


@query
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents", "text", "lang"))


ORACLE["op13_collocations"] = collocations.twin_sql()
