"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from assayframe.llm import (
    byte_cnn, context_mixing, fertility, lsh_forest, packed_ids, page_diff, pair_bpe, source_mix, srs_search, strassen_negatives, turn_repair, url_rules,
    weak_toxicity,
)

QUERIES, ORACLES = {}, {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_page_diff(spark, sf_dir):
    """Main text of every page."""
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op2_lsh_forest(spark, sf_dir):
    """Near-duplicate component of every document, at a similarity of 0.85."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op3_weak_toxicity(spark, sf_dir):
    """Toxicity of every document, learned outside the held-out fold."""
    return weak_toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fertility(spark, sf_dir):
    """Base counts, tokeniser fertility and verdict of every document."""
    return fertility.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_pair_index_bpe(spark, sf_dir):
    """Ids and decoded texts of all documents, as digests."""
    return pair_bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_context_mixing(spark, sf_dir):
    """Log-probability of every document under word counts and under context mixing."""
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op7_source_mix(spark, sf_dir):
    """Words that the mix takes of every document."""
    return source_mix.mix_taken(table(spark, sf_dir, "documents"))


def op8_url_rules(spark, sf_dir):
    """Verdict of every page's URL."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op9_srs_search(spark, sf_dir):
    """The 20 nearest vectors of every twentieth."""
    return srs_search.nearest(table(spark, sf_dir, "embeddings"))


def op10_byte_cnn(spark, sf_dir):
    """Language of every document, learned outside the held-out fold."""
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def op11_strassen_negatives(spark, sf_dir):
    """Hard negatives per anchor and positive."""
    return strassen_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_packed_ids(spark, sf_dir):
    """Ids of all documents through the bit-packed file format and back."""
    return packed_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_turn_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation after damage."""
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


for _query in (
    op1_page_diff, op2_lsh_forest, op3_weak_toxicity, op4_fertility, op5_pair_index_bpe, op6_context_mixing, op7_source_mix, op8_url_rules, op9_srs_search,
    op10_byte_cnn, op11_strassen_negatives, op12_packed_ids, op13_turn_repair,
):
    QUERIES[_query.__name__] = _query
ORACLES["op8_url_rules"] = url_rules.judge_sql()
ORACLES["op11_strassen_negatives"] = strassen_negatives.negatives_sql()
ORACLES["op13_turn_repair"] = turn_repair.repair_sql()
