"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, ann_forest, bpe, language_pieces, lm_score, mixing, quality_cnn, quality_rules, reversed_search, sharding, simhash, substring, url_filter
from .common import table

QUERIES = {
    "op1_lm_score": lambda spark, sf_dir: lm_score.query(table(spark, sf_dir, "documents")),
    "op2_mixing": lambda spark, sf_dir: mixing.query(table(spark, sf_dir, "documents")),
    "op3_substring_dedup": lambda spark, sf_dir: substring.query(table(spark, sf_dir, "documents")),
    "op4_ann_forest": lambda spark, sf_dir: ann_forest.query(table(spark, sf_dir, "embeddings")),
    "op5_sharding": lambda spark, sf_dir: sharding.query(table(spark, sf_dir, "documents")),
    "op6_url_filter": lambda spark, sf_dir: url_filter.query(table(spark, sf_dir, "pages")),
    "op7_bpe": lambda spark, sf_dir: bpe.query(table(spark, sf_dir, "documents")),
    "op8_quality_rules": lambda spark, sf_dir: quality_rules.query(table(spark, sf_dir, "documents")),
    "op9_quality_cnn": lambda spark, sf_dir: quality_cnn.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_simhash": lambda spark, sf_dir: simhash.query(table(spark, sf_dir, "documents")),
    "op11_language_pieces": lambda spark, sf_dir: language_pieces.query(table(spark, sf_dir, "documents")),
    "op12_reversed_search": lambda spark, sf_dir: reversed_search.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_alignment": lambda spark, sf_dir: alignment.query(table(spark, sf_dir, "documents")),
}
ORACLE_SQL = {"op6_url_filter": url_filter.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op12_reversed_search": reversed_search.ORACLE}
