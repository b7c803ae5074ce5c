"""One query per operator: the operator with production parameters over its whole table."""

import corpus_pipeline
from weblode.llm import chat, cotrain, decontaminate, html_extract, line_dedup, near_dedup, packing, permutation, prefix_trie, quality_rules, runs, sharding, suffix_dedup
from weblode.llm.common import table


def op1_island_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_snapshot_collapse(spark, sf_dir):
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op3_blockwise_suffixes(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_template_decontamination(spark, sf_dir):
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op5_ngram_perplexity(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("_key")


def op6_cotrained_quality(spark, sf_dir):
    return cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_winnowing(spark, sf_dir):
    return line_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_chosen_path_join(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_rendezvous_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_dom_boosted_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_tree_contraction(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_permutation_index(spark, sf_dir):
    return permutation.search(table(spark, sf_dir, "embeddings"), 20)


def op13_scale_tiled_runs(spark, sf_dir):
    return runs.collapse(table(spark, sf_dir, "documents"), runs.repeated)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_island_packing, op2_snapshot_collapse, op3_blockwise_suffixes, op4_template_decontamination, op5_ngram_perplexity, op6_cotrained_quality,
    op7_line_winnowing, op8_chosen_path_join, op9_rendezvous_sharding, op10_dom_boosted_extraction, op11_tree_contraction, op12_permutation_index, op13_scale_tiled_runs, pipeline)}
ORACLES = {"op2_snapshot_collapse": chat.ORACLE, "op4_template_decontamination": decontaminate.ORACLE, "op7_line_winnowing": line_dedup.ORACLE, "op11_tree_contraction": prefix_trie.ORACLE}
