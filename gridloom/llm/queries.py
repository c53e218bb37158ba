"""The operators' queries over whole tables, with production parameters, and SQL where SQL can express them."""

from gridloom.llm import archive, compression, conversations, dedup, licences, packing, resampling, residuals, sampling, toxicity, weaksup, webp, wordpieces
from gridloom.llm.common import Scratch, table


def op10_compression_quality(spark, folder):
    return compression.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op1_bottom_k_dedup(spark, folder):
    return dedup.near_duplicates(table(spark, folder, "documents"), size=2, percent=80)


def op2_longest_match_tokens(spark, folder):
    return wordpieces.token_counts(table(spark, folder, "documents"))


def op3_licence_scan(spark, folder):
    return licences.scan(table(spark, folder, "documents"))


def op4_lossless_webp(spark, folder):
    return webp.media_digest(webp.media(table(spark, folder, "documents")))


def op5_length_buckets(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


def op6_weak_supervision(spark, folder):
    return weaksup.quality(table(spark, folder, "documents"))


def op7_gumbel_segmentations(spark, folder):
    return sampling.sampled_segmentations(table(spark, folder, "conversations"), ["conv_id", "turn"])


def op8_repair_archive(spark, folder):
    path = f"{Scratch(spark).folder}/archive"
    archive.write_archive(table(spark, folder, "documents"), path)
    return archive.archive_digest(spark, path)


def op9_fuzzy_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_importance_resampling(spark, folder):
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_survivor_viterbi(spark, folder):
    return conversations.repair(table(spark, folder, "conversations"))


def op13_residual_packing(spark, folder):
    return residuals.packed_pieces(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_bottom_k_dedup, op2_longest_match_tokens, op3_licence_scan, op4_lossless_webp, op5_length_buckets, op6_weak_supervision, op7_gumbel_segmentations, op8_repair_archive, op9_fuzzy_toxicity, op10_compression_quality, op11_importance_resampling, op12_survivor_viterbi, op13_residual_packing)}
SQL = {"op1_bottom_k_dedup": dedup.near_duplicates_sql(2, 80), "op3_licence_scan": licences.scan_sql(), "op11_importance_resampling": resampling.resample_sql(), "op12_survivor_viterbi": conversations.repair_sql()}
