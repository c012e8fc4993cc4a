"""Queries over the whole tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import chat, decontam, mixing, neardup, packing, pii, prefixtrie, quality, runs, sharding, suffixdedup, toxicity, warc
from panelloom.llm.common import table


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``: one row per leaked pair."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), keep="none", with_bytes=False)


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``: prompt, completions and masks as text, one row per conversation."""
    pairs = chat.format_pairs(chat.pairs_from_conversations(table(spark, sf_dir, "conversations"), whole=True))

    def runs(mask: str):
        return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["length"].cast("string"), m["loss"].cast("int").cast("string"))), ",")

    return pairs.withColumns({"n_prompt_turns": F.col("n_prompt_turns").cast("long"), "chosen_mask": runs("chosen_mask"), "rejected_mask": runs("rejected_mask")})


def op5_ratio_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_report(runs.with_periodic_tails(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie_report(table(spark, sf_dir, "conversations"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {
    "op1_boosted_pii": op1_boosted_pii,
    "op2_string_tiling": op2_string_tiling,
    "op3_previous_factors": op3_previous_factors,
    "op4_preference_format": op4_preference_format,
    "op5_ratio_ngrams": op5_ratio_ngrams,
    "op6_setsketch": op6_setsketch,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_decision_list": op8_decision_list,
    "op9_warc_transactions": op9_warc_transactions,
    "op10_source_mix": op10_source_mix,
    "op11_lyndon_runs": op11_lyndon_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_best_fit_packing": op13_best_fit_packing,
}

SQL = {"op4_preference_format": chat.CHAT_SQL, "op9_warc_transactions": warc.WARC_SQL, "op10_source_mix": mixing.MIX_SQL, "op12_prefix_trie": prefixtrie.TRIE_SQL}
