"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, language, licenses, mixing, near_dup, phrases, pseudonyms, quality, stripes, suffix_tree, token_count, warc


def queries() -> dict:
    return {
        "op1_contained_items": decontaminate.op1_contained_items,
        "op2_warc": warc.op2_warc,
        "op3_suffix_tree": suffix_tree.op3_suffix_tree,
        "op4_repetition": quality.op4_repetition,
        "op5_language": language.op5_language,
        "op6_near_duplicates": near_dup.op6_near_duplicates,
        "op7_mixture": mixing.op7_mixture,
        "op8_token_counts": token_count.op8_token_counts,
        "op9_licenses": licenses.op9_licenses,
        "op10_pseudonyms": pseudonyms.op10_pseudonyms,
        "op11_source_divergence": stripes.op11_source_divergence,
        "op12_chat_format": chat.op12_chat_format,
        "op13_collocations": phrases.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_contained_items": decontaminate.OP1_SQL,
        "op2_warc": warc.OP2_SQL,
        "op4_repetition": quality.OP4_SQL,
        "op6_near_duplicates": near_dup.OP6_SQL,
        "op7_mixture": mixing.OP7_SQL,
        "op11_source_divergence": stripes.OP11_SQL,
        "op12_chat_format": chat.OP12_SQL,
        "op13_collocations": phrases.OP13_SQL,
    }
