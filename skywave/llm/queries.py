"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, languages, merkle, packing, periods, ranking, secrets, sentencepieces, sharding, simhash, substrings, toxicity


def queries() -> dict:
    return {
        "op1_repeated_substrings": substrings.op1_repeated_substrings,
        "op2_packed_sequences": packing.op2_packed_sequences,
        "op3_sentence_pieces": sentencepieces.op3_sentence_pieces,
        "op4_merkle_fingerprints": merkle.op4_merkle_fingerprints,
        "op5_chat_format": chat.op5_chat_format,
        "op6_shards": sharding.op6_shards,
        "op7_simhash_groups": simhash.op7_simhash_groups,
        "op8_toxicity_scores": toxicity.op8_toxicity_scores,
        "op9_nearest_vectors": ann.op9_nearest_vectors,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_language_ids": languages.op12_language_ids,
        "op13_ranked_search": ranking.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.ORACLE_SQL, "op13_ranked_search": ranking.ORACLE_SQL}
