"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, language, media, near_dups, neighbours, packing, repeats, secrets, token_counts

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_suffix_array_dedup": repeats.query,
    "op3_nearest_neighbours": neighbours.query,
    "op4_best_fit_packing": packing.query,
    "op5_chat_formatting": chat.query,
    "op6_media_columns": media.query,
    "op7_language_id": language.query,
    "op8_token_counts": token_counts.query,
    "op9_byte_bpe": bpe.query,
    "op10_near_duplicates": near_dups.query,
}
ORACLES = {"op1_secret_scan": secrets.ORACLE, "op5_chat_formatting": chat.ORACLE}
