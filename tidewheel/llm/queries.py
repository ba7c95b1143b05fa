"""The registered query of each operator, and its SQL where SQL can express it."""

from . import exact_dedup, mixing, near_dedup, pieces, quality, surrogates, token_store, topk, toxicity, url_filter

QUERIES = {
    "op1_surrogates": surrogates.op1,
    "op2_mixing": mixing.op2,
    "op3_pieces": pieces.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_toxicity": toxicity.op5,
    "op6_near_dedup": near_dedup.op6,
    "op7_quality": quality.op7,
    "op8_url_filter": url_filter.op8,
    "op9_token_files": token_store.op9,
    "op10_top_k": topk.op10,
}
ORACLE_SQL = {"op2_mixing": mixing.OP2_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op8_url_filter": url_filter.OP8_SQL, "op10_top_k": topk.OP10_SQL}
