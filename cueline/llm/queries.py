"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact, fmindex, licences, mixing, near, packing, phrases, quality, resample, sharding, suffix, tokenfiles, tokens

QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_substring_dedup": fmindex.op2_substring_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_sharding": sharding.op4_sharding,
    "op5_licences": licences.op5_licences,
    "op6_quality": quality.op6_quality,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_near_dedup": near.op8_near_dedup,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_token_files": tokenfiles.op11_token_files,
    "op12_phrases": phrases.op12_phrases,
    "op13_resampling": resample.op13_resampling,
}
ORACLES = {"op3_mixing": mixing.SQL, "op4_sharding": sharding.SQL, "op9_exact_dedup": exact.SQL, "op12_phrases": phrases.SQL}
