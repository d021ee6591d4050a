"""The queries of this subpackage and their SQL."""

from hirelake.llm import bpe, decontam, infilling, language, line_dedup, mixing, quality, sharding, simhash, suffix_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_language": language.op2_language,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontamination": decontam.op5_decontamination,
    "decontamination_near": decontam.decontamination_near,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality": quality.op9_quality,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_whitening": whitening.op11_whitening,
    "op12_fill_in_middle": infilling.op12_fill_in_middle,
    "op13_mixing": mixing.op13_mixing,
}
ORACLES = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_decontamination": decontam.OP5_SQL,
    "op9_quality": quality.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_fill_in_middle": infilling.OP12_SQL,
    "op13_mixing": mixing.OP13_SQL,
}
