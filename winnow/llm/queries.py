"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from winnow.llm import (alignment, ann, exact_dedup, langid, line_dedup, packing, periodic, pieces, range_coder, simhash,
                        suffix_dedup, toxicity, warc)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_token_files": range_coder.op5_token_files,
    "op6_warc": warc.op6_warc,
    "op7_langid": langid.op7_langid,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ann": ann.op9_ann,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_alignment": alignment.op12_alignment,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {
    "op6_warc": warc.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_line_dedup": line_dedup.SQL,
}
