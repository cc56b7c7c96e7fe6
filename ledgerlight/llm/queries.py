"""Registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from ledgerlight.llm.best_fit_packing import op11_best_fit_packing
from ledgerlight.llm.decontaminate import OP9_SQL, op9_decontamination
from ledgerlight.llm.quality_rules import OP7_SQL, op7_quality_rules
from ledgerlight.llm.bpe import op4_byte_bpe
from ledgerlight.llm.suffix_dedup import OP6_SQL, op6_suffix_dedup
from ledgerlight.llm.token_counts import op10_token_counts
from ledgerlight.llm.warc import OP5_SQL, op5_warc
from ledgerlight.llm.toxicity import op8_toxicity
from ledgerlight.llm.near_dedup import OP3_SQL, op3_minhash_near_dedup
from ledgerlight.llm.quality_model import op2_quality_classifier
from ledgerlight.llm.periodic_runs import op13_periodic_runs
from ledgerlight.llm.url_filter import OP1_SQL, op1_url_filter
from ledgerlight.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op4_byte_bpe": op4_byte_bpe,
    "op10_token_counts": op10_token_counts,
    "op9_decontamination": op9_decontamination,
    "op5_warc": op5_warc,
    "op8_toxicity": op8_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op3_minhash_near_dedup": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
}
