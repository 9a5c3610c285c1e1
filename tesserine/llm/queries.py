"""The queries of the training-data operators and the SQL that some of them are held against."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage that defines the function of that name
NAMES = {
    "op1_page_differencing": "htmltext",
    "op2_lattice_near_dup": "lattice",
    "op3_warc_capture_index": "warc",
    "op4_quadratic_quality": "quality",
    "op5_entropy_balancing": "mixing",
    "op6_elias_fano_token_ids": "tokenids",
    "op7_marginal_unigram_langid": "langid",
    "op8_feistel_sharding": "sharding",
    "op9_edit_decontamination": "decontaminate",
    "op10_divide_skip_join": "jaccard",
    "op11_seed_extend_dedup": "substrings",
    "op12_gram_spelling_variants": "spelling",
    "op13_bit_parallel_fim": "fim",
}

#: query name -> module whose SQL gives the same rows
IN_SQL = {"op3_warc_capture_index": "warc", "op10_divide_skip_join": "jaccard", "op11_seed_extend_dedup": "substrings", "op12_gram_spelling_variants": "spelling", "op13_bit_parallel_fim": "fim"}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"{__package__}.{module}").SQL for name, module in IN_SQL.items()}
