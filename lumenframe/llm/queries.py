"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: module and function of each query
_AT = {
    "op1_vector_approximation": "vafile",
    "op2_best_fit_packing": "packing",
    "op3_hilbert_shards": "hilbert",
    "op4_compact_windows": "windows",
    "op5_sorted_projections": "neardup",
    "op6_ngram_jaccard": "jaccard",
    "op7_consensus_paths": "html",
    "op8_information_sanitisation": "pii",
    "op9_sampled_pieces": "pieces",
    "op10_ordinal_toxicity": "toxicity",
    "op11_line_bitmaps": "lines",
    "op12_pivot_negatives": "negatives",
    "op13_suffix_transducer": "alignment",
}


def queries() -> dict:
    return {name: _query(module, name) for name, module in _AT.items()}


def _query(module: str, name: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {k: v for k, v in vars(oracles).items() if k.startswith("op")}
