"""Registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from evalweave.operators import delivery, drift
from evalweave.plans import evaluation, texts

QUERIES: dict = {**evaluation.QUERIES, **texts.QUERIES, **delivery.QUERIES, **drift.QUERIES}
SQL: dict = {**evaluation.SQL, **texts.SQL, **delivery.SQL, **drift.SQL}


def with_types(sql: str, kind: str, *columns: str) -> str:
    """``sql`` with columns brought to the type that Spark gives them; DuckDB's sums of integers are wider."""
    return "select * replace (" + ", ".join(f'cast("{c}" as {kind}) as "{c}"' for c in columns) + f") from ({sql}) t"


for _name, _columns in {
    "q01_pass_at_k": ["total_samples", "total_passed"], "q02_dedupe_last": ["passed"], "q03_dedupe_first": ["passed"], "q03_dedupe_none": ["passed"], "q27_lookup": ["prompt_chars"],
    "q29_rollup": ["iso_applied"], "q45_retryable": ["retryable"], "q48_variants": ["with_a"], "q20_auc": ["n_seen", "n_unseen"], "q28_lines": ["blank", "malformed"],
    "q33_prompt_fallback": ["chars"], "q22_box_summary": ["outliers"], "q30_fuzz_totals": ["replacements"], "q11_contract_modes": ["with_examples"], "q10_roundtrip": ["skipped_large"], "q37_natural_language": ["natural"], "q47_corpus_chunks": ["chars"],
}.items():
    SQL[_name] = with_types(SQL[_name], "bigint", *_columns)
SQL["q28_schema_profile"] = with_types(SQL["q28_schema_profile"], "integer", "min_length", "max_length")
