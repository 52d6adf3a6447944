"""Registered queries of the llm subpackage and their SQL counterparts."""

from __future__ import annotations

from evalweave.llm import fuzzyhash, oracles, packing, pairs, reading, splits, syntax, tiling, truncation

QUERIES = {
    "p2_found": truncation.p2_found,
    "p2_report": truncation.p2_report,
    "p2_limits": truncation.p2_limits,
    "p3_found": pairs.p3_found,
    "p3_labels": pairs.p3_labels,
    "p4_found": fuzzyhash.p4_found,
    "p4_groups": fuzzyhash.p4_groups,
    "p5_found": splits.p5_found,
    "p5_report": splits.p5_report,
    "p5_classes": splits.p5_classes,
    "p6_found": syntax.p6_found,
    "p6_rates": syntax.p6_rates,
    "p8_packing": packing.p8_packing,
    "p8_report": packing.p8_report,
    "p9_found": tiling.p9_found,
    "p9_covered": tiling.p9_covered,
    "p9_report": tiling.p9_report,
    "p10_found": reading.p10_found,
    "p10_profile": reading.p10_profile,
}
SQL: dict = dict(oracles.SQL)
