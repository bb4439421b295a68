"""The queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, lattice, licenses, line_dedup, mixing, quality, simhash, site_quality, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_site_quality": site_quality.op3_site_quality,
    "op4_warc": warc.op4_warc,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_lattice_scores": lattice.op6_lattice_scores,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_warc": warc.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op7_url_filter": url_filter.SQL,
}
