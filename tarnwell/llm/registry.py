"""The queries of this package and their SQL."""

from __future__ import annotations

from . import collocations, exact_dedup, fingerprints, license_scan, manifest, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, sentencepiece, toxicity, warc

MODULES = (quality_rules, license_scan, toxicity, quality_classifier, mixing, secret_scan, sentencepiece, near_dedup, exact_dedup, warc, fingerprints, collocations, manifest)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
