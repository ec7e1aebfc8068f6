"""Imports every operator, so that their queries register."""

from plantwatch.llm import (bpe, centroids, decontaminate, filter_audit, jaccard, lengths, lines, mix, pages,  # noqa: F401
                            quality, secret_scan, toxicity, urls)
from plantwatch.llm.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
