"""The queries of this folder; importing a module registers its query."""

from gritsieve.llm import balance, collocations, hamming, langid, lbl, lexical, licenses, planes, segment_bpe, templates, topk, toxicity, warc  # noqa: F401
from gritsieve.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
