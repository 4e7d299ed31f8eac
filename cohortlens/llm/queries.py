"""Queries of the operators, each over the whole of its table, and their SQL."""

from __future__ import annotations

from cohortlens.llm import bestfit, bpe, graph, html, language, lexical, neardup, negatives, packing, passages, topk, toxicity, urls

QUERIES = {
    "op1_topk": topk.query,
    "op2_bpe": bpe.query,
    "op3_html": html.query,
    "op4_packing": packing.query,
    "op5_graph": graph.query,
    "op6_neardup": neardup.query,
    "op7_language": language.query,
    "op8_toxicity": toxicity.query,
    "op9_passages": passages.query,
    "op10_urls": urls.query,
    "op11_lexical": lexical.query,
    "op12_bestfit": bestfit.query,
    "op13_negatives": negatives.query,
}
ORACLES = {
    "op1_topk": topk.SQL,
    "op6_neardup": neardup.SQL,
    "op9_passages": passages.SQL,
    "op11_lexical": lexical.SQL,
    "op13_negatives": negatives.SQL,
}
