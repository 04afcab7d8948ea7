"""Composed jobs: inspect a table for review, then apply approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from normlake.operators import text_findings, text_transform, urls
from normlake.operators.review import gate_members, review_gates


def inspection_job(sources: DataFrame) -> dict[str, DataFrame]:
    """Job A: findings, gates and proposals a reviewer works on."""
    findings = text_findings.text_findings(sources)
    draft = text_transform.canonicalize_text(sources)
    return {"findings": findings, "gates": review_gates(findings), "gate_members": gate_members(findings), "proposals": draft.proposals()}


def approval_job(sources: DataFrame, approvals: DataFrame, **policy) -> dict[str, DataFrame]:
    """Job B: canonical texts, URL tokens, ledgers and failures under the given approvals.

    URLs are read from the canonical text; a text with one unapproved URL keeps no rewritten form.
    """
    text = text_transform.canonicalize_text(sources, approvals, **policy)
    canonical = text.canonical()
    candidates = urls.url_candidates(canonical.select("source_id", "text"))
    links = urls.canonicalize_urls(urls.analyze_urls(candidates), approvals)
    return {
        "canonical": canonical, "text_ledger": text.ledger(), "text_failures": text.failures(), "url_tokens": links.tokens(),
        "url_ledger": links.ledger(), "url_failures": links.failures(), "rewritten": urls.rewrite_urls(canonical, candidates, links.tokens()),
    }
