"""Registered queries: every operator over the driver's tables, with an equivalent SQL text where there is one."""
from . import claim_queries, evidence_queries, report_queries, scan_queries, source_queries, text_queries

MODULES = (text_queries, source_queries, scan_queries, claim_queries, evidence_queries, report_queries)


def queries():
    out = {}
    for m in MODULES:
        out.update(m.R.queries)
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out.update(m.R.oracles)
    return out
