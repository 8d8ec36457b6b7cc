"""All queries of the core, by name."""

from __future__ import annotations

from quillstone.plans import data_queries, decision_queries, expansion_queries, graph_queries, name_queries, registry_queries, text_queries

MODULES = (data_queries, name_queries, registry_queries, decision_queries, text_queries, expansion_queries, graph_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def _plain_counts(sql: str) -> str:
    """``count_if(x)`` as a count of cases: DuckDB's own gives a 128-bit sum."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def oracle_sql() -> dict:
    return {k: _plain_counts(v) for m in MODULES for k, v in m.ORACLE.items()}
