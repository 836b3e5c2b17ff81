"""The queries of this folder and the pipeline, with their SQL."""

from __future__ import annotations

from .queries import ORACLE, QUERIES


def queries() -> dict:
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**ORACLE, **sql}
