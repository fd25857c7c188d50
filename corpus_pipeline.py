"""Training-data pipeline over ``documents``: each stage is written as Parquet and read again."""

from __future__ import annotations

from logsift.llm.pipeline import STAGES, run

#: The first stage's predictions come from a trained network, which SQL cannot express.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
