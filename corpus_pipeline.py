"""The corpus pipeline's entry points; its stages are in ``airq.llm.pipeline``."""

from airq.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
