"""The corpus pipeline's stages, SQL and run; all of it is in ``signpath.llm.pipeline``."""

from __future__ import annotations

from signpath.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
