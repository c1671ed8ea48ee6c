"""A training corpus from ``documents`` in five stages; they are in ``terrane.llm.pipeline``."""

from terrane.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
