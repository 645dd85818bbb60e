"""From raw documents to packed training sequences: five stages, each a written table that the next one reads."""

from vellum.llm.stages import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
