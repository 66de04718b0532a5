"""The pipeline from raw documents to packed training sequences: quality, language, line dedup, near duplicates, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir).  run(spark, sf_dir) applies them to documents.
"""

from corpusloom.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, language_stage, line_stage, near_duplicate_stage, packing_stage, quality_stage, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "language_stage", "line_stage", "near_duplicate_stage", "packing_stage", "quality_stage", "run"]
