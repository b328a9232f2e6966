"""All queries of the subpackage, the pipeline among them, and their SQL, for ``__spark_entry__``."""

from corpus_pipeline import ORACLE_SQL, run

from .queries import ORACLE, QUERIES

LLM_QUERIES = {**QUERIES, "pipeline": run}
LLM_ORACLE = {**ORACLE, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
