"""What ``__spark_entry__`` adds: the operators' queries, the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .queries import ORACLE_SQL as _OPERATOR_SQL
from .queries import QUERIES as _OPERATORS

QUERIES = _OPERATORS | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = _OPERATOR_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
