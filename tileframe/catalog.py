"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from .plans import assessments, calibration, georeference, objects, pixels, text_and_files
from .plans.registry import QUERIES, SQL, Query
from .streaming import queries as streams

_ = (assessments, calibration, georeference, objects, pixels, text_and_files, streams)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
