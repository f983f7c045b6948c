"""All queries of this part: the ten operators, and the pipeline at the repository's top."""

from __future__ import annotations

import corpus_pipeline  # noqa: F401
from textguard.llm import (  # noqa: F401
    covertree,
    decontamination,
    divergence,
    jaccard,
    language_id,
    licenses,
    packing,
    pii,
    quality,
    runs,
    secrets,
    sharding,
    warc,
)
from textguard.llm.common import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
