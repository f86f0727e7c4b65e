"""Importing this module registers all queries of the subpackage."""

from __future__ import annotations

import linewright.llm.decontamination  # noqa: F401
import linewright.llm.language_id  # noqa: F401
import linewright.llm.lm_scoring  # noqa: F401
import linewright.llm.near_dedup  # noqa: F401
import linewright.llm.packing  # noqa: F401
import linewright.llm.quality_classifier  # noqa: F401
import linewright.llm.quality_rules  # noqa: F401
import linewright.llm.secret_scans  # noqa: F401
import linewright.llm.source_divergence  # noqa: F401
import linewright.llm.suffix_dedup  # noqa: F401
import linewright.llm.tokenizer_alignment  # noqa: F401
import linewright.llm.toxicity  # noqa: F401
import linewright.llm.url_filters  # noqa: F401
from linewright.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
