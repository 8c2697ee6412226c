"""All queries of the subpackage; importing this registers them."""

from __future__ import annotations

from quillmap.llm import alignment, bitpack, bpe, decontamination, exact_dedup, language_id, lm_scoring, merge_queries, near_dedup, pii, repair, sharding, warc  # noqa: F401
from quillmap.llm.common import ORACLES, QUERIES  # noqa: F401
