"""Imports every operator module so that its query is registered."""

from vigil.llm import decontaminate, fingerprints, jaccard_join, licenses, manifest, mixing, phrases, pii, substring_dedup, token_counts, top_k, toxicity, url_filter  # noqa: F401
from vigil.llm.registry import REGISTRY  # noqa: F401
