"""plumbline: checking generated text against its sources, on Spark."""

import importlib
import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HOMES = {
    "plumbline.plans.verify": "assert_faithful assert_grounded logged raise_failure verify verify_analysis verify_answer verify_clause verify_or_retry verify_structured",
    "plumbline.streaming.verify": "conversation_scores verify_stream windowed_scores",
    "plumbline.model": "GENERAL RESEARCH STRICT Config GroundingError HallucinatedEvidenceError InvariantError ParseError Profile VerificationCostExceededError VerificationFailedError",
    "plumbline.operators.results": "accumulated analysis_summary citation_invariant faithfulness_summary majority",
    "plumbline.operators.chunking": "chunk_sources whole_chunks",
    "plumbline.operators.costs": "analysis_cost answer_cost",
    "plumbline.sources.accumulate": "first_of_each has_model_text terms with_boundary_context",
    "plumbline.sources.tables": "docx_paragraphs financial_rows legal_sections paragraph_sources retrieved_sources row_sources sections xlsx_rows",
    "plumbline.evaluators.protocol": "LiteLLM Overlap Scripted",
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_HOME_OF)


def __getattr__(name: str):
    """Exported names are imported when they are first asked for."""
    if name not in _HOME_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_HOME_OF[name]), name)
