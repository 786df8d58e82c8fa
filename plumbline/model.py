"""Statuses, profiles, schemas and exceptions."""

from __future__ import annotations

from dataclasses import dataclass

VERIFIED, CONTRADICTED, UNVERIFIABLE = "VERIFIED", "CONTRADICTED", "UNVERIFIABLE"
PARSE_ERROR, SKIPPED, INVARIANT_ERROR, ERROR = "PARSE_ERROR", "SKIPPED_DUE_TO_COST", "INVARIANT_ERROR", "ERROR"
#: Claims that need an evaluator where none is given.
OPEN = "OPEN"
GROUNDED, PARTIALLY_GROUNDED, NOT_GROUNDED = "GROUNDED", "PARTIALLY_GROUNDED", "NOT_GROUNDED"
LEXICAL_PASS, SEMANTIC_REVIEW, ALL_LOW = "lexical_pass", "semantic_review", "all_low_escalate"

SOURCE_SCHEMA = (
    "corpus_id string, source_ord long, source_id string, content string, source_type string, page_hint string,"
    " section_id string, original_document_id string, as_of_date string, prev_context string, next_context string,"
    " derived_from_llm boolean"
)
CHUNK_SCHEMA = "corpus_id string, source_ord long, source_id string, chunk_ord int, text_content string, char_start int, char_end int"
CITATION = "struct<source_id:string,excerpt:string,excerpt_char_start:int,excerpt_char_end:int,citation_confidence:double,page_hint:string>"


@dataclass(frozen=True)
class Profile:
    """How strictly claims are held to their sources."""

    name: str
    faithfulness_threshold: float
    lexical_threshold: float
    top_k: int
    majority_vote: bool
    audit: bool


# Fixed values.
STRICT = Profile("strict", 0.97, 2.0, 8, True, True)
GENERAL = Profile("general", 0.80, 0.85, 6, False, False)
RESEARCH = Profile("research", 0.70, 0.85, 4, False, False)


@dataclass(frozen=True)
class Config:
    """Settings of a verification run; all rows of a run share them."""

    profile: Profile = GENERAL
    model: str = "gpt-4o-mini"
    auto_chunk: bool = True
    chunk_size: int = 500
    chunk_overlap: int = 50
    max_source_tokens: int = 8000
    evidence_similarity: float = 0.90
    low_score_floor: float = 0.01
    max_spend: float = 0.50
    context: str | None = None
    attempts: int = 2

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError(f"chunk_overlap {self.chunk_overlap} must be below chunk_size {self.chunk_size}")


class HallucinatedEvidenceError(Exception):
    """Evidence that an agent gave is in none of the sources."""


class VerificationCostExceededError(Exception):
    """The spend cap is exceeded."""


class VerificationFailedError(Exception):
    """A run could not be completed."""


class ParseError(Exception):
    """A model's response is not the JSON asked for, after all attempts."""


class InvariantError(Exception):
    """A verdict lacks the citation it must have."""

    def __init__(self, message: str, cost_usd: float = 0.0):
        super().__init__(message)
        self.cost_usd = cost_usd


class GroundingError(Exception):
    """A text is not grounded in its sources."""
