"""Sources to chunks with exact character offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import CHUNK_SCHEMA, Config

_WORD = re.compile(r"\S+")


def whole_chunks(sources: DataFrame) -> DataFrame:
    """One chunk for each source."""
    return sources.select("corpus_id", "source_ord", "source_id", F.lit(0).alias("chunk_ord"), F.col("content").alias("text_content"), F.lit(0).alias("char_start"), F.length("content").alias("char_end"))


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Offsets of windows of size words, each overlapping the one before; the last reaches the end."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        yield 0, len(text)
    for first in range(0, len(spans), size - overlap):
        last = min(first + size, len(spans)) - 1
        yield spans[first][0], spans[last][1]
        if last == len(spans) - 1:
            return


def chunk_sources(sources: DataFrame, cfg: Config) -> DataFrame:
    """Sources up to max_source_tokens (four characters each) stay whole; larger ones become windows of words.

    Only the large ones visit Python, a text at a time, without a shuffle.
    """
    whole = whole_chunks(sources)
    if not cfg.auto_chunk:
        return whole
    large = F.floor(F.length("content") / 4) > cfg.max_source_tokens
    size, overlap = cfg.chunk_size, cfg.chunk_overlap

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.corpus_id, r.source_ord, r.source_id, k, r.content[a:b], a, b) for r in pdf.itertuples() for k, (a, b) in enumerate(windows(r.content, size, overlap))]
            yield pd.DataFrame(rows, columns=["corpus_id", "source_ord", "source_id", "chunk_ord", "text_content", "char_start", "char_end"])

    cut_up = sources.where(large).select("corpus_id", "source_ord", "source_id", "content").mapInPandas(cut, CHUNK_SCHEMA)
    return whole_chunks(sources.where(~large)).unionByName(cut_up)
