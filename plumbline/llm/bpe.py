"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before the library sees them, at places where its split pattern always starts a new
match: before an ASCII space or line feed that follows an ASCII letter or digit. A match that reaches such
a place ends there, and what follows it never looks back, so the ids are those of the uncut text. A run
without such a place is split by the pattern itself and each match encoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.shared import batch_of, slices, slim

#: Texts over so many bytes are cut; the library's own matcher overflows on far longer runs of white space.
LONG_TEXT = 32_768
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def load_encoding(ranks: bytes, pattern: str):
    """A tiktoken encoding without special tokens from the content of a rank file."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """The text cut at safe boundaries into pieces of about limit characters (longer where none is near)."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _white_space(pattern: str) -> str:
    """The pattern for the regex module, whose white space also has U+001C to U+001F."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def encode_parts(encoding, pattern: str, text: str, limit: int = LONG_TEXT) -> Iterator[list[int]]:
    """Ids of a whole text, in parts of its order."""
    if len(text) <= limit:
        yield encoding.encode_ordinary(text)
        return
    import regex

    for piece in pieces(text, limit):
        if len(piece) <= 2 * limit:
            yield encoding.encode_ordinary(piece)
        else:
            for match in regex.finditer(_white_space(pattern), piece):
                yield encoding._encode_single_piece(match[0].encode())


def encode(encoding, pattern: str, text: str, limit: int = LONG_TEXT) -> list[int]:
    """Ids of a whole text."""
    return [i for part in encode_parts(encoding, pattern, text, limit) for i in part]


def bpe_tokens(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Per row: the columns in keep, n_tokens, ids_sha256, decoded_sha256 and, if ids, token_ids.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the bytes that the ids decode
    to. A null text counts as empty: no ids. Rows are independent; repeated rows give repeated rows, an empty
    table an empty one. ranks is the content of a rank file: its size is fixed by the vocabulary, not the data.
    """
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast((ranks, pattern))
    kept = docs.select(*keep, text)
    schema = kept.select(*keep).schema
    ddl = [(f.name, f.dataType) for f in schema.fields]
    out = schema
    for name, kind in [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("token_ids", "array<int>")] * ids:
        out = out.add(name, kind) if kind != "array<int>" else out.add(name, _int_array())
    arrow = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("token_ids", pa.list_(pa.int32()))] * ids

    def run(batches):
        ranks, pattern = told.value
        encoding = load_encoding(ranks, pattern)
        decimal = [str(i) for i in range(encoding.n_vocab)]
        for batch, texts in slices(batches, text):
            rows = [[], [], []]
            flat, ends = array("i"), [0]
            for raw in texts:
                n, told_ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for part in encode_parts(encoding, pattern, raw.decode()):
                    if not part:
                        continue
                    told_ids.update((" " * (n > 0) + " ".join([decimal[i] for i in part])).encode())
                    decoded.update(encoding.decode_bytes(part))
                    n += len(part)
                    if ids:
                        flat.extend(part)
                for column, x in zip(rows, (n, told_ids.hexdigest(), decoded.hexdigest()), strict=True):
                    column.append(x)
                ends.append(ends[-1] + n)
            if ids:
                rows.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32))))
            own = [batch.column(n) for n, _ in ddl]
            fields = [pa.field(n, c.type) for (n, _), c in zip(ddl, own, strict=True)] + [pa.field(n, t) for n, t in arrow]
            yield batch_of(pa.schema(fields), *own, *rows)

    return kept.mapInArrow(slim(run), out)


def _int_array():
    from pyspark.sql.types import ArrayType, IntegerType

    return ArrayType(IntegerType())
