"""Token counts by overlap resynchronisation.

Huge texts are encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a common token
boundary that provably holds in the whole text: a non-blank character ends there, a blank follows, both encodings have
a boundary there and give the same tokens around it. Where the overlap has no such place, it is widened until it has
one or the chunk reaches the end of the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .memory import bound_batches

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Splices keep this far from a chunk's ends, so that no special string is cut where one is made.
GUARD_CHARS = 32
BLANKS = " \n\t\r"


class _Chunk:
    """The encoding of text[start:end], with the end of each token as a position in the text."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        found = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, found.ids
        self.ends = [start + e for _, e in found.offsets]

    def upto(self, place: int) -> int:
        """Number of tokens that end at or before the place."""
        return bisect_right(self.ends, place)


def _splice(text: str, left: _Chunk, right: _Chunk) -> int | None:
    """The last place in the overlap where both encodings provably agree with that of the whole text."""
    for place in range(left.end - GUARD_CHARS, right.start + GUARD_CHARS, -1):
        if text[place] in BLANKS and not text[place - 1].isspace():
            i, j = left.upto(place), right.upto(place)
            if i and j and left.ends[i - 1] == right.ends[j - 1] == place and left.ids[i - 1] == right.ids[j - 1]:
                return place
    return None


def encode_resynced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[list[int], int]:
    """Ids of the whole text, and the number of chunks it took. A text of one chunk is encoded as it is."""
    if chunk <= 0 or overlap < 0:
        raise ValueError("chunk must be positive and overlap not negative")
    ids: list[int] = []
    begin, taken, chunks = 0, 0, 1
    left = _Chunk(tokenizer, text, 0, min(len(text), chunk + overlap))
    while left.end < len(text):
        wide, place = max(overlap, 1), None
        while place is None and left.end < len(text):
            begin = max(left.start + 1, left.end - wide)
            right = _Chunk(tokenizer, text, begin, min(len(text), begin + wide + chunk))
            place = _splice(text, left, right)
            if place is None:
                wide *= 4
                left = _Chunk(tokenizer, text, left.start, min(len(text), left.end + wide))
        if place is None:
            break
        ids += left.ids[taken : left.upto(place)]
        left, taken, chunks = right, right.upto(place), chunks + 1
    return ids + left.ids[taken:], chunks


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit, n_chunks.

    Null and empty texts have no bytes and no tokens. Texts up to chunk_chars are encoded by the segments that workers
    keep (see encode); longer ones are resynchronised. Repeated rows are counted each; null ids stay null; other columns
    are not read.
    """
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            short = known.encode(x if len(x) <= chunk_chars else "" for x in texts)
            n_tokens, n_chunks = [], []
            for text, ids in zip(texts, short, strict=True):
                if len(text) <= chunk_chars:
                    n_tokens.append(len(ids) // 4)
                    n_chunks.append(1)
                else:
                    found, chunks = encode_resynced(known.tokenizer, text, chunk_chars, overlap_chars)
                    n_tokens.append(len(found))
                    n_chunks.append(chunks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_chunks, pa.int32())], ["id", "n_bytes", "n_tokens", "n_chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, n_chunks int")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
