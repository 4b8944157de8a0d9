"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole: encoding sections apart would give
other tokens at their seams. Token and section spans are both ordered, so their
interval join is a merge; a token that crosses a boundary goes to one section
by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's tokenizer cuts a text before it merges bytes: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Whose a crossing token is: the section of its first byte, or the one with most of its bytes (the first of equals).
RULES = ("first", "most")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer, and each token's length in bytes."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary) from the ends, in bytes, of tokens and of sections.

    Tokens cover the text without gaps, and so do sections; an empty section gets none.
    """
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(sections, starts, "right")
    last = np.searchsorted(sections, ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    own = first.copy()
    if rule == "most":
        for t in crossing.tolist():
            inner = np.arange(first[t], last[t] + 1)
            begin = np.maximum(np.where(inner > 0, sections[inner - 1], 0), starts[t])
            own[t] = inner[np.argmax(np.minimum(sections[inner], ends[t]) - begin)]
    return np.bincount(own, minlength=len(sections)), len(crossing)


def count(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "most", fields: tuple[str, ...] = ("text",), separator: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_bytes, n_crossing, field_tokens (map), section_tokens (array).

    A document is its fields' texts, joined by the separator, which belongs to the
    field before it; its sections are its lines, each with its line end. A null
    field is an empty one; an empty document has no tokens and no sections. Other
    columns are not read, and rows that repeat an id keep a row each.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_crossing", pa.int64()), ("field_tokens", pa.map_(pa.string(), pa.int64())), ("section_tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = encoder(vocabulary, pattern)
        for batch in batches:
            out = []
            for doc_id, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = [(x or "") + separator for x in parts[:-1]] + [parts[-1] or ""]
                text = "".join(pieces)
                raw = text.encode()
                ends = np.cumsum(lengths[tokenizer.encode_ordinary(text)]) if raw else np.zeros(0, np.int64)
                breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
                lines = breaks if not raw or (len(breaks) and breaks[-1] == len(raw)) else np.append(breaks, len(raw))
                by_field = attribute(ends, np.cumsum([len(x.encode()) for x in pieces]), rule)[0] if raw else np.zeros(len(pieces), np.int64)
                by_line, crossing = attribute(ends, lines, rule) if raw else (np.zeros(0, np.int64), 0)
                out.append((doc_id, len(ends), len(raw), crossing, list(zip(fields, by_field.tolist(), strict=True)), by_line.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(schema.types)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"field_{i}") for i, c in enumerate(fields)))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, n_crossing long, field_tokens map<string,bigint>, section_tokens array<bigint>")
