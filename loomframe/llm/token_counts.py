"""Token counts by offset-mapped attribution.

A whole document is encoded once. A byte-level vocabulary cuts a text into tokens whose bytes concatenate to it, so the
running sum of token lengths is every token's byte span; an interval join of the spans with a document's sections,
which tile it, gives each section its tokens. A token that crosses a border is allocated by a named rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import chunks

#: Where the public vocabularies lie; read on the driver, and sent to the tasks (less than a megabyte).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")

_encoders: dict[int, tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(ranks: dict[bytes, int], pattern: str) -> tuple:
    """The encoder and its tokens' lengths in bytes, made once in each Python worker."""
    name = hash((pattern, len(ranks), next(iter(ranks))))
    if name not in _encoders:
        import tiktoken

        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[name] = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[name]


def allocate(token_ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. token_ends: where the tokens end; cuts: where the sections begin, and the text's end.

    start: a token belongs to the section of its first byte. majority: to the section that holds most of its bytes, the
    earlier one of equals. split: to all sections it touches, by their shares of its bytes.
    """
    n = len(cuts) - 1
    if rule == "split":
        # the amount of token before a byte, which is linear within each token
        amount = np.interp(cuts, np.concatenate([[0], token_ends]), np.arange(len(token_ends) + 1.0))
        return np.diff(amount)
    starts = np.concatenate([[0], token_ends[:-1]])
    owner = np.searchsorted(cuts, starts, "right") - 1
    if rule == "majority":
        most = np.zeros(len(starts), np.int64)
        place = owner.copy()
        for _ in range(n):  # over the sections that the longest crossing token touches
            held = np.minimum(token_ends, cuts[np.minimum(place + 1, n)]) - np.maximum(starts, cuts[np.minimum(place, n)])
            better = held > most
            owner[better], most[better] = place[better], held[better]
            place = place + 1
            if not ((place < n) & (cuts[np.minimum(place, n)] < token_ends)).any():
                break
    return np.bincount(owner, minlength=n).astype(float)


def section_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rule: str = "start", separator: str = "\n",
    vocabulary: str = VOCABULARY, pattern: str = PATTERN,
) -> DataFrame:
    """Tokens of each section of each whole text: (``key``, section, start, end, tokens), one row for each section.

    Sections end after each ``separator`` (one byte) and at the text's end, and are numbered from 0; start and end are
    code points. A document's tokens are the sum over its sections, for every rule.

    Defined cases: a null or empty text has one empty section with 0 tokens; rows that repeat are counted each; null keys
    come back as null; an empty table gives an empty result; other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    if len(separator.encode()) != 1:
        raise ValueError("separator: one byte")
    ranks = read_ranks(vocabulary)
    mark = separator.encode()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(ranks, pattern)
        for batch in batches:
            for row, end, off, data in chunks(batch.column(1)):
                # code points before each byte: all but continuation bytes count
                points = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                owner, number, begin, stop, tokens = [], [], [], [], []
                raw = data.tobytes()
                for i in range(end - row):
                    a, b = int(off[i]), int(off[i + 1])
                    ends = np.flatnonzero(data[a:b] == mark) + 1
                    cuts = np.unique(np.concatenate([[0], ends, [b - a]])) if b > a else np.zeros(2, np.int64)
                    ids = encoding.encode_ordinary(raw[a:b].decode("utf-8", "replace")) if b > a else []
                    n = allocate(np.cumsum(lengths[ids]), cuts, rule) if ids else np.zeros(1)
                    owner.append(np.full(len(n), row + i))
                    number.append(np.arange(len(n)))
                    begin.append(points[a + cuts[:-1]] - points[a])
                    stop.append(points[a + cuts[1:]] - points[a])
                    tokens.append(n)
                kind = pa.float64() if rule == "split" else pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.concatenate(owner))),
                        pa.array(np.concatenate(number), pa.int32()),
                        pa.array(np.concatenate(begin), pa.int64()),
                        pa.array(np.concatenate(stop), pa.int64()),
                        pa.array(np.concatenate(tokens)).cast(kind),
                    ],
                    names=["id", "section", "start", "end", "tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    amount = "double" if rule == "split" else "long"
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        count, f"id {kind}, section int, start long, end long, tokens {amount}"
    ).withColumnRenamed("id", key)
