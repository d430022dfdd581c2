"""Secret scan: base patterns, and zstandard novelty primed with dictionaries.

A candidate is a long string of key characters. Its novelty is what it adds to the compressed size of its surroundings,
by a compressor that already knows the identifiers of the corpus: words, names, paths and repeats cost few bytes, keys
cost nearly all of their entropy. Incompressible candidates in a context that speaks of credentials are reported beside the base
patterns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .found import Span, scan

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a run of [0-9a-f]+ that is shorter fails as a whole
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{16,}")
#: Words that make the 48 characters before a candidate, or the candidate's own start, speak of credentials.
SENSITIVE = re.compile(
    "key|token|secret|passw|pwd|passphrase|auth|bearer|credential|private|signature|session|cookie|ghp_|gho_|xox[abp]-|sk[-_]|glpat|eyJ",
    re.IGNORECASE,
)
BEFORE, AROUND = 48, 256
#: Compressed bytes per character from which a candidate counts as incompressible (hex digits carry 0.5, base64 0.75).
NOVELTY = 0.5


#: A name as code has it: before a sign of assignment, call, member or index, or with an underscore inside.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}(?=\x20?[=:(.\[])|[A-Za-z]+(?:_[A-Za-z0-9]+)+")
#: Identifiers of the dictionary at most: the commonest ones.
IDENTIFIERS = 2048
#: Placeholders and boilerplate around credentials, known to every compressor.
COMMON = (
    "https://www.example.com/index.html http:// .org .net localhost username user_name password example changeme "
    "your_token_here your_api_key xxxxxxxxxxxxxxxx 0000000000000000 0123456789abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ configuration environment authorization application/json Content-Type "
    "access_key_id secret_access_key api_key = token: Bearer "
)


def corpus_identifiers(docs: DataFrame, text: str = "text", most: int = IDENTIFIERS) -> list[str]:
    """The identifiers that stand in the most documents of the whole table, the commonest last; no more than ``most``.

    Long ones with digits are left out: a key that was copied about must not hide itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(at, 256).to_pylist():
                    if t:
                        seen.update({w for w in IDENTIFIER.findall(t) if len(w) < 16 or not any(c.isdigit() for c in w)})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()
    return [r["word"] for r in reversed(best)]


class _Novelty:
    """Made once in each Python worker."""

    def __init__(self, identifiers: list[str]) -> None:
        content = (" ".join(identifiers) + " " + COMMON).encode()
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False).compress

    def __call__(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND] + "\n").encode("utf-8", "replace")
        return (len(self.compress(around + text[start:end].encode())) - len(self.compress(around))) / (end - start)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap within the kind; matches that fail their test are dropped."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, base: list[Span], novelty: _Novelty, least: float) -> list[Span]:
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        word = m.group()
        mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
        if not mixed or any(s < b and a < e for s, e, _ in base):
            continue
        if SENSITIVE.search(text, max(0, a - BEFORE), a + 8) and novelty(text, a, b) >= least:
            out.append((a, b, "novel"))
    return out


def secret_spans(docs: DataFrame, identifiers: list[str], key: str = "doc_id", text: str = "text", least: float = NOVELTY) -> DataFrame:
    """Spans of secrets in every whole text: (``key``, base, added), arrays of (start, end, kind) in code points.

    base holds the kinds assign, access and hex; added holds novel, found by compression against the surroundings and the
    ``identifiers``, none of which overlaps a base span. Defined cases: null and empty texts have none; very long texts
    are read whole; rows that repeat are scanned each; spans do not tie, as candidates never overlap; null keys come back
    as null; an empty table gives an empty result; other columns are not looked at.
    """

    def find(texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
        novelty = _Novelty(identifiers)
        for t in texts:
            base = base_spans(t)
            yield base, novel_spans(t, base, novelty, least)

    return scan(docs, find, key, text)
