"""Token counts of sections from one encoding of the whole document.

Cutting a text before encoding changes its tokens, so a document is encoded once, whole. Byte-level tokens spell the text, so
their lengths give each token's span; sections are intervals of the same line, and each token goes to one section by rule.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: A file of base64 token and rank on each line. The driver reads it from here; it is sent to the executors with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary parts a text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space (as the pattern has it) of so many characters are handed to the encoder as the pieces that the pattern
#: makes of them: its matcher gives up on much longer ones.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """The encoder and the number of bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def encoded(encoder, text: str) -> np.ndarray:
    """The tokens of the whole text. A long run of white space but its last character, or all of it at the end of the text, is one
    piece to the pattern; what stands before and after it is cut the same without it."""
    if len(text) < 10_000:  # too short to hold such a run
        return encoder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    parts, at = [], 0
    for m in LONG_SPACE.finditer(text):
        to = m.end() if m.end() == len(text) else m.end() - 1
        parts += [encoder.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(encoder._encode_single_piece(text[m.start() : to]))]
        at = to
    parts.append(encoder.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts).astype(np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens for each section, and how many of a section's own tokens reach beyond it.

    starts and ends are the tokens' spans, bounds the sections' starts and the end of the last: adjoining, ascending. A token
    within one section is that section's. One that crosses goes to the section of its first byte (``first``), of its last
    (``last``), or of most of its bytes, the earliest of equals (``most``).
    """
    n = len(bounds) - 1
    at = np.searchsorted(bounds, starts, "right") - 1
    to = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = np.flatnonzero(at != to)
    owner = (to if rule == "last" else at).copy()
    if rule == "most":
        for i in crossing:
            s = np.arange(at[i], to[i] + 1)
            owner[i] = s[np.argmax(np.minimum(bounds[s + 1], ends[i]) - np.maximum(bounds[s], starts[i]))]
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def _sections(name: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = encoding(SparkFiles.get(name))
        for batch in batches:
            ids, out, held = [], [], 0
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                sizes = lengths[encoded(encoder, text)] if text else np.zeros(0, np.int64)
                ends = np.cumsum(sizes)
                cuts = np.flatnonzero(data == 10) + 1
                bounds = np.concatenate([[0], cuts[cuts < len(data)], [len(data)]])
                own, over = attribute(ends - sizes, ends, bounds, rule)
                char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                m = len(own)
                ids += [doc] * m
                out.append((np.arange(m), char[:-1], char[1:], own, over, np.full(m, len(sizes))))
                held += m
                if held >= 20_000:
                    yield _batch(ids, out, batch)
                    ids, out, held = [], [], 0
            if out:
                yield _batch(ids, out, batch)

    return run


def _batch(ids: list, out: list, batch: pa.RecordBatch) -> pa.RecordBatch:
    cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), *cols], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])


def section_tokens(docs: DataFrame, rule: str = "most", path: str = VOCABULARY) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing, doc_tokens: a row for each line of each row of ``docs`` (doc_id, text).

    A section is a line with its line feed; start and end are characters, end exclusive. n_tokens are the tokens that the rule
    gives it, n_crossing those among them that reach beyond it; a document's n_tokens add up to doc_tokens. A null or
    empty text has one empty section without tokens. Repeated rows and null doc_ids get their rows each time; more columns are
    ignored; an empty table gives no rows. Very long texts, runs of white space among them, are encoded whole.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    docs.sparkSession.sparkContext.addFile(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_sections(os.path.basename(path), rule), f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
