"""Fill-in-middle: each text cut at two unit ends into prefix, middle and suffix, and put together anew in another order.

Units are lines. Their ends are a bitvector over the bytes of a run of texts, packed into words, with a directory of popcounts
for each block of words. A text's number of units is the ones between its bounds; two drawn ranks are turned into byte cuts by
select. A second bitvector marks the bytes that begin a code point, and rank on it tells the parts' lengths in characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_WORD = np.arange(8)


class Bits:
    """A bitvector of 64-bit words in blocks of eight, with the number of ones before each block."""

    def __init__(self, flags: np.ndarray):
        self.words = np.zeros((len(flags) // 512 + 1) * 8, np.uint64)
        packed = np.packbits(flags, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).reshape(-1, 8).sum(axis=1, dtype=np.int64))])

    def total(self) -> int:
        return int(self.before[-1])

    def _block(self, block: np.ndarray) -> np.ndarray:
        return self.words[(block * 8)[:, None] + _WORD]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place, which may be the vector's end."""
        block, word, bit = at >> 9, (at >> 6) & 7, (at & 63).astype(np.uint64)
        inside = self._block(block)
        whole = np.where(_WORD < word[:, None], np.bitwise_count(inside), 0).sum(axis=1, dtype=np.int64)
        part = np.bitwise_count(inside[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[block] + whole + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 1."""
        block = np.searchsorted(self.before, k, "left") - 1
        inside = self._block(block)
        upto = np.cumsum(np.bitwise_count(inside), axis=1, dtype=np.int64)
        need = k - self.before[block]
        word, row = (upto < need[:, None]).sum(axis=1), np.arange(len(k))
        need -= np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(inside[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 512 + word * 64 + (np.cumsum(bits, axis=1) < need[:, None]).sum(axis=1)


def unit_cuts(data: np.ndarray, bounds: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """For each text of a block: its units, the bytes before the first and the second cut, and the code points before each."""
    ends = data == 10
    ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
    units, chars = Bits(ends), Bits((data & 0xC0) != 0x80)
    ones = units.rank(bounds)
    n = np.diff(ones)
    ranks = [d % (n + 1) for d in draws]
    out = []
    for rank in (np.minimum(*ranks), np.maximum(*ranks)):
        cut = bounds[:-1].copy()
        some = np.flatnonzero(rank)
        cut[some] = units.select((ones[:-1] + rank)[some]) + 1
        out.append(cut)
    first = chars.rank(bounds[:-1])
    return n, *(c - bounds[:-1] for c in out), *(chars.rank(c) - first for c in out)


_CUTS = "struct<n:bigint,first:bigint,second:bigint,first_chars:bigint,second_chars:bigint>"


def _cuts(found: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = ["n", "first", "second", "first_chars", "second_chars"]
    for text, one, two in found:
        batch = pa.RecordBatch.from_arrays([text, one, two], ["text", "one", "two"])
        parts = [unit_cuts(data, bounds, (keys["one"].to_numpy(), keys["two"].to_numpy())) for keys, data, bounds in common.blocks(iter([batch]), ["one", "two"])]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


@dataclass(frozen=True)
class Infill:
    """seed of the draws; of 100 texts ``rate`` are cut, of these ``spm`` put the suffix first; the marks before prefix, suffix, middle."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")


def _draw(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th group of eight hex digits of a digest of the seed and doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs`` (doc_id, text; more columns are ignored).

    n counts lines; a last piece without a line feed is one. Prefix ends after the smaller, middle after the larger of two
    drawn numbers of lines. form is psm or spm by a draw of doc_id; it is plain, output is the text itself and the lengths are null
    where the draw leaves a text out, the text is empty or holds a mark. A null text is empty and a null doc_id draws as no
    digits; rows of one doc_id draw alike. An empty table gives no rows.
    """
    text = common.text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), *(_draw(F.col("doc_id"), rule.seed, i).alias(f"h{i}") for i in (1, 2, 3, 4)))
    rows = rows.withColumn("cut", F.arrow_udf(_cuts, _CUTS)("text", "h1", "h2"))
    marked = F.lit(False)
    for m in rule.marks:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rule.rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < rule.spm, "spm").otherwise("psm")
    raw = F.col("text").cast("binary")
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle = F.substring(raw, F.lit(1), first), F.substring(raw, first + 1, second - first)
    suffix = F.substring(raw, second + 1, F.octet_length("text") - second)
    p, s, m = (F.lit(x.encode()) for x in rule.marks)
    output = F.when(F.col("form") == "plain", raw).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    lengths = {"prefix_chars": F.col("cut.first_chars"), "middle_chars": F.col("cut.second_chars") - F.col("cut.first_chars")}
    return rows.withColumn("form", form).select("doc_id", F.col("cut.n").alias("n"), "form", *(F.when(F.col("form") != "plain", c).alias(k) for k, c in lengths.items()), output.cast("string").alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = Infill.marks) -> Column:
    """The text that an output was made of. No text that was cut holds a mark, so the output has three."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def infill_digests(docs: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of each output and of the text rebuilt from it."""
    made = common.held(fill_in_middle(docs, rule), made=F.col("output")).drop("output")
    back = restored(F.col("made"), F.col("form"), rule.marks)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("made", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def oracle() -> str:
    return r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
        ), e AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e
        ), p AS (
            SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """
