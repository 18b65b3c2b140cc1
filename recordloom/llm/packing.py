"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens to target proportions.

Each source is a queue of its documents, cut into packets. In every round a source's deficit grows by its quantum, its share of a
window, and it sends packets as long as the deficit covers them; the rest is carried to the next round. A backlogged queue has
sent, after r rounds, the packets that end within r quanta, so a packet's round follows from where it ends in its queue
alone: no state passes from window to window or task to task, and deficits carry over all of them. Sorting by round, source and
place gives the stream that one scheduler would send, and windows are cut from it at fixed lengths.

Places in queues and in the stream are running sums over range partitions; only a sum for each partition passes the driver.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 2048
#: A packet's largest number of tokens; the share of a source in a window is off its target by less than that.
PACKET = 256
END = 1
#: Words that a task's table holds before those that weren't used lately go.
KNOWN = 1_000_000

# ---- token ids ------------------------------------------------------------------------------------------------------

#: Normalizer and splitter (fixed values) under which a text's ids are those of its pieces between spaces, one after the other.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Pieces of these characters (ASCII that prints, and Latin-1 letters; no apostrophe, which splits by other rules, and no <, with which
#: special tokens begin) are split here; other pieces go through the whole tokenizer.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
#: The same for bytes: 0 parts words, 1 is of a letter, 2 a digit, 3 other; and the bytes of texts that aren't plain.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(9, 14), 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_OTHER = np.zeros(256, bool)
_OTHER[[*range(9), *range(14, 32), 39, 60, 127]] = True
_LEAD = 0xC3  # the first byte of Latin-1 letters; the second is from 0x80 to 0xBF, without those of the signs of times and division


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints in Latin-1, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin to begin + size of every run, one after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begins - upto + sizes, sizes)


def _plain_texts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts of a block have plain characters and white space only."""
    bad = _OTHER[data]
    second = np.concatenate([[False], data[:-1] == _LEAD])
    bad |= (data >= 0x80) & (data != _LEAD) & ~second
    bad |= second & ((data == 0x97) | (data == 0xB7))
    return np.diff(np.concatenate([[0], np.cumsum(bad)])[bounds]) == 0


class Encoder:
    """Ids of texts as little-endian bytes, two for each if the vocabulary allows, else four; equal to encoding each whole text.

    Where the tokenizer drops white space and works word by word, ids of words are kept in a bounded table by 64 hashed bits, and a
    block of texts is put together from it at once.
    """

    def __init__(self, path: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rule = json.load(f)
        first = (rule.get("pre_tokenizer") or {}).get("pretokenizers", [None])[0]
        spaced = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or "<" not in t["content"] for t in rule.get("added_tokens", []))
        self.by_word = rule.get("normalizer") == _NORMALIZER and first == _SPLIT and rule.get("post_processor") is None and not spaced
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.most = known
        self.hashes, self.begins, self.sizes, self.used, self.pool = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, bool, self.kind))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _spelt(self, part: bytes) -> str:
        """A word as the model takes it."""
        return part.decode() if part.isascii() else "".join([self.letters[b] for b in part])

    def _part(self, part: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(self._spelt(part.encode()))], self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of one text, piece by piece."""
        if not self.by_word:
            return self._whole(text)
        pieces = text.translate(_SPACES).split(" ")
        return b"".join(b"".join(self._part(x) for x in _PARTS.findall(p.lower())) if _PLAIN.fullmatch(p) else self._whole(p) for p in pieces if p)

    def _places(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The places of different words in the table, which is sorted by hash; those that it lacks are looked up and put in.

        Of a full table the words that were used since it last was full stay, if they are at most half of it.
        """
        if len(self.hashes) >= self.most:
            keep = self.used if self.used.sum() <= self.most // 2 else np.zeros(len(self.used), bool)
            self.pool = self.pool[_runs(self.begins[keep], self.sizes[keep])]
            self.hashes, self.sizes = self.hashes[keep], self.sizes[keep]
            self.begins, self.used = np.cumsum(self.sizes) - self.sizes, np.zeros(len(self.hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        lacks = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes if len(self.hashes) else np.ones(len(hashes), bool))
        if len(lacks):
            view, tokenize = data.tobytes(), self.tokenizer.model.tokenize
            made = [[t.id for t in tokenize(self._spelt(view[a:b]))] for a, b in zip(starts[lacks].tolist(), ends[lacks].tolist(), strict=True)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            begins = np.cumsum(sizes) - sizes + len(self.pool)
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(made), self.kind, int(sizes.sum()))])
            into = at[lacks]
            self.hashes, self.begins, self.sizes, self.used = (np.insert(x, into, y) for x, y in ((self.hashes, hashes[lacks]), (self.begins, begins), (self.sizes, sizes), (self.used, True)))
            at = np.searchsorted(self.hashes, hashes)
        self.used[at] = True
        return at

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts of a block."""
        plain = _plain_texts(data, bounds) if self.by_word else np.zeros(len(bounds) - 1, bool)
        data = common.lowered(data)
        second = np.concatenate([[False], data[:-1] == _LEAD])
        data[second & (data < 0xA0) & (data != 0x9F)] += 0x20
        kind = _KIND[data]
        kind[np.repeat(~plain, np.diff(bounds))] = 0
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)]) if len(kind) else np.zeros(0, bool)
        new[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(new & (kind > 0))
        ends = np.flatnonzero(np.concatenate([new[1:], [True]]) & (kind > 0)) + 1 if len(kind) else starts
        prefix = common.prefix_hash(data)
        hashes = common.mixed((prefix[ends] - prefix[starts]) * common.powers(len(data) + 1)[1][starts])
        words, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._places(words, starts[first], ends[first], data)[place]
        upto = np.concatenate([[0], np.cumsum(self.sizes[at])])
        ids = self.pool[_runs(self.begins[at], self.sizes[at])]
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(upto[np.searchsorted(starts, bounds)].tolist())]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def tokens(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, source, ids, n of every row: the n ids of the whole text and then ``end``. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        last, width = np.array([end], encoder.kind).tobytes(), encoder.kind.itemsize
        for keys, data, bounds in common.blocks(batches, ["doc_id", "source"]):
            ids = encoder.encode_block(data, bounds)
            for i in np.flatnonzero(~_plain_texts(data, bounds)) if encoder.by_word else range(len(ids)):
                ids[i] = encoder.encode(data[bounds[i] : bounds[i + 1]].tobytes().decode())
            ids = [x + last for x in ids]
            yield pa.RecordBatch.from_arrays([keys["doc_id"], keys["source"], pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64())], ["doc_id", "source", "ids", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, "doc_id long, source string, ids binary, n long")


# ---- the stream -----------------------------------------------------------------------------------------------------


def rounds(packets: DataFrame, shares: DataFrame, window: int) -> DataFrame:
    """The packets with ``round``, the one that sends them: the first whose quanta cover the queue up to the packet's end.

    packets has source and upto, where a packet ends in the order of all queues; shares has source, head, where a queue begins
    there, part and whole: a source's quantum is part / whole of a window. Whole numbers only, so that every machine agrees.
    """
    shares = shares.withColumnRenamed("source", "src")
    joined = packets.join(shares, F.col("source").eqNullSafe(F.col("src"))).withColumn("upto", F.col("upto") - F.col("head"))
    need, quantum = "cast(upto AS decimal(20,0)) * cast(whole AS decimal(17,0))", f"cast(part AS decimal(20,0)) * cast({window} AS decimal(10,0))"
    return joined.withColumn("round", F.expr(f"({need} - 1) div ({quantum}) + 1")).drop("src", "head", "part", "whole")


def _pieces(window: int):
    """Cuts each document's packets, which stand at ``at`` in the stream, at window ends; neighbours in both are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary(), "source": pa.string()}
        for batch in batches:
            out = []
            for doc, source, ids, tokens, sent in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source")), batch.column("ids"), batch.column("n").to_pylist(), batch.column("sent").to_pylist(), strict=True):
                ids = np.frombuffer(ids.as_buffer(), f"<u{ids.as_buffer().size // tokens}").astype("<u4")
                whole = []
                for start, n, at in sorted((x["start"], x["n"], x["at"]) for x in sent):
                    if whole and whole[-1][2] + whole[-1][1] == at:
                        whole[-1][1] += n
                    else:
                        whole.append([start, n, at])
                for start, n, at in whole:
                    while n:
                        k = min(n, window - at % window)
                        cut = ids[start : start + k].tobytes()
                        out.append((doc, start, k, zlib.crc32(cut), tokens, at // window, at % window, cut, source))
                        start, n, at = start + k, n - k, at + k
            for a in range(0, len(out), 4096):
                cols = zip(*out[a : a + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))

    return run


def packed(docs: DataFrame, path: str, window: int = WINDOW, packet: int = PACKET, end: int = END, weights: dict[str | None, int] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids, source: a row for each piece of each document.

    ``docs`` has doc_id, text, source; more columns are ignored. Every row is a document: the ids of its whole text and
    ``end``, so an empty or null text is one token. Rows of one doc_id, null included, are documents of their own; a null source
    is one source. Each token lies in one piece. Sequences hold ``window`` tokens and follow each other from 0; the last alone may
    be short. weights are whole numbers for each source, 1 for others; without any, a source's target is its share of all tokens,
    so that all queues end together. When a queue is empty, the others go on with their own quanta. A source's queue is ordered
    by a hash of doc_id and ids, so reruns agree; equal rows may change places. An empty table gives no rows.
    """
    made = tokens(docs, path, end).withColumn("row", F.monotonically_increasing_id())
    made = common.written(made, "tokens")
    turn = F.xxhash64("doc_id", "ids")
    queue = common.running(made.select("row", "source", turn.alias("turn"), "n"), "n", F.col("source").asc_nulls_first(), "turn", "row", name="before", label="queues")
    queue = common.written(queue, "queues")
    heads = queue.groupBy("source").agg(F.sum("n").alias("own"), F.min("before").alias("head"))
    total = heads.agg(F.sum("own").alias("s"))
    if weights is None:
        shares = heads.crossJoin(F.broadcast(total)).select("source", "head", F.col("own").alias("part"), F.col("s").alias("whole"))  # total is one row
    else:
        weight = F.lit(1)
        for k, v in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(v)).otherwise(weight)
        rated = heads.select("source", "head", weight.cast("long").alias("part"))
        shares = rated.crossJoin(F.broadcast(rated.agg(F.sum("part").alias("whole"))))  # one row
    shares = common.written(shares, "shares")
    shares = common.sized(shares, shares.count())

    parts = queue.select("row", "source", "n", "before", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {packet} AS int)"))).alias("k"))
    start = F.col("k").cast("long") * packet
    parts = parts.select("row", "source", "before", start.alias("start"), F.least(F.lit(packet).cast("long"), F.col("n") - start).alias("len"))
    sent = rounds(parts.withColumn("upto", F.col("before") + F.col("start") + F.col("len")), shares, window)
    stream = common.running(sent.select("row", "source", "start", "len", "upto", "round"), "len", "round", F.col("source").asc_nulls_first(), "upto", name="at", label="stream")
    lists = stream.groupBy("row").agg(F.collect_list(F.struct("start", F.col("len").alias("n"), "at")).alias("sent"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, source string"
    return made.join(lists, "row").select("doc_id", "source", "ids", "n", "sent").mapInArrow(_pieces(window), kinds)
