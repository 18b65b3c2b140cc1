"""Repeated byte strings across all texts, found from sorted suffixes and cut out.

Suffixes are sorted only at anchors: of all K-byte grams in a string of ``length`` bytes the one of smallest hash, the first of
equals, is the string's anchor. Equal strings have their anchors at the same place, so only suffixes (and reversed prefixes)
of anchors with one gram need an order among them. Start positions that share an anchor form one interval with one context.

Equal contexts, told by a 128-bit BLAKE2 digest of their bytes, are one suffix of higher multiplicity and are counted before
anything is shipped. The different contexts of a gram are sorted deep-shallow: multikey quicksort to a shallow depth, then a
blind trie for each set of suffixes that still agree. A start is repeated if another member agrees with it on the bytes left
and right of the anchor that make up the string: both orders cut the members into runs by their common prefixes, and two
members in the same two runs agree. The sorter compares bytes, so grams that merely share a hash don't matter to it.

A group too large for one task is parted by Spark before it is sorted: the starts are halved by their distance from the anchor,
and all starts of a half that can be equal share the bytes that every string of that half covers. Equal contexts of a half are
merged by their bytes. Halves go on until each group fits a task; a half of one distance has nothing left to sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
GRAM = 64
#: Bytes beyond the common gram that multikey quicksort looks at before blind tries take over.
SHALLOW = 8
#: Contexts that one task sorts together; a larger group is parted by further bytes first.
LARGEST_GROUP = 20_000
_PIECE = 1 << 20
#: Bits of a place in a piece. They don't depend on the piece, so that equal strings have equal anchors wherever they are.
_PLACE = np.uint64(21)


def _anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """First start, number of starts, anchor's place after the first start and gram hash of each interval.

    ends: for each byte the end of its document.
    """
    n = len(data)
    if n < length:
        return None
    prefix = common.prefix_hash(data)
    inverse = common.powers(n + 1)[1]
    h = common.mixed((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    width = length - gram + 1
    mask = (np.uint64(1) << _PLACE) - np.uint64(1)
    both = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
    padded[: len(h)] = both
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    least = np.minimum(back[: len(starts)], ahead[width - 1 : width - 1 + len(starts)])
    at = (least & mask).astype(np.int64)
    valid = starts + length <= ends[: len(starts)]
    at[~valid] = -1
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    keep = at[first] >= 0
    first, last = first[keep], last[keep]
    at = at[first]
    return first, last - first + 1, at - first, h[at]


def _intervals(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, bounds in common.blocks(batches, ["did"]):
            did = keys["did"]
            ends = np.repeat(bounds[1:], np.diff(bounds))
            out = []
            for lo in range(0, max(1, len(data) - length + 1), _PIECE):
                hi = min(len(data), lo + _PIECE + length - 1)
                if (found := _anchors(data[lo:hi], ends[lo:hi] - lo, length, gram)) is not None:
                    out.append((found[0] + lo, *found[1:]))
            if not out:
                continue
            first, count, off, key = (np.concatenate(x) for x in zip(*out, strict=True))
            doc = np.searchsorted(bounds, first, "right") - 1
            view, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
            context = [digest(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + count - 1 + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [did.take(pa.array(doc)), pa.array(first - bounds[doc]), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(context, pa.binary())],
                ["did", "first", "starts", "off", "key", "ctx"],
            )

    return run


def lcp(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], among: list[int]) -> list[int]:
    """Orders the strings with a trie that stores branching depths and characters only.

    A string goes down by the characters at branching depths without looking at what lies between; one comparison with the
    leaf that it comes to tells where it parts from the trie.
    """

    def at(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    leaf = lambda i: [None, None, [i]]  # noqa: E731  [depth, children, members]
    root = leaf(among[0])
    for i in among[1:]:
        s, node = strings[i], root
        while node[1] is not None:
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
        t = strings[node[2][0]]
        d = lcp(s, t)
        if d == len(s) == len(t):
            node[2].append(i)
            continue
        above, node = None, root
        while node[1] is not None and node[0] < d:
            above, node = node, node[1][at(s, node[0])]
        if node[1] is not None and node[0] == d:
            node[1][at(s, d)] = leaf(i)
            continue
        split = [d, {at(t, d): node, at(s, d): leaf(i)}, None]
        if above is None:
            root = split
        else:
            above[1][at(s, above[0])] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[1] is None:
            out += node[2]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices in ascending order of the strings, which agree on their first ``depth`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        among, d = stack.pop()
        if len(among) <= 1:
            out += among
        elif d >= depth + shallow:
            out += blind_trie_order(strings, among)
        else:
            c = [strings[i][d] if d < len(strings[i]) else -1 for i in among]
            pivot = sorted((c[0], c[len(c) // 2], c[-1]))[1]
            same = [i for i, x in zip(among, c, strict=True) if x == pivot]
            stack.append(([i for i, x in zip(among, c, strict=True) if x > pivot], d))
            if pivot < 0:
                less: list[int] = []
                out += same
            else:
                stack.append((same, d + 1))
                less = [i for i, x in zip(among, c, strict=True) if x < pivot]
            stack.append((less, d))
    return out


def repeated_starts(contexts: list[bytes], offs: np.ndarray, starts: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For each member of a group the offsets before its anchor at which its string also starts in another member."""
    m = len(contexts)
    right = [c[o:] for c, o in zip(contexts, offs, strict=True)]
    left = [c[:o][::-1] for c, o in zip(contexts, offs, strict=True)]
    ranks, commons = [], []
    for strings, depth in ((left, 0), (right, 0)):
        order = deep_shallow_order(strings, depth) if m > 2 else [0, 1]
        ranks.append(np.argsort(order))
        commons.append(np.array([lcp(strings[x], strings[y]) for x, y in zip(order[:-1], order[1:], strict=True)]))
    found: list[list[np.ndarray]] = [[] for _ in range(m)]
    top = int(offs.max()) + 1
    step = max(1, 1_000_000 // m)
    for lo in range(0, top, step):
        i = np.arange(lo, min(top, lo + step))
        run = [np.concatenate([np.zeros((len(i), 1), np.int64), np.cumsum(c[None, :] < need[:, None], axis=1)], axis=1)[:, r] for c, r, need in zip(commons, ranks, (i, length - i), strict=True)]
        pair = run[0] * m + run[1]
        own = (i[:, None] <= offs[None, :]) & (i[:, None] > (offs - starts)[None, :])
        pair[~own] = (-1 - np.arange(m)[None, :] + np.zeros((len(i), 1), np.int64))[~own]
        order = np.argsort(pair, axis=1)
        ordered = np.take_along_axis(pair, order, axis=1)
        twin = np.zeros_like(own)
        same = ordered[:, 1:] == ordered[:, :-1]
        twin[:, 1:] |= same
        twin[:, :-1] |= same
        hit = np.zeros_like(own)
        np.put_along_axis(hit, order, twin, axis=1)
        for j in np.flatnonzero(hit.any(axis=0)):
            found[j].append(i[hit[:, j]])
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers in ascending values."""
    cut = np.flatnonzero(np.diff(values) != 1)
    yield from zip(values[np.concatenate([[0], cut + 1])].tolist(), values[np.concatenate([cut, [len(values) - 1]])].tolist(), strict=True)


_SPAN = "did binary, lo long, hi long"
_INTERVAL = "did binary, first long, starts int, off int, key long, ctx binary"
_CONTEXT = "key long, did binary, first long, starts int, off int, times long, ctx binary"


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, did, list_ in zip(batch.column("text"), batch.column("did").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                rows = [(x["key"], did, x["first"], x["starts"], x["off"], x["times"], data[x["first"] : x["first"] + x["starts"] - 1 + length]) for x in list_]
                for a in range(0, len(rows), 4096):
                    cols = list(zip(*rows[a : a + 4096], strict=True))
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "did", "first", "starts", "off", "times", "ctx"])

    return run


def _sorted_groups(length: int, gram: int):
    """Rows come ordered by key; a group may go on in the next batch."""

    def spans(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["did", "lo", "hi"])

    def solve(rows: list[dict]) -> list[tuple[bytes, int, int]]:
        if len(rows) < 2:
            return []
        offs, starts = np.array([r["off"] for r in rows]), np.array([r["starts"] for r in rows])
        out = []
        for r, i in zip(rows, repeated_starts([r["ctx"] for r in rows], offs, starts, length, gram), strict=True):
            if len(i) and r["times"] == 1:
                out += [(r["did"], a, b) for a, b in _runs(np.sort(r["first"] + r["off"] - i))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group and row["key"] != group[0]["key"]:
                    out += solve(group)
                    group = []
                group.append(row)
            if out:
                yield spans(out)
        if out := solve(group):
            yield spans(out)

    return run


def _halves(pool: DataFrame, length: int) -> DataFrame:
    """Each context as one or two contexts: its starts in the nearer and in the farther half of the group's distances.

    lo and hi are the distances from start to anchor that the group still spans. Two equal strings at a distance within
    a half agree on the ``lo`` bytes before the anchor and the ``length - hi`` from it on; these make the new key.
    """
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("hi").alias("b"))))
    near, far = F.greatest("half.a", F.col("off") - F.col("starts") + 1), F.least("half.b", "off")
    rows = pool.where("lo < hi").withColumn("half", halves).withColumns({"near": near, "far": far}).where("near <= far")
    both = F.substring("ctx", F.col("off") - F.col("half.a") + 1, F.col("half.a") + F.lit(length) - F.col("half.b"))
    return rows.select(
        F.xxhash64("key", "half.a", "half.b", both).alias("key"), "did", (F.col("first") + F.col("off") - F.col("far")).alias("first"), (F.col("far") - F.col("near") + 1).alias("starts"), F.col("far").alias("off"), "times",
        F.substring("ctx", F.col("off") - F.col("far") + 1, F.col("far") - F.col("near") + F.lit(length)).alias("ctx"), F.col("half.a").alias("lo"), F.col("half.b").alias("hi"),
    )


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                data = (text.as_py() or "").encode()
                kept, removed, n, at = hashlib.sha256(), 0, 0, 0
                view = memoryview(data)
                if spans.is_valid:
                    lo = spans.values.field("lo").to_numpy()
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(spans.values.field("hi").to_numpy()[order] + length)
                    new = np.concatenate([[True], lo[1:] > hi[:-1]])
                    for a, b in zip(lo[new].tolist(), hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])].tolist(), strict=True):
                        kept.update(view[at:a])
                        removed, n, at = removed + b - a, n + 1, b
                kept.update(view[at:])
                out.append((doc, len(data), removed, n, kept.hexdigest()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _span() -> list:
    return ["did", F.col("first").alias("lo"), (F.col("first") + F.col("starts") - 1).alias("hi")]


def repeated_spans(texts: DataFrame, length: int, gram: int = GRAM, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """did, lo, hi: the first and last start of runs of ``length``-byte strings that also start elsewhere, of (did, text)."""
    found = common.written(texts.where(F.octet_length("text") >= length).mapInArrow(_intervals(length, gram), _INTERVAL), "anchors")
    total = found.count()
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("n > 1")
    keys = common.written(keys.select("key", (F.col("c0") != F.col("c1")).alias("several"), "n"), "keys")
    shared = common.written(common.matched(found, keys, ["key"], total), "shared")
    spans = shared.where("not several").select(*_span())

    several = shared.where("several").drop("several")
    contexts = several.groupBy("key", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("did", "first", "starts", "off")).alias("one"))
    contexts = common.written(contexts, "contexts")
    again = contexts.where("times > 1").select("key", "ctx", F.col("times").alias("n"))
    spans = spans.union(common.matched(several, again, ["key", "ctx"], total).select(*_span()))

    parts = contexts.groupBy(F.col("one.did").alias("did")).agg(F.collect_list(F.struct("key", "one.first", "one.starts", "one.off", "times")).alias("parts"))
    pool = texts.join(parts, "did").mapInArrow(_cut_contexts(length), _CONTEXT)
    pool = common.written(pool.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)}), "shipped")
    while True:
        large = common.written(pool.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > largest_group), "large")
        many = large.count()
        small = pool.join(common.sized(large, many), "key", "left_anti") if many else pool
        small = small.drop("lo", "hi").repartition("key").sortWithinPartitions("key")
        spans = spans.union(small.mapInArrow(_sorted_groups(length, gram), _SPAN))
        if not many:
            return spans
        halves = common.written(_halves(pool.join(common.sized(large.select("key"), many), "key", "left_semi"), length), "halves")
        merged = halves.groupBy("key", "off", "ctx", "lo", "hi").agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.min(F.struct("did", "first", "starts")).alias("one"))
        merged = common.written(merged, "merged")
        again = merged.where("n > 1").select("key", "off", "ctx", "n")
        spans = spans.union(common.matched(halves, again, ["key", "off", "ctx"], halves.count()).select(*_span()))
        pool = merged.select("key", "one.*", "off", "times", "ctx", "lo", "hi")


def _distinct(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """The texts with one row for each did, and the spans of those that had several: all of the text. None where none had."""
    again = common.written(texts.groupBy("did").agg(F.count("*").alias("n")).where("n > 1").select("did"), "again")
    if not (n := again.count()):
        return texts, None
    again = common.sized(again, n)
    one = common.written(texts.join(again, "did", "left_semi").groupBy("did").agg(F.first("text").alias("text")), "one-each")
    whole = one.where(F.octet_length("text") >= length).select("did", F.lit(0).cast("long").alias("lo"), (F.octet_length("text") - length).cast("long").alias("hi"))
    return texts.join(again, "did", "left_anti").select("did", "text").union(one.select("did", "text")), whole


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text; more columns are ignored).

    Every byte goes that is covered by a ``length``-byte string that also starts elsewhere, in the same text or another; strings
    are judged on the input. Texts are UTF-8 bytes, a null text is empty and matches never cross texts. Rows with equal texts
    lose all bytes if they have ``length`` or more. Repeated rows and null doc_ids are rows of their own. An empty table gives
    no rows. ``gram`` must be less than ``length``. Rows are told apart by the MD5 of doc_id and text; those that are equal are worked
    on once.
    """
    did = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), common.text_or_empty())))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("did", did)
    texts, whole = _distinct(docs.select("did", "text"), length)
    spans = repeated_spans(texts, length, gram, largest_group)
    spans = common.written(spans if whole is None else spans.union(whole), "spans")
    lists = spans.groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.join(lists, "did", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
