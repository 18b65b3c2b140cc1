"""Toxicity scores from a factorization machine over hashed words and hashed runs of characters.

Besides a weight for each term it learns a vector for each, whose products weigh pairs: an insult beside a mention of a group
can count for more than the two alone. Every term of the bounded sample of labelled rows gets both; runs of characters let
inflected forms share theirs. How freely a term's weight and vector move follows from its evidence: its own, or that of a pair which
it is part of, so that two terms which show nothing alone are learnt as a pair. One task fits, as the sample is
bounded; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

BINS_LOG2 = 20
#: At most so many labelled rows are read to fit; they are those of smallest hash, so any size of table gives a like sample.
MOST_ROWS = 20_000
#: Runs of so many bytes inside words are terms, too.
RUN = 4
#: A term's feature is the square of its standard errors by this, 1 at most: with little evidence it is small, but never left out.
FULL_Z = 10.0
#: Terms among which pairs are looked for that tell more than their members, and the standard errors from which on a pair counts
#: somewhat and wholly.
PAIR_TERMS, LEAST_PAIR_Z, FULL_PAIR_Z = 1024, 6.0, 12.0
#: Share of clean training rows that may score over 0.5 where the machine hasn't seen them.
FALSE_ALARMS = 0.003
FACTORS = 4


@dataclass(frozen=True)
class Machine:
    """terms: hash bins in ascending order; the score is the logistic of bias + sum of weights + products of pairs."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def table(self) -> np.ndarray:
        """For each bin its place among the terms, -1 where it has none."""
        out = np.full(1 << BINS_LOG2, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of 0 and 1 for each term."""
        p = x @ self.vectors
        pairs = 0.5 * ((p**2).sum(axis=1) - x @ (self.vectors**2).sum(axis=1))
        return _logistic(self.bias + x @ self.weights + pairs)

    def sums(self, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """What the logistic is taken of, for n rows that hold the terms at the places given for each row."""
        z, q = _rows(row, place, n, self.weights, self.vectors, (self.vectors**2).sum(axis=1))[:2]
        return self.bias + z + q


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(row: np.ndarray, at: np.ndarray, n: int, w: np.ndarray, v: np.ndarray, v2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: sum of weights, products of pairs, sum of vectors."""
    p = np.stack([np.bincount(row, weights=v[:, f][at], minlength=n) for f in range(v.shape[1])], axis=1)
    return np.bincount(row, weights=w[at], minlength=n), 0.5 * ((p**2).sum(axis=1) - np.bincount(row, weights=v2[at], minlength=n)), p


def _fit(start: np.ndarray, at: np.ndarray, y: np.ndarray, scale: np.ndarray, factors: int, steps: int, rate: float, ridge: float, batch: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss of rows that hold the terms at[start[i]:start[i + 1]], with a ridge on weights and vectors before
    scaling; the same input gives the same result."""
    rng = np.random.Generator(np.random.PCG64(3))
    n, m = len(y), len(scale)
    base = (y.sum() + 0.5) / (n + 1)
    theta = [np.array([np.log(base / (1 - base))]), np.zeros(m), rng.normal(0, 0.01, (m, factors))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    begins, step = list(range(0, n, batch)), 0
    while step < steps:
        for lo in begins:
            step += 1
            hi = min(n, lo + batch)
            own, row = at[start[lo] : start[hi]], np.repeat(np.arange(hi - lo), np.diff(start[lo : hi + 1]))
            b, w, v = theta[0], theta[1] * scale, theta[2] * scale[:, None]
            z, q, p = _rows(row, own, hi - lo, w, v, (v**2).sum(axis=1))
            g = (_logistic(b[0] + z + q) - y[lo:hi]) / (hi - lo)
            xg = np.bincount(own, weights=g[row], minlength=m)
            gv = np.stack([np.bincount(own, weights=(g * p[:, f])[row], minlength=m) for f in range(factors)], axis=1)
            grads = [np.array([g.sum()]), xg * scale + ridge * theta[1], (gv - v * xg[:, None]) * scale[:, None] + ridge * theta[2]]
            for t, d, f, s in zip(theta, grads, first, second, strict=True):
                f += 0.1 * (d - f)
                s += 0.001 * (d * d - s)
                t -= rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return float(theta[0][0]), theta[1] * scale, theta[2] * scale[:, None]


def _pair_evidence(start: np.ndarray, at: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """For each of m terms how much its strongest pair tells beyond its members, from 0 to 1.

    For two terms that is the sum over rows of label, first and second term, each less its mean, in standard errors. It is about
    0 where a term alone tells all that the pair tells. The PAIR_TERMS terms whose presence varies most are looked at; with so many
    pairs, LEAST_PAIR_Z standard errors come about by chance.
    """
    n = len(y)
    count = np.bincount(at, minlength=m)
    top = np.argsort(-count * (n - count), kind="stable")[:PAIR_TERMS]
    place = np.full(m, -1)
    place[top] = np.arange(len(top))
    label, share = (y - y.mean()).astype(np.float32), (count[top] / n).astype(np.float32)
    total, spread = np.zeros((len(top), len(top)), np.float32), np.zeros((len(top), len(top)), np.float32)
    for lo in range(0, n, 2000):
        hi = min(n, lo + 2000)
        own = place[at[start[lo] : start[hi]]]
        row = np.repeat(np.arange(hi - lo), np.diff(start[lo : hi + 1]))
        x = np.zeros((hi - lo, len(top)), np.float32)
        x[row[own >= 0], own[own >= 0]] = 1
        x -= share
        total += x.T @ (x * label[lo:hi, None])
        spread += (x**2).T @ (x**2 * label[lo:hi, None] ** 2)
    z = np.abs(total) / np.sqrt(spread + 1e-9)
    np.fill_diagonal(z, 0)
    out = np.zeros(m)
    out[top] = np.clip((z.max(axis=1, initial=0) - LEAST_PAIR_Z) / (FULL_PAIR_Z - LEAST_PAIR_Z), 0, 1)
    return out


def fit_sample(lists: list[np.ndarray], y: np.ndarray, steps: int = 40, rate: float = 0.1, ridge: float = 1e-5, batch: int = 1000) -> Machine:
    """The machine for rows of hashed terms. All terms get a weight and a vector, whose scale is the evidence of the term or of a pair.

    Two machines, each fitted on every other row, score the rows that they haven't seen; the bias is moved so that the score is
    0.5 where no more than FALSE_ALARMS of the clean ones among these are above.
    """
    terms, at = np.unique(np.concatenate(lists), return_inverse=True)
    terms, at = terms.astype(np.int32), at.astype(np.int32)
    start = np.cumsum([0, *map(len, lists)])

    def fitted(rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        own = np.concatenate([at[start[i] : start[i + 1]] for i in rows])
        sizes, t, n = np.diff(start)[rows], y[rows].sum(), len(rows)
        share = np.bincount(own, minlength=len(terms)) / n
        hits = np.bincount(own, weights=np.repeat(y[rows], sizes), minlength=len(terms))
        z = (hits - t * share) / np.sqrt(t * share * (1 - share) * (n - t) / max(n - 1, 1) + 1e-9)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        scale = np.maximum(np.minimum(np.abs(z) / FULL_Z, 1) ** 2, _pair_evidence(begins, own, y[rows], len(terms)))
        passes = max(4 * -(-n // batch), steps)
        return _fit(begins, own, y[rows], scale, FACTORS, passes, rate, ridge, batch)

    bias, weights, vectors = fitted(np.arange(len(y)))
    halves = [np.arange(i, len(y), 2) for i in (0, 1)]
    if all(0 < y[h].sum() < len(h) for h in halves):
        unseen = np.empty(len(y))
        for seen, other in (halves, halves[::-1]):
            half = Machine(terms, *fitted(seen))
            for i in range(0, len(other), batch):
                some = other[i : i + batch]
                sizes = np.diff(start)[some]
                unseen[some] = half.sums(np.repeat(np.arange(len(some)), sizes), np.concatenate([at[start[j] : start[j + 1]] for j in some]), len(some))
        clean = np.sort(unseen[y == 0])[::-1]
        over = clean[int(FALSE_ALARMS * len(clean))]
        higher = unseen[(y == 1) & (unseen > over)]
        if len(higher):
            bias -= float(over + higher.min()) / 2
    return Machine(terms, bias, weights.astype(np.float32), vectors.astype(np.float32))


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of RUN bytes inside a word, and its document."""
    low = common._LOWER[data]
    if len(low) < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.concatenate([[0], np.cumsum(~common._PUNCT[low])])
    i = np.flatnonzero(inside[RUN:] - inside[:-RUN] == RUN)
    doc = np.searchsorted(bounds, i, "right") - 1
    whole = i + RUN <= bounds[doc + 1]
    i, doc = i[whole], doc[whole]
    packed = sum((low[i + j].astype(np.uint64) << np.uint64(8 * j) for j in range(1, RUN)), low[i].astype(np.uint64))
    return common.mixed(packed + np.uint64(1 << 40)), doc


def _bins(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of each document in ascending order, and where each document's begin."""
    hashes, at = common.words(data, bounds, common._PUNCT)
    ends = np.append(at[1:], len(hashes))[: len(bounds)]
    runs, doc = _runs(data, bounds)
    docs = np.concatenate([np.repeat(np.arange(len(bounds)), ends - at), doc]).astype(np.int64)
    both = np.sort(docs << BINS_LOG2 | (np.concatenate([hashes, runs]) >> np.uint64(64 - BINS_LOG2)).astype(np.int64))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both & ((1 << BINS_LOG2) - 1)).astype(np.int32), np.searchsorted(both >> BINS_LOG2, np.arange(len(bounds)))


def _terms(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, data, bounds in common.blocks(batches, keys):
            bins, at = _bins(data, bounds)
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bins))], [*keys, "bins"])

    return run


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the machine that is fitted on all rows of the partition, taken in the order of their ids."""
    ids, ys, lists = [], [], []
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        ys += batch.column("y").to_pylist()
        col = batch.column("bins")
        values, at = col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy())])
        lists += [values[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], len(lists[i]), lists[i].tobytes()))
    machine = fit_sample([lists[i] for i in order], np.array([ys[i] for i in order], float))
    out = io.BytesIO()
    np.savez(out, terms=machine.terms, bias=machine.bias, weights=machine.weights, vectors=machine.vectors)
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["machine"])


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    """Fits on documents with a label (labels: doc_id, toxic). Null labels and ids don't count; of several labels the largest holds.

    Without labelled documents, or without both labels among them, the machine has no terms and gives every text one score.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = common.written(known.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(most_rows), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # most_rows at most
    rows = common.written(rows.mapInArrow(_terms(["doc_id", "y"]), "doc_id long, y int, bins array<int>"), "terms")
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    if total["n"] > most_rows:  # repeated ids: of their rows as many stay as were asked for
        rows = common.written(rows.orderBy(F.xxhash64("doc_id", "bins"), "doc_id").limit(most_rows), "terms")
        total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n, toxic = total["n"], total["t"] or 0
    if not 0 < toxic < n:
        return Machine(np.zeros(0, np.int64), float(np.log((toxic + 0.5) / (n - toxic + 0.5))) if n else -2.0, np.zeros(0), np.zeros((0, FACTORS)))
    made = np.load(io.BytesIO(rows.coalesce(1).mapInArrow(_fitted, "machine binary").first()["machine"]))  # most_rows labels at most
    return Machine(made["terms"], float(made["bias"]), made["weights"], made["vectors"])


def _scores(machine: Machine, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = machine.table()
        for cols, data, bounds in common.blocks(batches, columns):
            bins, at = _bins(data, bounds)
            place = table[bins]
            known = np.flatnonzero(place >= 0)
            doc = np.searchsorted(at, known, "right") - 1
            scores = _logistic(machine.sums(doc, place[known], len(bounds) - 1))
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(scores)], [*columns, "__score"])

    return run


def with_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` with score and predicted (1 from a score of 0.5), which take the place of columns so named.

    A null text scores as an empty one.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*kept)
    out = rows.mapInArrow(_scores(machine, kept), StructType([*rows.schema.fields, StructField("__score", DoubleType())]))
    return out.select(*kept, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); more columns are ignored.

    Learns only from labelled rows that are not held out. Null and empty texts have no terms and get the machine's base score;
    repeated rows get their score each time; a null doc_id has a null held_out. An empty table gives no rows.
    """
    machine = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = with_scores(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
