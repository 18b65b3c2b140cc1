import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import common, packing

from .conftest import docs_of, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["", "a", "It's <|endoftext|> x", "ÀÉß×÷ñ Ñandú\tTab\nnew 12,345.67 --...", "Ω ΣΑΣ", "é café", "a b c", "don't WE'LL 'tis", "x\x1fy\x7fz", "漢字 \U0001f600!", "ÿþÿ ª º µ ²³ ¼", "<|startoftext|>hello<|endoftext|>", "  two  spaces ", "İstanbul", "naïve—dash…", "\n", "9", "abc123def", "ç" * 50, "a\x85b"]


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [packing.END], "<u4")


def encoded(encoder, texts):
    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    block = np.frombuffer(b"".join(data), np.uint8)
    plain = packing._plain_texts(block, bounds)
    return [b if p else encoder.encode(t) for b, p, t in zip(encoder.encode_block(block, bounds), plain, texts, strict=True)]


def test_ids_are_those_of_the_whole_text():
    for known in (packing.KNOWN, 20):  # a table that is full all the time
        encoder = packing.Encoder(PATH, known)
        texts = ODD + [prose(i, 200).title() for i in range(30)] + ODD
        for some in (texts, texts[::-1], [x + y for x, y in zip(ODD, ODD[::-1], strict=True)]):
            assert encoded(encoder, some) == [ids_of(t)[:-1].astype(encoder.kind).tobytes() for t in some]
    assert encoder.by_word and not packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).by_word


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZéÑß' <|>.,-19\t\ń×")), max_size=25), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    encoder = packing._encoder(PATH)
    assert encoded(encoder, texts) == [ids_of(t)[:-1].astype(encoder.kind).tobytes() for t in texts]


def check(rows, docs, window):
    """Each document is cut into pieces without gaps, and each sequence is full but the last."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == docs.keys()
    for k, text in docs.items():
        ids, at = ids_of(text), 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s, rows_ in sequences.items():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or (at < window and s == max(sequences))
    assert sorted(sequences) == list(range(len(sequences)))


def scheduled(queues, quanta, packet):
    """Deficit round-robin, run in order: (source, document, start, length) as sent. queues: source -> lists of (doc, tokens)."""
    cut = {s: [(d, a, min(packet, n - a)) for d, n in q for a in range(0, n, packet)] for s, q in queues.items()}
    deficit, sent = dict.fromkeys(cut, 0), []
    while any(cut.values()):
        for s in sorted(cut, key=lambda s: (s is not None, s or "")):
            if cut[s]:
                deficit[s] += quanta[s]
                while cut[s] and cut[s][0][2] <= deficit[s]:
                    d, a, n = cut[s].pop(0)
                    deficit[s] -= n
                    sent.append((s, d, a, n))
    return sent


@pytest.mark.parametrize("weights", [None, {"b": 5, None: 2}])
def test_the_stream_is_that_of_one_scheduler(spark, weights):
    rng = random.Random(5)
    docs = docs_of(spark, [prose(i, rng.randint(0, 90)) for i in range(80)], ["a", "b", "b", None, "b"]).repartition(5)
    window, packet = 64, 16
    rows = packing.packed(docs, PATH, window, packet, weights=weights).collect()
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, window)
    order = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["sequence_id"] * window + r["offset"]):
        if r["start"] == 0:
            order[r["source"]].append((r["doc_id"], r["doc_tokens"]))
    total = {s: sum(n for _, n in q) for s, q in order.items()}
    part = {s: (total[s] if weights is None else weights.get(s, 1)) for s in total}
    from fractions import Fraction

    quanta = {s: Fraction(window * part[s], sum(part.values())) for s in part}
    want = [(s, d, a + i) for s, d, a, n in scheduled(order, quanta, packet) for i in range(n)]
    got = [(r["source"], r["doc_id"], r["start"] + i) for r in sorted(rows, key=lambda r: r["sequence_id"] * window + r["offset"]) for i in range(r["length"])]
    assert got == want


def test_windows_hold_the_target_shares(spark):
    """Every window up to the first empty queue is off its target by less than a packet for each source and end."""
    docs = docs_of(spark, [prose(i, 150) for i in range(90)], ["a", "b", "b"])
    window, packet = 256, 32
    rows = packing.packed(docs, PATH, window, packet).collect()
    total = sum(r["length"] for r in rows)
    share = defaultdict(int)
    for r in rows:
        share[r["source"]] += r["length"]
    for s in range(max(r["sequence_id"] for r in rows)):
        got = defaultdict(int)
        for r in rows:
            if r["sequence_id"] == s:
                got[r["source"]] += r["length"]
        assert all(abs(got[x] - window * share[x] / total) <= 2 * packet for x in share)


def test_reruns_agree(spark):
    docs = docs_of(spark, [prose(i % 30, 40) for i in range(60)], ["a", "b"])
    one, two = (sorted(map(tuple, packing.packed(d, PATH, 128, 32).drop("ids").collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def test_long_text_and_one_source(spark):
    docs = docs_of(spark, [prose(1, 20_000), "", None, "x"])
    check(packing.packed(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, packing.WINDOW)


def test_awkward_rows(awkward, nothing):
    rows = packing.packed(awkward, PATH).collect()
    assert sum(r["start"] == 0 for r in rows) == awkward.count()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"])) for r in awkward.collect())
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.packed(nothing, PATH).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 5) for i in range(101)], "k long, n long").repartition(6)
    got = {r["k"]: r["s"] for r in common.running(df, "n", "k", name="s", label="test").collect()}
    n = {i * 37 % 101: i % 5 for i in range(101)}
    assert got == {k: sum(n[j] for j in range(k)) for k in range(101)}
