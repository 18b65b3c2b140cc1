from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import tokens

from .conftest import docs_of, prose

TEXTS = ["one line", "two\nlines", "a\n\n\nb\n", "\n", "", None, "Zwölf あ\U0001f600\nBoxkämpfer 12345\n  indented   code\n", prose(3, 300).replace(" ba", "\nba"), "<|endoftext|>\nx" * 3, "\n" * 50]


def brute(text, rule):
    """Each token's bytes are walked one by one."""
    encoder, lengths = tokens.encoding(tokens.VOCABULARY)
    data = text.encode()
    ids = encoder.encode(text, disallowed_special=())
    assert b"".join(encoder.decode_single_token_bytes(i) for i in ids) == data
    line, owner = 0, []
    for b in data:
        owner.append(line)
        line += b == 10
    n = (owner[-1] if owner else 0) + 1
    own, over, at = [0] * n, [0] * n, 0
    for i in ids:
        of = owner[at : at + int(lengths[i])]
        at += int(lengths[i])
        to = {"first": of[0], "last": of[-1], "most": max(sorted(set(of)), key=of.count)}[rule]
        own[to] += 1
        over[to] += len(set(of)) > 1
    return own, over, len(ids)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_counts_equal_brute_force(spark, rule):
    found = defaultdict(list)
    for r in tokens.section_tokens(docs_of(spark, TEXTS), rule).orderBy("doc_id", "section").collect():
        found[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        text, rows = t or "", found[i]
        own, over, n = brute(text, rule)
        assert [r["n_tokens"] for r in rows] == own and [r["n_crossing"] for r in rows] == over
        assert all(r["doc_tokens"] == n for r in rows) and sum(own) == n
        assert [text[r["start"] : r["end"]] for r in rows] == (text.splitlines(keepends=True) if "\n" in text else [text])


@pytest.mark.parametrize("text", ["a" + " " * 30_000 + "b c", "\n" * 30_000, " \n" * 20_000 + "x", "x\u3000" + "\t" * 12_000 + "\ny" + " " * 11_000, " " * 10_000 + "!" + " " * 9_999 + "?"])
def test_long_white_space_has_the_tokens_of_the_whole(text):
    encoder, _ = tokens.encoding(tokens.VOCABULARY)
    assert tokens.encoded(encoder, text).tolist() == encoder.encode(text, disallowed_special=())


def test_very_long_white_space(spark):
    texts = ["a" + " " * 3_000_000 + "b", "\n" * 1_000_000]
    rows = tokens.section_tokens(docs_of(spark, texts)).where("section = 0 or section = 999999").orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["section"], r["end"]) for r in rows] == [(0, 0, 3_000_002), (1, 0, 1), (1, 999_999, 1_000_000)]
    assert all(r["n_tokens"] > 0 for r in rows[:1])


def test_rules_at_a_crossing():
    starts, ends, bounds = np.array([0, 2, 9]), np.array([2, 9, 10]), np.array([0, 4, 7, 10])
    assert tokens.attribute(starts, ends, bounds, "first")[0].tolist() == [2, 0, 1]
    assert tokens.attribute(starts, ends, bounds, "last")[0].tolist() == [1, 0, 2]
    assert tokens.attribute(starts, ends, bounds, "most")[0].tolist() == [1, 1, 1]


def test_awkward_rows(awkward, nothing):
    rows = tokens.section_tokens(awkward).collect()
    assert sum(r["section"] == 0 for r in rows) == awkward.count()
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    assert tokens.section_tokens(nothing).count() == 0
    with pytest.raises(ValueError, match="unknown rule"):
        tokens.section_tokens(awkward, "share")
