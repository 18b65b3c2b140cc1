import hashlib
import random
import re

import numpy as np

from recordloom.llm import infill

from .conftest import docs_of, prose, rows_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, rule=infill.Infill()):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{rule.seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in rule.marks) or h[2] % 100 >= rule.rate:
        return n, "plain", None, None, text
    x, y, z = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    p, s, m = rule.marks
    return (n, "spm", len(x), len(y), f"{s}{z}{p}{x}{m}{y}") if h[3] % 100 < rule.spm else (n, "psm", len(x), len(y), f"{p}{x}{s}{z}{m}{y}")


def texts():
    rng = random.Random(11)
    out = ["", None, "\n", "\n\n\n", "one line", "one line\n", "a\nb", "a\n\nb\n", "ñandú\n\U0001f600あ\n", "has <P> inside\nx", "<S>\n", "x<M", "<<P\nS>\n>", "\r\n\r\n", "a\x0bb\x0cc\n"]
    out += ["".join(rng.choice("ab\nñ\U0001f600") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    return out + ["\n" * 5000, prose(1, 30_000), "\n".join(prose(i, 9) for i in range(3000)), "é" * 300_000]


def test_outputs_equal_brute_force(spark):
    all_ = texts()
    made = rows_of(infill.fill_in_middle(docs_of(spark, all_)))
    digests = rows_of(infill.infill_digests(docs_of(spark, all_)))
    assert {r["form"] for r in made.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(all_):
        want = brute(i, t)
        assert tuple(made[i])[1:] == want, (i, t and t[:40])
        assert tuple(digests[i])[1:] == (*want[:4], sha(want[4]), sha(t or ""))


def test_rule_is_a_parameter(spark):
    rule = infill.Infill(seed=3, rate=50, spm=20, marks=("[pre]", "(suf)", "{mid}"))
    all_ = texts()[:60]
    made = rows_of(infill.fill_in_middle(docs_of(spark, all_), rule))
    assert all(tuple(made[i])[1:] == brute(i, t, rule) for i, t in enumerate(all_))
    assert {r["restored_sha256"] for r in infill.infill_digests(docs_of(spark, all_), rule).collect()} == {sha(t or "") for t in all_}


def test_rank_and_select():
    rng = np.random.default_rng(2)
    for n, share in ((0, 0), (1, 1), (63, 0.5), (64, 1), (511, 0), (512, 1), (513, 0.3), (5000, 0.01), (70_000, 0.9)):
        flags = rng.random(n) < share
        bits = infill.Bits(flags)
        ones = np.flatnonzero(flags)
        assert bits.total() == len(ones)
        assert (bits.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(flags)])).all()
        assert (bits.select(np.arange(1, len(ones) + 1)) == ones).all()


def test_awkward_rows(awkward, nothing):
    rows = infill.infill_digests(awkward).collect()
    assert len(rows) == awkward.count() and infill.infill_digests(nothing).count() == 0
    want = sorted(str((r["doc_id"], *brute(r["doc_id"], r["text"])[:4], sha(r["text"] or ""))) for r in awkward.collect())
    assert sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["restored_sha256"])) for r in rows) == want
