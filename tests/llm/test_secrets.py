import hashlib
import math
import random
import re
from collections import Counter

from recordloom.llm import secrets

from .conftest import docs_of, prose, rows_of

_FIXED = [("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX)]


def brute(text):
    text = text or ""
    spans, n = [], Counter()
    for order, (kind, pattern) in enumerate(_FIXED):
        for m in re.finditer(pattern, text):
            if kind != "assign" or len(m[2]) >= 12:
                spans.append((m.start(), order, kind, m.end()))
                n[kind] += 1
    base = sorted(spans)
    terms = secrets.scaled_terms()
    for order, (kind, _, cls, bits) in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(f"[{cls}]{{{secrets.WINDOW},}}", text):
            s = m[0]
            if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(re.search(a, s) for a in secrets.ALLOW):
                continue
            hot = [i for i in range(len(s) - secrets.WINDOW + 1) if sum(terms[c] for c in Counter(s[i : i + secrets.WINDOW]).values()) <= secrets.most_allowed(bits)]
            if hot:
                spans.append((m.start() + hot[0], order, kind, m.start() + hot[-1] + secrets.WINDOW))
    told = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(xs))
    return n["assign"], n["access"], n["hex"], hashlib.sha256(told(base).encode()).hexdigest(), told(spans)


def texts():
    rng = random.Random(6)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    key = lambda n, of=b64: "".join(rng.choice(of) for _ in range(n))
    out = [f"{prose(i, 10)} あ\U0001f600 {pre}{key(rng.randint(8, 60))}{post} {key(rng.randint(10, 50), '0123456789abcdef')} {prose(i + 90, 5)}" for i, (pre, post) in enumerate([("password=", ""), ("API_KEY: '", "'"), ('"secret" : "', '"'), ("token = ", ";"), ("passwd:", ""), ("PassWord  =  ", ""), ("", "")] * 4)]
    out += ["AKIA" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIAAKIA0123", "xAKIA" + "A" * 14, "AKIA" + "B" * 13, "password=short token=abcdefghijkl", "token=secret=abcdefghijklmnop"]
    out += [key(20) + "example" + key(20), "aaaaaaaa1aaaaaaaaaaaaaaaaaaaa", "0123456789" * 5, "d41d8cd98f00b204e9800998ecf8427e", "a1" * 30, "", None, "plain words only", " ".join(key(40) for _ in range(1200))]
    return out + ["x" * 5000 + key(30), "0" * 2000 + key(64, "0123456789abcdef")]


def test_spans_equal_brute_force(spark):
    given = texts()
    found = rows_of(secrets.find_secrets(docs_of(spark, given)))
    for i, t in enumerate(given):
        assert tuple(found[i])[1:] == brute(t), (i, t and t[:100])


def test_awkward_rows(awkward, nothing):
    rows = secrets.find_secrets(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r["spans"] == "" and r["n_assign"] == r["n_access"] == r["n_hex"] == 0 for r in rows)
    assert secrets.find_secrets(nothing).count() == 0


def test_allow_list_is_a_parameter(spark):
    docs = docs_of(spark, ["q8Zr2LmX9vTb4NcK7wYpS3dF"])
    assert "entropy_base64" in rows_of(secrets.find_secrets(docs))[0]["spans"]
    assert rows_of(secrets.find_secrets(docs, allow=("^q8Z",)))[0]["spans"] == ""


def test_bits_as_whole_numbers():
    for _, _, _, bits in secrets.CLASSES:
        window = "abcdefghijklmnopqrst"
        h = -sum(c / 20 * math.log2(c / 20) for c in Counter(window).values())
        total = sum(secrets.scaled_terms()[c] for c in Counter(window).values())
        assert (h >= bits) == (total <= secrets.most_allowed(bits))
