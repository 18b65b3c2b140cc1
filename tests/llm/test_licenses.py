import re

import pytest

from recordloom.llm import licenses

from .conftest import docs_of, prose, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

TEXTS = [
    "Licensed under the Apache License, Version 2.0", "licensed under the apache license 2.0 (the License); you may not use this file except in compliance with the License",
    "Licensed under the Apache License, Version 3.0", "under the MIT License", "MIT  license!", "Released under the MIT-License and CC BY 4.0, cc by nc sa 3.0", "CC BY nc 9.0 cc by",
    "GNU Lesser General Public License, version 3 or (at your option) any later version", "GNU general public license", "general public license general public license",
    "Copyright (c) 2019, 2020 Some Holder, Inc. All rights reserved. all rights reserved", "Copyright 2019 All rights reserved", "Copyright two thousand x All rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this and associated documentation files", "SPDX-License-Identifier: Apache-2.0", "ccéby cc byé あ cc by あ", "", None, "...",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    joined = " " + " ".join(words) + " "
    places = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
    every = sorted(i for v in places.values() for i in v)
    base = {licenses.PHRASES[p] for p, v in places.items() if v}
    more = {k for k, t in licenses.TEMPLATES.items() if re.search(licenses.as_regex(licenses.parse(t)) + " ", joined)}
    hit = set(more)
    more -= {part for part, wholes in licenses.PART_OF.items() if more & set(wholes)}
    best = max([len(p.split()) for p, v in places.items() if v] + [licenses.compile_template(licenses.TEMPLATES[k]).mandatory for k in hit], default=0)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)), ",".join(sorted(base | more)), min(1.0, best / licenses.CERTAIN)


def test_matches_equal_brute_force(spark):
    texts = TEXTS + [f"{prose(i, 300)} {t} {prose(i + 50, 300)}" for i, t in enumerate(TEXTS)]
    found = rows_of(licenses.scan_licenses(docs_of(spark, texts)))
    for i, t in enumerate(texts):
        assert tuple(found[i])[1:] == brute(t), t
    labels = {x for r in found.values() for x in r["labels"].split(",")}
    assert labels >= {"apache-2.0", "mit", "mit-text", "gpl-versioned", "cc-by-versioned", "copyright-notice", "spdx-tag", "gpl", "cc-by", "reserved"}
    assert "apache-2.0" not in found[2]["labels"] and "mit-text" not in found[14]["labels"]


def filled(label, optional=True, words="Some Holder and Others"):
    """A template's wording with every optional region in or out and every open region filled."""
    fit = {"lesser|affero|library": "Lesser", "[1-3]": "2", "https?": "https", "acknowledge?ment": "acknowledgment"}

    def walk(parts):
        out = []
        for p in parts:
            out += [p.decode()] if isinstance(p, bytes) else (walk(p) if optional else []) if isinstance(p, list) else [] if p[1] == 0 and not optional else [fit.get(p[0], words if p[2] > 1 else words.split()[0])]
        return out

    return " ".join(walk(licenses.parse(licenses.TEMPLATES[label])))


LONG = ["mit-license", "bsd-2-clause", "bsd-3-clause", "isc", "apache-2.0-notice", "gpl-notice", "zlib", "unlicense", "boost"]


def test_whole_licenses(spark):
    """With and without their optional regions they match; with one mandatory word changed they don't."""
    texts, want = [], []
    for label in LONG:
        for optional in (True, False):
            text = filled(label, optional)
            w = text.split()
            own = [p for p in licenses.parse(licenses.TEMPLATES[label]) if isinstance(p, bytes)]
            mandatory = [i for i, x in enumerate(licenses.split_words(text)) if x in own and licenses.split_words(licenses.TEMPLATES[label]).count(x) == 1]
            odd = " ".join([*w[: mandatory[-1]], "otherwise", *w[mandatory[-1] + 1 :]])
            texts += [f"{prose(1, 40)} {text.upper()}. {prose(2, 40)}", odd]
            want += [(label, True), (label, False)]
    found = rows_of(licenses.scan_licenses(docs_of(spark, texts)))
    for i, (label, there) in enumerate(want):
        assert (label in found[i]["labels"].split(",")) == there, (label, there, texts[i])
        assert tuple(found[i])[1:] == brute(texts[i])


def test_each_license_has_its_own_label_alone(spark):
    """Whole wordings, with and without optional regions: no opening of theirs and no other license is told beside them."""
    texts = [(label, filled(label, optional)) for label in LONG for optional in (True, False)]
    found = rows_of(licenses.scan_licenses(docs_of(spark, [f"x {t} y" for _, t in texts])))
    assert [found[i]["labels"] for i in range(len(texts))] == [",".join(sorted({label, *(["gpl"] if "General Public License" in t or "general public license" in t.lower() else [])})) for label, t in texts]
    cut = rows_of(licenses.scan_licenses(docs_of(spark, [" ".join(filled(k).split()[:-1]) for k in ("bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "boost", "mit-license")])))
    assert [cut[i]["labels"] for i in range(7)] == ["bsd-text", "bsd-text", "isc-text", "zlib-text", "unlicense-text", "boost-text", "mit-text"]


def test_awkward_rows(awkward, nothing):
    rows = licenses.scan_licenses(awkward).collect()
    assert len(rows) == awkward.count() and all(r["labels"] == "" and r["first_word"] is None for r in rows)
    assert licenses.scan_licenses(nothing).count() == 0


def test_bad_templates_are_refused():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError, match="region|wording"):
            licenses.compile_template(bad)
