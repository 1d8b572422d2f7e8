"""License scans against a scanner without gates, slices, index or sorted intervals."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skimdex.llm import licenses, queries

DOC = "doc_id long, text string"
RULES = licenses.build_rules()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


UNGATED = [(rule, re.compile(rule.pattern.pattern.decode())) for rule in RULES]


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    line = " " + " ".join(words) + " "
    tiers = list(licenses.TIERS)
    spots = []
    for rule, pattern in UNGATED:
        for m in pattern.finditer(line):
            a = line[: m.start()].count(" ") - 1
            spots.append((a, a + m[0].count(" ") + 1, rule.label, rule.name, licenses.TIERS[rule.tier], m.start(), m.end()))
    spots.sort(key=lambda s: (tiers.index(s[3].split("-")[0]), -len(line[s[5] : s[6]].encode()), s[5], s[3]))
    kept = []
    for s in spots:
        if not any(k[0] <= s[0] and s[1] <= k[1] for k in kept):
            kept.append(s)
    base = []
    for phrase, label in licenses.BASE.items():
        w = phrase.split()
        base += [(i, i + len(w), label, "base", licenses.BASE_SCORE) for i in range(len(words)) if words[i : i + len(w)] == w]
    return len(words), sorted([k[:5] for k in kept] + base)


def scanned(text):
    n, found = licenses.Scanner(RULES, licenses.BASE).scan((text or "").encode())
    return n, sorted(found)


SOME = [
    "Released under the MIT License", "licensed under the Apache License, Version 2.0", "CC BY-NC 4.0", "cc-by-nc-sa",
    "This work is licensed under the GNU General Public License, version 3", "all rights reserved", "GPLv2", "unter der MIT-Lizenz",
    "SPDX-License-Identifier: LGPL-2.1-or-later", "https://www.gnu.org/licenses/gpl-3.0.html", "under the mit license under the mit license",
    "sous licence MIT", "Mozilla Public Licence 2.0", "GNU Affero General Public License v3", "commit mit licensee", "cc by nc by nc cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "über ünder the MÍT license",
]


def test_texts_equal_plain_scanner():
    rng = random.Random(3)
    for _ in range(150):
        parts = [rng.choice([*SOME, "word", "mit", "license", "version 2", "...", " ", "été"]) for _ in range(rng.randrange(25))]
        text = rng.choice([" ", "\n", ", ", ""]).join(parts)
        assert scanned(text) == plain(text), text


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_gates_never_hide_a_match(data):
    rule = data.draw(st.sampled_from(RULES))
    inner = rule.pattern.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )")
    word = data.draw(st.from_regex(inner.replace(r"\S+", "[a-z]+").replace(r"\d", "[0-9]"), fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 éñ"))
    text = f"before {word} after"
    assert any(r == rule.name for _, _, _, r, _ in _ungated(rule, text)), rule
    assert scanned(text) == plain(text)


def _ungated(rule, text):
    return licenses.Scanner([rule], {}).scan(text.encode())[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(0, 3)), max_size=40))
def test_resolution_equals_all_comparisons(spans):
    spots = [(a, a + n, tier, "x", f"r{i:03}", 0.5) for i, (a, n, tier) in enumerate(spans)]
    kept = []
    for s in sorted(spots, key=lambda s: (s[2], s[0] - s[1], s[0], s[4])):
        if not any(k[0] <= s[0] and s[1] <= k[1] for k in kept):
            kept.append(s)
    assert licenses.Scanner.resolve(spots) == kept


def test_slices_never_cut_a_word(monkeypatch):
    monkeypatch.setattr(licenses, "SLICE", 7)
    for text in [*SOME, " ".join(SOME), "x" * 50, "   ", "under the mit " + " " * 40 + "license"]:
        assert scanned(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License", {"mit"}), ("This is free software: GPLv3", {"gpl-3"}),
        ("Ein Haus mit Garten und Lizenz", set()), ("GNU Lesser General Public License version 2.1", {"lgpl-2.1"}),
        ("a fair trade under the sun", set()), ("CC0 1.0 Universal", {"cc0-1"}),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", {"cc-by-nc-sa"}),
        ("https://creativecommons.org/licenses/by-sa/3.0/", {"cc-by-sa"}), ("All rights reserved.", {"all-rights-reserved"}),
    ],
)
def test_labels(text, labels):
    assert {s[2] for s in scanned(text)[1]} == labels


def test_edge_rows(spark):
    long = "filler words " * 200_000 + "under the MIT license " + "x" * 300_000
    rows = [(1, None), (2, ""), (3, "Under The\nMIT-License"), (3, "Under The\nMIT-License"), (None, "cc by nc"), (4, long)]
    docs = spark.createDataFrame(rows, DOC)
    for name in ("found", "n_words", "score", "label", "start"):
        docs = docs.withColumn(name, F.lit("x"))
    got = licenses.summarise(docs).drop("found").collect()
    want = [
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0),
        (3, 4, 1, 0, 0, "mit", "mit", 0.85), (3, 4, 1, 0, 0, "mit", "mit", 0.85),
        (None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 0.8), (4, 400_005, 1, 400_000, 400_000, "mit", "mit", 0.85),
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert licenses.summarise(spark.createDataFrame([], DOC)).collect() == []


def test_query_equals_plain_scanner(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc, text in docs:
        n, found = plain(text)
        starts = [f[0] for f in found if f[3] == "base"]
        names = lambda keep: ",".join(sorted({f[2] for f in found if keep(f)}))
        want.append((
            doc, n, len(starts), min(starts, default=None), max(starts, default=None), names(lambda f: f[3] == "base"),
            names(lambda f: True), max([f[4] for f in found], default=0.0),
        ))
    got = queries.QUERIES["op12_licenses"](spark, tables).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
