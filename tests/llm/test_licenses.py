"""The licence scan against a plain reading of its rules."""

import random
import re

import numpy as np
import pytest

import __spark_entry__ as E
from tessera.llm import license_rules, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, rules):
    """No prefilter, every rule, every pair of intervals."""
    words = words_of(text)
    line = " " + " ".join(words) + " "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        for i in range(len(words)):
            if tuple(words[i:i + len(phrase)]) == phrase:
                places.append(i)
                base.add(label)
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern.pattern.decode(), line):
            found.append((r.priority, line.count(" ", 0, m.start()) - 1, line.count(" ", 0, m.end()) - 1, i))
    weights = dict.fromkeys(base, license_rules.BASE_WEIGHT)
    for d in found:
        held = any(o is not d and o[1] <= d[1] and o[2] >= d[2] and (o[0] < d[0] or o[0] == d[0] and (o[2] - o[1] > d[2] - d[1] or o[1:3] == d[1:3] and o[3] < d[3]))
                   for o in found)
        if not held:
            weights[rules[d[3]].label] = max(rules[d[3]].weight, weights.get(rules[d[3]].label, 0))
    score = 1 - float(np.prod([1 - w for w in weights.values()])) if weights else 0.0
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(weights)), round(score, 9))


def got(text):
    n, places, first, last, base, labels, score, _ = license_scan.Scanner().scan((text or "").encode())
    return (n, places, first, last, base, labels, round(score, 9))


@pytest.fixture(scope="module")
def rules():
    return license_rules.all_rules()


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("the GNU Lesser General Public License v2.1 or later", "lgpl-2.1-or-later"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("https://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    ("GNU Affero General Public License", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("bsd-3-clause-clear license", "bsd-3-clause-clear"),
    ("a meeting by the lake, under a tree", ""), ("", ""), (None, ""), ("MIT Licenses", ""), ("größer MIT LICENSE日本", ""), ("日本 MIT\tLICENSE", "mit")])
def test_labels(text, labels, rules):
    assert got(text)[5] == labels
    assert got(text) == plain(text, rules)


def test_random_texts(rules):
    rng = random.Random(5)
    bits = ["gnu general public license", "version 3", "v2.1", "or later", "GNU Lesser General Public License", "Apache License", "2.0", "CC BY", "-NC-SA", " 4.0",
            "MIT License", "under the terms of the", "licensed under", "SPDX-License-Identifier:", "GPL-3.0-only", "all rights reserved", "creative commons attribution",
            "share-alike", "bsd", "3 clause", "license", "the", "é", "\n", "mozilla public license"]
    for _ in range(120):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        assert got(text) == plain(text, rules), text


def test_kept_is_containment():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        p, a = rng.integers(1, 4, n), rng.integers(0, 30, n)
        b = a + rng.integers(0, 8, n)
        want = [not any(a[j] <= a[i] and b[j] >= b[i] and (p[j] < p[i] or p[j] == p[i] and (b[j] - a[j] > b[i] - a[i] or (a[i], b[i]) == (a[j], b[j]) and j < i))
                        for j in range(n)) for i in range(n)]
        assert license_scan.kept(p, a, b).tolist() == want


def test_rules_are_reached_by_their_words(rules):
    assert len(rules) > 300 and all(r.needs for r in rules)


def test_query(spark, rules):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = E.queries()["op11_signature_rules"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and any(r.labels for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == plain(docs[r.doc_id], rules)


def test_edges(spark, odd_docs, no_docs, rules):
    rows = license_scan.scan_documents(odd_docs).collect()
    want = sorted(((r.doc_id, *plain(r.text, rules)) for r in odd_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in rows), key=str) == want
    assert license_scan.scan_documents(no_docs).count() == 0


def test_long_text_with_many_detections():
    text = "Licensed under the Apache License, Version 2.0. GNU GPL v3 or later; MIT License. " * 20_000
    n, places, first, last, base, labels, score, found = license_scan.Scanner().scan(text.encode())
    assert (places, base) == (40_000, "apache,mit") and labels == "apache,apache-2.0,gpl,gpl-3.0-or-later,mit" and len(found) > 100_000
