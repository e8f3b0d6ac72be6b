"""License scan: places, suppression and labels against a plain Python version, and odd rows."""
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import license_rules, license_scan

NOTICES = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU Lesser General Public License version 2.1; see the General Public License.",
    "Licensed under CC BY-NC 4.0. cc by, CC-BY ccby cc_by",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "Copyright (c) 2019 Some Company Inc. All rights reserved. All rights reserved all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Alle Rechte vorbehalten. Tous droits réservés. É all rights reservedé",
    "gplv3 or GPL v2 or asl2", "das mit Lizenz? mit Lizenzen", "all  rights\n\treserved", "cc\x00by cc by", "ccK by Kopie",
    None, "", "   ", "...", "é", "plain words without any notice at all",
]


def brute(text, rules):
    """All detections of one text by Python's expressions, kept when no better one contains them."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for no, (label, priority, _, regex) in enumerate(rules):
        at, joined = 0, " ".join(words)
        pattern = re.compile(f"(?:{regex})(?= |$)")
        starts = [m.start() + 1 for m in re.finditer(" ", joined)]
        place = {0: 0, **{s: i + 1 for i, s in enumerate(starts)}} if words else {}
        while at <= len(joined) and words:
            hits = [(s, pattern.match(joined, s)) for s in sorted(place) if s >= at]
            hit = next(((s, m) for s, m in hits if m), None)
            if hit is None:
                break
            s, m = hit
            found.append((place[s], place[s] + m[0].count(" ") + 1, label, no, priority))
            at = m.end() + 1
    better = lambda g, h: (g[4], g[0] - g[1], g[3]) < (h[4], h[0] - h[1], h[3])
    kept = [h for h in found if h[4] == 0 or not any(g[0] <= h[0] and g[1] >= h[1] and better(g, h) for g in found)]
    return len(words), sorted(kept)


def scan(spark, texts, rules=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = license_scan.detect(df, ["doc_id"], rules).collect()
    return {r.doc_id: (r.n_words, sorted((d.start, d.stop, d.label, d.rule, d.priority) for d in r.detections)) for r in rows}


def test_rules_are_many_and_gated():
    rules = license_rules.rules()
    assert len(rules) > 300
    for _, priority, gates, _ in rules:
        assert gates and 0 <= priority < len(license_rules.WEIGHTS)


def test_equals_brute_force(spark):
    rules = license_rules.rules()
    texts = NOTICES + [" ".join(n for n in NOTICES if n), "; ".join(n for n in reversed(NOTICES) if n)]
    texts += [f"spdx license identifier {license_rules.words(x)} end" for x in license_rules.SPDX[::9]]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t, rules), t


def test_gates_lose_no_match(spark):
    open_rules = [(label, p, ["x"], regex) for label, p, _, regex in license_rules.rules()]
    texts = ["x " + n for n in NOTICES if n]
    gated, ungated = scan(spark, texts), scan(spark, texts, open_rules)
    assert gated == ungated


def test_suppression(spark):
    rules = [("base", 0, ["b"], "b"), ("long", 1, ["a"], "a b c"), ("inner", 2, ["b"], "b c"), ("cross", 2, ["c"], "c d"),
             ("same", 1, ["a"], "a b c"), ("weak", 3, ["a"], "a b c d e")]
    got = scan(spark, ["a b c d e", "b c d"], rules)
    assert [d[2] for d in got[0][1]] == ["long", "weak", "base", "cross"]
    assert [d[2] for d in got[1][1]] == ["base", "inner", "cross"]


def test_many_detections_in_one_text(spark):
    n = 5_000
    text = "all rights reserved x " * n + "plain " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = license_scan.digest(license_scan.detect(df, ["doc_id"]), ["doc_id"]).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (4 * n + 100_000, n, 0, 4 * (n - 1))
    assert row.base_labels == "reserved" and row.score == pytest.approx(0.5)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "cc by"), (1, None), (1, "cc by"), (1, "cc by")],
                               "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("norm", F.lit(1))
    out = license_scan.detect(df, df.columns)
    assert out.columns == ["doc_id", "text", "norm", "n_words", "detections"]
    rows = license_scan.digest(out, ["doc_id"]).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in rows
                  if r.n_words) == [(False, 2, 1, 0, "cc-by", "cc-by", 0.5)] * 2 + [(True, 2, 1, 0, "cc-by", "cc-by", 0.5)]
    empty = [r for r in rows if not r.n_words][0]
    assert (empty.n_base, empty.first_word, empty.last_word, empty.base_labels, empty.labels, empty.score) == (0, None, None, "", "", 0.0)
    assert license_scan.detect(df.limit(0), ["doc_id"]).count() == 0
