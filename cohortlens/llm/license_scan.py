"""License scan: ordered signature rules over every whole text.

A text is normalised to its words, each between a line feed and a space, so a
signature consumes whole words and nothing else. Three steps follow, each a
column expression over one row, so nothing is shuffled:

1. Keyword prefilter. One expression asks whether any gate phrase occurs at all;
   in a text that passes, only rules one of whose gate phrases occurs are tried.
2. Detection. Matches of a rule are marked in the text, the text is split into
   words, and a mark's place is the word's number.
3. Suppression. Detections in order of place run past one table of "furthest end
   so far by priority": a detection inside one of better priority, or inside a
   longer one of its own, is dropped. Base phrases are never dropped.

DataFrame functions only: no Python runs on the executors.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import license_rules

# fixed by the contract: what separates words of a text in lower case
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"
BLOCK = 512      # detections that one inner pass of the suppression appends to a list
DETECTIONS = "array<struct<start:bigint,stop:bigint,label:string,rule:int,priority:int,weight:double,words:string>>"


def normalized(text: Column) -> Column:
    """``" \\nfirst \\nsecond \\n"``: every word of the text in lower case (A-Z), NULL as empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), SEPARATORS, " \n")


def compiled(regex: str) -> str:
    """A signature over words with single spaces, as an expression over normalised text."""
    inner = regex.replace("[^ ]", MARK).replace(" ", " \n").replace(" \n?", "(?: \n)?").replace(MARK, "[^ \n]")
    return f"\n(?:{inner}) "


def gate(phrase: str) -> str:
    return "\n" + phrase.replace(" ", " \n") + " "


def phrase_prefilter(rules: list[tuple[str, int, list[str], str]]) -> str:
    """One expression that finds a gate phrase, branching on its first letter."""
    by_letter: dict[str, set[str]] = {}
    for _, _, gates, _ in rules:
        for phrase in gates:
            by_letter.setdefault(phrase[0], set()).add(gate(phrase)[2:])
    letters = "".join(re.escape(c) for c in sorted(by_letter))
    branches = "|".join(f"{re.escape(c)}(?:{'|'.join(sorted(map(re.escape, rest)))})" for c, rest in sorted(by_letter.items()))
    return f"\n(?=[{letters}])(?:{branches})"


def _rule_array(rules: list[tuple[str, int, list[str], str]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"),
                              F.array(*[F.lit(gate(g)) for g in gates]).alias("gates"),
                              F.lit(compiled(regex)).alias("regex"))
                     for i, (label, priority, gates, regex) in enumerate(rules)])


def _detect_rule(norm: Column, rule: Column) -> Column:
    """Places of one rule: word numbers of its matches, in the order of the text."""
    tokens = F.split(F.regexp_replace(norm, rule["regex"], MARK + "$0"), "\n")
    starts = F.filter(F.transform(tokens, lambda word, i: F.when(F.endswith(word, F.lit(MARK)), i)), lambda i: i.isNotNull())
    return F.zip_with(starts, F.regexp_extract_all(norm, rule["regex"], F.lit(0)), lambda start, found: F.struct(
        start.cast("long").alias("start"), (start + _lines(found)).cast("long").alias("stop"), rule["label"].alias("label"),
        rule["rule"].alias("rule"), rule["priority"].alias("priority"),
        F.element_at(F.array(*[F.lit(w) for w in license_rules.WEIGHTS]), rule["priority"] + 1).alias("weight"),
        F.trim(F.replace(found, F.lit("\n"), F.lit(""))).alias("words")))


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _suppressed(found: Column) -> Column:
    """Detections that no better one contains, in order of (start, -stop, priority, rule).

    In that order all detections that can contain a given one come before it, so
    the furthest end by priority decides. Detections go through in blocks, each
    with its own short list, so that a text with many costs no square of them.
    """
    levels = len(license_rules.WEIGHTS)
    order = F.array_sort(found, lambda a, b: (
        F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["stop"] != b["stop"], F.when(a["stop"] > b["stop"], -1).otherwise(1))
        .when(a["priority"] != b["priority"], F.when(a["priority"] < b["priority"], -1).otherwise(1))
        .when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0)))
    empty = F.array().cast(DETECTIONS)

    def step(state: Column, one: Column) -> Column:
        inside = (one["priority"] > 0) & (F.element_at(state["furthest"], one["priority"] + 1) >= one["stop"])
        return F.struct(
            F.transform(state["furthest"], lambda end, p: F.when(p >= one["priority"], F.greatest(end, one["stop"])).otherwise(end))
            .alias("furthest"),
            F.when(inside, state["kept"]).otherwise(F.array_append(state["kept"], one)).alias("kept"))

    def block(state: Column, rows: Column) -> Column:
        start = F.struct(state["furthest"].alias("furthest"), empty.alias("kept"))
        done = F.transform(F.array(F.aggregate(rows, start, step)), lambda x: F.struct(
            x["furthest"].alias("furthest"), F.array_append(state["blocks"], x["kept"]).alias("blocks")))
        return done[0]

    def whole(rows: Column) -> Column:
        count = F.ceil(F.size(rows) / F.lit(float(BLOCK))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))
        zero = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("furthest"),
                        F.array().cast(f"array<{DETECTIONS}>").alias("blocks"))
        return F.flatten(F.aggregate(parts, zero, block)["blocks"])

    return F.transform(F.array(order), lambda rows: F.when(F.size(rows) > 0, whole(rows)).otherwise(empty))[0]


def detect(docs: DataFrame, carry: list[str], rules: list[tuple[str, int, list[str], str]] | None = None) -> DataFrame:
    """Rows of ``docs(text, ...)`` with the columns ``carry``, ``n_words`` and ``detections``.

    ``detections`` is an array of (start, stop, label, rule, priority, weight,
    words): words ``start`` to ``stop - 1`` of the text, from 0. NULL and empty
    texts have no words and no detections; each of several equal rows has its own
    result; carried columns of a new name are replaced. A rule's matches in one
    text do not overlap one another.
    """
    rules = license_rules.rules() if rules is None else rules
    carry = [c for c in carry if c not in ("n_words", "detections")]
    rows = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(carry)], normalized(F.col("text")).alias("norm"))
    norm = F.col("norm")
    tried = F.filter(_rule_array(rules), lambda r: F.exists(r["gates"], lambda g: F.contains(norm, g)))
    found = F.flatten(F.transform(tried, lambda r: _detect_rule(norm, r)))
    empty = F.array().cast(DETECTIONS)
    rows = rows.select(*rows.columns[:-1], (_lines(norm) - 1).cast("long").alias("n_words"),
                       F.when(norm.rlike(phrase_prefilter(rules)), found).otherwise(empty).alias("found"))
    return rows.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(carry)], "n_words",
                       F.when(F.size("found") > 0, _suppressed(F.col("found"))).otherwise(empty).alias("detections"))


def digest(detected: DataFrame, carry: list[str]) -> DataFrame:
    """Per row: counts and places of the base phrases, both label lists and the best weight (0 without any)."""
    seen = F.col("detections")
    base = F.filter(seen, lambda d: d["priority"] == 0)
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(found["label"])), ",")
    return detected.select(
        *carry, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        names(base).alias("base_labels"), names(seen).alias("labels"),
        F.coalesce(F.array_max(seen["weight"]), F.lit(0.0)).alias("score"))


def scan_sql() -> str:
    """DuckDB SQL of the digest over ``documents``: same rules, containment by a join within a text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n  ".join(
        f"({i}, {quote(label)}, {priority}, [{', '.join(quote(gate(g)) for g in gates)}], {quote(compiled(regex))}, "
        f"{license_rules.WEIGHTS[priority]}::DOUBLE)"
        for i, (label, priority, gates, regex) in enumerate(license_rules.rules()))
    return f"""
WITH rules(rule, label, priority, gates, regex, weight) AS (VALUES
  {values}),
norm AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_replace(' ' || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || ' ', '{SEPARATORS}', ' ' || chr(10), 'g') AS norm
  FROM documents),
tried AS (
  SELECT n.row_no, n.norm, r.* FROM norm n JOIN rules r ON len(list_filter(r.gates, lambda g: contains(n.norm, g))) > 0),
marked AS (
  SELECT row_no, rule, label, priority, weight, regexp_extract_all(norm, regex) AS texts,
    str_split(regexp_replace(norm, regex, chr(1) || '\\0', 'g'), chr(10)) AS tokens FROM tried),
placed AS (
  SELECT row_no, rule, label, priority, weight, texts,
    list_filter(range(0, len(tokens)), lambda i: suffix(tokens[i + 1], chr(1))) AS starts FROM marked),
hits AS (
  SELECT row_no, rule, label, priority, weight, unnest(starts) AS start,
    unnest(list_transform(texts, lambda t: len(t) - len(replace(t, chr(10), '')))) AS n FROM placed),
kept AS (
  SELECT h.* FROM hits h WHERE priority = 0 OR NOT EXISTS (
    SELECT 1 FROM hits g WHERE g.row_no = h.row_no AND g.start <= h.start AND g.start + g.n >= h.start + h.n
      AND (g.priority < h.priority OR (g.priority = h.priority AND (g.n > h.n OR (g.n = h.n AND g.rule < h.rule)))))),
summed AS (
  SELECT row_no, count(*) FILTER (priority = 0) AS n_base, min(start) FILTER (priority = 0) AS first_word,
    max(start) FILTER (priority = 0) AS last_word,
    coalesce(list_aggregate(list_sort(list_distinct(list(label) FILTER (priority = 0))), 'string_agg', ','), '') AS base_labels,
    list_aggregate(list_sort(list_distinct(list(label))), 'string_agg', ',') AS labels, max(weight) AS score
  FROM kept GROUP BY row_no)
SELECT n.doc_id, (len(n.norm) - len(replace(n.norm, chr(10), '')) - 1)::BIGINT AS n_words,
  coalesce(s.n_base, 0)::BIGINT AS n_base, s.first_word::BIGINT AS first_word, s.last_word::BIGINT AS last_word,
  coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels, coalesce(s.score, 0)::DOUBLE AS score
FROM norm n LEFT JOIN summed s USING (row_no)
"""
