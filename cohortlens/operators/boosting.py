"""Second-order boosting and forests on binned features (M2-M5).

* Borders of the features come from quantiles of all training rows.
* A search teaches every candidate on all rows outside a fold and judges it on all
  rows of the fold. Up to ``HELD_ROWS`` rows it is one Spark task a candidate and
  fold over coded rows in memory; beyond, every candidate and fold is a fit over
  many tasks. Candidates that differ in the number of rounds only are one run, read
  at each length.
* The best set is fitted on all training rows. Up to ``HELD_ROWS`` rows a
  boosted model is one task's work; beyond, each level of a tree is one Spark
  job over cached blocks of codes that adds up histograms. Both give the same trees.
* A forest learns from all rows. Up to ``TASK_ROWS`` rows it is grown in groups of
  trees, one task a group; beyond, each level of many trees is one Spark job over
  blocks of codes.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators.histogram_trees import (
    UNIT, Cells, Grower, Growth, Trees, grow_by_rows, grow_here, leaves_of, histogram, node_of, smaller_children, uniform, with_siblings)
from cohortlens.operators.split import assign_folds
from cohortlens.operators.tree_model import TreeModel
from cohortlens.session import remove_path, scratch_path, ship_package

HELD_ROWS = 1 << 20       # rows up to which a boosted fit, or one of a search, holds all of them in a task (about 100 bytes a row)
TASK_ROWS = 1 << 18       # rows up to which a group of a forest's trees is one task's work
TREE_GROUPS = 16          # tasks of one forest
LEVEL_NODES = 1 << 14     # nodes of a forest whose histograms one job adds up
BLOCK_ROWS = 1 << 17      # rows of one cached block, about
MOST_PARTS = 64           # partial histograms that the driver adds up by itself
FEW_ROWS = 1 << 16        # rows up to which a boosted tree grows by levels, not by nodes
PIECE_ROWS = 1 << 15      # rows whose gradients are worked out together
REFRESH = 25              # rounds between checkpoints of a fit over many tasks
MOST_BINS = {"boosted_a": 256, "boosted_b": 256, "random_forest": 32}


# ---------------------------------------------------------------------------
# Binned rows
# ---------------------------------------------------------------------------
def feature_borders(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Ascending borders of every feature (at most ``bins - 1``) from quantiles over all rows; a NaN is no value."""
    probes = [i / bins for i in range(1, bins)]
    value = [F.nanvl(F.element_at("x", i + 1), F.lit(None).cast("double")) for i in range(width)]
    found = rows.agg(*[F.percentile_approx(v, probes, 100 * bins).alias(f"q{i}") for i, v in enumerate(value)],
                     *[F.min(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    out = []
    for i in range(width):
        q = np.unique(np.array(found[f"q{i}"] or [], np.float64))
        out.append(q[q > found[f"m{i}"]] if len(q) else q)
    return out


def fewer_borders(borders: list[np.ndarray], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` of the borders of each feature, evenly spread."""
    return [b if len(b) < bins else b[np.unique(np.linspace(0, len(b) - 1, bins - 1).round().astype(int))] for b in borders]


def coded(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Number of borders at or below every value; NaN has code 0. A feature's codes lie side by side."""
    out = np.zeros(x.shape, np.uint8 if max(map(len, borders), default=0) < 256 else np.int64, order="F")
    for i, b in enumerate(borders):
        known = ~np.isnan(x[:, i])
        out[known, i] = np.searchsorted(b, x[known, i], side="right")
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long rows as a matrix; NULL values are NaN."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def training_rows(prep, train: DataFrame, width: int, folds: int, key: str = "enrol_key") -> DataFrame:
    """(id, y, w_pos, w_balanced, fold, x): written once, so that fits and lost tasks read files."""
    data = prep.transform(train).withColumn("x", vector_to_array("features"))
    if folds > 1:
        data = assign_folds(data, key, "label", folds, S.RANDOM_STATE)
    else:
        data = data.withColumn("fold", F.lit(0))
    data = data.where("label is not null").select(F.col(key).cast("long").alias("id"), F.col("label").alias("y"),
                                                  "w_pos", "w_balanced", "fold", "x")
    path = scratch_path(train.sparkSession, "training-rows")
    data.write.parquet(path)
    return train.sparkSession.read.parquet(path)


class Held:
    """Rows of bounded number in the memory of a task, in order of their id."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("id")
        get = lambda c: table[c].to_numpy()
        self.ids, self.y, self.fold = get("id"), get("y"), get("fold")
        self.weight = {"w_pos": get("w_pos"), "w_balanced": get("w_balanced"), "w_one": np.ones(len(self.y))}
        self.x = matrix(table["x"], width)

    def codes(self, borders: list[np.ndarray]) -> np.ndarray:
        return coded(self.x, borders)


BLOCK_KINDS = {"id": np.uint64, "y": np.float64, "fold": np.int32, "w": np.float64, "w_pos": np.float64, "w_balanced": np.float64}


def packed_blocks(rows: DataFrame, borders: list[np.ndarray], names: list[str]) -> DataFrame:
    """Rows in blocks of about ``BLOCK_ROWS``: a binary value for each of the named columns, and one of the codes."""
    width, sent = len(borders), rows.sparkSession.sparkContext.broadcast(borders)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in zip(*waiting)]
            waiting.clear()
            return pa.record_batch([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in parts], [*names, "codes"])

        for batch in batches:
            waiting.append((*(batch.column(c).to_numpy(zero_copy_only=False).astype(BLOCK_KINDS[c]) for c in names),
                            coded(matrix(batch.column("x"), width), sent.value)))
            if sum(len(w[0]) for w in waiting) >= BLOCK_ROWS:
                yield block()
        if waiting:
            yield block()

    return rows.select(*names, "x").mapInArrow(packed, ", ".join(f"{c} binary" for c in [*names, "codes"]))


def unpacked(row, names: list[str], width: int) -> list[np.ndarray]:
    """The arrays of a packed block, the codes last."""
    out = [np.frombuffer(row[c], BLOCK_KINDS[c]) for c in names]
    kind = np.uint8 if len(row["codes"]) == len(out[0]) * width else np.int64
    return [*out, np.frombuffer(row["codes"], kind).reshape(-1, width)]


class Coded:
    """:class:`Held` rows of which codes are kept only; models of fewer borders read theirs from them."""

    def __init__(self, rows: DataFrame, borders: list[np.ndarray]):
        names, self.borders = ["id", "y", "fold", "w_pos", "w_balanced"], borders
        found = packed_blocks(rows, borders, names).collect()
        parts = [unpacked(r, names, len(borders)) for r in found]
        self.ids, self.y, self.fold, w_pos, w_balanced, codes = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(self.ids.view(np.int64), kind="stable")
        self.ids, self.y, self.fold = self.ids[order], self.y[order], self.fold[order]
        self.weight = {"w_pos": w_pos[order], "w_balanced": w_balanced[order], "w_one": np.ones(len(order))}
        self.all_codes = np.asfortranarray(codes[order])

    def codes(self, borders: list[np.ndarray]) -> np.ndarray:
        """The codes for some of the borders: how many of them are among those at or below the value."""
        out = np.zeros(self.all_codes.shape, np.uint8 if max(map(len, borders), default=0) < 256 else np.int64, order="F")
        for i, (few, full) in enumerate(zip(borders, self.borders)):
            out[:, i] = np.searchsorted(np.searchsorted(full, few), np.arange(len(full) + 1), side="left").astype(out.dtype)[self.all_codes[:, i]]
        return out


# ---------------------------------------------------------------------------
# Growth of one model
# ---------------------------------------------------------------------------
def boosting_growth(kind: str, p: dict) -> tuple[Growth, int, float, str]:
    """(growth, rounds, learning rate, weight column) of a boosted parameter set."""
    if kind == "boosted_a":
        return (Growth(depth=int(p["max_depth"]), bins=MOST_BINS[kind], l2=1.0, least_hessian=float(p["min_child_weight"]),
                       least_gain=float(p["gamma"])), int(p["n_estimators"]), float(p["learning_rate"]), "w_pos")
    return (Growth(depth=int(p["depth"]), bins=int(p["border_count"]), l2=float(p["l2_leaf_reg"]), symmetric=True),
            int(p["iterations"]), float(p["learning_rate"]), "w_one")


def round_weights(kind: str, p: dict, ids: np.ndarray, t: int) -> np.ndarray:
    """Row weights of round ``t``: a subsample, or Bayesian weights ``(-ln u) ** temperature``."""
    if kind != "boosted_a" and float(p["bagging_temperature"]) == 0:
        return np.ones(len(ids))
    u = uniform(ids, 2 * t + 1)
    if kind == "boosted_a":
        return (u < float(p["subsample"])).astype(np.float64)
    weight = -np.log(u)
    return weight if float(p["bagging_temperature"]) == 1 else weight ** float(p["bagging_temperature"])


def round_columns(kind: str, p: dict, width: int, t: int) -> np.ndarray:
    """Features a round may use."""
    if kind != "boosted_a":
        return np.arange(width)
    n = max(1, int(float(p["colsample_bytree"]) * width))
    return np.sort(np.argsort(uniform(np.arange(width), 2 * t + 2))[:n])


def gradients(y: np.ndarray, margin: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Whole-number gradients and hessians of the logistic loss."""
    probability = 1 / (1 + np.exp(-margin))
    return [np.rint(weight * (probability - y) * UNIT), np.rint(weight * probability * (1 - probability) * UNIT)]


def boost_here(kind: str, p: dict, held: Held, borders: list[np.ndarray], keep: np.ndarray | None = None,
               at_rounds: list[int] = ()) -> tuple[Trees, dict[int, np.ndarray]]:
    """A boosted model over held rows; ``keep`` marks the rows that teach. Margins at the given rounds come along."""
    growth, rounds, rate, weight_name = boosting_growth(kind, p)
    borders = fewer_borders(borders, growth.bins)
    codes, margins = held.codes(borders), {}
    rows = slice(None) if keep is None else np.flatnonzero(keep)
    others = np.empty(0, np.int64) if keep is None else np.flatnonzero(np.asarray(keep) == 0)
    run = BoostRun(kind, p, borders, held.ids[rows], held.y[rows], held.weight[weight_name][rows], np.asfortranarray(codes[rows]))
    codes, rest = np.asfortranarray(codes[others]), np.zeros(len(others))
    for t in range(max([rounds, *at_rounds])):
        grower, value = run.round(t)
        if len(others) <= FEW_ROWS:
            rest += value[node_of(codes, grower)]
        else:
            for leaf, there in leaves_of(grower, codes, np.arange(len(others))):
                rest[there] += value[leaf]
        if t + 1 in at_rounds:
            margins[t + 1] = np.zeros(len(held.y))
            margins[t + 1][rows], margins[t + 1][others] = run.margin, rest
    return Trees.joined([g.trees(borders).scaled(rate) for g in run.grown]), margins


class BoostRun:
    """A boosted model that grows round by round over rows held here, alone or together with others that hold the rest."""

    def __init__(self, kind: str, p: dict, borders: list[np.ndarray], ids: np.ndarray, y: np.ndarray, weight: np.ndarray, codes: np.ndarray):
        self.kind, self.p, self.borders, self.ids, self.y, self.weight = kind, p, borders, ids, y, weight
        self.growth, _, self.rate, _ = boosting_growth(kind, p)
        self.cells, self.margin, self.grown = Cells(codes, [len(b) + 1 for b in borders]), np.zeros(len(y)), []

    def teaching(self, t: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(rows that teach in round ``t``, gradients and hessians, the other rows); worked out in pieces that a core's cache holds."""
        taught, sums = np.empty(len(self.y), bool), [np.empty(len(self.y)), np.empty(len(self.y))]
        for lo in range(0, len(self.y), PIECE_ROWS):
            part = slice(lo, lo + PIECE_ROWS)
            weight = self.weight[part] * round_weights(self.kind, self.p, self.ids[part], t)
            taught[part] = weight != 0
            sums[0][part], sums[1][part] = gradients(self.y[part], self.margin[part], weight)
        return np.flatnonzero(taught), sums, np.flatnonzero(~taught)

    def round(self, t: int) -> tuple[Grower, np.ndarray]:
        rows, sums, idle = self.teaching(t)
        columns = round_columns(self.kind, self.p, len(self.borders), t)
        if len(self.y) <= FEW_ROWS:      # one call for all nodes of a level costs less than one a node
            grower, at = grow_here(self.cells.codes, sums, self.growth, columns)
            return grower, self.follow(grower, [(at, slice(None))])
        grower, leaves = grow_by_rows(self.cells, rows, sums, self.growth, columns)
        return grower, self.follow(grower, [*leaves, *leaves_of(grower, self.cells.codes, idle)])

    def follow(self, grower: Grower, leaves: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
        """Move the margins by a tree; its leaf values."""
        value = grower.trees(self.borders).scaled(self.rate).value
        for leaf, rows in leaves_of(grower, self.cells.codes, np.arange(len(self.y))) if leaves is None else leaves:
            self.margin[rows] += value[leaf]
        self.grown.append(grower)
        return value


def forest_growth(p: dict, width: int) -> Growth:
    return Growth(depth=int(p["max_depth"]), bins=MOST_BINS["random_forest"], leaf_rows=int(p["min_samples_leaf"]),
                  split_rows=int(p.get("min_samples_split", 2)), node_features=max(1, int(math.sqrt(width))))


def forest_weight(p: dict) -> str:
    return "w_balanced" if p["class_weight"] == "balanced" else "w_one"


def forest_here(p: dict, held: Held, borders: list[np.ndarray], trees: range, keep: np.ndarray | None = None) -> tuple[Trees, np.ndarray]:
    """Trees number ``trees`` of a forest over held rows, and the sum of their leaf shares for every row."""
    growth, weight = forest_growth(p, len(borders)), held.weight[forest_weight(p)]
    borders = fewer_borders(borders, growth.bins)
    codes, total, parts = held.codes(borders), np.zeros(len(held.y)), []
    taught = np.flatnonzero(np.ones(len(held.y)) if keep is None else keep)
    for number in trees:
        rng = np.random.default_rng([S.RANDOM_STATE, number])
        drawn = np.zeros(len(held.y))
        if p["bootstrap"]:
            np.add.at(drawn, rng.choice(taught, len(taught)), 1.0)
        else:
            drawn[taught] = 1.0
        hessian = np.rint(drawn * weight * UNIT)
        sums = [-hessian * held.y, hessian, (drawn > 0).astype(np.float64)]
        grower, leaf = grow_here(codes, sums, growth, np.arange(len(borders)), rng)
        tree = grower.trees(borders)
        total += tree.value[leaf]
        parts.append(tree)
    return Trees.joined(parts), total


# ---------------------------------------------------------------------------
# Trees as rows
# ---------------------------------------------------------------------------
TREE_ROWS = ("number int, feature array<int>, threshold array<double>, left array<bigint>, value array<double>, "
             "cover array<double>, gain array<double>")


def tree_batch(trees: Trees, first: int) -> pa.RecordBatch:
    """One row a tree, nodes counted from the tree's root."""
    ends = [*trees.roots[1:].tolist(), len(trees.feature)]
    rows = []
    for i, (a, b) in enumerate(zip(trees.roots.tolist(), ends)):
        rows.append({"number": first + i, "left": np.where(trees.left[a:b] >= 0, trees.left[a:b] - a, -1).tolist(),
                     **{f: getattr(trees, f)[a:b].tolist() for f in ("feature", "threshold", "value", "cover", "gain")}})
    kinds = {"number": pa.int32(), "feature": pa.list_(pa.int32()), "left": pa.list_(pa.int64())}
    names = [f.split()[0] for f in TREE_ROWS.split(", ")]
    return pa.record_batch([pa.array([r[n] for r in rows], kinds.get(n, pa.list_(pa.float64()))) for n in names], names)


def trees_of_rows(rows: pa.Table) -> Trees:
    """The ensemble of tree rows, in order of their number."""
    parts = []
    for r in rows.sort_by("number").to_pylist():
        parts.append(Trees(np.array([0]), np.array(r["feature"], np.int32), np.array(r["threshold"]), np.array(r["left"], np.int64),
                           np.array(r["value"]), np.array(r["cover"]), np.array(r["gain"])))
    return Trees.joined(parts)


# ---------------------------------------------------------------------------
# Search: one task a candidate and fold
# ---------------------------------------------------------------------------
def f1_of(y: np.ndarray, predicted: np.ndarray) -> float:
    hit = float((y * predicted).sum())
    return 2 * hit / max(float(y.sum() + predicted.sum()), 1e-300) if hit else 0.0


def _rounds_name(kind: str) -> str | None:
    return {"boosted_a": "n_estimators", "boosted_b": "iterations"}.get(kind)


def runs_of(kind: str, candidates: list[dict]) -> list[tuple[dict, dict[int, int]]]:
    """Runs that cover all candidates: (longest parameter set, {candidate: rounds})."""
    name, runs = _rounds_name(kind), {}
    for i, p in enumerate(candidates):
        rest = tuple(sorted((k, str(v)) for k, v in p.items() if k != name)) if name else (i,)
        runs.setdefault(rest, {})[i] = int(p[name]) if name else 0
    return [(candidates[max(own, key=own.get)], own) for own in runs.values()]


def search_scores(spark: SparkSession, kind: str, rows: DataFrame, borders: list[np.ndarray], candidates: list[dict],
                  folds: int, held_rows: int = HELD_ROWS) -> list[float]:
    """Mean F1 of class 1 over the folds for every candidate, from all rows."""
    ship_package(spark)
    runs, n = runs_of(kind, candidates), rows.count()
    if not n:
        return [0.0] * len(candidates)
    if n > held_rows:
        return scores_of_fits(spark, kind, rows, borders, runs, folds)
    sent = spark.sparkContext.broadcast((Coded(rows, borders), borders, runs))       # at most held_rows rows of codes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, borders, runs = sent.value
        for batch in batches:
            for run, fold in zip(batch.column("run").to_pylist(), batch.column("fold").to_pylist()):
                p, own = runs[run]
                keep, out = held.fold != fold, held.fold == fold
                if kind == "random_forest":
                    n = int(p["n_estimators"])
                    _, total = forest_here(p, held, borders, range(n), keep)
                    sure = {0: total[out] / n > 0.5}
                else:
                    _, margins = boost_here(kind, p, held, borders, keep, sorted(set(own.values())))
                    sure = {t: m[out] >= 0 for t, m in margins.items()}
                f1 = [f1_of(held.y[out], sure[t].astype(np.float64)) for t in own.values()]
                yield pa.record_batch([pa.array(list(own), pa.int32()), pa.array([fold] * len(own), pa.int32()), pa.array(f1)],
                                      ["candidate", "fold", "f1"])

    cost = [int(p.get("max_depth", p.get("depth"))) * max([*own.values(), int(p.get("n_estimators", 0))]) for p, own in runs]
    jobs = [(r, f) for r in sorted(range(len(runs)), key=lambda r: -cost[r]) for f in range(folds)]
    tasks = spark.sparkContext.parallelize(jobs, len(jobs)).toDF("run int, fold int")   # longest first, one a task
    scored = tasks.mapInArrow(work, "candidate int, fold int, f1 double").toArrow().to_pandas()
    sent.destroy()
    means = scored.sort_values(["candidate", "fold"]).groupby("candidate").f1.mean()
    return [float(means.get(i, 0.0)) for i in range(len(candidates))]


def scores_of_fits(spark: SparkSession, kind: str, rows: DataFrame, borders: list[np.ndarray], runs: list[tuple[dict, dict[int, int]]],
                   folds: int) -> list[float]:
    """:func:`search_scores` over more rows than a task holds: a fit over many tasks for every run and fold."""
    found: dict[int, list[float]] = {}
    for p, own in runs:
        for fold in range(folds):
            teaching, judging = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
            if kind == "random_forest":
                trees, least = fit_forest(spark, teaching, borders, p), 0.5
            else:
                trees, least = fit_boosted(spark, kind, teaching, borders, p), 0.0
            counts = sure_counts(spark, judging, trees, len(borders), [t or len(trees.roots) for t in own.values()], least)
            for candidate, (hit, said, true) in zip(own, counts):
                found.setdefault(candidate, []).append(2 * hit / (said + true) if hit else 0.0)
    return [sum(found[i]) / folds for i in range(len(found))]


def sure_counts(spark: SparkSession, rows: DataFrame, trees: Trees, width: int, lengths: list[int], least: float) -> list[tuple]:
    """(hits, rows said to be of class 1, rows of class 1) of the first trees, for each of the lengths.

    A margin of ``least`` counts as sure for boosted models, a share must exceed it."""
    sent = spark.sparkContext.broadcast((trees, sorted(set(lengths))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, ends = sent.value
        for batch in batches:
            x, y, total, begun = matrix(batch.column("x"), width), batch.column("y").to_numpy(), 0.0, 0
            for end in ends:
                total, begun = total + replace(trees, roots=trees.roots[begun:end]).sums(x), end
                sure = total > least if least else total >= least
                yield pa.record_batch([pa.array([end]), *(pa.array([float(v)]) for v in ((y * sure).sum(), sure.sum(), y.sum()))],
                                      ["length", "hit", "said", "true"])

    each = rows.select("x", "y").mapInArrow(run, "length long, hit double, said double, true double")
    sums = {r["length"]: (r["hit"], r["said"], r["true"]) for r in each.groupBy("length").agg(
        *[F.sum(c).alias(c) for c in ("hit", "said", "true")]).collect()}        # a row a length
    sent.destroy()
    return [sums.get(n, (0.0, 0.0, 0.0)) for n in lengths]


# ---------------------------------------------------------------------------
# Fits on all rows
# ---------------------------------------------------------------------------
def fit_forest(spark: SparkSession, rows: DataFrame, borders: list[np.ndarray], p: dict, task_rows: int = TASK_ROWS) -> Trees:
    """A forest on all rows: one task a group of trees, or level by level over many tasks."""
    ship_package(spark)
    if rows.count() > task_rows:
        return forest_levels(spark, rows, borders, p)
    width, count = len(borders), int(p["n_estimators"])
    groups = min(TREE_GROUPS, count)
    copies = rows.withColumn("grp", F.explode(F.array(*[F.lit(g) for g in range(groups)])))
    sent = spark.sparkContext.broadcast(borders)

    def work(key, table):
        group = key[0].as_py()
        numbers = range(group * count // groups, (group + 1) * count // groups)
        trees, _ = forest_here(p, Held(table, width), sent.value, numbers)
        return pa.Table.from_batches([tree_batch(trees, numbers[0])])

    found = copies.groupBy("grp").applyInArrow(work, TREE_ROWS).toArrow()
    sent.destroy()
    trees = trees_of_rows(found)
    return trees.scaled(1 / count)


def forest_levels(spark: SparkSession, rows: DataFrame, borders: list[np.ndarray], p: dict) -> Trees:
    """A forest on all rows from histograms that Spark adds up: a job for a level of as many trees as have ``LEVEL_NODES`` nodes.

    Rows lie in cached blocks of codes, in order of their id. A tree without
    bootstrap is that of :func:`forest_here`. With bootstrap, as many rows are drawn
    with replacement as there are: the driver draws how many come from each block,
    and the block draws them.
    """
    ship_package(spark)
    width, count, bootstrap = len(borders), int(p["n_estimators"]), bool(p["bootstrap"])
    growth, weight_name = forest_growth(p, width), forest_weight(p)
    borders, names = fewer_borders(borders, growth.bins), ["id", "y", "w"]
    weight = F.lit(1.0) if weight_name == "w_one" else F.col(weight_name)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    spread = rows.select("id", "y", weight.alias("w"), "x").repartition(tasks, "id").sortWithinPartitions("id", "y", "x")

    def numbered(part: int, found: Iterator) -> Iterator[tuple]:
        for i, row in enumerate(found):
            _, y, w, codes = unpacked(row, names, width)
            yield (part, i), y, w, np.asfortranarray(codes)

    blocks = packed_blocks(spread, borders, names).rdd.mapPartitionsWithIndex(numbered).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = sorted(blocks.map(lambda b: (b[0], len(b[1]))).collect())
        place, sizes = {at: i for i, (at, _) in enumerate(sizes)}, np.array([n for _, n in sizes], np.int64)
        trees = [ForestTree(growth, number, width) for number in range(count)]
        draws = np.array([np.random.default_rng([S.RANDOM_STATE, t, 1]).multinomial(sizes.sum(), sizes / sizes.sum()) for t in range(count)]) if bootstrap else None
        for _ in range(growth.depth):
            waiting = [t for t in trees if t.nodes()]
            while waiting:
                job = [waiting.pop(0)]
                while waiting and sum(t.nodes() for t in [*job, waiting[0]]) <= LEVEL_NODES:
                    job.append(waiting.pop(0))
                for number, hist in level_of_trees(spark, blocks, job, place, draws, growth.bins):
                    trees[number].grow(hist)
        return Trees.joined([t.grower.trees(borders) for t in trees]).scaled(1 / count)
    finally:
        blocks.unpersist()


class ForestTree:
    """A tree of a forest on the driver, which sees its histograms only; random features are drawn as :func:`grow_here` draws them."""

    def __init__(self, growth: Growth, number: int, width: int):
        self.growth, self.number, self.width, self.grower = growth, number, width, None
        self.rng = np.random.default_rng([S.RANDOM_STATE, number])

    def nodes(self) -> int:
        return 1 if self.grower is None else len(self.grower.open)

    def drawn(self) -> np.ndarray:
        """The features that each open node may use."""
        self.columns = np.tile(np.arange(self.width), (self.nodes(), 1))
        if self.growth.node_features < self.width:
            self.columns = self.rng.permuted(self.columns, axis=1)[:, :self.growth.node_features]
        return self.columns

    def grow(self, hist: np.ndarray) -> None:
        if self.grower is None:
            self.grower = Grower(self.growth, hist[0, 0].sum(axis=0))
        self.grower.split(hist, self.columns)


def level_of_trees(spark: SparkSession, blocks: RDD, trees: list[ForestTree], place: dict, draws: np.ndarray | None, bins: int) -> list[tuple]:
    """(tree, histograms of its open nodes), added up over all blocks."""
    sent = spark.sparkContext.broadcast(([(t.number, t.grower, t.drawn()) for t in trees], place, draws))

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        trees, place, draws = sent.value
        totals: dict[int, np.ndarray] = {}
        for at, y, w, codes in found:
            for number, grower, columns in trees:
                times = 1.0
                if draws is not None:
                    rng = np.random.default_rng([S.RANDOM_STATE, number, 2, place[at]])
                    times = np.bincount(rng.integers(len(y), size=draws[number, place[at]]), minlength=len(y)).astype(np.float64)
                hessian = np.rint(times * w * UNIT)
                rows, node = np.flatnonzero(hessian), None
                if grower is not None:
                    open_at = np.full(len(grower.feature), -1)
                    open_at[grower.open] = np.arange(len(grower.open))
                    node = open_at[node_of(codes, grower, rows)]
                    rows, node = rows[node >= 0], node[node >= 0]
                else:
                    node = np.zeros(len(rows), np.int64)
                taken = hessian[rows]
                part = histogram(codes, rows, node, columns, [-taken * y[rows], taken, np.ones(len(rows))], bins)
                totals[number] = totals[number] + part if number in totals else part
        yield from totals.items()

    found = blocks.mapPartitions(run).reduceByKey(lambda a, b: a + b, min(len(trees), blocks.getNumPartitions())).collect()
    sent.destroy()
    return found        # at most LEVEL_NODES nodes, or one tree


def fit_boosted(spark: SparkSession, kind: str, rows: DataFrame, borders: list[np.ndarray], p: dict, task_rows: int = HELD_ROWS) -> Trees:
    """A boosted model on all rows: in one task, or level by level over many (same trees)."""
    ship_package(spark)
    n = rows.count()
    if n > task_rows:
        return boost_levels(spark, kind, rows, borders, p)
    if not n:
        return Trees.joined([])
    sent = spark.sparkContext.broadcast((Coded(rows, borders), borders))       # at most task_rows rows of codes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            trees, _ = boost_here(kind, p, *sent.value)
            yield tree_batch(trees, 0)

    found = spark.range(1, numPartitions=1).mapInArrow(work, TREE_ROWS).toArrow()
    sent.destroy()
    return trees_of_rows(found)


def row_blocks(rows: DataFrame, weight_name: str, borders: list[np.ndarray], tasks: int | None = None) -> RDD:
    """Blocks of at most ``BLOCK_ROWS`` rows: (ids, labels, weights, codes, margins of 0)."""
    names, width = ["id", "y", "w"], len(borders)
    weight = F.lit(1.0) if weight_name == "w_one" else F.col(weight_name)

    def block(row) -> tuple:
        ids, y, w, codes = unpacked(row, names, width)
        return ids, y, w, np.asfortranarray(codes), np.zeros(len(ids))

    tasks = tasks or max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    spread = rows.select("id", "y", weight.alias("w"), "x").repartition(tasks, "id", "x")
    return packed_blocks(spread, borders, names).rdd.map(block)


def summed(parts: RDD) -> np.ndarray | int:
    """The sum of the partitions' arrays; many are added up by tasks before the driver does."""
    if parts.getNumPartitions() > MOST_PARTS:
        return parts.treeAggregate(0, lambda a, b: a + b, lambda a, b: a + b)
    return sum(parts.collect())


def boost_levels(spark: SparkSession, kind: str, rows: DataFrame, borders: list[np.ndarray], p: dict, refresh: int = REFRESH) -> Trees:
    """A boosted model from histograms that Spark adds up, one job a level.

    The driver holds the trees and one level's histograms, both bounded by the
    parameters. Rows stay where they are, as cached blocks of codes with the
    round's gradients: a task leads them down the open tree and sums up the smaller
    of two siblings. The first job of a round moves the margins by the tree before;
    every ``refresh`` rounds the blocks are written to the checkpoint folder.
    """
    ship_package(spark)
    growth, rounds, rate, weight_name = boosting_growth(kind, p)
    borders, width = fewer_borders(borders, growth.bins), len(borders)
    base, old, saved, done = row_blocks(rows, weight_name, borders), None, None, []

    def moved(grower: Grower | None, value: np.ndarray | None, t: int):
        def run(block: tuple) -> tuple:
            ids, y, w, codes, margin = block[:5]
            if grower is not None:
                margin = margin + value[node_of(codes, grower)]
            return ids, y, w, codes, margin, gradients(y, margin, w * round_weights(kind, p, ids, t))
        return run

    def level(grower: Grower | None, columns: np.ndarray, smaller: np.ndarray | None):
        def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = None
            for _, _, _, codes, _, sums in blocks:
                rows = np.flatnonzero((sums[0] != 0) | (sums[1] != 0))
                node = np.zeros(len(rows), np.int64)
                if grower is not None:
                    place = np.full(len(grower.feature), -1)
                    place[grower.open.reshape(-1, 2)[np.arange(len(smaller)), smaller]] = np.arange(len(smaller))
                    node = place[node_of(codes, grower, rows)]
                    rows, node = rows[node >= 0], node[node >= 0]
                part = histogram(codes, rows, node, np.tile(columns, (1 if smaller is None else len(smaller), 1)), [x[rows] for x in sums], growth.bins)
                total = part if total is None else total + part
            if total is not None:
                yield total
        return run

    grower, value = None, None
    try:
        for t in range(rounds):
            state, columns = (base if old is None else old).map(moved(grower, value, t)).persist(StorageLevel.MEMORY_AND_DISK), round_columns(kind, p, width, t)
            write = t % refresh == refresh - 1 and t + 1 < rounds
            if write:
                state.checkpoint()
            found = summed(state.mapPartitions(level(None, columns, None)))
            hist = found if isinstance(found, np.ndarray) else np.zeros((1, len(columns), growth.bins, 2), np.int64)
            if old is not None:
                old.unpersist()
            if write:    # the checkpoint cuts the lineage; the one before it is read no more
                if saved:
                    remove_path(spark, saved)
                saved = state.getCheckpointFile()
            old, grower = state, Grower(growth, hist[0, 0].sum(axis=0))
            for depth in range(growth.depth):
                if depth:
                    smaller = smaller_children(grower)
                    small = summed(state.mapPartitions(level(grower, columns, smaller)))
                    hist = with_siblings(small, hist, smaller)
                hist = hist[grower.split(hist, np.tile(columns, (len(hist), 1)))]
                if not len(grower.open):
                    break
            tree = grower.trees(borders).scaled(rate)
            value = tree.value
            done.append(tree)
    finally:
        if old is not None:
            old.unpersist()
        if saved:
            remove_path(spark, saved)
    return Trees.joined(done)


def prepared_rows(kind: str, train: DataFrame, stages: list, features: list[str], folds: int):
    """(fitted stages, written training rows, feature borders)."""
    prep = Pipeline(stages=list(stages)).fit(train)
    rows = training_rows(prep, train, len(features), folds)
    return prep, rows, feature_borders(rows, len(features), MOST_BINS[kind])


def fit_trees(kind: str, train: DataFrame, stages: list, features: list[str], params: dict | None = None,
              candidates: list[dict] | None = None, folds: int = 1) -> tuple[TreeModel, dict, list[float]]:
    """(model, parameters, mean F1 of every candidate): a model of stated parameters, or the best of the candidates."""
    spark = train.sparkSession
    prep, rows, borders = prepared_rows(kind, train, stages, features, folds if params is None else 1)
    scores: list[float] = []
    if params is None:
        scores = search_scores(spark, kind, rows, borders, candidates, folds)
        params = candidates[max(range(len(candidates)), key=lambda i: scores[i])]
    if kind == "random_forest":
        trees, link = fit_forest(spark, rows, borders, params), "share"
    else:
        trees, link = fit_boosted(spark, kind, rows, borders, params), "logistic"
    return TreeModel(prep, trees, features, link), params, scores
