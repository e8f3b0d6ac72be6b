"""k-means segmentation (C1-C3), elbow curve (C2) and per-cluster dropout rates.

All numbers of clusters are fitted together: a pass over the rows assigns each
row for every k and leaves one partial sum a (k, centre). Scaled features are
rounded to a grid of 2^-24, so distances, sums and centres are whole numbers and
a result does not depend on how rows are spread or in which order they are added.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators.encode import minmax_features
from cohortlens.session import landed, ship_package


def attach_cluster_rate(assign: DataFrame) -> DataFrame:
    """Per-cluster mean dropout attached to every row.

    The aggregate has one row per cluster, so it is broadcast: neither a window
    by cluster id nor a shuffle on it puts a cluster into a single task."""
    rates = assign.groupBy("cluster_id").agg(F.avg(F.col("dropout").cast("double")).alias("dropout_rate"))
    return assign.join(F.broadcast(rates), "cluster_id", "left")


GRID = 1 << 24
PASSES = 40            # at most; a fit ends when no centre moves


def grid_points(df: DataFrame, cols=S.CLUSTER_FEATURES) -> DataFrame:
    """``df`` with grid coordinates ``__p0..`` of its min-max scaled features (NULL if one is) and ``__u``, a hash in (0, 1)."""
    scaled = minmax_features(df.select(*df.columns, *[F.col(c).alias(f"__s{i}") for i, c in enumerate(cols)]),
                             [f"__s{i}" for i in range(len(cols))])
    points = [F.round(F.col(f"__s{i}") * float(GRID)).cast("long") for i in range(len(cols))]
    out = scaled.select(*df.columns, *[p.alias(f"__p{i}") for i, p in enumerate(points)])
    name = F.concat_ws(":", F.coalesce(F.col("id_student").cast("string"), F.lit("null")), *[F.col(f"__p{i}") for i in range(len(cols))])
    return out.withColumn("__u", (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32))


def _distance(centre: list[int]):
    total = F.lit(0).cast("long")
    for i, c in enumerate(centre):
        gap = F.col(f"__p{i}") - F.lit(int(c)).cast("long")
        total = total + gap * gap
    return total


def _nearest(centres: list[list[int]]):
    """(squared distance, number) of the nearest centre; ties go to the lower number."""
    return F.array_min(F.array(*[F.struct(_distance(c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)]))


def _coordinates(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([batch.column(f"__p{i}").to_numpy(zero_copy_only=False) for i in range(width)], axis=1)


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centres) squared distances on the grid: all terms are whole numbers below 2^53, so doubles hold them exactly."""
    p, c = points.astype(np.float64), centres.astype(np.float64)
    return (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)


def seed_centres(points: DataFrame, k: int, width: int) -> list[list[int]]:
    """Up to ``k`` rows, each drawn with a weight of its squared distance to those before (k-means++).

    The draw takes the smallest exponential key ``-ln(u) / distance``, u being the
    row's hash, so a task offers its smallest and the result is the same wherever
    rows lie. The first k of them seed every smaller fit.
    """
    names, seeds = [f"__p{i}" for i in range(width)], []
    spark = points.sparkSession
    for j in range(k):
        sent = spark.sparkContext.broadcast(np.array(seeds, np.int64).reshape(-1, width))

        def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                p, u = _coordinates(batch, width), batch.column("__u").to_numpy(zero_copy_only=False)
                if len(sent.value):
                    spread = squared(p, sent.value).min(axis=1)
                    p, u, spread = p[spread > 0], u[spread > 0], spread[spread > 0]
                    u = -np.log(u) / spread
                for i in np.lexsort((*p.T[::-1], u))[:1]:
                    here = (float(u[i]), *p[i].tolist())
                    best = here if best is None else min(best, here)
            if best is not None:
                yield pa.record_batch([pa.array([x]) for x in best], ["key", *names])

        offers = points.select("__u", *names).mapInArrow(offer, "key double, " + ", ".join(f"{n} long" for n in names))
        found = offers.agg(F.min(F.struct("key", *names)).alias("best")).first()["best"]
        sent.destroy()
        if found is None:
            break
        seeds.append([int(found[n]) for n in names])
    return seeds


def lloyd(points: DataFrame, ks: list[int], width: int) -> dict[int, tuple[list[list[int]], list[int], float]]:
    """Per k: centres on the grid, their sizes and the inertia, from shared seeds and shared passes, which leave out ended fits.

    The centres travel as a broadcast, so all passes run the same plan; a task
    leaves one row a (k, centre), with distances summed in two halves of 24 bits.
    """
    spark, names = points.sparkSession, [f"__p{i}" for i in range(width)]
    ship_package(spark)
    seeds = seed_centres(points, max(ks), width)
    if not seeds:
        return {k: ([], [], 0.0) for k in ks}
    centres = {k: seeds[:k] for k in ks}
    fields = ["n", "high", "low", *[f"s{i}" for i in range(width)]]
    fits: dict[int, tuple] = {}
    for last in [False] * PASSES + [True]:
        sent = spark.sparkContext.broadcast({k: np.array(c, np.int64) for k, c in centres.items()})

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros((len(c), len(fields)), np.int64) for k, c in sent.value.items()}
            for batch in batches:
                p, at = _coordinates(batch, width), np.arange(batch.num_rows)
                distances, first = squared(p, np.concatenate(list(sent.value.values()))), 0
                for k, c in sent.value.items():
                    distance, first = distances[:, first:first + len(c)], first + len(c)
                    near = distance.argmin(axis=1)
                    least = distance[at, near].astype(np.int64)
                    for f, x in enumerate([None, least >> 24, least & ((1 << 24) - 1), *p.T]):
                        sums[k][:, f] += np.bincount(near, x, len(c)).astype(np.int64)
            for k, s in sums.items():
                some = np.flatnonzero(s[:, 0])
                yield pa.record_batch([pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32()),
                                       *[pa.array(s[some, f]) for f in range(len(fields))]], ["k", "j", *fields])

        kinds = "k int, j int, " + ", ".join(f"{f} long" for f in fields)
        rows = (points.select(*names).mapInArrow(partial, kinds).groupBy("k", "j")
                .agg(*[F.sum(f).alias(f) for f in fields]).collect())          # a row a (k, centre)
        sent.destroy()
        found = {(r["k"], r["j"]): r for r in rows}
        moved = {k: [[found[k, j][f"s{i}"] // found[k, j]["n"] for i in range(width)] if (k, j) in found else c
                     for j, c in enumerate(own)] for k, own in centres.items()}
        for k in [k for k in centres if last or moved[k] == centres[k]]:
            sizes = [found[k, j]["n"] if (k, j) in found else 0 for j in range(len(centres[k]))]
            total = sum((int(r["high"]) << 24) + int(r["low"]) for r in rows if r["k"] == k)
            fits[k] = (centres[k], sizes, float(total) / GRID / GRID)
            del moved[k]
        centres = moved
        if not centres:
            break
    return {k: fits[k] for k in ks}


def fit_clusters(df: DataFrame, k: int = S.K_CLUSTERS, cols=S.CLUSTER_FEATURES):
    """K-means on min-max scaled features; cluster ids ascend with the mean avg_score.

    Returns (rows with cluster_id, centres on the scaled features, inertia). Rows
    with a NULL feature have no cluster.
    """
    df = landed(df, "cluster-rows")        # read for the bounds, the points and the rows that come back
    points, whole = grid_points(df, cols), F.col("__p0").isNotNull()
    for i in range(1, len(cols)):
        whole = whole & F.col(f"__p{i}").isNotNull()
    points = points.persist()
    try:
        centres, _, inertia = lloyd(points.where(whole), [k], len(cols))[k]
    finally:
        points.unpersist()
    raw = F.when(whole, _nearest(centres)["j"]) if centres else F.lit(None).cast("int")
    placed = points.withColumn("__raw", raw).select(*df.columns, "__raw")
    # renumber: a k-row table (one row per centre), attached by broadcast
    order = placed.where("__raw is not null").groupBy("__raw").agg(F.avg("avg_score").alias("__m"))
    order = order.select("__raw", (F.row_number().over(Window.orderBy("__m", "__raw")) - 1).cast("int").alias("cluster_id"))
    out = placed.join(F.broadcast(order), "__raw", "left").drop("__raw")
    return out, [[x / GRID for x in c] for c in centres], inertia


def clusters_table(df: DataFrame, k: int = S.K_CLUSTERS) -> DataFrame:
    """(id_student, cluster_id, dropout_rate) for every enrolment."""
    assign, _, _ = fit_clusters(df, k)
    return attach_cluster_rate(assign).select("id_student", "cluster_id", "dropout_rate")


def inertia_k1(df: DataFrame, cols=S.CLUSTER_FEATURES) -> DataFrame:
    """C2 for k=1 (MLlib rejects k=1): n * sum of population variances of the
    scaled features = total squared distance to the grand mean."""
    scaled = minmax_features(df, cols)
    n = F.count(F.lit(1))
    total = None
    for c in cols:
        term = F.coalesce(F.var_pop(c), F.lit(0.0)) * n
        total = term if total is None else total + term
    return scaled.agg(F.lit(1).alias("k"), total.alias("inertia"))


def elbow(spark: SparkSession, df: DataFrame, ks=range(1, 11)) -> DataFrame:
    """Inertia for each k, all fitted together."""
    fits = _all_fits(df, list(ks))
    return spark.createDataFrame([(int(k), inertia) for k, (_, _, inertia) in fits.items()], S.KMEANS_METRICS_SCHEMA)


def elbow_centres(spark: SparkSession, df: DataFrame, ks=range(1, 11), cols=S.CLUSTER_FEATURES) -> DataFrame:
    """Centres and sizes of all fits on the scaled features: (k, centre, n_rows, one column a feature)."""
    rows = [(int(k), j, n, *[x / GRID for x in c]) for k, (centres, sizes, _) in _all_fits(df, list(ks)).items()
            for j, (c, n) in enumerate(zip(centres, sizes))]
    return spark.createDataFrame(rows, "k int, centre int, n_rows long, " + ", ".join(f"{c} double" for c in cols))


def _all_fits(df: DataFrame, ks: list[int], cols=S.CLUSTER_FEATURES) -> dict:
    points = grid_points(landed(df, "cluster-rows"), cols).select("__u", *[f"__p{i}" for i in range(len(cols))]).dropna().persist()
    try:
        return lloyd(points, ks, len(cols))
    finally:
        points.unpersist()


def kmeans_sql(source: str, ks: list[int], cols=S.CLUSTER_FEATURES, passes: int = PASSES) -> str:
    """DuckDB CTEs of the same fit: ``pts`` (row_no, p0.., d) and ``fitted`` (k, j, c0..), ``near`` (row_no, k, j, d)."""
    width = range(len(cols))
    gap = lambda a, b: " + ".join(f"({a}p{i} - {b}{i}) * ({a}p{i} - {b}{i})" for i in width)
    ps = ", ".join(f"p{i}" for i in width)
    scaled = ", ".join(f"CAST(round(coalesce(({c} - st.lo{i}) / nullif(st.hi{i} - st.lo{i}, 0), 0e0) * {GRID}e0) AS BIGINT) AS p{i}"
                       for i, c in enumerate(cols))
    bounds = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols))
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    name = " || ':' || ".join(["coalesce(CAST(id_student AS VARCHAR), 'null')", *[f"CAST(p{i} AS VARCHAR)" for i in width]])
    out = [f"""grid AS (SELECT z.*, row_number() OVER () AS row_no FROM (
 SELECT s.*, {scaled} FROM ({source}) s, (SELECT {bounds} FROM ({source}) x) st WHERE {known}) z)""",
           f"""pts AS MATERIALIZED (SELECT *, ((('0x' || substr(md5({name}), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296e0 AS u FROM grid)""",
           f"seed0 AS MATERIALIZED (SELECT 0 AS j, {ps} FROM pts ORDER BY u, {ps} LIMIT 1)",
           f"far0 AS MATERIALIZED (SELECT pts.*, {gap('pts.', 'seed0.p')} AS d FROM pts, seed0)"]
    for j in range(1, max(ks)):
        out += [f"seed{j} AS MATERIALIZED (SELECT {j} AS j, {ps} FROM far{j - 1} WHERE d > 0 ORDER BY -ln(u) / d, {ps} LIMIT 1)",
                f"far{j} AS MATERIALIZED (SELECT f.* REPLACE (least(d, coalesce({gap('f.', 's.p')}, d)) AS d) FROM far{j - 1} f LEFT JOIN seed{j} s ON true)"]
    seeds = " UNION ALL ".join(f"SELECT * FROM seed{j}" for j in range(max(ks)))
    start = ", ".join(f"p{i} AS c{i}" for i in width)
    out.append(f"step0 AS MATERIALIZED (SELECT k, j, {start} FROM ({seeds}) s, (SELECT unnest({list(ks)}) AS k) WHERE j < k)")
    close = "(SELECT row_no, k, min(struct_pack(d := {g}, j := s.j)) AS n FROM pts, {step} s GROUP BY row_no, k)"
    for t in range(1, passes + 1):
        mean = ", ".join(f"CAST(sum(p{i}) // count(*) AS BIGINT) AS c{i}" for i in width)
        near = close.format(g=gap("pts.", "s.c"), step=f"step{t - 1}")
        out.append(f"step{t} AS MATERIALIZED (SELECT o.k, o.j, " + ", ".join(f"coalesce(m.c{i}, o.c{i}) AS c{i}" for i in width)
                   + f" FROM step{t - 1} o LEFT JOIN (SELECT k, n.j AS j, {mean} FROM {near} a JOIN pts USING (row_no) GROUP BY k, n.j) m USING (k, j))")
    out.append(f"fitted AS (SELECT * FROM step{passes})")
    out.append(f"near AS MATERIALIZED (SELECT row_no, k, n.j AS j, n.d AS d FROM {close.format(g=gap('pts.', 's.c'), step='fitted')} a)")
    return ",\n".join(out)
