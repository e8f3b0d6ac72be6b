"""Fixture adapter: derives the learner tables from the TPC-H-style test tables.

The reference ships no data, so `FIXTURES.md` defines how each learner table
(enrolments, click log, predictions, clusters, sites, runs, requests) is
derived from the driver's parquet tables. Everything here is a lazy DataFrame
over the given tables, so its work grows with them; nothing is made up.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schemas as S

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Fixed values of the fixture mapping (FIXTURES.md)
PRIORITY_TO_MODULE = [("1-URGENT", "AAA"), ("2-HIGH", "BBB"), ("3-MEDIUM", "CCC"),
                      ("4-NOT SPECIFIED", "DDD")]
SEGMENT_TO_EDUCATION = [("MACHINERY", "No Formal quals"), ("BUILDING", "Lower Than A Level"),
                        ("AUTOMOBILE", "A Level or Equivalent"), ("FURNITURE", "HE Qualification")]
ACCTBAL_BAND = ["0", "10-20", "20-30%", "30-40%", "40-50%", "50-60%", "60-70%",
                "70-80%", "80-90%", "90-100%"]
FIXTURE_MODELS = [("logistic_dropout", 1), ("random_forest", 2), ("xgboost_dropout", 3),
                  ("catboost_dropout", 4), ("tabnet", 5), ("Random Forest", 6), ("XGBoost", 7)]
MODULE_CODES = ["AAA", "BBB", "CCC", "DDD", "EEE"]
GOLDEN = 2654435761
RUN_EXPERIMENTS = ["student_dropout_logistic_v2", "random-forest-prediction-v2",
                   "xgboost_stu_vle_v2", "catboost_stu_vle_v2", "tabnet-dropout-prediction"]


def _case(c, pairs, default):
    expr = None
    for k, v in pairs:
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


class Tables:
    """Lazy accessors for the base tables and the derived learner tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._overrides: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name in self._overrides:
            return self._overrides[name]
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def use(self, name: str, df: DataFrame) -> "Tables":
        """Replace a derived table by a materialised copy (see ``materialize``)."""
        self._overrides[name] = df
        self.__dict__.pop(name, None)
        return self

    def _derived(self, name, build):
        if name in self._overrides:
            return self._overrides[name]
        return build()

    # -- enrolment grain of the orders table --------------------------------
    @functools.cached_property
    def enrol(self) -> DataFrame:
        o = self.base("orders")
        d = F.col("o_orderdate")
        return o.select(
            F.col("o_custkey").alias("id_student"),
            _case(F.col("o_orderpriority"), PRIORITY_TO_MODULE, "EEE").alias("code_module"),
            F.concat(F.year(d).cast("string"),
                     F.when(F.month(d) <= 6, F.lit("B")).otherwise(F.lit("J"))).alias("code_presentation"),
            "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")

    @functools.cached_property
    def _lines_enrol(self) -> DataFrame:
        li = self.base("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag",
                                          "l_linestatus", "l_shipdate")
        e = self.enrol.select("o_orderkey", "id_student", "code_module", "code_presentation",
                              "o_orderdate")
        return li.join(e, li.l_orderkey == e.o_orderkey)

    @functools.cached_property
    def student_vle(self) -> DataFrame:
        """Click log: one row per line item, day offset folded into -25..244."""
        def build():
            x = self._lines_enrol
            dd = F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))
            return x.select(
                "code_module", "code_presentation", "id_student",
                F.col("l_partkey").alias("id_site"),
                (F.pmod(dd, F.lit(270)) - 25).cast("int").alias("date"),
                F.col("l_quantity").cast("int").alias("sum_click"))
        return self._derived("student_vle", build)

    @functools.cached_property
    def vle(self) -> DataFrame:
        def build():
            p = self.base("part")
            return p.select(
                F.col("p_partkey").alias("id_site"),
                F.element_at(F.array(*[F.lit(m) for m in MODULE_CODES]),
                             (F.pmod(F.col("p_partkey"), F.lit(5)) + 1).cast("int")).alias("code_module"),
                F.concat((F.lit(1992) + F.pmod(F.col("p_size"), F.lit(7))).cast("string"),
                         F.when(F.col("p_partkey") % 2 == 0, F.lit("B")).otherwise(F.lit("J"))).alias("code_presentation"),
                F.col("p_type").alias("activity_type"),
                (F.col("p_size") % 40).cast("int").alias("week_from"),
                (F.col("p_size") % 40 + 1).cast("int").alias("week_to"))
        return self._derived("vle", build)

    @functools.cached_property
    def raw_students(self) -> DataFrame:
        def build():
            keys = ["id_student", "code_module", "code_presentation"]
            st = (F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 120000), F.lit(2))
                   .when(F.col("o_orderstatus") == "P", F.lit(1)).otherwise(F.lit(0)))
            en = self.enrol.groupBy(*keys).agg(
                F.min("o_orderkey").alias("enrol_key"), F.max(st).alias("st"),
                F.count(F.lit(1)).alias("n_ord"))
            flag = lambda c, v: F.sum(F.when(F.col(c) == v, F.lit(1)).otherwise(F.lit(0)))
            cl = self._lines_enrol.groupBy(*keys).agg(
                F.sum("l_quantity").alias("total_clicks"),
                # exact distinct counts in one exchange (bounded per enrolment)
                F.size(F.collect_set("l_shipdate")).alias("active_days"),
                F.size(F.collect_set("l_partkey")).alias("unique_resources"),
                flag("l_returnflag", "A").alias("num_forum"),
                flag("l_returnflag", "R").alias("num_quiz"),
                (F.avg("l_quantity") * 2).alias("avg_score"),
                flag("l_linestatus", "F").alias("num_assess_attempted"),
                (F.count(F.lit(1)) * 12.5).alias("total_weight"))
            cust = self.base("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
            nat = self.base("nation").select("n_nationkey", "n_name")
            ck = F.col("c_custkey")
            band_idx = F.floor((F.col("c_acctbal") + 1000) / 1000).cast("int")
            band = _case(band_idx, list(enumerate(ACCTBAL_BAND)), "0-10%")
            j = (en.join(cust, en.id_student == cust.c_custkey)
                   .join(nat, F.col("n_nationkey") == F.col("c_nationkey"))
                   .join(cl, keys, "left"))
            dbl = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
            return j.select(
                "id_student", "code_module", "code_presentation",
                F.when(ck % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
                F.col("n_name").alias("region"),
                _case(F.col("c_mktsegment"), SEGMENT_TO_EDUCATION,
                      "Post Graduate Qualification").alias("highest_education"),
                band.alias("imd_band"),
                F.when(ck % 3 == 0, F.lit("0-35")).when(ck % 3 == 1, F.lit("35-55"))
                 .otherwise(F.lit("55<=")).alias("age_band"),
                (F.col("n_ord") - 1).cast("int").alias("num_of_prev_attempts"),
                (F.lit(30) * (F.lit(1) + ck % 8)).cast("int").alias("studied_credits"),
                F.when(ck % 10 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("disability"),
                dbl("total_clicks"), dbl("active_days"), dbl("unique_resources"), dbl("num_forum"),
                dbl("num_quiz"), dbl("avg_score"), dbl("num_assess_attempted"), dbl("total_weight"),
                (F.lit(234) + ck % 36).cast("int").alias("module_presentation_length"),
                "enrol_key",
                F.when(F.col("enrol_key") % 101 == 0, F.lit(None).cast("string"))
                 .when(F.col("st") == 2, F.lit("Withdrawn"))
                 .when(F.col("st") == 1, F.lit("Fail")).otherwise(F.lit("Pass")).alias("final_result"))
        return self._derived("raw_students", build)

    @functools.cached_property
    def students(self) -> DataFrame:
        """Cleaned enrolments (F1-F3) plus the fixture-only ``enrol_key``."""
        def build():
            from cohortlens.operators.cleaning import clean_students
            return clean_students(self.raw_students, keep=("enrol_key",))
        return self._derived("students", build)

    @functools.cached_property
    def predictions(self) -> DataFrame:
        """Held-out predictions of seven stored model names (synthetic scores)."""
        def build():
            wide = F.col("enrol_key").cast("decimal(38,0)")   # products exceed a long at large scale
            s = self.students.where(
                (F.pmod(wide * F.lit(GOLDEN), F.lit(4294967296)).cast("long") / F.lit(4294967296.0)) < 0.2)
            models = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(k).cast("long").alias("k"))
                               for n, k in FIXTURE_MODELS])
            x = s.select("id_student", "enrol_key", "dropout", F.explode(models).alias("m"))
            wide_key = F.col("enrol_key").cast("decimal(38,0)") + 1
            num = (F.lit(3000) * F.col("dropout")
                   + F.lit(7) * F.pmod(wide_key * (F.lit(GOLDEN) + F.col("m.k")), F.lit(1000)).cast("long"))
            prob = num / F.lit(10000.0)
            return x.select(
                F.when(F.col("enrol_key") % 97 == 0, F.col("id_student") + 1000000)
                 .otherwise(F.col("id_student")).alias("id_student"),
                F.col("m.model_name").alias("model_name"),
                F.when(prob >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("predicted"),
                prob.alias("probability"),
                F.concat(F.lit("run-"), F.col("m.model_name")).alias("run_id"))
        return self._derived("predictions", build)

    @functools.cached_property
    def cluster_assign(self) -> DataFrame:
        """Deterministic stand-in for a k-means assignment at enrolment grain."""
        s = self.students
        cid = (F.when(F.col("enrol_key") % 50 == 0, F.lit(7))
                .when(F.col("active_days") < 3, F.lit(0))
                .when(F.col("active_days") < 6, F.lit(1)).otherwise(F.lit(2))).cast("int")
        return s.select("id_student", "enrol_key", "dropout", cid.alias("cluster_id"))

    @functools.cached_property
    def clusters(self) -> DataFrame:
        """clusters table: assignment plus the per-cluster dropout rate."""
        def build():
            from cohortlens.operators.cluster import attach_cluster_rate
            return attach_cluster_rate(self.cluster_assign).select("id_student", "cluster_id", "dropout_rate")
        return self._derived("clusters", build)

    @functools.cached_property
    def runs(self) -> DataFrame:
        """Run-tracking table derived from orders: one run per order."""
        def build():
            o = self.base("orders")
            k = F.col("o_orderkey")
            exp = F.element_at(F.array(*[F.lit(e) for e in RUN_EXPERIMENTS]),
                               (F.pmod(k, F.lit(len(RUN_EXPERIMENTS))) + 1).cast("int"))
            return o.select(
                F.concat(F.lit("run-"), k.cast("string")).alias("run_id"),
                exp.alias("experiment"),
                F.when(F.col("o_orderstatus") == "F", F.lit("FINISHED"))
                 .when(F.col("o_orderstatus") == "O", F.lit("RUNNING")).otherwise(F.lit("FAILED")).alias("status"),
                (F.col("o_orderdate") + F.make_dt_interval(
                    secs=F.pmod(k, F.lit(86400)).cast("decimal(18,6)"))).alias("start_time"),
                F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("file:///runs/"), k.cast("string")))
                 .otherwise(F.concat(F.lit("server-artifacts:/"), k.cast("string"))).alias("artifact_uri"),
                F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("params"),
                F.create_map(F.lit("f1"), F.pmod(F.col("o_totalprice"), F.lit(1.0))).alias("metrics"))
        return self._derived("runs", build)

    @functools.cached_property
    def requests(self) -> DataFrame:
        """Scoring requests: enrolments with a hash-chosen subset of features left
        NULL (meaning 'take the default') and a free-text student id."""
        def build():
            s = self.students
            ek = F.col("enrol_key")
            sid = (F.when(ek % 7 == 0, F.lit(""))
                    .when(ek % 7 == 1, F.concat(F.lit("id-"), F.col("id_student").cast("string")))
                    .otherwise(F.col("id_student").cast("string")))
            cols = [ek.alias("request_id"), sid.alias("student_id_text")]
            for i, c in enumerate(S.FEATURE_COLS):
                keep = F.pmod(ek + F.lit(i), F.lit(3)) != 0
                cols.append(F.when(keep, F.col(c)).alias(c))
            return s.select(*cols)
        return self._derived("requests", build)

    @functools.cached_property
    def early(self) -> DataFrame:
        """Enrolments with early-click features (I4)."""
        def build():
            from cohortlens.operators.features import early_frame
            return early_frame(self.students, self.student_vle)
        return self._derived("early", build)

    @functools.cached_property
    def requests_early(self) -> DataFrame:
        """Early-click-form scoring requests: enrolments with early features,
        a hash-chosen subset left NULL and a free-text student id."""
        def build():
            e = self.early
            ek = F.col("enrol_key")
            sid = (F.when(ek % 5 == 0, F.lit(" ")).when(ek % 5 == 1, F.lit("x" )).otherwise(
                F.col("id_student").cast("string")))
            cols = [ek.alias("request_id"), sid.alias("student_id_text")]
            for i, c in enumerate(S.EARLY_FEATURE_COLS):
                cols.append(F.when(F.pmod(ek + F.lit(2 * i), F.lit(4)) != 0, F.col(c)).alias(c))
            return e.select(*cols)
        return self._derived("requests_early", build)

    def register_views(self, names=("students", "student_vle", "vle", "predictions", "clusters", "runs")) -> None:
        """Temp views under the learner-table names, for Spark SQL users
        (``studentVle`` keeps its original spelling)."""
        for n in names:
            getattr(self, n).createOrReplaceTempView("studentVle" if n == "student_vle" else n)

    def materialize(self, names=("student_vle", "students", "predictions", "clusters", "requests"),
                    base: str | None = None, buckets: int | None = None,
                    max_bucket_skew: float = 2.0) -> "Tables":
        """Ingest job: write the derived tables as parquet (in the shared
        checkpoint folder unless ``base`` is given) and read them back, so
        later queries scan files instead of recomputing the derivations.

        With ``buckets``, the click log and the enrolments are written as
        external tables bucketed (and sorted) on the three enrolment keys:
        the click-feature aggregation and its join onto enrolments then run
        without any exchange -- the click log is shuffled once, at ingest.

        A bucket holds all rows of its keys, so one hot enrolment (say a
        third of all clicks) would make one bucket -- one task -- a third of
        the scan. Rows per bucket are checked after the write (from parquet
        footers); above ``max_bucket_skew`` x the mean, the files are read
        unbucketed, and the partial-aggregation path spreads the hot key.

        The line-item x order join feeds both the click log and the
        enrolment aggregates; if both are named it is written once to the
        shared checkpoint folder, and that copy is deleted when the job ends."""
        import uuid

        from cohortlens.session import remove_path, scratch_path
        keys = ["id_student", "code_module", "code_presentation"]
        needs_join = [n for n in names if n in ("student_vle", "students", "raw_students")
                      and n not in self._overrides]
        shared = scratch_path(self.spark, "ingest-lines") if len(needs_join) > 1 else None
        if shared:
            self._lines_enrol.write.parquet(shared)
            self.__dict__["_lines_enrol"] = self.spark.read.parquet(shared)
        try:
            for name in names:  # order matters: later tables derive from earlier ones
                path = f"{base.rstrip('/')}/{name}" if base else scratch_path(self.spark, f"ingest-{name}")
                df = getattr(self, name)
                if buckets and name in ("student_vle", "students"):
                    table = f"cohortlens_{name}_{uuid.uuid4().hex[:8]}"
                    # hash-partition into exactly the buckets first: each task then
                    # writes one bucket file instead of one file per bucket
                    (df.repartition(int(buckets), *keys)
                       .write.mode("overwrite").format("parquet").option("path", path)
                       .bucketBy(int(buckets), *keys).sortBy(*keys).saveAsTable(table))
                    if bucket_skew(self.spark, path) <= max_bucket_skew:
                        self.use(name, self.spark.table(table))
                    else:  # a hot key filled one bucket: read the same files unbucketed
                        self.use(name, self.spark.read.parquet(path))
                else:
                    df.write.mode("overwrite").parquet(path)
                    self.use(name, self.spark.read.parquet(path))
        finally:
            if shared:
                self.__dict__.pop("_lines_enrol", None)
                remove_path(self.spark, shared)
        return self


def bucket_skew(spark, path: str) -> float:
    """Largest bucket's row count / mean bucket row count of a bucketed
    parquet folder. Rows are counted per file with no column read (parquet
    footers only) and summed per bucket id, the file-name suffix."""
    f = F.input_file_name()
    b = F.regexp_extract(f, r"_(\d{5})(\.c\d+)?\.[^/]*$", 1)
    counts = [r["n"] for r in spark.read.parquet(path).select(b.alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()]   # one row per bucket
    if not counts:
        return 1.0
    mean = sum(counts) / len(counts)
    return max(counts) / mean if mean else 1.0
