"""cohortlens: learner-dropout analytics expressed as Spark DataFrame / MLlib jobs.

Layers:
  sources/    readers for the enrolment, click-log and site tables, plus the
              fixture adapter that derives them from the TPC-H-style test tables
  functions/  column expressions (cleaning, encoding, display mapping)
  operators/  DataFrame -> DataFrame operators (features, reports, metrics,
              split, store, training, clustering, scoring)
  plans/      the named query registry and the equivalent DuckDB SQL
  streaming/  file-stream scoring of request rows
"""

__version__ = "0.1.0"
