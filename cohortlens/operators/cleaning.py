"""Ingest cleaning of the raw enrolment table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.functions import clean_education, clean_imd_band, derive_label


def project_students(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """F1 + F2: derive the 0/1 label and keep the 21 student columns in order."""
    cols = [derive_label().alias(c) if c == "dropout" else F.col(c) for c in S.STUDENT_COLS]
    return raw.select(*cols, *keep)


def clean_students(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Label, projection and the three value repairs, one projection."""
    fixes = {"imd_band": clean_imd_band(), "highest_education": clean_education()}
    cols = [derive_label().alias(c) if c == "dropout"
            else fixes[c].alias(c) if c in fixes else F.col(c) for c in S.STUDENT_COLS]
    return raw.select(*cols, *keep)
