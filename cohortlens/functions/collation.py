"""The reference's comparison of text without regard to case, as a switch of the schema."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLATION = "UTF8_LCASE"
#: keys and names that the reference's database compares
TEXT_KEYS = ("code_module", "code_presentation", "model_name")


def ignore_case(df: DataFrame, cols=TEXT_KEYS) -> DataFrame:
    """``df`` with its text columns among ``cols`` collated without case: group-bys, joins and comparisons follow.

    Values stay as they are written; which spelling of a group is shown is open, as
    in the reference. Accents still count.
    """
    texts = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.collate(c, COLLATION) for c in texts}) if texts else df


def same_name(col: Column, names, without_case: bool) -> Column:
    """Whether a name is one of ``names``."""
    return F.collate(col, COLLATION).isin([F.collate(F.lit(n), COLLATION) for n in names]) if without_case else col.isin(list(names))
