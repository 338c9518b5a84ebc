"""Many matches in one relation.

Every operator takes ``chunk`` as the key of a source and never looks inside it, so it may have any type.  Chunks restart
in every match; for tables of many matches it therefore is one text of match and chunk, and results are split again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BETWEEN = "\x1f"


def kind(df: DataFrame, *columns: str) -> str:
    """Names and types of columns, as a schema."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def keyed(df: DataFrame, match: str = "match_id", chunk: str = "chunk") -> DataFrame:
    """``chunk`` becomes the key of (match, chunk); rows without a match or chunk belong to no source and are left out."""
    rest = [c for c in df.columns if c not in (match, chunk)]
    return df.where(F.col(match).isNotNull() & F.col(chunk).isNotNull()).select(F.concat(F.col(match).cast("string"), F.lit(_BETWEEN), F.col(chunk).cast("string")).alias("chunk"), *rest)


def split(df: DataFrame, match: str = "match_id", chunk: str = "chunk") -> DataFrame:
    """The key of ``keyed`` as match and chunk again, both as text; a chunk may hold any character, a match not the separator."""
    return df.where(F.instr("chunk", _BETWEEN) > 0).select(F.expr(f"left(chunk, instr(chunk, '{_BETWEEN}') - 1)").alias(match), F.expr(f"substring(chunk, instr(chunk, '{_BETWEEN}') + 1)").alias(chunk), *(c for c in df.columns if c != "chunk"))
