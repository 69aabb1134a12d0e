"""What several operators need: byte-exact word rules, names that do not clash, Arrow helpers, the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import fresh_path, materialise, settled, shared_dir

__all__ = ["SPACE", "byte_texts", "documents", "free_names", "fresh_path", "materialise", "settled", "shared_dir", "whole_text"]

#: The white space of every contract here, as the inside of a regular expression's character class.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def free_names(taken: list[str], *wanted: str) -> tuple[str, ...]:
    """Names like those wanted that clash with none of the taken ones, whatever their case."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


def byte_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty, without decoding them first."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column
    return [x or b"" for x in column.to_pylist()]
