"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import fresh, hot_join, sized

__all__ = ["NOT_WHITE", "WHITE", "fresh", "held_out", "hot_join", "sample", "sized", "text_of"]

WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(id_col: str, of: int, rest: int) -> Column:
    """Whether the checksum of the id leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: tuple[int, int]) -> tuple[list[str], list[str]]:
    """Whole texts of ``rows`` rows at most of each label, ones and zeros, the same at every run: (ones, zeros)."""
    out = []
    for value, most in zip((1, 0), rows, strict=True):
        ids = labels.where((F.col(label) == value) & F.col(id_col).isNotNull()).select(F.col(id_col)).distinct()
        ids = ids.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(most)
        texts = docs.select(id_col, text_of(text_col).alias("text")).join(F.broadcast(ids), id_col)
        out.append([r["text"] for r in texts.groupBy(id_col).agg(F.min("text").alias("text")).orderBy(id_col).collect()])
    return out[0], out[1]
