"""Tables of matches and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(line, query, target, pct, match_len) of columns parted by white space; more columns are ignored."""
    return matches(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))


def matches(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select("line", parts[0].alias("query"), parts[1].alias("target"), parts[2].cast("double").alias("pct"), parts[3].cast("int").alias("match_len"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """(line, query, hit, bitscore) of twelve columns parted by tabs; a query's name ends at its first dot."""
    parts = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.monotonically_increasing_id().alias("line"), F.split(parts[0], r"\.")[0].alias("query"), parts[1].alias("hit"), parts[11].cast("double").alias("bitscore"))


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, counts): counts by the taxa that the first line names; of one contig the last line."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("parts"))
    head = lines.orderBy("line").limit(1).select(F.col("line").alias("head_line"), F.slice("parts", 2, F.size("parts") - 1).alias("names"))
    rows = lines.crossJoin(F.broadcast(head)).where(F.col("line") > F.col("head_line"))  # one row of names
    counts = F.map_from_arrays("names", F.transform(F.slice("parts", 2, F.size("names")), lambda x: x.cast("int")))
    return rows.select("line", F.get("parts", F.lit(0)).alias("contig_id"), counts.alias("counts")).groupBy("contig_id").agg(F.max_by("counts", "line").alias("counts"))


def settings(files: list[str], given: list[str] | None = None, extra: str | None = None) -> dict:
    """Flat settings: later files over earlier ones, ``extra`` over those, given flags over all.

    Files hold ``name: value`` lines, and lists as lines of ``- value``. Flags
    are ``--name value``, ``--name``/``--no-name`` for true and false, and
    ``--name a b`` for lists.
    """
    out: dict = {}
    for path in [*files, *([extra] if extra else [])]:
        with open(path) as f:
            out.update(parsed(f.read()))
    given, at = given or [], 0
    while at < len(given):
        name = given[at].removeprefix("--")
        if name.startswith("no-") and isinstance(out.get(name[3:]), bool):
            out[name[3:]], at = False, at + 1
        elif isinstance(out.get(name), bool):
            out[name], at = True, at + 1
        else:
            values = []
            at += 1
            while at < len(given) and not given[at].startswith("--"):
                values.append(given[at])
                at += 1
            if name not in out or not values:
                raise ValueError(f"no such setting or no value: {name}")
            kind = type(out[name])
            out[name] = [value(v) for v in values] if kind is list else kind(values[0])
    return out


def value(text: str):
    text = text.strip().strip("\"'")
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parsed(text: str) -> dict:
    """Settings of one file."""
    out: dict = {}
    name = None
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        if line.strip().startswith("- ") and name:
            out[name] = [*(out[name] if isinstance(out[name], list) else []), value(line.strip()[2:])]
        elif ":" in line:
            name, rest = line.split(":", 1)
            name = name.strip()
            out[name] = value(rest) if rest.strip() else None
    return out
