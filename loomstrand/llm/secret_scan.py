"""Secret scans over an incremental blob ledger.

Every version of every path is named by the SHA-256 digest of its text. A
ledger holds, for each digest and rule version, what the rules found in that
blob. A scan looks up which digests of the versions the ledger lacks, reads
one copy of each of those, adds their findings, and joins the ledger back to
all paths. Blobs of one copy are scanned where they are read; of blobs with
several copies one is chosen by grouping on the whole text, which is combined
before it is shuffled.

Findings are spans of code points, end exclusive. Rules are scanned leftmost
first and without overlaps; a match that fails its least length is passed over
whole.

The ledger may hold a blob more than once, from scans that overlapped or an
append that was repeated; what the rules find in a blob is the same each time,
so it is read as one entry.

Defined results: null text is the empty blob; rows that repeat are versions of
their own; an empty table gives no rows; a null id is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import hot_join, sized, text_of


@dataclass(frozen=True)
class Rule:
    """kind; pattern; group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int
    least: int
    flags: int = re.ASCII
    scheme: bool = False  # the finding begins with the URL scheme before the match


#: The rules of the contract, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Rules that find more kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("url_password", r"://[^\s/:@]+:[^\s/:@]+@", 0, 12, scheme=True),
)
RULES = BASE + MORE
RULE_VERSION = 3
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_SPANS = "array<struct<kind:string,first:int,last:int>>"


def scheme_start(text: str, end: int) -> int:
    """Where the URL scheme of two characters and more that ends at ``end`` starts, -1 without one."""
    first, at = -1, end - 1
    while at >= 0 and text[at] in _SCHEME:
        if "a" <= text[at] <= "z":
            first = at
        at -= 1
    return first if first < end - 1 else -1


def spans(text: str, rules: tuple[Rule, ...], compiled: list[re.Pattern] | None = None) -> list[tuple[int, int, int]]:
    """(first, kind's number, last) of all findings, in order."""
    out = []
    for k, (rule, pattern) in enumerate(zip(rules, compiled or [re.compile(r.pattern, r.flags) for r in rules], strict=True)):
        for m in pattern.finditer(text):
            first = scheme_start(text, m.start()) if rule.scheme else m.start()
            least_from = m.start(rule.group) if rule.group else first
            if first >= 0 and m.end(rule.group) - least_from >= rule.least:
                out.append((first, k, m.end()))
    return sorted(out)


def _fast(rule: Rule) -> str:
    """The pattern with the least length inside, where that drops the same matches."""
    return re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if rule.kind == "hex" else rule.pattern


def scanned(rules: tuple[Rule, ...]):
    """Rows (digest, spans) of rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(_fast(r), r.flags) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            found = [[{"kind": rules[k].kind, "first": a, "last": b} for a, k, b in spans(text, rules, compiled)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["digest", "spans"])

    return run


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(text_of(text_col), 256))


class Ledger:
    """Findings by blob and rule version, in tables that are only added to."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES, version: int = RULE_VERSION):
        """path: where the ledger is kept between scans; without one it starts empty."""
        self.spark, self.rules, self.version = spark, rules, version
        self.scratch = Scratch(spark, "secrets")
        self.path = path or self.scratch.path("ledger")

    def known(self) -> DataFrame:
        """(digest, spans) under the present rules, as it was appended."""
        schema = f"digest binary, spans {_SPANS}, rule_version int"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema).drop("rule_version")
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("rule_version") == self.version).drop("rule_version")

    def found(self) -> DataFrame:
        """(digest, spans) of the blobs with findings, each once."""
        return self.known().where(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans"))

    def scan(self, versions: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
        """Scan the blobs of versions that are not in the ledger and add them.

        Returns the blobs (digest, n) of the versions, and how many were scanned.
        """
        blobs = versions.select(digest_of(text_col).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
        blobs = self.scratch.write(blobs, "blobs")
        known = self.known().select("digest")
        unseen = self.scratch.write(blobs.join(known, "digest", "left_anti"), "unseen")
        n = unseen.count()
        if not n:
            return blobs, 0
        texts = versions.select(digest_of(text_col).alias("digest"), text_of(text_col).alias("text"))
        if n < blobs.count():
            texts = texts.join(sized(unseen.select("digest")), "digest", "left_semi")
        copied = sized(unseen.where("n > 1").select("digest"))
        once = texts.join(copied, "digest", "left_anti")
        several = texts.join(copied, "digest", "left_semi").groupBy("digest", "text").agg(F.lit(1).alias("one")).drop("one")
        found = once.unionByName(several).select("digest", "text").mapInArrow(scanned(self.rules), f"digest binary, spans {_SPANS}")
        found.withColumn("rule_version", F.lit(self.version)).write.mode("append").option("compression", "zstd").parquet(self.path)
        return blobs, n


def findings(spark: SparkSession, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """(id, spans) of every version, through the ledger."""
    ledger = ledger or Ledger(spark)
    blobs, _ = ledger.scan(versions, text_col)
    total = blobs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    some = blobs.join(ledger.found(), "digest")
    some = ledger.scratch.write(some, "found")
    rows = versions.select(F.col(id_col), digest_of(text_col).alias("digest"))
    return hot_join(rows, some, ["digest"], "n", total, "left").select(id_col, F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = findings(spark, docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return out.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
