"""Assigning reads to libraries by barcodes with mismatches, combined by and, or and not."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Barcode:
    """A barcode at a 1-based position of a read column, with a mismatch budget."""

    read: str
    barcode: str
    position: int = 1
    mismatch: int = 0

    def missed(self) -> Column:
        """Mismatches; a read too short for the barcode can't match (null)."""
        s = F.col(self.read)
        n = sum((F.when(F.substring(s, self.position + i, 1) != c, 1).otherwise(0) for i, c in enumerate(self.barcode)), F.lit(0))
        return F.when(F.length(s) >= self.position - 1 + len(self.barcode), n)

    def matches(self) -> Column:
        return F.coalesce(self.missed() <= self.mismatch, F.lit(False))

    def worst(self) -> Column:
        return F.when(self.matches(), self.missed()).otherwise(0)


@dataclass(frozen=True)
class Rule:
    """``and``, ``or`` or ``not`` of barcodes and rules."""

    kind: str
    parts: tuple = field(default=())

    def matches(self) -> Column:
        ms = [p.matches() for p in self.parts]
        out = ms[0]
        for m in ms[1:]:
            out = out & m if self.kind == "and" else out | m
        return ~out if self.kind == "not" else out

    def worst(self) -> Column:
        ws = [p.worst() for p in self.parts]
        return F.greatest(*ws) if len(ws) > 1 else ws[0]


def demultiplex(df: DataFrame, libraries: dict[str, Barcode | Rule], policy: str = "exclusive", undetermined: str = "undetermined") -> DataFrame:
    """The rows with ``library`` and ``mismatches`` (the most of any barcode that matched), once for each library they go to.

    A read that matches one library goes there, one that matches none to ``undetermined``. One that matches several goes to all of them under
    policy ``inclusive``, to ``undetermined`` under ``exclusive``.
    """
    if policy not in ("inclusive", "exclusive"):
        raise ValueError(policy)
    hits = F.array_compact(F.array(*(F.when(r.matches(), F.struct(F.lit(n).alias("library"), r.worst().alias("mismatches"))) for n, r in libraries.items())))
    other = F.array(F.struct(F.lit(undetermined).alias("library"), F.lit(0).alias("mismatches")))
    some = F.size(hits) == 1 if policy == "exclusive" else F.size(hits) >= 1
    return df.withColumn("__hits", hits).select("*", F.inline(F.when(some if policy == "inclusive" else F.size("__hits") == 1, F.col("__hits")).otherwise(other))).drop("__hits")


def statistics(assigned: DataFrame) -> DataFrame:
    """library, read_count, no_mismatch_read_count."""
    return assigned.groupBy("library").agg(F.count("*").alias("read_count"), F.count_if(F.col("mismatches") == 0).alias("no_mismatch_read_count"))
