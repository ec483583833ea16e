"""Structured streaming over files of lines: counters, and FASTQ records, FASTA records and WIG values whose state goes on from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """file, value of lines as files arrive."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).format("text").load(folder)
    return raw.select(F.col("_metadata.file_path").alias("file"), "value")


def counts(lines: DataFrame, key: Column, weight: Column | None = None) -> DataFrame:
    """A running counter by key, for update or complete mode."""
    return lines.groupBy(key.alias("key")).agg(F.sum(weight).alias("n") if weight is not None else F.count("*").alias("n"))


def windowed(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` fall outside."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def fastq_records(lines: DataFrame, source: str, order: str) -> DataFrame:
    """name, sequence, qualities of records whose four lines may come in different micro-batches; ``source`` keys the state, ``order`` sorts a batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order)
        held += rows["value"].tolist()
        whole = len(held) // 4 * 4
        out = [(key[0], held[i][1:], held[i + 1], held[i + 3], None if held[i].startswith("@") and held[i + 2].startswith("+") and len(held[i + 1]) == len(held[i + 3]) else "malformed") for i in range(0, whole, 4)]
        state.update((held[whole:],))
        yield pd.DataFrame(out, columns=["source", "name", "sequence", "qualities", "error"])

    return lines.groupBy(source).applyInPandasWithState(step, "source string, name string, sequence string, qualities string, error string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def fasta_records(lines: DataFrame, source: str, order: str) -> DataFrame:
    """source, description, sequence of every record that a later one follows, and of the last once a line ``>`` alone ends it; lines may come in different micro-batches."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, held = state.get if state.exists else (None, [])
        held, out = list(held), []
        for v in pd.concat(list(parts)).sort_values(order)["value"]:
            if v.startswith(">"):
                if head is not None:
                    out.append((key[0], head, "".join(held)))
                head, held = v[1:] or None, []
            elif head is not None and v.strip() and v[0] not in ";#":
                held.append(v.rstrip())
        state.update((head, held))
        yield pd.DataFrame(out, columns=["source", "description", "sequence"])

    return lines.groupBy(source).applyInPandasWithState(step, "source string, description string, sequence string", "head string, held array<string>", "append", GroupStateTimeout.NoTimeout)


def wig_values(items: DataFrame, source: str, order: str) -> DataFrame:
    """source, chrom, lo, hi (closed), val of every value of WIG items (see ``codecs.wig``); the declaration in force goes on across micro-batches."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, chrom, at, by, span = state.get if state.exists else (None, None, 0, 0, 1)
        out = []
        for r in pd.concat(list(parts)).sort_values(order).itertuples():
            if r.kind in ("fixed", "variable"):
                whole = lambda x, none: none if pd.isna(x) else int(x)
                kind, chrom, at, by, span = r.kind, r.chrom, whole(r.start, 0), whole(r.step, 0), whole(r.span, 1)
            elif r.kind == "bed_graph":
                out.append((key[0], r.chrom, int(r.lo), int(r.hi), float(r.val), None))
            elif r.kind in ("fixed_value", "variable_value"):
                if r.kind != f"{kind}_value":
                    out.append((key[0], None, None, None, None, f"not_in_{r.kind.removesuffix('_value')}_step_state"))
                    continue
                lo = at if kind == "fixed" else int(r.lo)
                at += by
                out.append((key[0], chrom, lo, lo + span - 1, float(r.val), None))
        state.update((kind, chrom, at, by, span))
        frame = pd.DataFrame(out, columns=["source", "chrom", "lo", "hi", "val", "error"])
        yield frame.astype({"lo": "Int64", "hi": "Int64"})

    good = items.where("error IS NULL AND kind <> 'comment'")
    return good.groupBy(source).applyInPandasWithState(step, "source string, chrom string, lo bigint, hi bigint, val double, error string", "kind string, chrom string, at bigint, by bigint, span bigint", "append", GroupStateTimeout.NoTimeout)
