"""VCF 4.1: types come from each file's own header, merged with reserved defaults; values stay strings with their type and a typed reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import written
from spanloom.sources.codecs import failures, integer, number

#: Headers are broadcast up to so many measured bytes; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

# Types of reserved INFO and FORMAT keys, and reserved ALT ids.
RESERVED_INFO = {
    "integer": "AC AN DP MQ0 NS END CIPOS CIEND HOMLEN CILEN CN CNADJ CICN CICNADJ", "float": "AF BQ MQ", "flag": "DB H2 SOMATIC VALIDATED IMPRECISE NOVEL",
    "string": "AA CIGAR SB SVTYPE HOMSEQ BKPTID MEINFO METRANS DGVID DBVARID MATEID PARID EVENT",
}
RESERVED_FORMAT = {"integer": "DP CN NQ HAP AHAP", "float": "GL GQ HQ CNQ CNL", "string": "GT FT"}
RESERVED_ALT = ("DEL", "INS", "DUP", "INV", "CNV", "DUP:TANDEM", "DEL:ME", "INS:ME")


def _reserved(table: dict[str, str]) -> Column:
    return F.create_map(*(x for kind, keys in table.items() for k in keys.split() for x in (F.lit(k), F.struct(F.lit(kind).alias("type"), F.lit(".").alias("number")))))


def header(df: DataFrame) -> DataFrame:
    """One row a file: version, columns, and maps of declared INFO, FORMAT, FILTER and ALT (key -> struct<type, number>)."""
    v = F.col("value")
    attr = lambda k: F.regexp_extract(v, rf"[<,]{k}=([^,>]+)", 1)
    rows = df.where("startswith(value, '#')").select("file", v.alias("value"), F.regexp_extract(v, "^##([A-Za-z]+)=<", 1).alias("part"), attr("ID").alias("id"), F.struct(F.lower(attr("Type")).alias("type"), attr("Number").alias("number")).alias("t"))
    pick = lambda p: F.map_from_entries(F.collect_list(F.when((F.col("part") == p) & (F.col("id") != ""), F.struct("id", "t"))))
    last = rows.dropDuplicates(["file", "part", "id", "value"])
    return last.groupBy("file").agg(
        F.max(F.when(v.startswith("##fileformat="), F.substr(v, F.lit(14)))).alias("version"), F.split(F.max(F.when(v.startswith("#CHROM"), F.substr(v, F.lit(2)))), "\t").alias("columns"),
        pick("INFO").alias("info"), pick("FORMAT").alias("format"), pick("FILTER").alias("filter"), pick("ALT").alias("alt"),
    )


def _typed(types: Column, items: Column) -> Column:
    """array<struct<key, type, values<struct<s, i, f>>, ok>> of struct<key, raw>; ``.`` is a missing value.

    A step for each of type, values and verdict, so that what a step makes is looked up or read once an item.
    """
    known = F.transform(items, lambda x: F.struct(x["key"].alias("key"), types[x["key"]].alias("t"), F.split(x["raw"], ",", -1).alias("raw")))

    def valued(x: Column) -> Column:
        kind = x["t"]["type"]
        vals = F.transform(x["raw"], lambda s: F.struct(F.when(s != ".", s).alias("s"), F.when(kind == "integer", integer(s)).alias("i"), F.when(kind == "float", number(s)).alias("f")))
        return F.struct(x["key"].alias("key"), x["t"].alias("t"), vals.alias("values"))

    def judged(x: Column) -> Column:
        kind, number_of, vals = x["t"]["type"], x["t"]["number"], x["values"]
        flag = kind == "flag"
        fits = F.forall(vals, lambda v: v["s"].isNull() | F.when(kind == "integer", v["i"].isNotNull()).when(kind == "float", v["f"].isNotNull()).when(kind == "character", F.length(v["s"]) == 1).otherwise(True))
        arity = flag | ~number_of.rlike("^[0-9]+$") | (F.size(vals) == number_of.try_cast("int"))
        return F.struct(x["key"].alias("key"), kind.alias("type"), F.when(flag, F.slice(vals, 1, 0)).otherwise(vals).alias("values"), F.coalesce(kind.isNotNull() & (flag | fits) & arity, F.lit(False)).alias("ok"))

    return F.transform(F.transform(known, valued), judged)


def rows(df: DataFrame, lenient: bool = True) -> DataFrame:
    """chrom, pos, ids, ref, alts, qual, filters, info, samples (name -> keyed values), error of every record.

    Unknown INFO or FORMAT keys, undeclared filters or symbolic alleles, wrong types and wrong counts are errors. ``lenient``: a lone dot as filter is none.
    """
    empty = F.create_map().cast("map<string,struct<type:string,number:string>>")
    merged = lambda name, table: F.map_zip_with(F.coalesce(F.col(name), empty), _reserved(table), lambda k, a, b: F.coalesce(a, b))
    # types are merged once a file: an optimiser that moves a filter on errors would merge them anew for each value
    head = written(header(df).select(F.col("file").alias("__file"), "columns", "filter", "alt", merged("info", RESERVED_INFO).alias("__i"), merged("format", RESERVED_FORMAT).alias("__t")), "headers")
    size = head.agg(F.sum(sum((F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) for c in ("columns", "filter", "alt", "__i", "__t")), F.lit(64)))).first()[0] or 0
    c = lambda i: F.get("__f", F.lit(i))
    f = df.where("value <> '' AND NOT startswith(value, '#')").withColumn("__f", F.split("value", "\t", -1)).join(F.broadcast(head) if size <= BROADCAST_BYTES else head, F.col("file") == F.col("__file"), "left")
    # of a file without a header nothing is declared
    declared = lambda name: F.coalesce(F.col(name), empty)
    types = lambda name, table: F.coalesce(F.col(name), _reserved(table))
    pos, qual = integer(c(1)), number(c(5))
    list_of = lambda x, sep: F.when(x == ".", F.array().cast("array<string>")).otherwise(F.split(x, sep))
    alts, ids = list_of(c(4), ","), list_of(c(2), ";")
    filters = F.when((c(6) == "PASS") | (F.lit(lenient) & (c(6) == ".")), F.array().cast("array<string>")).otherwise(F.split(c(6), ";"))
    info = _typed(types("__i", RESERVED_INFO), F.transform(F.filter(F.split(c(7), ";"), lambda x: ~x.isin("", ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=?", "").alias("raw"))))
    keys = F.split(c(8), ":")
    names = F.slice("columns", 10, F.greatest(F.size("columns") - 9, F.lit(0)))
    cells = F.slice("__f", 10, F.greatest(F.size("__f") - 9, F.lit(0)))
    sample = lambda x: _typed(types("__t", RESERVED_FORMAT), F.transform(F.arrays_zip(keys.alias("k"), F.split(x, ":", -1).alias("v")), lambda kv: F.struct(kv["k"].alias("key"), F.coalesce(kv["v"], F.lit(".")).alias("raw"))))
    samples = F.transform(cells, sample)
    dna = lambda x: x.rlike("^[ACGTNacgtn]+$")
    tests = [
        ("row_length", F.size("__f") == F.size("columns")), ("pos", pos.isNotNull()), ("ref", dna(c(3))), ("alt", F.forall(alts, lambda a: dna(a) | F.when(a.rlike("^<.+>$"), F.map_contains_key(declared("alt"), F.substring(a, 2, F.length(a) - 2)) | F.substring(a, 2, F.length(a) - 2).isin(*RESERVED_ALT)).otherwise(False))),
        ("info", F.forall(info, lambda x: x["ok"])), ("filter", F.forall(filters, lambda x: F.map_contains_key(declared("filter"), x))), ("samples", F.forall(samples, lambda s: F.forall(s, lambda x: x["ok"]))),
    ]
    strip = lambda xs: F.transform(xs, lambda x: F.struct(x["key"].alias("key"), x["type"].alias("type"), x["values"].alias("values")))
    return f.select("file", "line_no", c(0).alias("chrom"), pos.alias("pos"), ids.alias("ids"), F.upper(c(3)).alias("ref"), alts.alias("alts"), qual.alias("qual"), filters.alias("filters"), strip(info).alias("info"),
                    F.arrays_zip(names.alias("name"), F.transform(samples, strip).alias("values")).alias("samples"), failures(*tests).alias("error"))
