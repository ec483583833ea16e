"""Codecs of the text formats: a table of lines (file, line_no, value) to typed rows with an ``error`` column, and rows to lines.

``error`` is null in a valid row and names the first fault otherwise; values of a faulty row that can be read stay. Mode ``failfast`` raises instead, ``strict_prefix``
keeps the rows before a file's first fault. Nothing is shifted: coordinates stay as they stand unless ``zero_based`` says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.sequence import CIGAR, IUPAC, cigar, cigar_text, percent_encoded, phred_char, qualities
from spanloom.operators.ordered import carried, prefix_sums
from spanloom.operators.packed import percent_decoded
from spanloom.operators.streams import demanded


def integer(c: Column) -> Column:
    """Decimal integers that a BIGINT holds; null otherwise."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def number(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf(inity)?|nan|NaN)$"), c.try_cast("double"))


def failures(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that doesn't hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(tests):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def with_mode(df: DataFrame, mode: str = "permissive") -> DataFrame:
    if mode == "failfast":
        return df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error"))).cast("string")))
    if mode == "strict_prefix":
        first = df.where("error IS NOT NULL").groupBy("file").agg(F.min("line_no").alias("__stop"))
        return df.join(first, "file", "left").where("__stop IS NULL OR line_no < __stop").drop("__stop")
    if mode != "permissive":
        raise ValueError(mode)
    return df


def _split(df: DataFrame, pattern: str = "\t") -> DataFrame:
    return df.withColumn("__f", F.split("value", pattern, -1))


def _f(i: int) -> Column:
    return F.get(F.col("__f"), F.lit(i))


def _N() -> Column:  # noqa: N802
    return F.size("__f")


def bed(df: DataFrame, columns: int = 5, validated: bool = True) -> DataFrame:
    """BED: chrom, chrom_start, chrom_end, then (5 columns) name and score, and others. ``validated``: positions not negative, score 0 to 1000."""
    f = _split(df)
    start, end, score = integer(_f(1)), integer(_f(2)), integer(_f(4)).cast("int")
    tests = [("column_count", _N() >= columns), ("chrom_start", start >= 0 if validated else start.isNotNull()), ("chrom_end", end >= 0 if validated else end.isNotNull())]
    named = []
    if columns == 5:
        tests.append(("score", score.between(0, 1000) if validated else score.isNotNull()))
        named = [_f(3).alias("name"), score.alias("score")]
    rest = F.when(_N() > columns, F.slice("__f", columns + 1, F.greatest(_N() - columns, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return f.select("file", "line_no", _f(0).alias("chrom"), start.alias("chrom_start"), end.alias("chrom_end"), *named, rest.alias("others"), failures(*tests).alias("error"))


def bed_line() -> Column:
    return F.concat_ws("\t", "chrom", F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), "name", F.col("score").cast("string"), "others")


def bed_typed(df: DataFrame, kinds: list[str]) -> DataFrame:
    """BED with declared further columns: chrom, chrom_start, chrom_end, c0, c1, ... of the kinds int, float or string."""
    f = _split(df)
    start, end = integer(_f(1)), integer(_f(2))
    cells = [_TYPES[k](_f(i + 3)) for i, k in enumerate(kinds)]
    tests = [("column_count", _N() == len(kinds) + 3), ("chrom_start", start.isNotNull()), ("chrom_end", end.isNotNull()), *((f"c{i}", c.isNotNull()) for i, c in enumerate(cells))]
    return f.select("file", "line_no", _f(0).alias("chrom"), start.alias("chrom_start"), end.alias("chrom_end"), *(c.alias(f"c{i}") for i, c in enumerate(cells)), failures(*tests).alias("error"))


_TYPES = {"int": integer, "float": number, "string": lambda c: c}


def typed_rows(df: DataFrame, kinds: list[str], separators: str = " \t", strict: bool = True) -> DataFrame:
    """Cells c0, c1, ... of the declared kinds (int, float, string); runs of separators part cells. ``strict``: no cells beyond them."""
    f = df.withColumn("__f", F.filter(F.split("value", f"[{separators}]"), lambda x: x != ""))
    cells = [_TYPES[k](_f(i)) for i, k in enumerate(kinds)]
    tests = [("column_count", _N() == len(kinds) if strict else _N() >= len(kinds)), *((f"c{i}", c.isNotNull()) for i, c in enumerate(cells))]
    return f.select("file", "line_no", *(c.alias(f"c{i}") for i, c in enumerate(cells)), failures(*tests).alias("error"))


def gff3_attributes(x: Column) -> Column:
    """array<struct<key, values>> of ``k=v,v;k=v``, percent escapes decoded; null where a tag has no value."""
    parts = F.filter(F.split(x, ";"), lambda p: F.trim(p) != "")
    out = F.transform(parts, lambda p: F.struct(percent_decoded(F.trim(F.substring_index(p, "=", 1))).alias("key"), F.transform(F.split(F.regexp_replace(p, "^[^=]*=", ""), ",", -1), percent_decoded).alias("values")))
    return F.when(F.forall(parts, lambda p: F.contains(p, F.lit("="))), out)


def gtf_attributes(x: Column) -> Column:
    """array<struct<key, values>> of ``key "value";`` lists; null where a token is out of place."""
    token = r'\s*([^\s";]+)\s+("([^"]*)"|[^\s";]+)\s*'
    parts = F.regexp_extract_all(x, F.lit(token), 0)
    out = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, token, 1).alias("key"), F.array(F.regexp_replace(F.regexp_extract(p, token, 2), '^"|"$', "")).alias("values")))
    return F.when(x.rlike(rf"^({token};)*({token};?)?\s*$"), out)


def gff(df: DataFrame, version: int = 3) -> DataFrame:
    """GFF3 (or GTF, version 2): nine fields, a lone dot is null; comments and blank lines are left out.

    The first three fields are percent-decoded in version 3 and may stand in double quotes (a backslash before a quote) in version 2.
    """
    f = _split(df.where("value <> '' AND NOT startswith(value, '#')"))
    bare = percent_decoded if version == 3 else (lambda c: F.when(c.rlike(r'^"(?:[^"\\]|\\.)*"$'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), r"\\(.)", "$1")).otherwise(c))
    dot = lambda c: F.when(c != ".", bare(c))
    lo, hi, score, phase = integer(_f(3)), integer(_f(4)), number(_f(5)), integer(_f(7)).cast("int")
    attrs = gff3_attributes(_f(8)) if version == 3 else gtf_attributes(_f(8))
    tests = [("column_count", _N() == 9), ("start_pos", lo.isNotNull()), ("stop_pos", hi.isNotNull()), ("phase", (_f(7) == ".") | phase.isNotNull()), ("score", (_f(5) == ".") | score.isNotNull()), ("strand", _f(6).isin("+", "-", ".", "?")), ("attributes", attrs.isNotNull())]
    return f.select("file", "line_no", bare(_f(0)).alias("seqname"), dot(_f(1)).alias("source"), dot(_f(2)).alias("feature"), lo.alias("lo"), hi.alias("hi"), score.alias("score"), _f(6).alias("strand"), phase.alias("phase"), attrs.alias("attributes"), failures(*tests).alias("error"))


def gff_line(version: int = 3) -> Column:
    """A line of version 3 (percent-encoded) or 2 (quoted)."""
    esc = percent_encoded if version == 3 else (lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')))
    dot = lambda c: F.coalesce(c, F.lit("."))
    pair = (lambda a: F.concat(esc(a["key"]), F.lit("="), F.array_join(F.transform(a["values"], esc), ","))) if version == 3 else (lambda a: F.concat(a["key"], F.lit(" "), F.array_join(F.transform(a["values"], esc), ",")))
    return F.concat_ws("\t", esc(F.col("seqname")), dot(esc(F.col("source"))), dot(esc(F.col("feature"))), F.col("lo").cast("string"), F.col("hi").cast("string"), dot(F.col("score").cast("string")), "strand", dot(F.col("phase").cast("string")), F.array_join(F.transform("attributes", pair), ";"))


def macs2_xls(df: DataFrame) -> DataFrame:
    """MACS2 peaks; comments, blank lines and the header are left out."""
    f = _split(df.where("value <> '' AND NOT startswith(value, '#') AND NOT startswith(value, 'chr\tstart\tend')"))
    ints = {n: integer(_f(i)) for n, i in (("peak_start", 1), ("peak_end", 2), ("peak_length", 3), ("abs_summit", 4))}
    nums = {n: number(_f(i)) for n, i in (("pileup", 5), ("log10pvalue", 6), ("fold_enrichment", 7), ("log10qvalue", 8))}
    tests = [("column_count", _N() == 10), *((n, c.isNotNull()) for n, c in {**ints, **nums}.items())]
    return f.select("file", "line_no", _f(0).alias("chr"), *(c.alias(n) for n, c in {**ints, **nums}.items()), _f(9).alias("peak_name"), failures(*tests).alias("error"))


def broad_peaks(df: DataFrame) -> DataFrame:
    f = _split(df.where("value <> ''"))
    vals = {"chr_start": integer(_f(1)), "chr_end": integer(_f(2)), "score": integer(_f(4)).cast("int"), "fold_change": number(_f(6)), "log10pvalue": number(_f(7)), "log10qvalue": number(_f(8))}
    tests = [("column_count", _N() == 9), *((n, c.isNotNull()) for n, c in vals.items())]
    return f.select("file", "line_no", _f(0).alias("chr"), _f(3).alias("peak_name"), _f(5).alias("strand"), *(c.alias(n) for n, c in vals.items()), failures(*tests).alias("error"))


def sgr(df: DataFrame, increment: int = 0) -> DataFrame:
    """chrom, pos, value; tabs, or blanks where there are none."""
    f = df.withColumn("__f", F.when(F.size(F.split("value", "\t")) == 3, F.split("value", "\t")).otherwise(F.split("value", " ")))
    pos, v = integer(_f(1)) + increment, number(_f(2))
    return f.select("file", "line_no", _f(0).alias("chrom"), pos.alias("pos"), v.alias("val"), failures(("column_count", _N() == 3), ("pos", pos.isNotNull()), ("val", v.isNotNull())).alias("error"))


def bpmap(df: DataFrame) -> DataFrame:
    """Probes: two coordinates, ``organism:version;chromosome``, position and sequence; the header is left out."""
    f = _split(df.where("NOT startswith(value, 'PMX\t')"))
    ints = {n: integer(_f(i)) for n, i in (("pm_x", 0), ("pm_y", 1), ("mm_x", 2), ("mm_y", 3), ("start", 5))}
    at = _f(4)
    tests = [("column_count", _N() == 7), ("seq", at.rlike("^[^:;]*:[^:;]*;[^:;]*$")), *((n, c.isNotNull()) for n, c in ints.items()), ("probe", F.upper(_f(6)).rlike(f"^[{IUPAC}]*$"))]
    return f.select("file", "line_no", *(c.alias(n) for n, c in ints.items()), F.substring_index(at, ":", 1).alias("org"), F.regexp_extract(at, ":([^;]*);", 1).alias("version"), F.substring_index(at, ";", -1).alias("chrom"), F.upper(_f(6)).alias("sequence"), failures(*tests).alias("error"))


PSL = ("matches", "mismatches", "rep_matches", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert", "strands", "q_name", "q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "block_count", "block_sizes", "q_starts", "t_starts")


def psl(df: DataFrame) -> DataFrame:
    """BLAT alignments of 21 columns; header lines (which don't begin with a digit) are left out."""
    f = _split(df.where(F.col("value").rlike(r"^\s*\d")))
    cols, tests = {}, [("column_count", _N() == 21)]
    for i, n in enumerate(PSL):
        c = F.trim(_f(i))
        if n == "strands":
            cols["q_strand"], cols["t_strand"] = F.substring(c, 1, 1), F.when(F.length(c) == 2, F.substring(c, 2, 1))
            tests.append((n, c.rlike("^[+-]{1,2}$")))
        elif n in ("q_name", "t_name"):
            cols[n] = c
        elif n in ("block_sizes", "q_starts", "t_starts"):
            bare = F.regexp_replace(c, "^,+|,+$", "")
            cols[n] = F.transform(F.split(bare, ","), lambda x: integer(F.trim(x)).cast("int"))
            tests.append((n, F.forall(cols[n], lambda x: x.isNotNull())))
        else:
            cols[n] = integer(c)
            tests.append((n, cols[n].isNotNull()))
    return f.select("file", "line_no", *(c.alias(n) for n, c in cols.items()), failures(*tests).alias("error"))


OPTIONAL = {"A": "^[!-~]$", "i": r"^-?[0-9]{1,19}$", "f": r"^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$", "Z": "^[ !-~]+$", "H": "^[0-9A-F]+$", "B": r"^[cCsSiIf](,[-+0-9.eE]+)*$"}


def sam(df: DataFrame) -> DataFrame:
    """Alignments of SAM lines; header lines (``@``) are left out. ``*``, 0 and 255 in their fields are null."""
    f = _split(df.where("NOT startswith(value, '@')"))
    star = lambda c: F.when(c != "*", c)
    # fields that several tests and columns use are read once, in a projection of their own
    tags = F.transform(F.slice("__f", 12, F.greatest(_N() - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1).alias("type"), F.substr(t, F.lit(6)).alias("value")))
    f = f.withColumns({**{f"__i{i}": integer(_f(i)) for i in (1, 3, 4, 7, 8)}, "__tags": F.filter(tags, lambda t: t["tag"] != "")})
    num = lambda i, lo, hi: F.when(F.col(f"__i{i}").between(lo, hi), F.col(f"__i{i}").cast("int"))
    flag, pos, mapq, pnext, tlen = num(1, 0, 65535), num(3, 0, 2147483647), num(4, 0, 255), num(7, 0, 2147483647), num(8, -2147483647, 2147483647)
    ops, tags = cigar(_f(5)), F.col("__tags")
    tag = "^(?:|[A-Za-z][A-Za-z0-9]:(?:" + "|".join(f"{k}:{p[1:-1]}" for k, p in OPTIONAL.items()) + "))$"
    tests = [
        ("column_count", _N() >= 11), ("qname", _f(0).rlike(r"^(\*|[!-?A-~]{1,255})$")), ("flag", flag.isNotNull()), ("rname", _f(2).rlike(r"^(\*|[!-()+-<>-~][!-~]*)$")), ("pos", pos.isNotNull()), ("mapq", mapq.isNotNull()),
        ("cigar", _f(5).rlike(CIGAR)), ("rnext", _f(6).rlike(r"^(\*|=|[!-()+-<>-~][!-~]*)$")), ("pnext", pnext.isNotNull()), ("tlen", tlen.isNotNull()), ("seq", _f(9).rlike(r"^(\*|[A-Za-z=.]+)$")),
        ("qual", (_f(10) == "*") | (_f(10).rlike("^[!-~]+$") & ((_f(9) == "*") | (F.length(_f(9)) == F.length(_f(10)))))), ("tags", F.forall(F.slice("__f", 12, F.greatest(_N() - 11, F.lit(0))), lambda t: t.rlike(tag))),
    ]
    return f.select(
        "file", "line_no", star(_f(0)).alias("qname"), flag.alias("flag"), star(_f(2)).alias("rname"), F.when(pos > 0, pos).alias("pos"), F.when(mapq < 255, mapq).alias("mapq"), ops.alias("cigar"),
        F.when(_f(6) == "=", star(_f(2))).otherwise(star(_f(6))).alias("rnext"), F.when(pnext > 0, pnext).alias("pnext"), F.when(tlen != 0, tlen).alias("tlen"), star(_f(9)).alias("seq"),
        F.when(_f(10) != "*", qualities(_f(10))).alias("qual"), tags.alias("tags"), failures(*tests).alias("error"),
    )


def _any(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out | x
    return out


def sam_header(df: DataFrame) -> DataFrame:
    """Header lines: record type and its tags as a map."""
    f = _split(df.where("startswith(value, '@')"))
    return f.select("file", "line_no", F.substring(_f(0), 2, 2).alias("record"), F.map_from_entries(F.transform(F.filter(F.slice("__f", 2, F.greatest(_N() - 1, F.lit(1))), lambda t: F.substring(t, 3, 1) == ":"), lambda t: F.struct(F.substring(t, 1, 2), F.substr(t, F.lit(4))))).alias("tags"))


# Tags that a header record must have, and the values of a file's sort and group orders.
HEADER_TAGS = {"HD": ("VN",), "SQ": ("SN", "LN"), "RG": ("ID",), "PG": ("ID",), "CO": ()}
SORT_ORDERS, GROUP_ORDERS = ("unknown", "unsorted", "queryname", "coordinate"), ("none", "query", "reference")


def sam_header_checked(df: DataFrame) -> DataFrame:
    """Header lines typed and checked: file, line_no, record, name (SN of @SQ, ID of @RG and @PG), length, version, sort_order, group_order, text (of @CO), tags, error.

    Faults: an unknown record, a tag that isn't two letters and a colon or comes twice, a missing mandatory tag, a version, length or order out of form, a
    second @HD or one that isn't the first line, a name used before in its file.
    """
    f = _split(df.where("startswith(value, '@')"))
    record = F.substr(_f(0), F.lit(2))
    body = F.when(record != "CO", F.slice("__f", 2, F.greatest(_N() - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    names = F.transform(body, lambda t: F.substring(t, 1, 2))
    sound = F.forall(body, lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[ -~]+$")) & (F.size(F.array_distinct(names)) == F.size(names))
    pairs = F.when(sound, F.map_from_entries(F.transform(body, lambda t: F.struct(F.substring(t, 1, 2), F.substr(t, F.lit(4))))))
    f = f.select("file", "line_no", record.alias("record"), pairs.alias("tags"), F.when(record == "CO", F.substr("value", F.lit(5))).alias("text"))
    tag = lambda k: F.col("tags")[k]
    r = F.col("record")
    must = _any([(r == k) & F.forall(F.array(*map(F.lit, tags)).cast("array<string>"), lambda t: F.array_contains(F.map_keys("tags"), t)) for k, tags in HEADER_TAGS.items()])
    name, length = F.when(r == "SQ", tag("SN")).when(r.isin("RG", "PG"), tag("ID")), F.when(r == "SQ", integer(tag("LN")))
    f = f.withColumns({"name": name, "length": length})
    # headers are as long as there are references and read groups
    w = Window.partitionBy("file", "record", "name").orderBy("line_no")
    first = Window.partitionBy("file")
    f = f.withColumns({"__nth": F.row_number().over(w), "__first": F.min("line_no").over(first)})
    tests = [
        ("record", r.isin(*HEADER_TAGS)), ("tags", F.col("tags").isNotNull()), ("missing_tag", must), ("version", (r != "HD") | tag("VN").rlike(r"^[0-9]+\.[0-9]+$")), ("sort_order", (r != "HD") | tag("SO").isNull() | tag("SO").isin(*SORT_ORDERS)),
        ("group_order", (r != "HD") | tag("GO").isNull() | tag("GO").isin(*GROUP_ORDERS)), ("header_first", (r != "HD") | (F.col("line_no") == F.col("__first"))), ("length", (r != "SQ") | F.col("length").between(1, 2147483647)),
        ("reference_name", (r != "SQ") | tag("SN").rlike(r"^[!-)+-<>-~][!-~]*$")), ("duplicate", ~r.isin("SQ", "RG", "PG") | (F.col("__nth") == 1)),
    ]
    out = failures(*tests)
    return f.select("file", "line_no", "record", "name", "length", *(F.when(r == "HD", tag(k)).alias(n) for k, n in (("VN", "version"), ("SO", "sort_order"), ("GO", "group_order"))), "text", "tags", out.alias("error"))


def sam_header_line() -> Column:
    """A line of each record of :func:`sam_header_checked`: mandatory tags first, the others by name."""
    r, tags = F.col("record"), F.col("tags")
    first = F.when(r == "HD", F.array(F.lit("VN"))).when(r == "SQ", F.array(F.lit("SN"), F.lit("LN"))).when(r.isin("RG", "PG"), F.array(F.lit("ID"))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(first, F.array_sort(F.array_except(F.map_keys(tags), first)))
    return F.when(r == "CO", F.concat(F.lit("@CO\t"), F.col("text"))).otherwise(F.concat_ws("\t", F.concat(F.lit("@"), r), F.transform(keys, lambda k: F.concat(k, F.lit(":"), tags[k]))))


def sam_line() -> Column:
    """A line of each alignment of :func:`sam`; nulls become ``*``, 0 or 255."""
    text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    same = F.when(F.col("rnext") == F.col("rname"), "=").otherwise(text("rnext", "*"))
    ops = F.when(F.size("cigar") > 0, cigar_text(F.col("cigar"))).otherwise("*")
    qual = F.coalesce(F.array_join(F.transform("qual", lambda q: phred_char(q)), ""), F.lit("*"))
    tags = F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"]))
    return F.concat_ws("\t", text("qname", "*"), text("flag", "0"), text("rname", "*"), text("pos", "0"), text("mapq", "255"), ops, same, text("pnext", "0"), text("tlen", "0"), text("seq", "*"), qual, tags)


def unknown_references(alignments: DataFrame, header: DataFrame) -> DataFrame:
    """Alignments whose reference isn't declared in their file's @SQ lines."""
    known = header.where("record = 'SQ'").select("file", F.col("tags")["SN"].alias("rname"))
    return alignments.where("rname IS NOT NULL").join(known, ["file", "rname"], "left_anti")


# --- formats with state: a line's state is the last declaration before it ---


def _counted(df: DataFrame, **marks: Column) -> DataFrame:
    """Adds for each mark the number of marked lines of all files up to and including this one, in order of (file, line_no)."""
    rows = df.select("*", *(F.when(c, 1).otherwise(0).cast("bigint").alias(n) for n, c in marks.items()))
    return prefix_sums(rows, ["file", "line_no"], list(marks))


def wig(df: DataFrame, comments: bool = True) -> DataFrame:
    """Items of WIG lines: kind (comment, variable, fixed, variable_value, fixed_value, bed_graph), chrom, start, step, span, lo, hi, value. Empty lines are skipped."""
    v = F.col("value")
    f = df.where("value <> ''").withColumn("__f", F.filter(F.split("value", r"[ \t\r]+"), lambda x: x != ""))
    key = lambda k: F.regexp_extract(v, rf"(?:^|[ \t]){k}=([^ \t\r=]+)(?=[ \t\r]|$)", 1)
    decl = v.startswith("fixedStep") | v.startswith("variableStep")
    kind = F.when(F.lit(comments) & v.startswith("#"), "comment").when(v.startswith("fixedStep"), "fixed").when(v.startswith("variableStep"), "variable").when(_N() == 1, "fixed_value").when(_N() == 2, "variable_value").when(_N() == 4, "bed_graph")
    f = f.withColumn("kind", kind)
    k = F.col("kind")
    last = number(F.element_at("__f", -1))
    chrom = F.when(decl, F.when(key("chrom") != "", key("chrom"))).when(k == "bed_graph", _f(0))
    lo = F.when(k == "bed_graph", integer(_f(1))).when(k == "variable_value", integer(_f(0)))
    hi = F.when(k == "bed_graph", integer(_f(2)))
    start, step, span = (F.when(decl, integer(key(n))) for n in ("start", "step", "span"))
    value = k.isin("fixed_value", "variable_value", "bed_graph")
    tests = [("unrecognizable_line", k.isNotNull()), ("key_values", ~decl | F.forall(F.slice("__f", 2, F.greatest(_N() - 1, F.lit(1))), lambda t: F.size(F.split(t, "=")) == 2)), ("chrom", ~decl | chrom.isNotNull()), ("start", (k != "fixed") | start.isNotNull()), ("step", (k != "fixed") | step.isNotNull()),
             ("span", ~decl | (key("span") == "") | span.isNotNull()), ("position", ~k.isin("variable_value", "bed_graph") | lo.isNotNull()), ("end", (k != "bed_graph") | hi.isNotNull()), ("value", ~value | last.isNotNull())]
    return f.select("file", "line_no", "kind", chrom.alias("chrom"), start.alias("start"), step.alias("step"), span.alias("span"), lo.alias("lo"), hi.alias("hi"), F.when(value, last).alias("val"), failures(*tests).alias("error"))


def wig_bed_graph(items: DataFrame, zero_based: bool = False) -> DataFrame:
    """file, line_no, chrom, lo, hi (closed), val, error of every value, by the declaration in force. Faulty items keep their error."""
    decl = F.col("kind").isin("fixed", "variable") & F.col("error").isNull()
    # null kinds are no declarations
    decl = F.coalesce(decl, F.lit(False))
    counts = F.coalesce((F.col("kind") == "fixed_value") & F.col("error").isNull(), F.lit(False))
    # a file starts without a declaration: that of another file doesn't hold
    both = carried(items.where("kind IS NULL OR kind <> 'comment'"), ["file", "line_no"], decl, F.struct("kind", "chrom", "start", "step", "span"), ["file"], counts).where(~decl)
    both = both.select("*", *(F.col("carried")[c].alias(f"__{c}") for c in ("kind", "chrom", "start", "step", "span")))
    k, span = F.col("kind"), F.coalesce(F.col("__span"), F.lit(1))
    lo = F.when(k == "bed_graph", F.col("lo") + (1 if zero_based else 0)).when(k == "variable_value", F.col("lo")).otherwise(F.col("__start") + F.col("__step") * (F.col("since") - 1))
    state_error = F.when((k == "variable_value") & ~F.col("__kind").eqNullSafe("variable"), "not_in_variable_step_state").when((k == "fixed_value") & ~F.col("__kind").eqNullSafe("fixed"), "not_in_fixed_step_state")
    error = F.coalesce(F.col("error"), state_error)
    good = error.isNull()
    return both.select("file", "line_no", F.when(good, F.when(k == "bed_graph", F.col("chrom")).otherwise(F.col("__chrom"))).alias("chrom"), F.when(good, lo).alias("lo"), F.when(good, F.when(k == "bed_graph", F.col("hi")).otherwise(lo + span - 1)).alias("hi"), F.when(good, F.col("val")).alias("val"), error.alias("error"))


def wig_line() -> Column:
    """A line of each item of :func:`wig`."""
    k = F.col("kind")
    opt = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n).cast("string")))
    text = lambda *cs: F.concat_ws(" ", *(c.cast("string") for c in cs))
    return (
        F.when(k == "fixed", F.concat_ws(" ", F.lit("fixedStep"), opt("chrom"), opt("start"), opt("step"), opt("span"))).when(k == "variable", F.concat_ws(" ", F.lit("variableStep"), opt("chrom"), opt("span")))
        .when(k == "fixed_value", F.col("val").cast("string")).when(k == "variable_value", text(F.col("lo"), F.col("val"))).when(k == "bed_graph", text(F.col("chrom"), F.col("lo"), F.col("hi"), F.col("val")))
    )


def fasta(df: DataFrame) -> DataFrame:
    """file, record (from 1 over all files), description, sequence, error. Lines that begin with ``;`` or ``#`` before the first record are comments; blank lines are skipped.

    Records are numbered by distributed running counts. A record is one value, so it is put together in one task.
    """
    v = F.col("value")
    head = v.startswith(">")
    rows = _counted(df.where("trim(value) <> '' AND NOT startswith(value, ';') AND NOT startswith(value, '#')"), r=head)
    # lines before a file's first record belong to none
    first = rows.where("r = 1").groupBy("file").agg(F.min("r_to").alias("__first")).withColumnRenamed("file", "__file")
    rows = rows.join(first, F.col("file") == F.col("__file"), "left")
    orphan = F.col("__first").isNull() | (F.col("r_to") < F.col("__first"))
    got = rows.where(~orphan).groupBy("file", F.col("r_to").alias("record")).agg(
        F.max(F.when(head, F.substr(v, F.lit(2)))).alias("description"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", F.rtrim(v).alias("v"))))), lambda x: x["v"]), "").alias("sequence"),
    )
    bad = rows.where(orphan).groupBy("file").agg(F.lit(0).cast("bigint").alias("record"))
    ok = failures(("empty_description", F.trim("description") != ""), ("empty_sequence", F.length("sequence") > 0))
    return got.withColumn("error", ok).unionByName(bad.select("file", "record", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("sequence"), F.lit("sequence_before_description").alias("error")))


def fasta_text(width: int = 70) -> Column:
    from spanloom.functions.sequence import chunks

    return F.concat(F.lit(">"), F.col("description"), F.lit("\n"), F.array_join(chunks(F.col("sequence"), width if width > 0 else 70), "\n"))


def fastq(df: DataFrame) -> DataFrame:
    """file, record (from 0), name, sequence, comment, qualities, error: strict groups of four lines by line number."""
    at = F.col("line_no") - 1
    line = lambda i: F.max(F.when(at % 4 == i, F.col("value")))
    got = df.groupBy("file", F.floor(at / 4).alias("record")).agg(line(0).alias("n"), line(1).alias("sequence"), line(2).alias("c"), line(3).alias("qualities"))
    tests = [("incomplete", F.col("qualities").isNotNull()), ("name", F.col("n").startswith("@")), ("comment", F.col("c").startswith("+")), ("qualities", F.length("qualities") == F.length("sequence"))]
    return got.select("file", "record", F.substr("n", F.lit(2)).alias("name"), "sequence", F.substr("c", F.lit(2)).alias("comment"), "qualities", failures(*tests).alias("error"))


def fastq_text() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), "sequence", F.concat(F.lit("+"), F.col("comment")), "qualities")


def bar(df: DataFrame) -> DataFrame:
    """file, section, pos, val, error of a BAR text file: each section's name (its second header line) with its data rows."""
    v = F.rtrim("value")
    seq = v.rlike(r"^#\s*Seq\t")
    rows = _counted(df, s=seq)
    names = rows.where(v.rlike(r"^#\s*Name\t")).select(F.col("s_to").alias("__s"), F.substring_index(v, "\t", -1).alias("section"))
    hits = rows.where(v.rlike(r"^#\s*Number of hits\t")).select(F.col("s_to").alias("__h"), integer(F.substring_index(v, "\t", -1)).alias("hits"))
    data = _split(rows.where("NOT startswith(value, '#') AND trim(value) <> '' AND s_to > 0"))
    n = data.groupBy(F.col("s_to").alias("__c")).agg(F.count("*").alias("n"))
    both = data.join(names, F.col("s_to") == F.col("__s"), "left").join(hits, F.col("s_to") == F.col("__h"), "left").join(n, F.col("s_to") == F.col("__c"))
    pos, val = integer(_f(0)), number(F.rtrim(_f(1)))
    return both.select("file", "line_no", "section", pos.alias("pos"), val.alias("val"), failures(("column_count", _N() == 2), ("pos", pos.isNotNull()), ("val", val.isNotNull()), ("hits", F.col("n") == F.col("hits"))).alias("error"))


def cel(df: DataFrame) -> DataFrame:
    """file, x, y, mean, stdv, npixels, error of the [INTENSITY] section of a CEL file."""
    v = F.trim("value")
    rows = _counted(df, s=v.rlike(r"^\[.*\]$"))
    name = rows.where("s = 1").select(F.col("s_to").alias("__s"), v.alias("__name"))
    f = _split(rows.join(name, F.col("s_to") == F.col("__s")).where("__name = '[INTENSITY]' AND s = 0 AND trim(value) <> '' AND NOT contains(value, '=')"))
    ints, nums = {n: integer(F.trim(_f(i))).cast("int") for n, i in (("x", 0), ("y", 1), ("npixels", 4))}, {n: number(F.trim(_f(i))) for n, i in (("mean", 2), ("stdv", 3))}
    return f.select("file", "line_no", *(c.alias(n) for n, c in {**ints, **nums}.items()), failures(("column_count", _N() == 5), *((n, c.isNotNull()) for n, c in {**ints, **nums}.items())).alias("error"))


# What letters after a backslash stand for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b"}


def _unescaped(c: Column) -> Column:
    """Backslash escapes of a quoted string: those of ESCAPES, three decimal digits, x with two hexadecimal ones; any other letter stands for itself."""
    parts = F.regexp_extract_all(c, F.lit(r"\\[0-9]{3}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+|\\$"), 0)

    def one(p: Column) -> Column:
        out = F.when(~p.startswith("\\"), p).when(p.rlike(r"^\\[0-9]{3}$"), F.char(F.substring(p, 2, 3).cast("int"))).when(p.rlike(r"^\\x[0-9a-fA-F]{2}$"), F.char(F.conv(F.substring(p, 3, 2), 16, 10).cast("int")))
        for k, v in ESCAPES.items():
            out = out.when(p == f"\\{k}", v)
        return out.otherwise(F.substr(p, F.lit(2)))

    return F.array_join(F.transform(parts, one), "")


def track_content(df: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The content lines of a track file as ``parse`` (a codec of this module, such as ``bed``, ``gff`` or ``wig``) reads them; line numbers stay."""
    return parse(track(df).where("kind = 'content'").select("file", "line_no", F.col("content").alias("value")))


def track(df: DataFrame) -> DataFrame:
    """file, line_no, kind (track, browser_position, browser_hide, browser_unknown, comment, content), attributes, chrom, lo, hi, content, error."""
    v = F.col("value")
    pos = r"^browser\s+position\s+(.+):(\d+)-(\d+)\s*$"
    attr = r'([^=\s"]+)=("((?:[^"\\]|\\.)*)"|[^\s]*)'
    kind = (
        F.when(v.startswith("track"), "track").when(v.rlike(r"^browser\s+position\s"), "browser_position").when(v.rlike(r"^browser\s+hide\s+all\s*$"), "browser_hide").when(v.startswith("browser"), "browser_unknown")
        .when(v.startswith("#"), "comment").otherwise("content")
    )
    attrs = F.transform(F.regexp_extract_all(v, F.lit(attr), 0), lambda p: F.struct(F.regexp_extract(p, attr, 1).alias("key"), _unescaped(F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), '^"|"$', "")).alias("value")))
    f = df.where("value <> ''").withColumn("kind", kind)
    k = F.col("kind")
    left = F.trim(F.regexp_replace(F.regexp_replace(v, "^track", ""), attr, ""))
    tests = [("key_value", (k != "track") | (left == "")), ("browser_position", (k != "browser_position") | v.rlike(pos))]
    part = lambda i: F.when(k == "browser_position", F.regexp_extract(v, pos, i))
    return f.select("file", "line_no", "kind", F.when(k == "track", attrs).alias("attributes"), part(1).alias("chrom"), part(2).try_cast("bigint").alias("lo"), part(3).try_cast("bigint").alias("hi"), F.when(k == "content", v).alias("content"), failures(*tests).alias("error"))


# --- conversions between formats ---


def fastq_to_sam(df: DataFrame) -> DataFrame:
    """Reads as unmapped alignments."""
    none = lambda kind: F.lit(None).cast(kind)
    return df.select(F.substring_index("name", " ", 1).alias("qname"), F.lit(4).alias("flag"), none("string").alias("rname"), none("int").alias("pos"), none("int").alias("mapq"), F.lit("*").alias("cigar"), F.col("sequence").alias("seq"), F.col("qualities").alias("qual"))


def sam_to_fastq(df: DataFrame) -> DataFrame:
    """Primary alignments as reads in the direction they were sequenced."""
    from spanloom.functions.sequence import flag, phred_char, reverse_complement

    back = flag("is_reverse_complemented", F.col("flag"))
    text = F.array_join(F.transform("qual", lambda q: phred_char(q)), "")
    return df.where(flag("is_primary", F.col("flag")) & F.col("seq").isNotNull()).select(F.col("qname").alias("name"), F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("sequence"), F.lit("").alias("comment"), F.when(back, F.reverse(text)).otherwise(text).alias("qualities"))


def fastq_to_fasta(df: DataFrame) -> DataFrame:
    """name, sequence and scores (blank-separated Phred numbers) of FASTQ records, for a FASTA and a quality file."""
    return df.select("name", "sequence", F.array_join(F.transform(qualities(F.col("qualities")), lambda q: q.cast("string")), " ").alias("scores"))


def probe_intensities(probes: DataFrame, cells: DataFrame, strict: bool = True) -> DataFrame:
    """The columns of ``probes`` (:func:`bpmap`) with the mean intensities pm and mm of their two cells in ``cells`` (:func:`cel`).

    ``strict``: a cell that isn't there raises an error; otherwise its value is null. Cells are joined once each, by coordinates.
    """
    side = lambda n: cells.select(F.col("x").cast("bigint").alias(f"{n}_x"), F.col("y").cast("bigint").alias(f"{n}_y"), F.col("mean").alias(n))
    both = probes.join(side("pm"), ["pm_x", "pm_y"], "left").join(side("mm"), ["mm_x", "mm_y"], "left")
    if strict:
        both = demanded(both, F.col("pm").isNotNull() & F.col("mm").isNotNull(), "a probe's cell is missing")
    return both.select(*probes.columns, "pm", "mm")


def reference_names(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """``alignments`` with ``rname`` of their ``ref_id`` in ``references`` (ref_id, rname); ``*`` where it has none."""
    return alignments.join(references.select("ref_id", F.col("rname").alias("__name")), "ref_id", "left").select(*alignments.columns, F.coalesce("__name", F.lit("*")).alias("rname"))


def fasta_with_scores(sequences: DataFrame, scores: DataFrame) -> DataFrame:
    """FASTQ records of two FASTA tables with equal descriptions, the second with scores parted by blanks; a difference in length is an error."""
    from spanloom.functions.sequence import phred_char

    q = scores.select("description", F.array_join(F.transform(F.split(F.trim("sequence"), " +"), lambda x: phred_char(integer(x).cast("int"))), "").alias("qualities"))
    both = sequences.select("description", "sequence").join(q, "description")
    return both.select(F.col("description").alias("name"), "sequence", F.lit("").alias("comment"), "qualities", failures(("qualities", F.length("sequence") == F.length("qualities"))).alias("error"))
