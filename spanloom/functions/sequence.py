"""Scalar functions on sequences, chromosome names, ranges, qualities and alignments; Catalyst expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide letters.
IUPAC = "ACGTURYKMSWBDHVNX"
# Roman digits of ones, tens and hundreds.
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _strings(xs: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in xs))


def to_roman(n: Column) -> Column:
    """Roman numeral of a number above 0; null otherwise."""
    digit = lambda table, unit: F.get(_strings(table), F.floor(n / unit).cast("int") % 10)
    out = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(HUNDREDS, 100), digit(TENS, 10), digit(ONES, 1))
    return F.when(n > 0, out)


def of_roman(s: Column) -> Column:
    """Number of a well-formed roman numeral in any case; null otherwise."""
    u = F.upper(s)
    value = F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv))
    step = lambda a, c: F.struct(
        (a["v"] + F.when(a["p"] < value[c], -a["p"]).otherwise(a["p"])).alias("v"), value[c].alias("p"))
    ok = u.rlike("^[IVXLCDM]+$")
    letters = F.when(ok, F.split(u, "(?<=.)(?=.)")).otherwise(F.array().cast("array<string>"))
    n = F.aggregate(letters, F.struct(F.lit(0).alias("v"), F.lit(0).alias("p")), step, lambda a: a["v"] + a["p"])
    return F.when(ok & (to_roman(n) == u), n)


def _chr_core(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.startswith("chr"), F.substr(low, F.lit(4))).otherwise(low)


def chr_arabic(s: Column) -> Column:
    """X, Y, M or the number without prefix; an unknown name as it is."""
    c = _chr_core(s)
    number = F.coalesce(of_roman(c), F.when(c.rlike("^[0-9]{1,9}$"), c.try_cast("int")))
    return F.when(c == "x", "X").when(c == "y", "Y").when(c.isin("m", "mt", "mtdna"), "M").when(number > 0, number.cast("string")).otherwise(s)


def chr_roman(s: Column) -> Column:
    """Roman form; null where it would read as X, Y or the mitochondrion, which is ambiguous."""
    a = chr_arabic(s)
    out = F.when(a.rlike("^[0-9]{1,9}$"), to_roman(a.try_cast("int"))).otherwise(a)
    return F.when(~F.lower(out).isin("x", "y", "m", "mt", "mtdna"), out)


def strand(s: Column) -> Column:
    """+ or - of ``+``, ``fwd``, ``-`` and ``rev`` in any case; null otherwise."""
    low = F.lower(s)
    return F.when(low.isin("+", "fwd"), "+").when(low.isin("-", "rev"), "-")


def range_of(s: Column) -> Column:
    """struct(name, lo, hi) of ``name:lo-hi``; null where it isn't one with lo <= hi."""
    part = lambda i: F.regexp_extract(s, r"^(.+):(-?\d+)-(-?\d+)$", i)
    lo, hi = part(2).try_cast("bigint"), part(3).try_cast("bigint")
    return F.when((part(1) != "") & (lo <= hi), F.struct(part(1).alias("name"), lo.alias("lo"), hi.alias("hi")))


def range_text(name: Column, lo: Column, hi: Column) -> Column:
    return F.concat(name, F.lit(":"), lo.cast("string"), F.lit("-"), hi.cast("string"))


def dna(s: Column) -> Column:
    """Upper case, or null where a letter isn't IUPAC."""
    return F.when(F.upper(s).rlike(f"^[{IUPAC}]*$"), F.upper(s))


def nth(s: Column, k: Column | int) -> Column:
    """1-based letter; null outside."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when((k >= 1) & (k <= F.length(s)), F.substr(s, k, F.lit(1)))


def slice_(s: Column, first: int, last: int) -> Column:
    """Inclusive 1-based slice; null where a bound lies outside."""
    return F.when((F.lit(first) >= 1) & (F.lit(first) <= F.lit(last)) & (F.lit(last) <= F.length(s)), F.substring(s, first, last - first + 1))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"))


def composition(s: Column, pseudo: float = 0.0) -> dict[str, Column]:
    """Share of each base among ACGT with a pseudo-count; null where there is none and no pseudo-count."""
    u = F.upper(s)
    n = {b: F.length(u) - F.length(F.replace(u, F.lit(b), F.lit(""))) for b in "ACGT"}
    total = sum(n.values(), F.lit(0))
    return {b: F.when(total + 4 * pseudo > 0, (c + pseudo) / (total + 4 * pseudo)) for b, c in n.items()}


def chunks(s: Column, width: int) -> Column:
    """Fixed-width pieces, the last may be shorter; none of an empty string."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{width}}}"), 0)


def rounded(x: Column) -> Column:
    """Half up on the fractional part, as quality scores are rounded."""
    return F.when(x - F.floor(x) < 0.5, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def phred_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), q / -10.0)


def phred_of_probability(p: Column) -> Column:
    return F.when((p > 0) & (p <= 1), rounded(-10 * F.log10(p)))


def phred_char(q: Column, offset: int = 33) -> Column:
    return F.when((q >= 0) & (q + offset <= 126), F.char(q + offset))


def phred_of_char(c: Column, offset: int = 33) -> Column:
    return F.when((F.ascii(c) >= offset) & (F.ascii(c) <= 126), F.ascii(c) - offset)


def phred_of_solexa(q: Column) -> Column:
    return rounded(10 * F.log10(F.pow(F.lit(10.0), q / 10.0) + 1))


def solexa_of_phred(q: Column) -> Column:
    """Null for 0, which has no Solexa score."""
    return F.when(q > 0, rounded(10 * F.log10(F.pow(F.lit(10.0), q / 10.0) - 1)))


def solexa_probability(q: Column) -> Column:
    z = F.pow(F.lit(10.0), q / -10.0)
    return z / (1 + z)


def solexa_of_probability(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.floor(-10 * F.log10(p / (1 - p)) + 0.5).cast("int"))


def qualities(s: Column, offset: int = 33) -> Column:
    """Array of scores of a quality string; an invalid character gives null."""
    return F.transform(F.split(s, "(?<=.)(?=.)"), lambda c: phred_of_char(c, offset))


#: What a CIGAR string is.
CIGAR = r"^(\*|(0*[1-9]\d*[MIDNSHP=X])+)$"


def cigar(s: Column) -> Column:
    """array<struct<len,op>> of a CIGAR string, empty for ``*``; null where it is malformed or a length isn't above 0."""
    parts = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda p: F.struct(F.regexp_extract(p, r"^\d+", 0).try_cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))
    return F.when(s == "*", F.slice(parts, 1, 0)).when(s.rlike(r"^(0*[1-9]\d*[MIDNSHP=X])+$"), parts)


def cigar_text(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, "*").otherwise(F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))


def reference_length(ops: Column) -> Column:
    """Bases of the reference an alignment covers."""
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["len"]).otherwise(0))


# Fixed values: (shift, first bin) of the levels of the hierarchical bin index, finest first.
BIN_LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))


def reg2bin(first: Column, last: Column) -> Column:
    """Bin of a closed 0-based region: the finest level at which it lies in one bin; 0 for the whole."""
    out = F.lit(0)
    for shift, base in reversed(BIN_LEVELS):
        out = F.when(F.shiftright(first, shift) == F.shiftright(last, shift), F.lit(base) + F.shiftright(first, shift)).otherwise(out)
    return out


# Fixed value: mass of a proton.
PROTON = 1.00727646677


def precursor_mass(mz: Column, z: Column) -> Column:
    return (mz - PROTON) * z


FLAG_BITS = {
    "has_multiple_segments": 0x1, "each_segment_is_properly_aligned": 0x2, "is_unmapped": 0x4, "next_segment_is_unmapped": 0x8, "is_reverse_complemented": 0x10,
    "next_is_reverse_complemented": 0x20, "is_first": 0x40, "is_last": 0x80, "is_secondary": 0x100, "not_passing_quality_controls": 0x200,
    "is_pcr_or_optical_duplicate": 0x400, "is_supplementary": 0x800,
}


def flag(name: str, x: Column) -> Column:
    """A predicate on alignment flags; ``is_primary`` is neither secondary nor supplementary."""
    return x.bitwiseAND(F.lit(0x900)) == 0 if name == "is_primary" else x.bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def illumina_id(s: Column) -> Column:
    """struct of an Illumina sequence identifier; null where a field doesn't fit."""
    part = lambda t, i: F.get(F.split(t, ":"), F.lit(i))
    x, y = F.substring_index(s, " ", 1), F.regexp_replace(s, "^[^ ]* ?", "")
    num = lambda t, i: F.when(part(t, i).rlike(r"^-?\d+$"), part(t, i).try_cast("bigint"))
    tile = part(x, 4)
    fields = {
        "instrument": part(x, 0), "run_number": num(x, 1), "flowcell_id": part(x, 2), "lane": num(x, 3), "surface": F.when(F.substring(tile, 1, 1) == "1", "top").otherwise("bottom"),
        "swath": F.substring(tile, 2, 1).try_cast("int"), "tile": F.substring(tile, 3, 2).try_cast("int"), "x_pos": num(x, 5), "y_pos": num(x, 6),
        "read": num(y, 0), "is_filtered": part(y, 1) == "Y", "control_number": num(y, 2), "index": part(y, 3),
    }
    ok = (F.size(F.split(x, ":")) == 7) & (F.size(F.split(y, ":")) == 4) & tile.rlike("^[12][123](0[1-9]|[1-9][0-9])$") & part(y, 1).isin("Y", "N")
    for c in ("run_number", "lane", "x_pos", "y_pos", "read", "control_number"):
        ok = ok & fields[c].isNotNull()
    return F.when(ok, F.struct(*(c.alias(n) for n, c in fields.items())))


def percent_encoded(s: Column) -> Column:
    """RFC 3986: everything but unreserved characters as percent escapes of its UTF-8 bytes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(s), r"\+", "%20"), "%7E", "~"), r"\*", "%2A")


# Fixed value: address of the genome browser.
BROWSER = "http://genome.ucsc.edu/cgi-bin/hgTracks"


def track_line(**attrs: Column | str | int) -> Column:
    """A track line; name, description and group are quoted."""
    parts = [F.lit("track")]
    for k, v in attrs.items():
        v = v if isinstance(v, Column) else F.lit(str(v))
        parts.append(F.concat(F.lit(f'{k}="'), v, F.lit('"')) if k in ("name", "description", "group") else F.concat(F.lit(f"{k}="), v.cast("string")))
    return F.concat_ws(" ", *parts)


def browser_url(db: Column, chrom: Column, lo: Column, hi: Column, custom: Column | None = None, big: bool = False) -> Column:
    url = F.concat(F.lit(f"{BROWSER}?db="), db, F.lit("&position="), range_text(chrom, lo, hi))
    return url if custom is None else F.concat(url, F.lit("&hgct_customText=" if big else "&hgt.customText="), percent_encoded(custom) if big else custom)


# Fixed value: address of the search service.
EUTILS = "http://eutils.ncbi.nlm.nih.gov/entrez/eutils"


def entrez_url(tool: str, **params: Column | str | int | None) -> Column:
    """esearch, esummary or efetch URL; null parameters are left out, ``term`` is percent-encoded."""
    cols = []
    for k, v in params.items():
        if v is None:
            continue
        v = v if isinstance(v, Column) else F.lit(str(v))
        v = percent_encoded(v) if k == "term" else v.cast("string")
        cols.append(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v)))
    return F.concat(F.lit(f"{EUTILS}/{tool}.fcgi?"), F.concat_ws("&", *cols))
