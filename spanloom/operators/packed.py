"""Several values packed in one field: one row per value, position kept.

Quoted spans are taken out of the field and stand in it as indexed placeholders, so that what is left can be split at plain
delimiters; the spans come back by array lookup. Placeholders use private characters; where these occur in the data they are
escaped first, so nothing can collide. Everything is Catalyst expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private characters for opening and closing a placeholder, a literal quote and the escape of these four.
OPEN, CLOSE, QUOTE, ESC = "", "", "", ""
_SAFE = {ESC: ESC + "d", OPEN: ESC + "a", CLOSE: ESC + "b", QUOTE: ESC + "c"}


def _hide(x: Column) -> Column:
    for a, b in _SAFE.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _show(x: Column) -> Column:
    x = F.replace(x, F.lit(QUOTE), F.lit('"'))
    for a, b in reversed(_SAFE.items()):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def percent_decoded(x: Column) -> Column:
    """Percent escapes as UTF-8; broken escapes and plus signs stay as they are."""
    x = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.instr(x, "%") > 0, F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))).otherwise(x)


def _hold(df: DataFrame, **cols: Column) -> DataFrame:
    """Compute columns once: an expression inside a lambda would otherwise be worked out again for every element."""
    pack = F.array(F.struct(*(c.alias(n) for n, c in cols.items())))
    return df.select("*", F.inline(pack))


def _restored(spans: Column, text: Column, decode: bool) -> Column:
    """Text with its spans back; only what stands outside them is decoded."""
    out = percent_decoded if decode else (lambda x: x)

    def piece(p: Column, i: Column) -> Column:
        number = F.substring_index(p, CLOSE, 1)
        return F.when(i == 0, out(p)).otherwise(F.concat(F.get(spans, F.expr("0") + number.try_cast("int")), out(F.substring_index(p, CLOSE, -1))))

    return _show(F.array_join(F.transform(F.split(text, OPEN), piece), ""))


def _trimmed(x: Column) -> Column:
    return F.trim(x)


def split_packed(df: DataFrame, keep: list[Column], field: str, delimiters: str, pairs: bool = False, decode: bool = False) -> DataFrame:
    """One row per value of ``field``: the ``keep`` columns, pos (from 0), tag, val.

    ``delimiters``: characters that part values outside double quotes. A quote in a quoted span is written twice or after a
    backslash; a quote without partner is an ordinary character. Blanks around a value go. An empty slot is an empty value
    with its position; a delimiter at the end opens no value. A field that is null, blank or a lone dot has no values.
    ``pairs``: slots are ``tag=value[,value...]`` or ``tag value``; a slot without a value has an empty one. ``decode``:
    percent escapes outside quotes are decoded in the first of these notations. Without ``pairs`` tag is empty.
    """
    x = F.col(field)
    names = [f"__{i}" for i in range(len(keep))]
    cls = "[" + "".join("\\" + c if c in "\\]^-|" else c for c in delimiters) + "]"
    rows = df.where(x.isNotNull() & ~F.trim(x).isin("", ".") & (F.length(F.trim(F.regexp_replace(x, "[\t\r\n]", " "))) > 0))
    rows = rows.select(*(k.alias(n) for k, n in zip(keep, names, strict=True)), x.alias("__x"))
    # odd parts lie inside quotes
    rows = _hold(rows, __parts=F.split(F.replace(_hide(F.col("__x")), F.lit('\\"'), F.lit(QUOTE)), '"', -1)).drop("__x")
    parts, last = F.col("__parts"), F.size("__parts") - 1

    def held(p: Column, i: Column) -> Column:
        inside = (i % 2 == 1) & (i < last)
        doubled = (i % 2 == 0) & (i > 0) & (i < last - F.when(last % 2 == 1, 1).otherwise(0)) & (p == "")
        lone = (i % 2 == 1) & (i == last)
        return F.when(inside, F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).when(doubled, F.lit(QUOTE)).when(lone, F.concat(F.lit(QUOTE), p)).otherwise(p)

    rows = _hold(rows, __slots=F.split(F.rtrim(F.array_join(F.transform(parts, held), "")), cls, -1))
    slots = F.col("__slots")
    slots = F.when((F.size(slots) > 1) & (F.trim(F.element_at(slots, -1)) == ""), F.slice(slots, 1, F.size(slots) - 1)).otherwise(slots)
    slots = F.transform(slots, _trimmed)
    if pairs:
        eq, gap = r"^([^=\s]*)\s*=\s*", r"^(\S*)\s*"

        def values(s: Column) -> Column:
            is_eq = s.rlike(eq)
            tag = F.when(is_eq, F.regexp_extract(s, eq, 1)).otherwise(F.regexp_extract(s, gap, 1))
            many = F.when(is_eq, F.split(F.regexp_replace(s, eq, ""), ",", -1)).otherwise(F.array(F.regexp_replace(s, gap, "")))
            return F.transform(many, lambda v: F.struct(is_eq.alias("eq"), tag.alias("tag"), F.trim(v).alias("val")))

        cells = F.flatten(F.transform(slots, values))
    else:
        cells = F.transform(slots, lambda s: F.struct(F.lit(False).alias("eq"), F.lit("").alias("tag"), s.alias("val")))
    flat = rows.select(*names, "__parts", F.posexplode(cells).alias("pos", "__c"))
    spans = F.col("__parts")

    def text(part: str) -> Column:
        raw = F.col(f"__c.{part}")
        plain = _restored(spans, raw, False)
        return F.when(F.col("__c.eq"), _restored(spans, raw, True)).otherwise(plain) if decode else plain

    flat = flat.select(*names, "pos", text("tag").alias("tag"), text("val").alias("val"))
    return flat.toDF(*(f"k{i}" for i in range(len(names))), "pos", "tag", "val")
