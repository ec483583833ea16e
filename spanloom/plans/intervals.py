"""Queries of the interval algebra. Loci come from line items (by supplier, days) and orders (by customer modulo 100, thirty days)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.runtime import table

K = ["chrom"]


def loci(s: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    return table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("chrom"), day.alias("lo"), (day + F.col("l_quantity").cast("bigint")).alias("hi"))


def windows(s: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("string").alias("chrom"), day.alias("lo"), (day + 30).alias("hi"))


_BASE = """
WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS lo,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS hi FROM lineitem),
b AS (SELECT o_orderkey AS id, CAST(o_custkey % 100 AS VARCHAR) AS chrom, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 30 AS hi FROM orders)
"""


def _merged(name: str, src: str) -> str:
    return f""",
{name}_m AS (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{name}_g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_m),
{name} AS (SELECT chrom, min(lo) AS lo, max(hi) AS hi FROM {name}_g GROUP BY chrom, grp)"""


_SWEEP = """,
ev AS (SELECT chrom, lo AS pos, 1 AS da, 0 AS db FROM a UNION ALL SELECT chrom, hi + 1, -1, 0 FROM a UNION ALL SELECT chrom, lo, 0, 1 FROM b UNION ALL SELECT chrom, hi + 1, 0, -1 FROM b),
pt AS (SELECT chrom, pos, sum(da) AS da, sum(db) AS db FROM ev GROUP BY chrom, pos),
st AS (SELECT chrom, pos AS lo, lead(pos) OVER w - 1 AS hi, sum(da) OVER w AS na, sum(db) OVER w AS nb FROM pt WINDOW w AS (PARTITION BY chrom ORDER BY pos))"""




QUERIES = {
    "i01_merge": lambda s, d: iv.merge(loci(s, d), K),
    "i02_union": lambda s, d: iv.union(loci(s, d), windows(s, d), K),
    "i03_intersection": lambda s, d: iv.intersection(loci(s, d), windows(s, d), K),
    "i04_difference": lambda s, d: iv.difference(loci(s, d), windows(s, d), K),
    "i05_complement": lambda s, d: iv.complement(loci(s, d), K, 0, 20000),
    "i06_subset": lambda s, d: iv.subset(loci(s, d), windows(s, d), K),
    "i07_restrict": lambda s, d: iv.restrict(loci(s, d), 9500, 10000).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo") + 1).alias("points")),
    "i08_add_remove": lambda s, d: iv.difference(iv.union(loci(s, d), loci(s, d).select("chrom").distinct().select("chrom", F.lit(7000).cast("bigint").alias("lo"), F.lit(7100).cast("bigint").alias("hi")), K),
                                                 loci(s, d).select("chrom").distinct().select("chrom", F.lit(10000).cast("bigint").alias("lo"), F.lit(10100).cast("bigint").alias("hi")), K),
    "i09_cardinality": lambda s, d: iv.cardinality(loci(s, d), K),
    "i10_elements": lambda s, d: iv.elements(loci(s, d), K).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("point").alias("total")),
    "i11_filter_elements": lambda s, d: iv.keep_elements(loci(s, d), K, F.col("point") % 7 != 0),
    "i11_partition": lambda s, d: _partition(s, d),
    "i11_for_all": lambda s, d: iv.quantified(loci(s, d), K, F.col("point") % 100 != 0),
    "i12_relations": lambda s, d: _relations(s, d),
    "i13_adjacency": lambda s, d: iv.adjacency(table(s, d, "orders").select((F.col("o_custkey")).alias("cust"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("lo"), (F.unix_date(F.to_date("o_orderdate")) + 30).cast("bigint").alias("hi"), F.col("o_orderstatus").alias("status")), ["cust"], "status"),
    "i14_least_window": lambda s, d: _least(s, d),
    "i15_expand": lambda s, d: iv.expanded(windows(s, d), K, "id").select("chrom", "pos", F.size("payloads").alias("n"), F.array_join("payloads", ",").alias("ids")),
    "i16_regions": lambda s, d: iv.regions(loci(s, d).withColumn("len", F.col("hi") - F.col("lo")), K, F.col("len") >= 45, 10),
    "i17_coverage": lambda s, d: iv.depth(loci(s, d), K),
    "i18_intersects_by_name": lambda s, d: iv.intersection(loci(s, d), windows(s, d), K).groupBy("chrom").agg(F.count("*").alias("parts")),
    "j01_overlap_semi": lambda s, d: iv.overlapping(windows(s, d), loci(s, d), K).select("id", "chrom", "lo", "hi"),
    "j02_overlap_inner": lambda s, d: iv.overlaps(windows(s, d), loci(s, d), K).groupBy("id").agg(F.count("*").alias("n"), F.min("lo_b").alias("first_lo"), F.max("hi_b").alias("last_hi")),
    "j04_nearest": lambda s, d: iv.nearest(windows(s, d), loci(s, d), K, "id"),
    "j05_overlap_size": lambda s, d: iv.overlap_size(windows(s, d), loci(s, d), K, "id"),
    "j06_value_at": lambda s, d: iv.value_at(windows(s, d).select("id", "chrom", F.col("lo").alias("pos")), iv.depth(loci(s, d), K).withColumn("value", F.col("depth").cast("double")), K, "id", 0.0),
}


def _partition(s: SparkSession, d: str) -> DataFrame:
    yes, no = iv.partition(loci(s, d), K, F.col("point") % 7 != 0)
    return yes.withColumn("side", F.lit("yes")).unionByName(no.withColumn("side", F.lit("no")))


def _least(s: SparkSession, d: str) -> DataFrame:
    """The least window around position 20 of each vector that holds two positive values."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    positive = lambda lo, hi: F.size(F.filter(F.slice("e", lo + 1, hi - lo + 1), lambda x: x > 0)) >= 2
    w = iv.least_window(F.size("e"), F.lit(20), positive)
    return e.select("vec_id", w.alias("w")).select("vec_id", "w.lo", "w.hi")


def _relations(s: SparkSession, d: str) -> DataFrame:
    """All relations of each order's window to the first window of its customer's chromosome."""
    w = windows(s, d)
    first = w.groupBy("chrom").agg(F.min(F.struct("lo", "hi")).alias("f")).select("chrom", F.col("f.lo").alias("lo_b"), F.col("f.hi").alias("hi_b"))
    return w.join(first, "chrom").select("id", *(c.alias(n) for n, c in iv.relations().items()))


ORACLE = {
    "i01_merge": _BASE + _merged("m", "a") + "SELECT chrom, lo, hi FROM m",
    "i02_union": _BASE + ", u AS (SELECT chrom, lo, hi FROM a UNION ALL SELECT chrom, lo, hi FROM b)" + _merged("m", "u") + "SELECT * FROM m",
    "i03_intersection": _BASE + _SWEEP + ", k AS (SELECT chrom, lo, hi FROM st WHERE na > 0 AND nb > 0)" + _merged("m", "k") + "SELECT * FROM m",
    "i04_difference": _BASE + _SWEEP + ", k AS (SELECT chrom, lo, hi FROM st WHERE na > 0 AND nb = 0)" + _merged("m", "k") + "SELECT * FROM m",
    "i05_complement": _BASE + _merged("m", "a") + """, e AS (SELECT chrom, lo, hi, lag(hi) OVER w AS p, lead(lo) OVER w AS n FROM m WINDOW w AS (PARTITION BY chrom ORDER BY lo))
SELECT chrom, coalesce(p + 1, 0) AS lo, lo - 1 AS hi FROM e WHERE coalesce(p + 1, 0) <= lo - 1 UNION ALL SELECT chrom, hi + 1, 20000 FROM e WHERE n IS NULL AND hi < 20000""",
    "i06_subset": _BASE + _SWEEP + """SELECT chrom, NOT bool_or(na > 0 AND nb = 0) AS is_subset, NOT bool_or(na > 0 AND nb = 0) AND NOT bool_or(nb > 0 AND na = 0) AS is_equal
FROM st GROUP BY chrom HAVING bool_or(na > 0)""",
    "i07_restrict": _BASE + "SELECT chrom, CAST(count(*) AS BIGINT) AS n, CAST(sum(least(hi, 10000) - greatest(lo, 9500) + 1) AS BIGINT) AS points FROM a WHERE greatest(lo, 9500) <= least(hi, 10000) GROUP BY chrom",
    "i08_add_remove": _BASE + ", u AS (SELECT chrom, lo, hi FROM a UNION ALL SELECT DISTINCT chrom, 7000, 7100 FROM a)" + _merged("m", "u") + """, r AS (
SELECT chrom, lo, least(hi, 9999) AS hi FROM m WHERE lo < 10000 UNION ALL SELECT chrom, greatest(lo, 10101), hi FROM m WHERE hi > 10100)
SELECT * FROM r""",
    "i09_cardinality": _BASE + _merged("m", "a") + "SELECT chrom, CAST(sum(hi - lo + 1) AS BIGINT) AS points FROM m GROUP BY chrom",
    "i10_elements": _BASE + ", e AS (SELECT DISTINCT chrom, unnest(range(lo, hi + 1)) AS p FROM a) SELECT chrom, CAST(count(*) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS total FROM e GROUP BY chrom",
    "i11_filter_elements": _BASE + ", e AS (SELECT DISTINCT chrom, unnest(range(lo, hi + 1)) AS p FROM a), k AS (SELECT chrom, p AS lo, p AS hi FROM e WHERE p % 7 <> 0)" + _merged("m", "k") + "SELECT * FROM m",
    "i11_partition": _BASE + ", e AS (SELECT DISTINCT chrom, unnest(range(lo, hi + 1)) AS p FROM a), k AS (SELECT chrom, p AS lo, p AS hi FROM e WHERE p % 7 <> 0), l AS (SELECT chrom, p AS lo, p AS hi FROM e WHERE p % 7 = 0)"
    + _merged("m", "k") + _merged("o", "l") + "SELECT *, 'yes' AS side FROM m UNION ALL SELECT *, 'no' FROM o",
    "i11_for_all": _BASE + ", e AS (SELECT chrom, unnest(range(lo, hi + 1)) AS p FROM a) SELECT chrom, bool_and(p % 100 <> 0) AS for_all, bool_or(p % 100 <> 0) AS exists FROM e GROUP BY chrom",
    "i12_relations": _BASE + """, f AS (SELECT chrom, (min({'lo': lo, 'hi': hi})).lo AS lo2, (min({'lo': lo, 'hi': hi})).hi AS hi2 FROM b GROUP BY chrom),
p AS (SELECT id, lo, hi, lo2, hi2, lo = lo2 AND hi = hi2 AS same, lo < lo2 AND hi < hi2 AS sb, lo2 < lo AND hi2 < hi AS sa, lo >= lo2 AND hi <= hi2 AS sub, lo2 >= lo AND hi2 <= hi AS sup FROM b JOIN f USING (chrom))
SELECT id, least(hi, hi2) - greatest(lo, lo2) + 1 AS overlap, -(least(hi, hi2) - greatest(lo, lo2) + 1) AS gap, sb AS strict_before, sa AS strict_after, sb OR same AS "before", sa OR same AS "after",
  sub AS subset, sup AS superset, sub AND NOT same AS strict_subset, sup AND NOT same AS strict_superset,
  CAST(CASE WHEN same THEN 0 WHEN sb THEN -1 WHEN sa THEN 1 END AS INTEGER) AS compare_positional, CAST(CASE WHEN same THEN 0 WHEN sub THEN -1 WHEN sup THEN 1 END AS INTEGER) AS compare_containment FROM p""",
    "i13_adjacency": """
WITH o AS (SELECT o_custkey AS cust, o_orderstatus AS status, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo FROM orders),
p AS (SELECT *, lo + 30 AS hi, lag(lo) OVER (PARTITION BY cust, status ORDER BY lo) AS plo FROM o)
SELECT cust, status, coalesce(bool_or(lo <= plo + 30), false) AS any_overlap, coalesce(bool_and(plo <= lo), true) AS all_positional, CAST(max(lo - (plo + 30) - 1) AS BIGINT) AS max_gap FROM p GROUP BY cust, status""",
    "i14_least_window": """
WITH k AS (SELECT vec_id, embedding, greatest(0, 20 - k // 2) AS lo, least(len(embedding) - 1, 20 + (k + 1) // 2) AS hi, k FROM embeddings, range(0, 800) t(k)),
f AS (SELECT vec_id, lo, hi, k FROM k WHERE len(list_filter(embedding[lo + 1 : hi + 1], lambda x: x > 0)) >= 2)
SELECT vec_id, CAST(arg_min(lo, k) AS INTEGER) AS lo, CAST(arg_min(hi, k) AS INTEGER) AS hi FROM f GROUP BY 1""",
    "i15_expand": _BASE + ", e AS (SELECT chrom, id, unnest(range(lo, hi + 1)) AS pos FROM b) SELECT chrom, pos, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM e GROUP BY chrom, pos",
    "i16_regions": _BASE + ", k AS (SELECT chrom, lo, hi + 10 AS hi FROM a WHERE hi - lo >= 45)" + _merged("m", "k") + "SELECT chrom, lo, hi - 10 AS hi FROM m",
    "i17_coverage": _BASE + _SWEEP.replace("UNION ALL SELECT chrom, lo, 0, 1 FROM b UNION ALL SELECT chrom, hi + 1, 0, -1 FROM b", "") + "SELECT chrom, lo, hi, CAST(na AS BIGINT) AS depth FROM st WHERE na > 0",
    "i18_intersects_by_name": _BASE + _SWEEP + ", k AS (SELECT chrom, lo, hi FROM st WHERE na > 0 AND nb > 0)" + _merged("m", "k") + "SELECT chrom, CAST(count(*) AS BIGINT) AS parts FROM m GROUP BY chrom",
    "j01_overlap_semi": _BASE + "SELECT id, chrom, lo, hi FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND a.lo <= b.hi AND b.lo <= a.hi)",
    "j02_overlap_inner": _BASE + "SELECT b.id, CAST(count(*) AS BIGINT) AS n, min(a.lo) AS first_lo, max(a.hi) AS last_hi FROM a JOIN b ON a.chrom = b.chrom AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY b.id",
    "j04_nearest": _BASE + """, t AS (SELECT DISTINCT chrom, lo, hi FROM a),
p AS (SELECT b.id, t.lo, t.hi, CASE WHEN t.lo <= b.hi AND b.lo <= t.hi THEN 0 ELSE greatest(t.lo - b.hi, b.lo - t.hi) END AS d FROM b JOIN t USING (chrom)),
m AS (SELECT id, min({'d': d, 'lo': lo, 'hi': hi}) AS x FROM p GROUP BY id)
SELECT b.id, x.lo AS near_lo, x.hi AS near_hi, CAST(x.d AS BIGINT) AS distance FROM b LEFT JOIN m USING (id)""",
    "j05_overlap_size": _BASE + "" + _merged("m", "a") + """
SELECT b.id, CAST(sum(CASE WHEN m.lo IS NULL THEN 0 ELSE least(b.hi, m.hi) - greatest(b.lo, m.lo) + 1 END) AS BIGINT) AS shared FROM b LEFT JOIN m ON m.chrom = b.chrom AND m.lo <= b.hi AND b.lo <= m.hi GROUP BY b.id""",
    "j06_value_at": _BASE + "SELECT b.id, CAST(count(a.lo) AS DOUBLE) AS value FROM b LEFT JOIN a ON a.chrom = b.chrom AND a.lo <= b.lo AND b.lo <= a.hi GROUP BY b.id",
}
