"""Line dedup by site-relative frequency: a line that more than a given share of a host's pages contain is boilerplate and goes.

All counting is on pairs of 64- and 32-bit hashes of lines, pre-aggregated per host, so the text is shuffled once, to put the
verdicts beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.workspace import fresh

#: A line on more than this share of its host's pages is boilerplate ...
MAX_RATIO = 0.05
#: ... if it is on this many of them at least: a line of one page alone is no repetition, whatever share of a small host that page is.
MIN_PAGES = 2

#: Python's and SQL's idea of a line that only layout tells from another.
_TRIM = r"^[ \t\r]+|[ \t\r]+$"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _bare(line):
    return F.regexp_replace(line, _TRIM, "")


def _mark(line):
    bare = _bare(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def dedup_lines(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, keep_copied_pages: bool = False) -> DataFrame:
    """``df`` with boilerplate lines cut out of ``text``, plus ``n_lines`` and ``n_dropped`` (columns of these names are replaced).

    Boilerplate is a line that more than ``max_ratio`` of its host's pages contain, and ``min_pages`` of them at least.  A line is compared without
    blanks, tabs and carriage returns at its ends; blank lines are never boilerplate.  What is left of a text keeps its lines in order, joined by
    newlines; a text of nothing but boilerplate becomes empty, unless ``keep_copied_pages`` says that such a page is a copied one, to be kept whole
    for a stage that looks for copies.  Pages with a null host are one host.  A null text stays null, has no lines and isn't counted.  A page counts
    once for a line however often it has it; rows that share a host and key are one page, those with a null key too.  Repeated rows stay and lose
    the same lines; shares of exactly ``max_ratio`` stay; texts of any length are read whole; an empty table gives an empty one; other
    columns are kept, whatever their names.

    Hot hosts are counted per line and pre-aggregated before the shuffle; no host's rows meet in one task.
    """
    pages = df.select(F.col(key).alias("k"), F.col(host).alias("h"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    hashed = F.transform(_lines(F.col("t")), lambda x: F.when(_bare(x) != "", _mark(x)))
    per_page = pages.select("k", "h", F.explode(F.array_distinct(hashed)).alias("m")).where(F.col("m").isNotNull()).select("k", "h", "m.a", "m.b")
    if _unique(df, key):
        counted, counted_pages = per_page, pages.select("h")
    else:
        counted, counted_pages = per_page.distinct(), pages.select("k", "h").distinct().select("h")
    totals = counted_pages.groupBy(F.col("h").alias("th")).agg(F.count("*").alias("pages"))
    counts = counted.groupBy("h", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    bad = counts.join(totals, F.col("h").eqNullSafe(F.col("th"))).where(F.col("n") > F.lit(max_ratio) * F.col("pages")).select(F.col("h").alias("bh"), "a", "b")
    hit = counted.join(bad, F.col("h").eqNullSafe(F.col("bh")) & (counted["a"] == bad["a"]) & (counted["b"] == bad["b"]), "left_semi")

    names = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    of_key, of_host, drop, kept = (fresh(n, names) for n in ("drop_key", "drop_host", "drop", "kept"))
    verdicts = hit.groupBy(F.col("k").alias(of_key), F.col("h").alias(of_host)).agg(F.collect_set(F.struct("a", "b")).alias(drop))
    c = lambda name: F.col(f"`{name}`")
    wide = df.select(*map(c, names)).join(verdicts, c(key).eqNullSafe(F.col(of_key)) & c(host).eqNullSafe(F.col(of_host)), "left")
    lines = _lines(c(text).cast("string"))
    out = wide.withColumn(kept, F.when(F.col(drop).isNotNull(), F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(F.col(drop), _mark(x)))))
    if keep_copied_pages:
        out = out.withColumn(kept, F.when(F.exists(kept, lambda x: _bare(x) != ""), F.col(kept)))
    size = F.when(c(text).isNull(), F.lit(0)).otherwise(F.size(lines))
    rest = {n: c(n) for n in names}
    rest[text] = F.when(F.col(kept).isNull(), c(text)).otherwise(F.array_join(kept, "\n"))
    return out.select(*[rest[n].alias(n) for n in names], size.cast("long").alias("n_lines"), F.when(F.col(kept).isNull(), F.lit(0)).otherwise(size - F.size(kept)).cast("long").alias("n_dropped"))


def _unique(df: DataFrame, key: str) -> bool:
    """Whether no page key repeats; decided on the key column alone."""
    row = df.agg(F.count("*").alias("n"), F.count(key).alias("m"), F.countDistinct(key).alias("d")).first()
    return row["n"] == row["m"] == row["d"]


ORACLE_SQL = """
WITH doc AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM doc
),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM lines),
totals AS (SELECT source, count(DISTINCT doc_id) AS pages FROM doc GROUP BY source),
counts AS (SELECT source, b, count(DISTINCT doc_id) AS n FROM bare WHERE b <> '' GROUP BY source, b),
bad AS (
  SELECT c.source, c.b FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {min_pages} AND c.n > {max_ratio} * t.pages
),
flagged AS (
  SELECT r.*, (bad.b IS NOT NULL) AS dropped FROM bare r LEFT JOIN bad ON r.source IS NOT DISTINCT FROM bad.source AND r.b = bad.b
),
made AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
  FROM flagged GROUP BY doc_id
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NOT NULL THEN m.text END AS text, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN made m ON d.doc_id = m.doc_id
""".format(min_pages=MIN_PAGES, max_ratio=MAX_RATIO)
