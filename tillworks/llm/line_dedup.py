"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.session import settle

RATIO = 0.1
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Per site the lines found on more than ``ratio`` of its pages, as columns site and lines.

    Lines are compared without blanks at their ends; empty ones do not count. A line counts once
    per page. First 64-bit hashes are counted, combined before the shuffle; a site has few hashes
    above the ratio (average lines of a page / ratio), and only lines with such a hash are then
    counted by their text, so a hash shared by two lines does no harm.
    """
    pages = settle(docs.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("pages")), "pages")
    trimmed = F.filter(F.transform(_lines(F.col(text)), lambda x: F.trim(x)), lambda x: x != "")
    page = docs.select(F.col(site).alias("site"), F.array_distinct(trimmed).alias("lines"))

    def frequent(counted: DataFrame) -> DataFrame:
        enough = counted.filter(F.col("n") >= min_pages).join(
            pages.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site")))
        return enough.filter(F.col("n") > F.col("pages") * ratio)

    hashed = page.select("site", F.explode("lines").alias("line")).groupBy(
        "site", F.xxhash64("line").alias("hash")).agg(F.count("*").alias("n"))
    hashes = settle(
        frequent(hashed).groupBy("site").agg(F.collect_set("hash").alias("hashes")), "hashes")
    suspects = with_site(page, hashes).select(
        "site",
        F.explode(F.filter(
            "lines", lambda x: F.array_contains(F.col("hashes"), F.xxhash64(x)))).alias("line"))
    counted = suspects.groupBy("site", "line").agg(F.count("*").alias("n"))
    return settle(
        frequent(counted).groupBy("site").agg(F.collect_set("line").alias("lines")), "lines")


def with_site(docs: DataFrame, per_site: DataFrame, site: str = "site") -> DataFrame:
    """Left join with a small written table of one row per site; Spark broadcasts it if its size
    allows, and otherwise splits large sites."""
    right = per_site.withColumnRenamed("site", "_site")
    return docs.join(right, docs[site].eqNullSafe(right["_site"]), "left").drop("_site")


def drop_site_lines(
    docs: DataFrame, site: str = "source", text: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """The documents without the boilerplate lines of their site, in their old columns.

    Adds _n_lines and _n_dropped; columns of these names, _site and _drop are replaced. All other
    lines stay as they are, in order; a document may become empty but is kept. NULL text stays
    NULL. NULL site is a site of its own. Sites of fewer than ``min_pages`` pages lose nothing.
    """
    lines = boilerplate(docs, site, text, ratio, min_pages).withColumnRenamed("lines", "_drop")
    joined = with_site(docs.drop("_drop", "_site", "_n_lines", "_n_dropped"), lines, site)
    kept = F.filter(
        _lines(F.col(text)), lambda x: ~F.array_contains(F.col("_drop"), F.trim(x)))
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(_lines(F.col(text))).cast("long"), F.lit(0).cast("long"))
    left = F.when(F.col("_drop").isNull(), n).otherwise(F.size(kept).cast("long"))
    n_lines = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n)
    dropped = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n - left)
    return joined.withColumns(
        {"_n_lines": n_lines, "_n_dropped": dropped, text: cleaned}).drop("_drop")


def clean_lines(docs: DataFrame) -> DataFrame:
    return drop_site_lines(docs.select("doc_id", "source", "text")).select(
        "doc_id", "text", F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id, source, text FROM documents
), lines AS (
  SELECT rn, source, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs WHERE text IS NOT NULL
), pages AS (SELECT source, count(*) AS pages FROM docs GROUP BY source
), counted AS (
  SELECT source, trim(line, ' ') AS line, count(DISTINCT rn) AS n FROM lines
  WHERE trim(line, ' ') <> '' GROUP BY 1, 2
), boilerplate AS (
  SELECT c.source, c.line FROM counted c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}::DOUBLE
), marked AS (
  SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN boilerplate b
  ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line
), cleaned AS (
  SELECT rn, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
    count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY rn
)
SELECT d.doc_id, c.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM docs d LEFT JOIN cleaned c USING (rn)
"""
