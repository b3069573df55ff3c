"""Line dedup by site-relative frequency, in DataFrame functions only.

A page's lines are its text blocks. Within a site (the host of the url) a line's ratio is the number
of the site's pages that hold it, divided by all pages of the site; lines on two pages at least and above
a ratio are boilerplate and dropped from every page of that site.

Scale: lines travel as (site, page row, 64-bit line hash); counts are combined before the shuffle, so
a line on every page of a hot site costs one row per task. Only boilerplate lines are joined back
and regrouped by page; the join's large side can be split by adaptive execution. Page texts are
shuffled once, for the join with the dropped line hashes of each page.

Cases: null or empty html has no lines; a page without a host belongs to no site and loses nothing,
as do pages of sites with fewer than ``min_pages`` pages; a line repeated in a page counts once and
is dropped everywhere; a line on one page only stays, however few pages the site has; tags are known in any
case of letters; repeated rows are pages of their own; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstrata.runtime import materialize

#: What holds no visible text, and the tags that end a line. Both are also valid in DuckDB's syntax.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = (
    r"(?i)</?(?:address|article|aside|body|br|div|dd|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main"
    r"|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[ /][^>]*)?>|\n"
)
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def site(url: Column) -> Column:
    """Host of a url, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    """Array of the text lines of an html page, blank ones left out."""
    breaks = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BREAKS, "\n")
    plain = F.regexp_replace(breaks, TAGS, "")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(pages: DataFrame, max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """Per page row: page_id, site, site_pages, n_lines, n_dropped, text (the lines kept, one a row)."""
    cut = pages.select("page_id", site(F.col("url")).alias("site"), lines_of(F.col("html")).alias("lines"))
    # a written row number makes pages distinct, whatever their ids
    cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pages")
    sizes = materialize(cut.groupBy("site").agg(F.count("*").alias("site_pages")), "sites")
    each = cut.where("site != ''").select(
        "site", "row", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")
    )
    common = each.groupBy("site", "line").agg(F.count("*").alias("n")).where("n > 1")
    common = common.join(sizes, "site").where(F.col("site_pages") >= min_pages)
    common = common.where(F.col("n") > F.col("site_pages") * F.lit(max_ratio)).select("site", "line")
    common = materialize(common, "boilerplate")
    dropped = each.join(common, ["site", "line"]).groupBy("row").agg(F.collect_list("line").alias("dropped"))
    out = cut.join(dropped, "row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<bigint>")))
    kept = F.filter("lines", lambda x: ~F.array_contains("dropped", F.xxhash64(x)))
    out = out.withColumn("kept", kept).join(sizes, "site")
    return out.select(
        "page_id",
        "site",
        "site_pages",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
