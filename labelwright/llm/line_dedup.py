"""Line dedup by site-relative frequency, in DataFrame functions only.

A line of a page is boilerplate if more than `ratio` of its host's pages contain it, and at least
`least_pages` do. Lines are counted once a page, by 128-bit digests and pre-aggregated, so a host or line
that holds much of the corpus meets no single task. The boilerplate of a host is short: at most its mean
number of lines a page, divided by the ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, work_folder

#: Tags that end a line of text.
BLOCK_TAGS = "article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|section|table|td|th|title|tr|ul"
BROADCAST_BYTES = 8 << 20
SALTS = 32


def host_of(url: str = "url") -> Column:
    """Lower-case host of a URL, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def text_lines(html: str = "html") -> Column:
    """Lines of a page's text: scripts, styles and comments go, block tags end lines, other tags go, blanks are trimmed, empty lines go."""
    t = F.coalesce(F.col(html).cast("string"), F.lit(""))
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCK_TAGS})(?:[ \t\r\n/][^>]*)?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  "))), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = 0.2, least_pages: int = 3, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_text (kept lines, joined by line ends) of every row of pages.

    A null html has no lines; a null or odd url has the host ''. Null page_ids and repeated rows are pages of
    their own and count as such. Other columns are not read. Empty in, empty out.
    """
    folder = work_folder(pages.sparkSession)
    lines = cut(pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(url).alias("host"), text_lines(html).alias("lines")), folder, "lines")
    total = lines.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= least_pages)
    digest = lambda x: F.unhex(F.md5(x))
    seen = lines.select("host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("d")).groupBy("host", "d").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    found = seen.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("total"))
    common = cut(found.groupBy("host").agg(F.collect_set("d").alias("common")), folder, "common")
    size = common.agg(F.coalesce(F.sum(F.size("common") * 32 + F.octet_length("host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        both = lines.join(F.broadcast(common), "host", "left")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = lines.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", digest(x))))
    out = both.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


SQL = rf"""
WITH t AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
        '(?i)</?(?:{BLOCK_TAGS})(?:[ \t\r\n/][^>]*)?>', chr(10), 'g'),
        '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(translate(x, chr(9) || chr(13), '  '), ' ')), lambda x: x <> '') AS lines,
    row_number() OVER () AS r
  FROM pages
), u AS (SELECT r, page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t),
n AS (SELECT host, line, count(DISTINCT r) AS n FROM u GROUP BY ALL),
h AS (SELECT host, count(*) AS total FROM t GROUP BY host),
b AS (SELECT host, line FROM n JOIN h USING (host) WHERE n >= 3 AND n > 0.2::DOUBLE * total),
k AS (
  SELECT u.r, count(*) FILTER (b.line IS NOT NULL) AS n_dropped, string_agg(u.line, chr(10) ORDER BY i) FILTER (b.line IS NULL) AS kept
  FROM u LEFT JOIN b ON u.host = b.host AND u.line = b.line GROUP BY u.r
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(kept, '') AS kept_text
FROM t LEFT JOIN k USING (r)
"""
