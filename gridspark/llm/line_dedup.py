"""Boilerplate removal by how often a line stands on the pages of its host.

A page's lines are counted once each by (host, line); a line that stands on more than ``ratio`` of its host's
pages is boilerplate. Each page has a bounded number of lines on average, so a host has at most (mean distinct
lines a page) / ``ratio`` boilerplate lines, however many pages it has: that short list, and not the lines, joins
the pages, and they are cut where they lie. Pages are parsed once, into a table of their lines. A host with a third of all pages costs no more than others: counts
are summed before the shuffle, and the join with the lists is one that Spark can broadcast or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table, written

#: Elements whose tags end a line.
BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
SPACE = r"[ \t\n\x0B\f\r]"
#: What is not text: scripts, styles and comments, to their end or, if they have none, to that of the page. No part of
#: a page is looked at by more than one attempt at a match, so malformed pages take no longer than others.
HIDDEN = "(?is)<(?:" + "|".join(rf"{x}(?:[ \t\n\x0B\f\r/][^>]*)?(?:>|\z).*?(?:</{x}{SPACE}*>|\z)" for x in ("script", "style")) + r"|!--.*?(?:-->|\z))"
BREAK = rf"(?i)</?(?:{BREAKS})(?:[ \t\n\x0B\f\r/][^<>]*)?>"
TAG = "<[^<>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def host(url: Column) -> Column:
    """The host of a URL in lower case; '' for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines(html: Column) -> Column:
    """The lines of a page's text: block elements and line ends part them, other tags go, whitespace is folded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, "")
    text = F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float) -> DataFrame:
    """(host, boilerplate: the keys of the lines to drop) of every host that has such lines; pages has host, keys."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    seen = pages.select("host", F.explode(F.array_distinct("keys")).alias("key"))
    counts = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    over = counts.join(totals, "host").where(F.col("n") > ratio * F.col("total"))
    return over.groupBy("host").agg(F.collect_set("key").alias("boilerplate"))


def drop_lines(pages: DataFrame, ratio: float = 0.2) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text of every row of ``pages`` (page_id, url, html).

    A line is dropped, in each place it stands, if two or more and more than ``ratio`` of its host's pages hold it. A
    null html has no line and an empty text. Pages without a host count as one host, ''. Rows that repeat a page are
    pages of their own. An unclosed script, style or comment goes on to the end of its page; a '<' that no '>' follows
    before the next '<' is text. Pages of any length take time in proportion. Other columns are not read. An empty
    table gives an empty result.
    """
    text = lines(F.col("html"))
    cut = written(pages.select("page_id", host(F.col("url")).alias("host"), text.alias("lines")), "lines")
    cut = cut.withColumn("keys", F.transform("lines", F.md5))
    lists = written(boilerplate(cut, ratio), "boilerplate")
    told = cut.join(lists, "host", "left").withColumn("hits", F.array_intersect("keys", F.coalesce("boilerplate", F.array().cast("array<string>"))))
    kept = F.when(F.size("hits") == 0, F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("hits"), F.md5(x)))
    )
    return told.select("page_id", "host", "lines", kept.alias("kept")).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "pages"))


ORACLE = rf"""
WITH raw AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host, regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g') AS t
  FROM pages
), cut AS (
  SELECT page_id, host, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(t, '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'), '[ \t\x0B\f\r]+', ' ', 'g'),
    chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM raw
), totals AS (
  SELECT host, count(*) AS total FROM cut GROUP BY host
), counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) GROUP BY host, line
), lists AS (
  SELECT host, list(line) AS boilerplate FROM counts JOIN totals USING (host) WHERE n > 1 AND n > 0.2::DOUBLE * total GROUP BY host
), told AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boilerplate, []::VARCHAR[]), x)) AS kept
  FROM cut LEFT JOIN lists USING (host)
)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM told
"""
