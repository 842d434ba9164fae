"""Site-relative line frequency (operator 2), in DataFrame operations only.

A line (text between newlines, without surrounding blanks) is boilerplate on a host if it is in at least ``min_pages``
of the host's pages and in more than ``ratio`` of them. Boilerplate lines are dropped from their host's pages.

Counting goes over 64-bit hashes of lines, which shuffles few bytes; partial sums are made before the shuffle and the key
holds the line besides the host, so that a host with a third of all pages is spread over all tasks. Hashes that
pass are counted again by the line itself, so that the result doesn't rest on them. A host has fewer than (its mean number
of lines in a page) / ratio boilerplate lines; they become one array for each host. The arrays are broadcast if their
measured size allows, and else joined on (host, salt).

Defined cases: blank lines are neither counted nor dropped. A null text stays null and its page counts in the total. A null
host is a host of its own. Repeated rows are pages of their own. A line twice in a page counts once and both go.
A page of boilerplate alone becomes empty. An empty table gives an empty result. Other columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, stored


@dataclass(frozen=True)
class Params:
    """What is boilerplate, and how its list reaches the pages.

    Three in a hundred pages is where a line that stands on a host by chance or as a shared passage ends and one of its layout
    begins; on a host of few pages a line near that share may fall on either side. Below ``min_pages`` no share says much.
    """

    ratio: float = 0.03
    min_pages: int = 5
    broadcast_chars: int = 16 << 20
    broadcast_hosts: int = 200_000
    salts: int = 32


BLANKS = " \t\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def page_lines(pages: DataFrame, host: str, text: str) -> DataFrame:
    """host and line: one row for each distinct line with content of each page."""
    own = F.array_distinct(F.transform(F.split(F.col(quoted(text)), "\n"), _bare))
    return pages.select(F.col(quoted(host)).alias("lf__h"), F.explode(own).alias("lf__l")).where("lf__l <> ''")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", p: Params = Params()) -> DataFrame:
    """(lf__h, lf__l, lf__n): boilerplate lines of each host, and the pages that hold them; stored in the shared folder."""
    totals = stored(pages.groupBy(F.col(quoted(host)).alias("lf__h")).agg(F.count("*").alias("lf__all")), "host-totals")
    if totals.count() <= p.broadcast_hosts:
        totals = F.broadcast(totals)
    often = lambda df: df.where(F.col("lf__n") >= p.min_pages).join(totals.withColumnRenamed("lf__h", "lf__t"), F.col("lf__h").eqNullSafe(F.col("lf__t"))).where(F.col("lf__n") > p.ratio * F.col("lf__all")).drop("lf__t", "lf__all")
    lines = page_lines(pages, host, text).withColumn("lf__x", F.xxhash64("lf__l"))
    likely = stored(often(lines.groupBy("lf__h", "lf__x").agg(F.count("*").alias("lf__n"))).select(F.col("lf__h").alias("lf__g"), F.col("lf__x").alias("lf__y")), "line-candidates")
    if likely.count() * 64 <= p.broadcast_chars:
        likely = F.broadcast(likely)
    sure = lines.join(likely, F.col("lf__h").eqNullSafe(F.col("lf__g")) & (F.col("lf__x") == F.col("lf__y")), "left_semi")
    return stored(often(sure.groupBy("lf__h", "lf__l").agg(F.count("*").alias("lf__n"))), "boilerplate")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", p: Params = Params(), counts: bool = False) -> DataFrame:
    """``pages`` with the host's boilerplate lines taken out of ``text``; with ``counts``, also n_lines and n_dropped (in place of columns of these names)."""
    found = boilerplate(pages, host, text, p)
    size = found.agg(F.sum(F.length("lf__l") + F.coalesce(F.length(F.col("lf__h").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    lists = found.groupBy("lf__h").agg(F.collect_list("lf__l").alias("lf__drop"))
    # All columns of a page go into one struct, so that none of them can clash with what is added.
    rows = pages.select(F.struct(*[F.col(quoted(c)) for c in pages.columns]).alias("lf__row"), F.col(quoted(host)).alias("lf__g"), F.col(quoted(text)).alias("lf__text"))
    if size <= p.broadcast_chars:
        joined = rows.join(F.broadcast(lists), F.col("lf__g").eqNullSafe(F.col("lf__h")), "left")
    else:
        salt = F.pmod(F.xxhash64("lf__text"), F.lit(p.salts))
        spread = lists.withColumn("lf__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.salts - 1).cast("long"))))
        joined = rows.withColumn("lf__r", salt).join(spread, F.col("lf__g").eqNullSafe(F.col("lf__h")) & (F.col("lf__r") == F.col("lf__s")), "left")
    split = F.split("lf__text", "\n")
    # The page's own boilerplate is found by hashing and is short; each line is looked up in that, not in the host's list.
    joined = joined.withColumn("lf__hits", F.array_intersect(F.transform(split, _bare), "lf__drop"))
    kept = F.when(F.size("lf__hits") == 0, split).otherwise(F.filter(split, lambda x: ~F.array_contains("lf__hits", _bare(x))))
    out = joined.withColumn("lf__kept", F.when(F.col("lf__drop").isNull(), split).otherwise(kept))
    cleaned = F.when(F.col("lf__drop").isNull(), F.col("lf__text")).otherwise(F.array_join("lf__kept", "\n"))
    tally = {"n_lines": F.size(split), "n_dropped": F.size(split) - F.size("lf__kept")} if counts else {}
    own = [cleaned.alias(c) if c == text else F.col(f"lf__row.{quoted(c)}").alias(c) for c in pages.columns if c.lower() not in tally]
    return out.select(*own, *[F.when(F.col("lf__text").isNull(), 0).otherwise(c).cast("long").alias(n) for n, c in tally.items()])


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def oracle(p: Params = Params(), docs: str = "documents") -> str:
    """DuckDB SQL for ``drop_boilerplate`` with counts over documents by source."""
    return f"""
    WITH pages_ AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM {docs}),
    lines AS (SELECT DISTINCT r, source, trim(l, ' ' || chr(9) || chr(13)) AS l FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS l FROM pages_)),
    totals AS (SELECT source, count(*) AS n FROM pages_ GROUP BY source),
    drops AS (SELECT source, list(l) AS dropped FROM (
      SELECT a.source, l FROM lines a JOIN totals t ON a.source IS NOT DISTINCT FROM t.source WHERE l <> ''
      GROUP BY a.source, l, t.n HAVING count(*) >= {p.min_pages} AND count(*) > {p.ratio} * t.n) GROUP BY source),
    cut AS (SELECT doc_id, p.source AS host, text, string_split(text, chr(10)) AS ls,
      list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(dropped, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
      FROM pages_ p LEFT JOIN drops d ON p.source IS NOT DISTINCT FROM d.source)
    SELECT doc_id, host, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
      CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text FROM cut"""
