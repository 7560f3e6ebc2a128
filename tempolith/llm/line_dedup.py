"""Line deduplication by site-relative frequency.

For every host the pages that contain a line are divided by the host's pages; lines above a
ratio are boilerplate and go from every page of that host.  Lines are compared by their MD5,
counted once a page, and pre-aggregated before the shuffle.  A host has at most (mean
distinct lines of its pages / ratio) such lines, so they fit one row a host; that table is
broadcast only if its measured size is below a bound, and joined otherwise.

Defined cases: null texts are pages without lines and stay null; a null host is a host of its
own; blank lines are kept and never counted; repeated rows count as pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Bytes of the boilerplate table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _filled(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, *, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(_host, _lines): the digests of each host's boilerplate lines; hosts without any are absent."""
    lines = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), _filled), _digest))
    slim = pages.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    seen = slim.select("_host", F.explode(lines).alias("_line"))
    counts = seen.groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    totals = slim.groupBy("_host").agg(F.count("*").alias("_pages")).withColumnRenamed("_host", "_site")
    common = counts.join(totals, F.col("_host").eqNullSafe(F.col("_site"))).where(F.col("_n") > ratio * F.col("_pages"))
    return common.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_lines"))


def with_kept_lines(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """pages with one struct column more, ``lines`` (or ``lines_`` ...): text, n_lines, n_dropped."""
    out = fresh(pages, "lines")
    table = materialize(boilerplate(pages, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages), "boilerplate")
    size = table.agg(F.sum(F.size("_lines") * 16 + 64).alias("b")).first().b or 0
    known = table.select(F.col("_host").alias(fresh(pages, "known_host")), F.col("_lines").alias(fresh(pages, "known_lines")))
    host, lines = known.columns
    joined = pages.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, pages[host_col].eqNullSafe(known[host]), "left")
    all_lines, drop = fresh(pages, "all_lines"), lambda x: _filled(x) & F.array_contains(F.col(lines), _digest(x))
    kept = F.filter(F.col(all_lines), lambda x: ~F.coalesce(drop(x), F.lit(False)))
    made = joined.withColumn(all_lines, F.split(F.col(text_col), "\n")).withColumn(
        out,
        F.struct(
            F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias("text"),
            F.coalesce(F.size(F.filter(all_lines, _filled)), F.lit(0)).cast("long").alias("n_lines"),
            F.when(F.col(lines).isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(all_lines) - F.size(kept)).cast("long").alias("n_dropped"),
        ),
    )
    return made.select(*[F.col(f"`{c}`") for c in pages.columns], out)


def drop_boilerplate(pages: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """pages with boilerplate lines cut from the text; rows and columns stay."""
    out = fresh(pages, "lines")
    made = with_kept_lines(pages, text_col=text_col, **options)
    return made.select(*[F.col(f"{out}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns])


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines (with a word), n_dropped and the SHA-256 of the text that is left."""
    made = with_kept_lines(docs.select("doc_id", "source", "text"), **options)
    return made.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("text_sha256"))


#: The report in DuckDB's SQL.
LINE_SQL = r"""
with pages as (select row_number() over () as rid, doc_id, source, text from documents),
lines as (select rid, doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from pages where text is not null),
filled as (select * from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
counts as (select source, line, count(distinct rid) as n from filled group by source, line having count(distinct rid) >= 5),
totals as (select source, count(*) as pages from pages group by source),
bad as (select c.source, c.line from counts c join totals t on c.source is not distinct from t.source where c.n > 0.05 * t.pages),
marked as (select l.*, regexp_matches(l.line, '[^\x20\x09-\x0D]') as has, b.line is not null as dropped from lines l left join bad b on l.line = b.line and l.source is not distinct from b.source),
texts as (select rid, count(*) filter (where has) as n_lines, count(*) filter (where dropped) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '') as kept from marked group by rid)
select p.doc_id, coalesce(t.n_lines, 0)::bigint as n_lines, coalesce(t.n_dropped, 0)::bigint as n_dropped,
  case when p.text is not null then sha256(t.kept) end as text_sha256
from pages p left join texts t on p.rid = t.rid
"""
