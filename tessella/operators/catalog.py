"""Crawl and download catalog: URL columns, links, crawl frontier, reuse of downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import web
from tessella.session import cut_lineage, release


def url_columns(pages: DataFrame, url: str = "page_url") -> DataFrame:
    """page_id, site key, authority, domain slug, file name and type, shared-drive id of each page's address."""
    c = F.col(url)
    name = web.file_name(c)
    return pages.select("page_id", web.site_key(c).alias("site_key"), web.authority(c).alias("authority"), web.domain_slug(c).alias("slug"), name.alias("file_name"), web.file_type(name).alias("file_type"), web.drive_id(c).alias("drive_id"))


def domain_counts(pages: DataFrame, url: str = "page_url") -> DataFrame:
    return pages.groupBy(F.coalesce(web.domain_slug(F.lower(url)), F.lit("unknown")).alias("slug")).agg(F.count(F.lit(1)).alias("pages"))


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, heading) in document order; blank headings are dropped."""
    rows = pages.select("page_id", F.posexplode("headings").alias("pos", "heading"))
    return rows.where(F.trim("heading") != "").select("page_id", "pos", F.trim("heading").alias("heading"))


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the title, else the address."""
    return pages.select("page_id", F.coalesce(F.nullif(F.trim("page_title"), F.lit("")), F.col("page_url")).alias("title"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, internal, download, media): different links in the pages' text."""
    rows = pages.select("page_id", "page_url", F.explode(F.array_distinct(web.text_links(F.col("page_text")))).alias("link"))
    link = F.lower("link")
    return rows.select("page_id", "link", web.is_internal(F.lower("page_url"), link).alias("internal"), web.is_download(F.col("link")).alias("download"), web.is_media(F.col("link")).alias("media"))


def html_catalog(pages: DataFrame, html: str = "html") -> DataFrame:
    """Page columns with title, headings, visible text and links of their HTML."""
    return pages.withColumn("_p", web.parse_page(F.col(html))).select(*pages.columns, "_p.*")


def distinct_files(chunks: DataFrame, source: str = "source", cap: int | None = None) -> DataFrame:
    """Sorted different sources of all chunks; with ``cap`` of the first ``cap`` chunks by id only."""
    taken = chunks if cap is None else chunks.orderBy(chunks.columns[0]).limit(cap)
    return taken.select(source).where(F.coalesce(source, F.lit("")) != "").distinct().orderBy(source)


def crawl_order(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, max_pages: int | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(url, depth): breadth-first frontier over an edge table (url, link); media links are not visited.

    ``max_pages`` keeps the first pages by depth and address. The addresses of ``failed`` (url) count as visited but lead nowhere, and
    addresses that hold the path of a failed page seen at an earlier depth are skipped. Each level is an anti-join with what was
    visited, cut by a written table.
    """
    seen = front = cut_lineage(seeds.select("url").where(~web.is_media(F.col("url"))).distinct().withColumn("depth", F.lit(0)))
    d, total = 0, seen.count()
    while (max_depth is None or d < max_depth) and (max_pages is None or total < max_pages):
        d += 1
        alive = front if failed is None else front.join(failed.select("url").distinct(), "url", "left_anti")
        nxt = alive.join(edges, "url").select(F.col("link").alias("url")).where(F.col("url").isNotNull() & ~web.is_media(F.col("url"))).distinct().join(seen.select("url"), "url", "left_anti")
        if failed is not None:
            bad = seen.join(failed.select("url").distinct(), "url", "left_semi").select(web.url_path(F.col("url")).alias("bad")).where("bad <> ''").distinct()
            nxt = nxt.join(F.broadcast(bad), F.contains(F.col("url"), F.col("bad")), "left_anti")  # the few paths that failed
        nxt = nxt.withColumn("depth", F.lit(d))
        if max_pages is not None:
            nxt = nxt.orderBy("url").limit(max_pages - total)
        front = cut_lineage(nxt)
        new = front.count()
        if not new:
            release(front)
            break
        grown = cut_lineage(seen.unionByName(front))
        if seen is not front:
            release(seen)
        seen, total = grown, total + new
    return seen


def new_downloads(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog rows to add: a link the resource already has gives none, one of another resource a skipped copy.

    ``asked``: resource_id, download_url, origin_url. ``files``: resource_id, download_url, file_name.
    """
    own = asked.join(files.select("resource_id", "download_url").distinct(), ["resource_id", "download_url"], "left_anti")
    other = files.groupBy("download_url").agg(F.min("file_name").alias("known_name"))
    row = own.join(other, "download_url", "left")
    return row.select("resource_id", "origin_url", "download_url", F.coalesce("known_name", web.file_name(F.col("download_url"))).alias("file_name"), F.col("known_name").isNotNull().alias("skipped"))
