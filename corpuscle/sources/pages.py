"""Pages of PDF files by a pluggable reader, as tables of spans, and the blocks they make.

No PDF library is part of this package. A reader is a callable ``bytes -> Iterable[dict]`` that
yields pages in order: width, height, images (their number), spans (block, text, x0, y0, x1, y1,
size, bold), tables (x0, y0, x1, y1, rows), links, and n_pages on the first. It runs on the
executors; what it raises becomes a row with an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import strip

from .files import MAX_PAGES

Reader = Callable[[bytes], Iterable[dict]]
SPAN = "struct<block:int,text:string,x0:double,y0:double,x1:double,y1:double,size:double,bold:boolean>"
TABLE = "struct<x0:double,y0:double,x1:double,y1:double,rows:array<array<string>>>"
PAGES = f"path string, page int, n_pages int, width double, height double, images int, spans array<{SPAN}>, tables array<{TABLE}>, links array<string>, error string"


def read_pages(files: DataFrame, reader: Reader, most: int = MAX_PAGES) -> DataFrame:
    """files: (path, content). One row a page, at most ``most`` a file (the reader is not asked for
    more); a file that can't be read, an encrypted one say, is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ", 1)[0] for f in ("path", "page", "n_pages", "width", "height", "images", "spans", "tables", "links", "error")]
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    for n, page in enumerate(reader(bytes(content or b"")), 1):
                        if n > most:
                            break
                        rows.append({"path": path, "page": n, "error": None, **{k: page.get(k) for k in ("n_pages", "width", "height", "images", "spans", "tables", "links")}})
                except Exception as e:  # the reader is not ours: its failure is a row's, not the job's
                    rows = [r for r in rows if r["path"] != path]
                    rows.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page": "Int32", "n_pages": "Int32", "images": "Int32", "width": "Float64", "height": "Float64"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def page_warnings(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """(path, warnings): that a document has more pages than are read, and pages without text that
    hold images."""
    image = F.when(image_only(F.col("spans"), F.col("images")), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": no text layer but images present — scanned page")))
    each = pages.where("error is null").groupBy("path").agg(F.max("n_pages").alias("n"), F.array_sort(F.collect_list(F.when(image.isNotNull(), F.struct("page", image.alias("w"))))).alias("i"))
    long = F.when(F.col("n") > most, F.concat(F.lit("document has "), F.col("n").cast("string"), F.lit(f" pages; processing first {most} (unusual for a resume — check this is not a portfolio)")))
    return each.select("path", F.concat(F.array_compact(F.array(long)), F.transform("i", lambda x: x["w"])).alias("warnings"))


def image_only(spans: Column, images: Column) -> Column:
    """A page without any text that holds images."""
    none = ~F.exists(F.coalesce(spans, F.array().cast(f"array<{SPAN}>")), lambda s: strip(F.coalesce(s["text"], F.lit(""))) != "")
    return none & (F.coalesce(images, F.lit(0)) > 0)


def span_blocks(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans: keys, block, nth, line, text, x0, y0, x1, y1, size, bold. One row a block that has
    text: its spans joined, lines by line ends; the box around them, the greatest size, and bold if
    more than 60 % of the characters are."""
    s = spans.withColumn("_len", F.length(strip(F.coalesce("text", F.lit("")))))
    line = s.groupBy(*keys, "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("t"))
    line = line.where(strip(F.col("t")) != "").groupBy(*keys, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))
    box = s.groupBy(*keys, "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("font_size"), F.coalesce(F.try_divide(F.sum(F.when(F.col("bold"), F.col("_len")).otherwise(0)), F.sum("_len")) > 0.6, F.lit(False)).alias("bold"))
    return line.join(box, [*keys, "block"])


def whole_tables(tables: Column) -> Column:
    """Tables without their empty rows; those with fewer than two rows left are none."""
    rows = lambda t: F.filter(t["rows"], lambda r: F.exists(r, lambda c: strip(F.coalesce(c, F.lit(""))) != ""))
    cut = F.transform(F.coalesce(tables, F.array().cast(f"array<{TABLE}>")), lambda t: F.struct(t["x0"].alias("x0"), t["y0"].alias("y0"), t["x1"].alias("x1"), t["y1"].alias("y1"), rows(t).alias("rows")))
    return F.filter(cut, lambda t: F.size(t["rows"]) >= 2)


def table_text(rows: Column) -> Column:
    """Cells joined by bars, rows by line ends."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def document_links(pages: DataFrame) -> DataFrame:
    """(path, links): the different links of a document's pages in the order in which they come."""
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("links", F.array().cast("array<string>")).alias("l")))), lambda x: x["l"]))
    return pages.groupBy("path").agg(F.array_distinct(F.filter(each, lambda x: x.isNotNull() & (x != ""))).alias("links"))
