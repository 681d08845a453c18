"""Files as tables: scan, format by content, DOCX text, ranking JSON."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.text import first_line, slug, stem

#: Name space of WordprocessingML, and of compatibility markup.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_PAGES = 12


def scan(spark: SparkSession, *targets: str) -> DataFrame:
    """(path, length, content) of PDF, DOCX and DOC files in files or folders, in the order of
    their paths. Targets that don't exist are passed over; without any there is no row."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for t in targets:
        path = jvm.org.apache.hadoop.fs.Path(t)
        if path.getFileSystem(conf).globStatus(path):
            there.append(t)
    if not there:
        return spark.createDataFrame([], "path string, length long, content binary")
    targets = there
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(list(targets))
    return found.where(F.lower("path").rlike("\\.(pdf|docx|doc)$")).select("path", "length", "content").orderBy("path")


def _has_document(content: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> bool:
        try:
            return "word/document.xml" in zipfile.ZipFile(io.BytesIO(b or b"")).namelist()
        except zipfile.BadZipFile:
            return False

    return content.map(one)


def sniff(content: Column) -> Column:
    """pdf, docx, doc (OLE2) or unknown, by the first bytes; a ZIP is DOCX if it has a document."""
    head = F.hex(F.substring(content, 1, 4))
    is_docx = F.pandas_udf(_has_document, "boolean")
    zipped = F.when(head == "504B0304", content)
    return F.when(head == "25504446", "pdf").when(head == "D0CF11E0", "doc").when(zipped.isNotNull() & is_docx(zipped), "docx").otherwise("unknown")


def typed(files: DataFrame) -> DataFrame:
    """Adds format, a warning where the suffix says otherwise, and an error for what isn't read."""
    suffix = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    f = files.withColumn("format", sniff(F.col("content")))
    warning = F.when(suffix.isin("pdf", "docx") & F.col("format").isin("pdf", "docx") & (suffix != F.col("format")), F.concat(F.lit("suffix "), suffix, F.lit(" but content is "), F.col("format")))
    error = F.when(F.col("format") == "doc", "legacy .doc is not read").when(F.col("format") == "unknown", "unknown format")
    return f.withColumn("warning", warning).withColumn("error", error)


def _paragraph(p: ElementTree.Element) -> str:
    """Text of a paragraph without that of text boxes in it and of their fallback copies."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            if c.tag in (f"{_W}txbxContent", f"{_MC}Fallback"):
                continue
            if c.tag == f"{_W}t":
                out.append(c.text or "")
            elif c.tag == f"{_W}tab":
                out.append("\t")
            elif c.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
            walk(c)

    walk(p)
    return "".join(out)


def _boxes(p: ElementTree.Element) -> list[str]:
    """Paragraphs of the text boxes in a paragraph, without the fallback copies."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            if c.tag == f"{_MC}Fallback":
                continue
            if c.tag == f"{_W}txbxContent":
                out.extend(t for q in c.iter(f"{_W}p") if (t := _paragraph(q)).strip())
            else:
                walk(c)

    walk(p)
    return out


def _style(p: ElementTree.Element) -> tuple[bool, float | None]:
    """Bold and size of the first run; headings and titles are bold."""
    named = p.find(f"{_W}pPr/{_W}pStyle")
    bold = named is not None and bool(re.match("Heading|Title", named.get(f"{_W}val", ""), re.I))
    run = p.find(f"{_W}r/{_W}rPr")
    if run is None:
        return bold, None
    b, size = run.find(f"{_W}b"), run.find(f"{_W}sz")
    bold |= b is not None and b.get(f"{_W}val", "1") not in ("0", "false")
    return bold, float(size.get(f"{_W}val")) / 2 if size is not None else None


def docx_parts(content: bytes) -> tuple[list[dict], list[list[list[str]]], list[str]]:
    """Blocks in order, tables of at least 2 x 2, links of a DOCX file."""
    z = zipfile.ZipFile(io.BytesIO(content))
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    blocks: list[dict] = []
    tables: list[list[list[str]]] = []

    def add(text: str, bold: bool = False, size: float | None = None, table: bool = False) -> None:
        if text.strip():
            n = len(blocks)
            blocks.append({"ord": n, "text": text.strip(), "y0": 12.0 * n, "bold": bold, "font_size": size, "in_table": table})

    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            add(_paragraph(e), *_style(e))
            for t in _boxes(e):
                add(t)
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(filter(None, (_paragraph(p).strip() for p in c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            for r in rows:
                add(" | ".join(filter(None, r)), table=True)
            if len(rows) >= 2 and max(map(len, rows)) >= 2:
                tables.append(rows)
    names = z.namelist()
    for part in sorted(n for n in names if re.match(r"word/(header|footer)\d*\.xml$", n)):
        for p in ElementTree.fromstring(z.read(part)).iter(f"{_W}p"):
            add(_paragraph(p))
    links: list[str] = []
    if "word/_rels/document.xml.rels" in names:
        for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
            if r.get("Type", "").endswith("/hyperlink") and r.get("Target") and r.get("TargetMode") != "Internal" and not r.get("Target").startswith("#"):
                links.append(r.get("Target"))
    return blocks, tables, list(dict.fromkeys(links))


def docx_blocks(files: DataFrame) -> DataFrame:
    """files: (path, content). (path, ord, text, y0, bold, font_size, in_table, links, error); a
    file that can't be read is one row with an error."""
    schema = "path string, ord int, text string, y0 double, bold boolean, font_size double, in_table boolean, links array<string>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["path", "ord", "text", "y0", "bold", "font_size", "in_table", "links", "error"]
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    blocks, _, links = docx_parts(content)
                    rows += [{"path": path, **x, "links": links, "error": None} for x in blocks]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append({"path": path, "links": [], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=cols).astype({"ord": "Int32", "y0": "Float64", "font_size": "Float64", "bold": "boolean", "in_table": "boolean"})

    return files.select("path", "content").mapInPandas(run, schema)


#: Fields of the ranking files.
CANDIDATE = "path string, rank long, score double, summary string, matched_skills array<string>, missing_or_weak array<string>, components array<struct<label:string,earned:double,possible:double,detail:string>>, flags array<string>, extraction_confidence double"
RANKING = f"job string, generated_seconds double, shortlist array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in CANDIDATE.split(', ')))}>>, duplicates_folded array<struct<path:string,score:double,duplicate_of:string>>, unreadable array<struct<file:string,error:string>>"


def read_rankings(spark: SparkSession, *targets: str, folded: bool = False) -> DataFrame:
    """(file, job, candidate columns) of every *_ranking.json below the targets, each file once;
    with ``folded`` also the copies folded into others (rank null, duplicate_of)."""
    j = spark.read.schema(RANKING).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_ranking.json").json(list(targets))
    j = j.withColumn("file", F.input_file_name())
    rows = j.select("file", "job", F.inline("shortlist")).dropDuplicates(["file", "path", "rank"])
    if not folded:
        return rows
    copies = j.select("file", "job", F.inline("duplicates_folded")).dropDuplicates(["file", "path"])
    return rows.withColumn("duplicate_of", F.lit(None).cast("string")).unionByName(copies, allowMissingColumns=True)


def read_job(spark: SparkSession, target: str) -> DataFrame:
    """(text): a job description; the content of ``target`` if that is an existing file, else
    ``target`` itself."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if "\n" not in target and target.strip():
        path = jvm.org.apache.hadoop.fs.Path(target.strip())
        system = path.getFileSystem(conf)
        if system.exists(path) and system.getFileStatus(path).isFile():
            return spark.read.text(target.strip(), wholetext=True).select(F.col("value").alias("text"))
    return spark.range(1).select(F.lit(target).alias("text"))


def store_documents(documents: DataFrame, directory: str) -> None:
    """Extracted documents as JSON rows below ``directory``/json and their texts, one row each with
    the path, below ``directory``/text."""
    documents.write.mode("overwrite").json(f"{directory}/json")
    documents.where("ok").select("path", "text").write.mode("overwrite").parquet(f"{directory}/text")


def write_ranking(ranked: DataFrame, path: str, job: str, seconds: float = 0.0, folded: DataFrame | None = None, unreadable: DataFrame | None = None) -> None:
    """One JSON object: job, generated_seconds, shortlist in the order of its ranks,
    duplicates_folded and unreadable (file, error). It is the report of one job, that is one row."""
    def rows(df: DataFrame, first: str) -> Column:
        return F.array_sort(F.collect_list(F.struct(first, *[c for c in df.columns if c != first])))

    out = ranked.agg(F.lit(job).alias("job"), F.lit(round(seconds, 2)).alias("generated_seconds"), rows(ranked, "rank").alias("shortlist"))
    for name, df, first in (("duplicates_folded", folded, "path"), ("unreadable", unreadable, "file")):
        out = out.withColumn(name, F.array().cast("array<string>")) if df is None else out.crossJoin(df.agg(rows(df, first).alias(name)))  # one row each
    out.coalesce(1).write.mode("overwrite").json(path)


def store_results(ranked: DataFrame, directory: str, job: str, text: str = "", **options) -> DataFrame:
    """Writes every candidate as JSON below ``directory``/<job slug>/eval=<name>, and the ranking
    beside them; returns (path, eval_name). Names are the job's and the file's slugs; repeated ones
    get -2, -3, ..."""
    job_slug = slug(F.coalesce(F.nullif(F.lit(job), F.lit("")), first_line(F.lit(text)), F.lit("role")))
    named = ranked.withColumn("_e", F.concat(job_slug, F.lit("_"), slug(stem(F.col("path")), 20), F.lit("_eval")))
    nth = F.row_number().over(W.partitionBy("_e").orderBy("path"))
    named = named.withColumn("eval_name", F.when(nth == 1, F.col("_e")).otherwise(F.concat("_e", F.lit("-"), nth.cast("string")))).drop("_e")
    top = ranked.sparkSession.range(1).select(job_slug.alias("s")).first()["s"]
    named.write.mode("overwrite").partitionBy("eval_name").json(f"{directory}/{top}")
    write_ranking(ranked, f"{directory}/{top}_ranking", job, **options)
    return named.select("path", "eval_name")


def load_ranking(spark: SparkSession, *targets: str) -> DataFrame:
    """The shortlist of ranking files in the order of the ranks; ValueError if there is none."""
    rows = read_rankings(spark, *targets).orderBy("file", "rank")
    if rows.isEmpty():
        raise ValueError("no shortlist in the ranking")
    return rows


def load_labels(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """(grades, thresholds) of a label file: grades as (name, grade), thresholds as a dictionary."""
    j = spark.read.schema("grades map<string,int>, thresholds map<string,double>").option("multiLine", True).json(path)
    grades = j.select(F.explode("grades").alias("name", "grade"))
    held = j.select("thresholds").first()
    return grades, dict(held["thresholds"] or {}) if held else {}


def unique_names(df: DataFrame, name_col: str, order: str, out: str = "unique_name") -> DataFrame:
    """Names that come again get -2, -3, ... before their suffix."""
    nth = F.row_number().over(W.partitionBy(F.lower(name_col)).orderBy(order))
    parts = F.regexp_extract(name_col, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(name_col, "^(.*?)(\\.[^.]*)?$", 2)
    return df.withColumn(out, F.when(nth == 1, F.col(name_col)).otherwise(F.concat(parts[0], F.lit("-"), nth.cast("string"), parts[1])))


def accept_uploads(files: DataFrame, most_bytes: int = 15 << 20, most_files: int = 400) -> DataFrame:
    """(name, size, ord) with error: a wrong suffix, too large, or beyond the number of files."""
    ok = F.lower("name").rlike("\\.(pdf|docx|doc)$")
    # the limit's last place: only that many rows are sorted out, whatever comes in
    last = files.orderBy("ord").limit(most_files).agg(F.max("ord").alias("_last"), F.count("*").alias("_many"))
    files = files.crossJoin(F.broadcast(last))  # one row
    nth = F.when((F.col("_many") == most_files) & (F.col("ord") > F.col("_last")), most_files + 1).otherwise(1)
    return files.withColumn("error", F.when(~ok, "unsupported type").when(F.col("size") > most_bytes, "too large").when(nth > most_files, "too many files")).drop("_last", "_many")


def sheet_title(df: DataFrame, col: str, order: str) -> DataFrame:
    """Worksheet titles: without []:*?/\\, at most 31 characters, unique in any case."""
    t = F.substring(F.regexp_replace(col, "[\\[\\]:*?/\\\\]", "-"), 1, 31)
    t = F.when(F.trim(t) == "", "Sheet").otherwise(t)
    d = df.withColumn("_t", t).withColumn("_n", F.row_number().over(W.partitionBy(F.lower("_t")).orderBy(order)))
    tail = F.concat(F.lit("-"), F.col("_n").cast("string"))
    return d.withColumn("title", F.when(F.col("_n") == 1, F.col("_t")).otherwise(F.concat(F.expr("substring(_t, 1, 31 - length(cast(_n as string)) - 1)"), tail))).drop("_t", "_n")
