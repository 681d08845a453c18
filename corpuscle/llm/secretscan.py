"""Secret scans over an incremental blob ledger.

Every text is a blob named by its SHA-256; paths (documents, or versions of them) point to
blobs. The ledger has one row per blob and rule version that has been scanned, with the spans
found. A run scans only the pairs that the ledger lacks, each blob once however many paths
hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, shared_dir, staged


@dataclass(frozen=True)
class Rule:
    """group and least: the part of a match that must have so many characters."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.A


#: The base kinds first, in their order; then what this operator adds, with bounded beginnings, so
#: that a text takes time in proportion to its length.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.A | re.I),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]+", 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,250}:[^\s/:@]{1,250}@"),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def find(rule: Rule, text: str) -> list[dict]:
    """Spans of a rule in a text: leftmost, non-overlapping, code points, end exclusive."""
    pattern = rule.pattern
    if pattern == r"[0-9a-f]+":
        pattern = f"[0-9a-f]{{{rule.least},}}"  # a run is matched whole, so that short ones can be passed over
    return [{"start": m.start(), "end": m.end()} for m in re.compile(pattern, rule.flags).finditer(text) if len(m.group(rule.group)) >= rule.least]


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): paths has one row per document with doc_id and blob; the ledger has a row
    for each blob and rule version seen so far, the given rows and the new ones (with ``stored``
    the new ones alone, to be added to where the given ones are kept).

    Null texts count as empty. Null and repeated ids and repeated rows are paths of their own;
    equal texts are one blob. A ledger may have rows for blobs or versions no longer in use.
    Texts of any length are scanned whole; other columns are ignored, whatever their names; an
    empty table adds nothing to the ledger.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = docs.select("doc_id", "blob")
    # any one path of a blob stands for it: the smallest id; equal rows are scanned with it
    todo = paths.groupBy("blob").agg(F.min("doc_id").alias("_id"))
    if ledger is not None:
        pairs = todo.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])))
        pairs = pairs.select("blob", "_id", "rule.kind", "rule.version").join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        todo = pairs.groupBy("blob", "_id").agg(F.collect_set("kind").alias("kinds"))
    else:
        todo = todo.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    todo = todo.withColumnRenamed("blob", "_blob")
    unseen = docs.join(todo, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("blob", "kinds", "text")
    schema = pa.schema([("blob", pa.binary()), ("kind", pa.string()), ("version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(blob.as_py(), r.kind, r.version, find(r, t)) for blob, kinds, text in zip(*b.columns) for t in [text.as_py()] for have in [set(kinds.as_py())] for r in rules if r.kind in have]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    new = unseen.mapInArrow(run, LEDGER).dropDuplicates(["blob", "kind", "version"])
    new = staged(new, "secrets")
    return paths, new if ledger is None or stored else ledger.select("blob", "kind", "version", "spans").unionByName(new)


def report(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the rules' present versions joined back to all paths: doc_id, n_assign,
    n_access, n_hex, base_sha256, spans, n_spans. Spans stand by start, then kind as listed."""
    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    order = F.array(*[F.lit(r.kind) for r in rules])
    found = ledger.where(F.array_contains(now, F.struct("kind", "version"))).where(F.size("spans") > 0)
    found = found.select("blob", F.array_position(order, F.col("kind")).alias("nth"), "kind", F.inline("spans"))
    found = found.groupBy(F.col("blob").alias("_blob")).agg(F.array_sort(F.collect_list(F.struct("start", "nth", "end", "kind"))).alias("f"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("f", lambda x: x["nth"] <= len(BASE))
    count = lambda k: F.coalesce(F.size(F.filter("f", lambda x: x["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    found = found.select("_blob", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("f")).alias("spans"), F.size("f").cast("long").alias("n_spans"))
    out = paths.join(found, F.col("blob") == F.col("_blob"), "left").drop("_blob")
    zero = {c: 0 for c in ("n_assign", "n_access", "n_hex", "n_spans")}
    return out.fillna(zero | {"spans": ""}).withColumn("base_sha256", F.coalesce("base_sha256", F.sha2(F.lit(""), 256))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")


def keep(ledger: DataFrame, path: str) -> DataFrame:
    """The ledger as stored in ``path``, to which the rows that it lacks are appended: what the next
    run starts from. Rows of ``ledger`` that ``path`` has already are not written again."""
    spark = ledger.sparkSession
    try:
        had = spark.read.schema(LEDGER).parquet(path)
        ledger = ledger.join(had.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    ledger.select("blob", "kind", "version", "spans").write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: over an earlier state of the table (the documents whose crc32(id as text) is even),
    whose ledger is stored, and over what came since; findings go to the paths of both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.coalesce(fold_of("doc_id", 2) == 0, F.lit(False))
    path = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    before, ledger = scan(docs.where(old))
    after, new = scan(docs.where(~old), keep(ledger, path), stored=True)
    return report(before.unionAll(after), keep(new, path))


def _spans_sql(nth: int, r: Rule) -> str:
    """A rule's matches by place: what the pattern splits the text into, added up. The place of
    the group that is measured is told by the pattern itself."""
    p = ("(?i)" if r.flags & re.I else "") + r.pattern.replace("'", "''")
    return f"""SELECT doc_id, {nth} AS nth, '{r.kind}' AS kind, i, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(found[i]) AS n, length(measured[i]) AS m
  FROM (SELECT doc_id, parts, found, measured, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS parts, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {r.group}) AS measured FROM d)) WHERE length(measured[i]) >= {r.least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))}),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, nth) FILTER (nth < {len(BASE)}) AS base,
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, nth) AS spans, count(*) AS n_spans FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN s USING (doc_id)
"""
