"""Registered queries of the library and the SQL that states the same.

Each query is a function of (spark, sf_dir); ``SQL`` has the DuckDB statement of those that SQL
can express. Doubles are rounded to 6 places on both sides, as sums may differ in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions import quality as Q
from corpuscle.functions import text as T
from corpuscle.functions import vectors as V
from corpuscle.operators import candidates, dedup, evaluation, experience, extraction, judge, layout, report, retrieval, scoring, skills
from corpuscle.operators.ordering import settled
from corpuscle.sources import files, pages
from corpuscle.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space at both ends, for regexp_replace.
_ENDS = r"'^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g'"


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- retrieval

#: The skills that the flagship query looks for in ``documents``.
SKILLS = (("thing", "mandatory", "thing heat"), ("hand", "mandatory", "hand"), ("eren", "mandatory", "eren"), ("mention", "preferred", "mention action"), ("ches", "preferred", "ches"), ("tion", "preferred", "tion"))
_SKILL_ROWS = ", ".join(f"({i}, '{s}', '{imp}', '{q}')" for i, (s, imp, q) in enumerate(SKILLS))
_TOK = r"regexp_extract_all(lower({}), '[a-z0-9][a-z0-9+#.\-]*')"
_BM25 = rf"""
sk(pos, skill, importance, q_text) AS (VALUES {_SKILL_ROWS}),
qt AS (SELECT skill, term, count(*) AS times FROM (SELECT skill, unnest({_TOK.format('q_text')}) AS term FROM sk) GROUP BY ALL),
ln AS (SELECT doc_id, i - 1 AS chunk_id, l[i] AS chunk FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))),
tk AS (SELECT doc_id, chunk_id, {_TOK.format('chunk')} AS w FROM ln),
dc AS (SELECT doc_id, count(*) AS n_chunks, avg(len(w)) AS avg_dl FROM tk GROUP BY doc_id),
tf AS (SELECT doc_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, len(w) AS dl, unnest(w) AS term FROM tk) GROUP BY ALL),
st AS (SELECT tf.*, count(*) OVER (PARTITION BY doc_id, term) AS df, n_chunks, avg_dl FROM tf JOIN dc USING (doc_id)),
bm AS (SELECT doc_id, chunk_id, skill, sum(times * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS bm25
  FROM st JOIN qt USING (term) GROUP BY doc_id, chunk_id, skill)"""


def _skills(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SKILLS)], "pos int, skill string, importance string, q_text string")


def _best_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = retrieval.line_chunks(read(spark, sf_dir, "documents"))
    return chunks, retrieval.bm25(chunks, F.broadcast(retrieval.query_terms(_skills(spark))))


@register(f"""WITH {_BM25},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, skill ORDER BY bm25 DESC, chunk_id) AS k FROM bm) WHERE k = 1 AND bm25 > 0),
asm AS (SELECT d.doc_id, sk.skill, importance, CASE WHEN b.chunk_id IS NULL THEN 'none' WHEN b.chunk_id = 0 THEN 'mentioned' WHEN regexp_matches(ln.chunk, '[0-9]') THEN 'strong' ELSE 'used' END AS depth
  FROM documents d CROSS JOIN sk LEFT JOIN best b ON b.doc_id = d.doc_id AND b.skill = sk.skill LEFT JOIN ln ON ln.doc_id = b.doc_id AND ln.chunk_id = b.chunk_id),
bk AS (SELECT doc_id, sum(CASE WHEN importance = 'mandatory' THEN w END) AS m, sum(CASE WHEN importance = 'preferred' THEN w END) AS p,
  count(*) FILTER (depth IN ('used', 'strong')) AS n_shown, count(*) FILTER (depth = 'strong') AS n_strong
  FROM (SELECT *, CASE depth WHEN 'strong' THEN 1.0 WHEN 'used' THEN 0.8 WHEN 'mentioned' THEN 0.4 ELSE 0.0 END AS w FROM asm) GROUP BY doc_id),
sc AS (SELECT doc_id, round(m / 3 * 70 + p / 3 * 30, 6)::DOUBLE AS score, n_shown::BIGINT AS n_shown, n_strong::BIGINT AS n_strong FROM bk)
SELECT row_number() OVER (ORDER BY score DESC, n_shown DESC, n_strong DESC, doc_id) AS rank, doc_id, score, n_shown, n_strong FROM sc""")
def flagship_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 evidence for six skills, the depth rule (first line: listed; later lines: shown),
    bucket scores and the ranking of all documents."""
    chunks, scored = _best_lines(spark, sf_dir)
    best = retrieval.top_chunks(scored, "bm25", 1).join(chunks, ["doc_id", "chunk_id"])
    depth = judge.rule_depth(F.when(F.col("chunk_id") > 0, "experience").otherwise("skills"), F.col("chunk"))
    best = best.select("doc_id", "skill", depth.alias("depth"))
    sk = F.broadcast(_skills(spark).select("skill", "importance"))
    grid = read(spark, sf_dir, "documents").select("doc_id").crossJoin(sk)  # six rows a document: the label table itself
    asm = grid.join(best, ["doc_id", "skill"], "left").fillna("none", ["depth"])
    rows = scoring.score(scoring.buckets(asm, ["doc_id"])).withColumn("score", r6("score"))
    return scoring.rank(rows, ["score", "n_shown", "n_strong"], tie="doc_id").select("rank", "doc_id", "score", "n_shown", "n_strong")


@register(f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n_tokens, len(list_distinct({_TOK.format('text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@register(f"WITH {_BM25} SELECT doc_id, chunk_id::BIGINT AS chunk_id, term, tf, df, n_chunks, dl::BIGINT AS dl, round(avg_dl, 6) AS avg_dl FROM st")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieval.term_stats(retrieval.line_chunks(read(spark, sf_dir, "documents")))
    return s.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "term", "tf", "df", "n_chunks", F.col("dl").cast("long").alias("dl"), r6("avg_dl").alias("avg_dl"))


@register(f"WITH {_BM25} SELECT doc_id, skill, k, chunk_id::BIGINT AS chunk_id, bm25 FROM (SELECT doc_id, skill, chunk_id, b AS bm25, row_number() OVER (PARTITION BY doc_id, skill ORDER BY b DESC, chunk_id) AS k FROM (SELECT *, round(bm25, 6) AS b FROM bm)) WHERE k <= 3 AND bm25 > 0")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored = _best_lines(spark, sf_dir)
    return retrieval.top_chunks(scored.withColumn("bm25", r6("bm25")), "bm25", 3).select("doc_id", "skill", F.col("k").cast("long").alias("k"), F.col("chunk_id").cast("long").alias("chunk_id"), "bm25")


_HASHED = r"""SELECT {keys}, ('0x' || substr(md5(f), 31, 2))::INT AS bucket, count(*) AS n FROM (SELECT {keys}, unnest(list_concat(w,
  list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS f FROM (SELECT {keys}, """ + _TOK.format("{text}") + r""" AS w, string_split(lower({text}), '') AS c FROM {table})) GROUP BY ALL"""


@register(f"""WITH h AS ({_HASHED.format(keys='doc_id', text='text', table='documents')})
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS w FROM h""")
def hashing_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hashed(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "bucket", r6("w").alias("w"))


@register(f"""WITH {_BM25},
cv AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_id)) AS w FROM ({_HASHED.format(keys='doc_id, chunk_id', text='chunk', table='ln')})),
qv AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY skill)) AS v FROM ({_HASHED.format(keys='skill', text='q_text', table='sk')})),
se AS (SELECT doc_id, chunk_id, skill, sum(w * v) AS semantic FROM cv JOIN qv USING (bucket) GROUP BY ALL),
gr AS (SELECT ln.doc_id, ln.chunk_id, sk.skill, coalesce(bm25, 0) AS b, coalesce(semantic, 0) AS s FROM ln CROSS JOIN sk LEFT JOIN bm USING (doc_id, chunk_id, skill) LEFT JOIN se USING (doc_id, chunk_id, skill)),
fu AS (SELECT *, round(CASE WHEN bx > bn THEN 0.5 * (b - bn) / (bx - bn) ELSE 0 END + CASE WHEN sx > sn THEN 0.5 * (s - sn) / (sx - sn) ELSE 0 END, 6) AS fused
  FROM (SELECT *, min(b) OVER g AS bn, max(b) OVER g AS bx, min(s) OVER g AS sn, max(s) OVER g AS sx FROM gr WINDOW g AS (PARTITION BY doc_id, skill)))
SELECT doc_id, skill, k, chunk_id::BIGINT AS chunk_id, fused FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, skill ORDER BY fused DESC, chunk_id) AS k FROM fu) WHERE k <= 3 AND fused > 0""")
def hybrid_fusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sk = _skills(spark)
    fused = retrieval.fuse(retrieval.line_chunks(read(spark, sf_dir, "documents")), F.broadcast(retrieval.query_terms(sk)), sk)
    # a share like 45/128 ends on a half: by the product, as the SQL rounds, not by the digits of a sum just below it
    fused = fused.withColumn("fused", F.floor(F.col("fused") * 1e6 + 0.5) / 1e6)
    return retrieval.top_chunks(fused, "fused", 3).select("doc_id", "skill", F.col("k").cast("long").alias("k"), F.col("chunk_id").cast("long").alias("chunk_id"), "fused")


@register("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, k, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM p) WHERE k <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set (every 100th id) against all rows; the five nearest by dot product."""
    e = read(spark, sf_dir, "embeddings")
    return V.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


@register("""SELECT l_orderkey, l_linenumber, round(CASE WHEN hi > lo THEN (l_quantity - lo) / (hi - lo) ELSE 0 END, 6) AS scaled
FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS lo, max(l_quantity) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem)""")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(retrieval.minmax("l_quantity", "l_orderkey")).alias("scaled"))


# ---------------------------------------------------------------- quality

_HINTS = " + ".join(f"contains(lower(t), '{h}')::BIGINT" for h in Q.HINTS)
_CONTACT = r"regexp_matches(t, '[\w.+-]+@[\w-]+\.[\w.]+') OR regexp_matches(t, '\+?\d[\d\s().-]{7,}\d') OR regexp_matches(t, '(?i)(https?://|www\.|linkedin\.com|github\.com)')"
_QUALITY = rf"""
q0 AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
q1 AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z][A-Za-z''\x{{2019}}\-]*') AS w FROM q0),
q2 AS (SELECT doc_id, length(t) AS chars, length(regexp_replace(t, '\s', '', 'g')) AS non_space, len(w)::BIGINT AS n_words,
  length(t) - length(regexp_replace(t, '\(cid:\d+\)|[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}]', '', 'g')) AS garbage, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS alpha,
  len(list_filter(w, lambda x: length(x) = 1))::BIGINT AS singles, len(list_filter(w, lambda x: (length(x) <= 2 OR regexp_matches(x, '[aeiouyAEIOUY]')) AND length(x) <= 22))::BIGINT AS plausible,
  {_HINTS} AS hints, ({_CONTACT}) AS contact FROM q1),
q3 AS (SELECT *, CASE WHEN chars < 120 THEN 0.55 WHEN chars < 400 THEN 0.25 ELSE 0.0 END::DOUBLE AS p_density, least(0.6, coalesce(garbage / nullif(chars, 0), 0) * 6.0)::DOUBLE AS p_garbage,
  (CASE WHEN coalesce(alpha / nullif(non_space, 0), 0) < 0.45 THEN 0.35 WHEN coalesce(alpha / nullif(non_space, 0), 0) < 0.6 THEN 0.12 ELSE 0 END)::DOUBLE AS p_alpha,
  (CASE WHEN n_words < 20 THEN 0 WHEN singles / n_words > 0.4 THEN 0.45 WHEN singles / n_words > 0.25 THEN 0.18 ELSE 0 END)::DOUBLE AS p_single,
  (CASE WHEN n_words < 20 THEN 0 WHEN plausible / n_words < 0.7 THEN 0.4 WHEN plausible / n_words < 0.85 THEN 0.15 ELSE 0 END)::DOUBLE AS p_plausible,
  (CASE WHEN hints > 0 OR contact THEN 0 WHEN chars > 400 THEN 0.2 ELSE 0.08 END)::DOUBLE AS p_landmarks FROM q2),
q4 AS (SELECT *, round(CASE WHEN chars = 0 THEN 0 ELSE greatest(0, least(1, 1 - p_density - p_garbage - p_alpha - p_single - p_plausible - p_landmarks)) END, 6)::DOUBLE AS q_score FROM q3),
q5 AS (SELECT *, CASE WHEN chars = 0 THEN 'empty' WHEN q_score >= 0.75 THEN 'good' WHEN q_score >= 0.45 THEN 'suspect' ELSE 'bad' END AS verdict FROM q4)"""
_Q_COLS = "doc_id, chars, non_space, n_words, garbage, alpha, singles, plausible, hints, contact, q_score, verdict"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.signals(read(spark, sf_dir, "documents")).withColumn("q_score", r6("q_score"))
    return d.withColumn("verdict", Q.verdict(F.col("q_score"), F.col("chars") == 0))


@register(f"WITH {_QUALITY} SELECT {_Q_COLS} FROM q5")
def quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select(*_Q_COLS.split(", "))


@register(f"WITH {_QUALITY} SELECT lang, verdict, count(*) AS n, round(avg(q_score), 6) AS mean_score FROM q5 JOIN documents USING (doc_id) GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).groupBy("lang", "verdict").agg(F.count("*").alias("n"), r6(F.avg("q_score")).alias("mean_score"))


@register(f"WITH {_QUALITY} SELECT doc_id, hints, contact, p_landmarks FROM q5")
def landmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("doc_id", "hints", "contact", "p_landmarks")


@register(f"WITH {_QUALITY} SELECT doc_id, verdict IN ('empty', 'bad', 'suspect') AS need_ocr, verdict IN ('empty', 'bad', 'suspect') AND coalesce(quality, 0) > q_score + 0.05 AS take_ocr FROM q5 LEFT JOIN labels USING (doc_id)")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are read a second time, and whether that reading (here the label) is better."""
    d = _quality(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    need = Q.need_ocr(F.col("verdict"), F.lit(False))
    return d.select("doc_id", need.alias("need_ocr"), (need & Q.take_ocr(F.col("q_score"), F.coalesce("quality", F.lit(0)).cast("double"))).alias("take_ocr"))


@register("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS conf, l_extendedprice / 100 AS words FROM lineitem),
s AS (SELECT *, round(conf / 100 * (0.35 + 0.65 * least(1, words / 250)), 6) AS s FROM a)
SELECT l_orderkey, l_linenumber AS attempt, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS k FROM s) WHERE k = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several readings by confidence and length; of equals the earliest."""
    score = F.col("l_quantity") * 2 / 100 * (0.35 + 0.65 * F.least(F.lit(1.0), F.col("l_extendedprice") / 100 / 250))
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(score).alias("s"))
    best = a.groupBy("l_orderkey").agg(F.max(F.struct("s", (-F.col("l_linenumber")).alias("n"))).alias("b"))
    return best.select("l_orderkey", (-F.col("b.n")).alias("attempt"), F.col("b.s").alias("score"))


@register("""SELECT l_orderkey, round(greatest(0, least(1, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 0.6 * max(l_discount) * 10 + 0.4 * avg(CASE WHEN l_returnflag = 'R' THEN l_quantity * 2 END) / 100 ELSE max(l_discount) * 10 END)), 3) AS confidence
FROM lineitem GROUP BY l_orderkey""")
def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_discount") * 10).alias("q"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 2)).alias("c"))
    return g.select("l_orderkey", Q.confidence(F.col("q"), F.col("c")).alias("confidence"))


# ---------------------------------------------------------------- duplicates

_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@register(f"""SELECT doc_id, fp, min(doc_id) OVER (PARTITION BY fp) AS rep, count(*) OVER (PARTITION BY fp) AS copies
FROM (SELECT doc_id, substr(sha256({_PLAIN.format("coalesce(text, '')")}), 1, 32) AS fp FROM documents)""")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", dedup.exact_fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))
    # aggregated before joining back, so that a large group is one row
    return d.join(d.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "fp").select("doc_id", "fp", "rep", "copies")


_BITS = ", ".join(f"sum(((h >> {i}) & 1)::INT * 2 - 1) AS b{i}" for i in range(64))
_PACK = " + ".join(f"CASE WHEN b{i} > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
_SIMHASH = rf"""
sw AS (SELECT doc_id, list_filter(string_split({_PLAIN.format('text')}, ' '), lambda x: x <> '') AS w FROM documents),
ss AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS s FROM sw),
sb AS (SELECT doc_id, {_BITS} FROM (SELECT doc_id, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM ss) GROUP BY doc_id),
sf AS (SELECT d.doc_id, coalesce({_PACK}, 0::UBIGINT) AS fp FROM documents d LEFT JOIN sb USING (doc_id))"""


@register(f"WITH {_SIMHASH} SELECT doc_id, lpad(format('{{:x}}', fp), 16, '0') AS fp FROM sf")
def simhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.simhash(read(spark, sf_dir, "documents")).select("doc_id", dedup.hex16(F.col("fp")).alias("fp"))


@register(f"""WITH {_SIMHASH}, n AS (SELECT fp, min(doc_id) AS doc_id FROM sf GROUP BY fp)
SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.fp, y.fp))::INT AS d FROM n x JOIN n y ON x.doc_id < y.doc_id AND bit_count(xor(x.fp, y.fp)) <= 3""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different fingerprints up to three bits apart, each by its smallest document."""
    return dedup.near_pairs(dedup.simhash(read(spark, sf_dir, "documents")))


@register(f"""WITH RECURSIVE {_SIMHASH}, e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sf x JOIN sf y ON bit_count(xor(x.fp, y.fp)) <= 3),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS rep FROM r GROUP BY a""")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class: the smallest document reachable over near pairs."""
    prints = settled(dedup.simhash(read(spark, sf_dir, "documents")))  # read three times
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    reps = dedup.classes(dedup.near_pairs(prints), nodes.select("doc_id"))
    named = nodes.join(reps, "doc_id").select("fp", "rep")
    return prints.join(named, "fp").select("doc_id", "rep")


_QUOTE = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@register(f"""WITH d AS (SELECT doc_id, {_QUOTE.format('text')} AS hay FROM documents), b AS (SELECT item_id, {_QUOTE.format('text')} AS q FROM benchmark)
SELECT doc_id, item_id, contains(hay, q) AS whole FROM d JOIN b ON contains(hay, q) OR (len(string_split(q, ' ')) > 3 AND contains(hay, array_to_string(string_split(q, ' ')[1:6], ' ')))""")
def contamination_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items, taken as quotes, are grounded in which documents."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return judge.grounded_pairs(read(spark, sf_dir, "documents").select("doc_id", "text"), items)


@register(r"SELECT doc_id, regexp_extract(coalesce(text, ''), '[\w.+-]+@[\w-]+\.[\w.]+', 0) AS email, trim(regexp_extract(coalesce(string_split(text, chr(10))[1], ''), '(?:\+\d{1,3}[\s-]?)?\d{5}[\s-]?\d{5}|\d{3}[\s-]?\d{3}[\s-]?\d{4}', 0)) AS phone FROM documents")
def identity_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail address of the whole text, the phone number of its header, here the first line."""
    return report.contacts(read(spark, sf_dir, "documents").withColumn("header", F.split("text", "\n")[0]), "text", "header")


# ---------------------------------------------------------------- sequences


@register("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN length(text) < 120 THEN role || ':' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'header') AS section FROM conversations""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short turns as headings: each turn has the last heading up to it."""
    head = F.when(F.length("text") < 120, F.concat(F.col("role"), F.lit(":"), F.col("turn").cast("string")))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("header")).alias("section"))


_RUNS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {gap} THEN 1 ELSE 0 END AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)"""


@register(_RUNS.format(gap=86_400_000_000) + " SELECT user_id, run::BIGINT AS run, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us FROM r GROUP BY ALL")
def paragraph_sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.paragraphs_by_gap(read(spark, sf_dir, "events"), 86_400)
    return out.select("user_id", "run", "n", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("stop").cast("timestamp")).alias("stop_us"))


_SPANS = """s AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1970-01-01', greatest(max(l_shipdate), any_value(o_orderdate))::DATE) AS b
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"""


@register(f"""WITH {_SPANS}, m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, sum(b - a)::BIGINT AS months, count(*) AS n_islands FROM (SELECT o_custkey, island, min(a) AS a, max(b) AS b FROM i GROUP BY ALL) GROUP BY o_custkey""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the union of each customer's spans from order to last shipment (in days)."""
    last = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    spans = read(spark, sf_dir, "orders").join(last, "o_orderkey").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("start"), F.unix_date(F.to_date(F.greatest("s", "o_orderdate"))).alias("end"))
    return experience.union_months(spans, ["o_custkey"])


@register("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN y * 12 + m WHEN 1 THEN y * 12 + 1 ELSE y * 12 + m END AS first_month,
  CASE o_orderkey % 3 WHEN 0 THEN (y + 2) * 12 + 6 WHEN 1 THEN (y + 1) * 12 + 12 ELSE 2030 * 12 + 7 END AS last_month, o_orderkey % 3 = 2 AS is_current
FROM (SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m FROM orders)""")
def date_ranges_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges read from prose made of the orders' dates, in three of the forms."""
    d = F.col("o_orderdate")
    y = F.year(d)
    year = lambda n: (y + n).cast("string")
    name = F.element_at(F.array(*[F.lit(m.title()) for m in experience.MONTHS]), F.month(d))
    forms = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Engineer, "), name, F.lit(" "), year(0), F.lit(" – June "), year(2)))
    forms = forms.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Analyst "), year(0), F.lit(" to "), year(1)))
    forms = forms.otherwise(F.concat(F.lpad(F.month(d).cast("string"), 2, "0"), F.lit("/"), year(0), F.lit(" - Present")))
    out = read(spark, sf_dir, "orders").select("o_orderkey", F.inline(experience.date_ranges(forms, F.lit("2030-07-01").cast("date"))))
    return out.select("o_orderkey", F.col("start").alias("first_month"), F.col("end").alias("last_month"), "is_current")


@register("""WITH x AS (SELECT doc_id, n_chars % 5 AS k, 2000 + (n_chars % 15)::INT AS y FROM documents)
SELECT doc_id, round(CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN (n % 20 + 1) ELSE (23 + CASE WHEN k >= 3 THEN 23 ELSE 0 END) / 12.0 END, 6)::DOUBLE AS years,
  CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'claimed' ELSE 'date-ranges' END AS method FROM (SELECT x.*, n_chars AS n FROM x JOIN documents USING (doc_id))""")
def experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from sections made of the documents' numbers: none, a claim, one range, two apart
    ranges, and these with a third one inside; dates of education don't count."""
    k, y = F.col("n_chars") % 5, (2000 + F.col("n_chars") % 15).cast("int")
    span = lambda a, b: F.concat((y + a).cast("string"), F.lit(" - "), (y + b).cast("string"))
    claim = F.concat(F.lit("Over "), (F.col("n_chars") % 20 + 1).cast("string"), F.lit("+ years of practice."))
    body = F.when(k == 0, "Worked on things.").when(k == 1, claim).when(k == 2, span(0, 1)).when(k == 3, F.concat_ws("\n", span(0, 1), span(5, 6))).otherwise(F.concat_ws("\n", span(0, 1), span(5, 6), F.concat(F.lit("Mar "), (y + 5).cast("string"), F.lit(" to Apr "), (y + 6).cast("string"))))
    d = read(spark, sf_dir, "documents")
    s = d.select("doc_id", F.lit("experience").alias("section"), body.alias("body")).unionAll(d.select("doc_id", F.lit("education"), span(-9, -5)))
    return experience.estimate(s, F.lit("2026-07-01").cast("date")).select("doc_id", r6("years").alias("years"), "method")


# ---------------------------------------------------------------- scores

_DEPTHS = "CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'mentioned' WHEN 2 THEN 'used' ELSE 'strong' END"
_SCORED = f"""
a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'mandatory' ELSE 'preferred' END AS importance, {_DEPTHS} AS depth FROM lineitem),
b AS (SELECT l_orderkey, count(*) FILTER (importance = 'mandatory') AS m_n, count(*) FILTER (importance = 'preferred') AS p_n, coalesce(sum(w) FILTER (importance = 'mandatory'), 0) AS m, coalesce(sum(w) FILTER (importance = 'preferred'), 0) AS p,
  count(*) FILTER (depth IN ('used', 'strong')) AS n_shown, count(*) FILTER (depth = 'strong') AS n_strong, count(*) FILTER (importance = 'mandatory' AND depth = 'none') AS m_missing
  FROM (SELECT *, CASE depth WHEN 'strong' THEN 1.0 WHEN 'used' THEN 0.8 WHEN 'mentioned' THEN 0.4 ELSE 0.0 END::DOUBLE AS w FROM a) GROUP BY l_orderkey),
e AS (SELECT b.*, CASE WHEN l_orderkey % 3 = 0 THEN 5.0 END::DOUBLE AS required, CASE WHEN l_orderkey % 5 <> 0 THEN (l_orderkey % 7)::DOUBLE END AS years FROM b),
f AS (SELECT *, CASE WHEN required > 0 AND years IS NOT NULL THEN 15.0 ELSE 0.0 END AS w_e FROM e),
c AS (SELECT *, coalesce(m / nullif(m_n, 0), 0) * (CASE WHEN p_n = 0 THEN 100 WHEN m_n = 0 THEN 0 ELSE 70 END) * (100 - w_e) / 100 AS m_earned,
  coalesce(p / nullif(p_n, 0), 0) * (CASE WHEN m_n = 0 THEN 100 WHEN p_n = 0 THEN 0 ELSE 30 END) * (100 - w_e) / 100 AS p_earned,
  CASE WHEN w_e = 0 THEN 0 WHEN years + 0.5 >= required THEN 15 ELSE years / required * 15 END AS e_earned FROM f)"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.element_at(F.array(*[F.lit(x) for x in ("none", "mentioned", "used", "strong")]), F.col("l_linenumber") % 4 + 1)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.concat(F.lit("skill"), F.col("l_linenumber").cast("string")).alias("skill"), F.when(F.col("l_returnflag") == "N", "mandatory").otherwise("preferred").alias("importance"), depth.alias("depth"), F.col("l_discount").alias("confidence"))


@register(f"WITH {_SCORED} SELECT l_orderkey, m_n, p_n, m_missing, round(m_earned, 6)::DOUBLE AS m_earned, round(p_earned, 6)::DOUBLE AS p_earned, round(e_earned, 6)::DOUBLE AS e_earned, round(m_earned + p_earned + e_earned, 6)::DOUBLE AS score FROM c")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates, their lines as judged skills."""
    k = F.col("l_orderkey")
    rows = scoring.score(scoring.buckets(_assessed(spark, sf_dir), ["l_orderkey"]), F.when(k % 3 == 0, 5.0), F.when(k % 5 != 0, (k % 7).cast("double")))
    return rows.select("l_orderkey", "m_n", "p_n", "m_missing", *[r6(c).alias(c) for c in ("m_earned", "p_earned", "e_earned", "score")])


@register(f"""WITH {_SCORED} SELECT l_orderkey, coalesce(string_agg(skill, ',' ORDER BY l_linenumber) FILTER (depth <> 'none'), '') AS matched,
  concat_ws('; ', CASE WHEN count(*) FILTER (importance = 'mandatory' AND depth = 'none') > 0 THEN 'missing required skill(s): ' || string_agg(skill, ', ' ORDER BY l_linenumber) FILTER (importance = 'mandatory' AND depth = 'none') END,
  CASE WHEN count(*) FILTER (conf < 0.45 AND depth <> 'none') > 0 THEN 'low-confidence judgement(s): ' || string_agg(skill, ', ' ORDER BY l_linenumber) FILTER (conf < 0.45 AND depth <> 'none') END) AS flags
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'mandatory' ELSE 'preferred' END AS importance, {_DEPTHS} AS depth, 'skill' || l_linenumber AS skill, l_discount AS conf FROM lineitem) GROUP BY l_orderkey""")
def explain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.explain(_assessed(spark, sf_dir), ["l_orderkey"])
    return x.select("l_orderkey", F.array_join("matched", ",").alias("matched"), F.array_join("flags", "; ").alias("flags"))


_RANKED = "row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal / 100, 1) DESC, length(c_mktsegment) DESC, c_custkey)"


@register(f"SELECT c_nationkey, c_custkey, {_RANKED} AS rank FROM customer")
def rank_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.round(F.col("c_acctbal") / 100, 1).alias("score"), F.length("c_mktsegment").alias("shown"))
    return scoring.rank(c, ["score", "shown"], partition=["c_nationkey"], tie="c_custkey").select("c_nationkey", "c_custkey", "rank")


@register("""SELECT c_nationkey, c_custkey, rank, coalesce(round(gap, 6), -1)::DOUBLE AS gap, coalesce(gap < 2, FALSE) AS near_tie FROM (SELECT *, lag(c_acctbal) OVER w - c_acctbal AS gap, row_number() OVER w AS rank
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))""")
def near_tie_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scoring.rank(read(spark, sf_dir, "customer"), ["c_acctbal"], partition=["c_nationkey"], tie="c_custkey")
    return c.select("c_nationkey", "c_custkey", "rank", F.coalesce(r6("gap"), F.lit(-1.0)).alias("gap"), "near_tie")


# ---------------------------------------------------------------- evaluation

_EVAL = "ev AS (SELECT doc_id AS name, (n_chars % 500) / 5.0 AS score, quality * 2 + 1 - toxic AS grade FROM documents JOIN labels USING (doc_id))"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("name"), (F.col("n_chars") % 500 / 5.0).alias("score"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))


@register(f"""WITH {_EVAL}, r AS (SELECT rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY grade DESC) + (count(*) OVER (PARTITION BY grade) - 1) / 2.0 AS b FROM ev)
SELECT round(coalesce(corr(a, b), 0), 6) AS rho FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.spearman(_graded(spark, sf_dir)).select(r6("rho").alias("rho"))


@register(f"""WITH {_EVAL}, p AS (SELECT sign(x.score - y.score) * sign(x.grade - y.grade) AS s, x.score = y.score AS tx, x.grade = y.grade AS ty FROM ev x JOIN ev y ON x.name < y.name)
SELECT round(coalesce(sum(s) / nullif(sqrt(count(*) FILTER (NOT tx) * count(*) FILTER (NOT ty)), 0), 0), 6) AS tau_b FROM p""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kendall(_graded(spark, sf_dir)).select(r6("tau_b").alias("tau_b"))


def _ndcg_sql(k: int | None) -> str:
    return f"""(SELECT sum((pow(2, g) - 1) / log2(p + 1)) FROM (SELECT grade AS g, row_number() OVER (ORDER BY score DESC, name) AS p FROM ev) WHERE p <= {k or 10**9})
  / (SELECT sum((pow(2, g) - 1) / log2(p + 1)) FROM (SELECT grade AS g, row_number() OVER (ORDER BY grade DESC, name) AS p FROM ev) WHERE p <= {k or 10**9})"""


@register(f"WITH {_EVAL} " + " UNION ALL ".join(f"SELECT '{n}' AS at_k, round({_ndcg_sql(k)}, 6) AS ndcg" for n, k in (("3", 3), ("5", 5), ("all", None))))
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graded(spark, sf_dir)
    parts = [evaluation.ndcg(g, k).select(F.lit(n).alias("at_k"), r6("ndcg").alias("ndcg")) for n, k in (("3", 3), ("5", 5), ("all", None))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@register(f"""WITH {_EVAL}, t AS (SELECT grade FROM ev ORDER BY score DESC, name LIMIT 5) SELECT avg((grade >= 3)::INT)::DOUBLE AS precision_3, avg((grade >= 2)::INT)::DOUBLE AS precision_2 FROM t""")
def precision_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graded(spark, sf_dir)
    return evaluation.precision_at(g, 5, 3).toDF("precision_3").crossJoin(evaluation.precision_at(g, 5, 2).toDF("precision_2"))  # one row each


@register(f"WITH {_EVAL} SELECT round(min(score) FILTER (grade >= 2) - max(score) FILTER (grade < 2), 6) AS separation FROM ev")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.separation(_graded(spark, sf_dir), 2).select(r6("separation").alias("separation"))


@register(f"WITH {_EVAL} SELECT count(*) AS inversions FROM ev x JOIN ev y ON x.grade > y.grade AND x.score < y.score")
def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.inversions(_graded(spark, sf_dir))


@register(f"WITH {_EVAL} SELECT grade, count(*) AS n, round(avg(score), 6) AS mean_score, min(score) AS min_score, max(score) AS max_score, min(pos) AS best_pos, max(pos) AS worst_pos FROM (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS pos FROM ev) GROUP BY grade")
def by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_tier(_graded(spark, sf_dir)).withColumn("mean_score", r6("mean_score"))


@register(f"WITH {_EVAL} SELECT name, round(rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0, 6)::DOUBLE AS avg_rank FROM ev")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_ranks(_graded(spark, sf_dir), "score", "avg_rank").select("name", "avg_rank")


@register("SELECT source, count(*) AS unlabelled, min(doc_id) AS first_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def labelled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return d.groupBy("source").agg(F.count("*").alias("unlabelled"), F.min("doc_id").alias("first_id"))


@register("""WITH o AS (SELECT o_orderpriority AS metric, round(avg(o_totalprice), 6) AS v, year(o_orderdate) % 2 AS run FROM orders GROUP BY ALL)
SELECT a.metric, a.v AS old_value, b.v AS new_value, round(b.v - a.v, 6) AS delta, CASE WHEN a.metric = '1-URGENT' THEN b.v > a.v ELSE b.v < a.v END AS worse FROM o a JOIN o b ON a.metric = b.metric AND a.run = 0 AND b.run = 1""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric"), (F.year("o_orderdate") % 2).alias("run")).agg(r6(F.avg("o_totalprice")).alias("value"))
    return evaluation.compare(o.where("run = 0"), o.where("run = 1"), ("1-URGENT",)).withColumn("delta", r6("delta"))


@register("""WITH m AS (SELECT c_mktsegment AS metric, round(avg(c_acctbal), 6) AS value FROM customer GROUP BY ALL) SELECT metric, value, 4500.0::DOUBLE AS least, value >= 4500 AS passed FROM m WHERE metric <> 'BUILDING'""")
def threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("metric")).agg(r6(F.avg("c_acctbal")).alias("value"))
    limits = c.where("metric != 'BUILDING'").select("metric", F.lit(4500.0).alias("least"))
    return evaluation.thresholds(c, limits)


# ---------------------------------------------------------------- reports

_BAL = "(c_acctbal + 1000) / 110"


@register(f"""WITH c AS (SELECT c_name, round({_BAL}) AS s, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
SELECT count(*) AS total, max(s) AS top, round(avg(s), 6) AS mean, min_by(c_name, rank) AS leader, count(*) FILTER (s >= 90) AS n_90, count(*) FILTER (s >= 80 AND s < 90) AS n_80, count(*) FILTER (s >= 70 AND s < 80) AS n_70, count(*) FILTER (s < 70) AS n_low FROM c""")
def summary_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), ((F.col("c_acctbal") + 1000) / 110).alias("score"), F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey").alias("rank"))
    return report.summarise(c).withColumn("mean", r6("mean"))


@register(f"SELECT c_custkey, CASE WHEN s >= 80 THEN 'STRONG MATCH' WHEN s >= 60 THEN 'GOOD MATCH' WHEN s >= 40 THEN 'MODERATE' WHEN s >= 20 THEN 'WEAK MATCH' ELSE 'LOW MATCH' END AS status, CASE WHEN s >= 75 THEN 'Strong match' WHEN s >= 55 THEN 'Moderate match' WHEN s >= 30 THEN 'Weak match' ELSE 'Poor match' END AS verdict FROM (SELECT c_custkey, {_BAL} AS s FROM customer)")
def status_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("c_acctbal") + 1000) / 110
    return read(spark, sf_dir, "customer").select("c_custkey", scoring.status(s).alias("status"), scoring.verdict(s).alias("verdict"))


@register(f"""SELECT c_mktsegment, count(*) FILTER (NOT d) AS candidates, count(*) FILTER (d) AS duplicates, round(max(s) FILTER (NOT d), 6) AS top, round(median(s) FILTER (NOT d), 6) AS median_score, count(*) FILTER (NOT d AND s >= 70) AS n_70, count(*) FILTER (NOT d AND s = 0) AS n_zero, max_by(c_name, (s, c_name)) FILTER (NOT d) AS best
FROM (SELECT *, {_BAL} AS s, c_custkey % 10 = 0 AS d FROM customer) GROUP BY c_mktsegment""")
def workbook_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("s", (F.col("c_acctbal") + 1000) / 110)
    out = report.workbook_summary(c, "c_mktsegment", "s", "c_name", F.col("c_custkey") % 10 == 0)
    return out.withColumns({"top": r6("top"), "median_score": r6("median_score")})


@register("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN r END AS rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 25 OR c_custkey % 10 = 0")
def top_with_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scoring.rank(read(spark, sf_dir, "customer"), ["c_acctbal"], tie="c_custkey")
    c = c.withColumn("rank", F.when(F.col("c_custkey") % 10 != 0, F.col("rank")))
    return report.top_printed(c, 25).select("c_custkey", "rank")


@register("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '12') OR contains(lower('segment ' || c_mktsegment), '12'))")
def ui_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("name"), F.lit("role").alias("role"), F.array("c_mktsegment").alias("skills"), F.col("c_mktsegment").alias("status"))
    return report.ui_filter(c, "12", "BUILDING").select("c_custkey", "c_name")


@register("""SELECT c_custkey, upper(left(string_split(replace(c_name, '#', ' '), ' ')[1], 1) || left(string_split(replace(c_name, '#', ' '), ' ')[2], 1)) AS initials,
  (list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x))) % 360)::INT AS hue FROM customer""")
def avatars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", report.initials(F.translate("c_name", "#", " ")).alias("initials"), report.hue(F.col("c_name")).alias("hue"))


def _near(x: str, digits: int) -> str:
    p = f"{10**digits}::DOUBLE"
    low, high = f"floor({x} * {p}) / {p}", f"(floor({x} * {p}) + 1) / {p}"
    return f"(CASE WHEN {x} - {low} < {high} - {x} THEN {low} WHEN {x} - {low} > {high} - {x} THEN {high} WHEN floor({x} * {p})::BIGINT % 2 = 0 THEN {low} ELSE {high} END)"


_NAMES = "string_agg(skill, ', ' ORDER BY l_linenumber) FILTER"
_REPORT = f"""{_SCORED}, sk AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'mandatory' ELSE 'preferred' END AS importance, {_DEPTHS} AS depth, 'skill' || l_linenumber AS skill, l_discount AS conf FROM lineitem),
n AS (SELECT l_orderkey, count(*) FILTER (importance = 'mandatory' AND depth IN ('used', 'strong')) AS m_shown, count(*) FILTER (importance = 'mandatory' AND depth = 'mentioned') AS m_listed, count(*) FILTER (importance = 'mandatory' AND depth = 'strong') AS m_strong,
  count(*) FILTER (importance = 'preferred' AND depth IN ('used', 'strong')) AS p_shown, count(*) FILTER (importance = 'preferred' AND depth = 'mentioned') AS p_listed, count(*) FILTER (importance = 'preferred' AND depth = 'none') AS p_missing,
  {_NAMES} (importance = 'mandatory' AND depth = 'none') AS lost, {_NAMES} (conf < 0.45 AND depth <> 'none') AS unsure FROM sk GROUP BY l_orderkey),
r0 AS (SELECT *, l_orderkey % 10 / 10 AS ec, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'Engineer' END AS role, {_near("m_earned::DOUBLE", 2)} AS me, {_near("p_earned::DOUBLE", 2)} AS pe, {_near("e_earned::DOUBLE", 2)} AS ee,
  ((CASE WHEN p_n = 0 THEN 100 WHEN m_n = 0 THEN 0 ELSE 70 END) * (100 - w_e) / 100)::DOUBLE AS mp, ((CASE WHEN m_n = 0 THEN 100 WHEN p_n = 0 THEN 0 ELSE 30 END) * (100 - w_e) / 100)::DOUBLE AS pp FROM c JOIN n USING (l_orderkey)),
r1 AS (SELECT *, {_near("(me + pe + ee)", 1)} AS s FROM r0),
r2 AS (SELECT *, concat_ws('; ', 'missing required skill(s): ' || lost, CASE WHEN required > 0 AND years IS NULL THEN 'JD requires 5+ years but no dates could be read from the resume — experience not scored, review manually' END,
  CASE WHEN ec < 0.6 THEN 'low extraction confidence (' || printf('%.2f', ec) || ') — recommend manual review of the source resume' END, 'low-confidence judgement(s): ' || unsure) AS flags,
  CASE WHEN m_n = 0 THEN 'no skills in this bucket' ELSE m_shown || ' demonstrated, ' || m_listed || ' listed-only, ' || m_missing || ' missing of ' || m_n END AS md, CASE WHEN p_n = 0 THEN 'no skills in this bucket' ELSE p_shown || ' demonstrated, ' || p_listed || ' listed-only, ' || p_missing || ' missing of ' || p_n END AS pd,
  CASE WHEN years + 0.5 >= required THEN years::INT || ' years, meets the 5-year minimum' ELSE years::INT || ' of 5 years required' END || CASE WHEN l_orderkey % 2 = 1 THEN ' (self-reported, no dated roles to verify against)' ELSE '' END AS ed FROM r1)"""


@register(f"""WITH {_REPORT} SELECT l_orderkey, s::DOUBLE AS score, concat_ws(' ', (CASE WHEN s >= 75 THEN 'Strong match' WHEN s >= 55 THEN 'Moderate match' WHEN s >= 30 THEN 'Weak match' ELSE 'Poor match' END) || (CASE WHEN role <> '' THEN ' for ' || role ELSE '' END) || '.',
  CASE WHEN m_n > 0 THEN m_shown || '/' || m_n || ' required skills demonstrated' || (CASE WHEN m_strong > 0 THEN ' (' || m_strong || ' strongly)' ELSE '' END) || '.' END, CASE WHEN p_n > 0 THEN p_shown || '/' || p_n || ' preferred demonstrated.' END,
  CASE WHEN years IS NOT NULL AND required > 0 THEN years::INT || ' years experience (' || (CASE WHEN years + 0.5 >= required THEN 'meets' ELSE 'below' END) || ' the 5-year bar).' WHEN years IS NOT NULL THEN years::INT || ' years experience.' END, 'Missing: ' || lost || '.') AS summary, flags,
  concat_ws(chr(10), 'Score ' || {_near("s", 0)}::INT || '/100 for c' || l_orderkey || '.pdf:', '  - Mandatory skills: ' || {_near("me", 0)}::INT || ' of ' || {_near("mp", 0)}::INT || ' — ' || md, '  - Preferred skills: ' || {_near("pe", 0)}::INT || ' of ' || {_near("pp", 0)}::INT || ' — ' || pd,
  CASE WHEN w_e > 0 THEN '  - Years of experience: ' || {_near("ee", 0)}::INT || ' of 15 — ' || ed END, CASE WHEN flags <> '' THEN '  flags: ' || flags END) AS explanation FROM r2""")
def candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates: score, summary sentence, flags and the explanation."""
    out = candidates.score_candidates(*_people(spark, sf_dir))
    return out.select(F.col("doc_id").alias("l_orderkey"), "score", "summary", F.array_join("flags", "; ").alias("flags"), "explanation")


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _assessed(spark, sf_dir).withColumnRenamed("l_orderkey", "doc_id")
    k = F.col("doc_id")
    people = a.select("doc_id").distinct().select("doc_id", F.concat(F.lit("in/c"), k.cast("string"), F.lit(".pdf")).alias("path"), (k % 10 / 10).alias("extraction_confidence"), F.when(k % 4 == 0, "").otherwise("Engineer").alias("role_title"), F.when(k % 3 == 0, 5.0).alias("min_years"), F.when(k % 5 != 0, (k % 7).cast("double")).alias("years"), F.when(k % 2 == 1, "claimed").otherwise("date-ranges").alias("method"), F.array().cast("array<string>").alias("warnings"))
    return a, people


@register(f"""WITH {_REPORT}, ag AS (SELECT l_orderkey, string_agg(skill || ' — ' || depth, chr(10) ORDER BY l_linenumber) AS a FROM sk GROUP BY l_orderkey)
SELECT 'c' || l_orderkey || '.pdf' AS "Resume", s::DOUBLE AS "Score", row_number() OVER (ORDER BY s DESC, l_orderkey) AS "Rank", printf('%.1f / %.1f', {_near("me", 1)}, {_near("mp", 1)}) || chr(10) || md AS "Mandatory Skills", a AS "Assessment",
  CASE WHEN years IS NULL THEN '' ELSE years::INT || ' yrs (' || (CASE WHEN l_orderkey % 2 = 1 THEN 'claimed' ELSE 'date-ranges' END) || ')' END AS "Experience", replace(flags, '; ', chr(10)) AS "Flags" FROM r2 JOIN ag USING (l_orderkey)""")
def sheet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported sheet's columns for the same candidates."""
    a, people = _people(spark, sf_dir)
    ranked = scoring.rank(candidates.score_candidates(a, people), ["score"], tie="doc_id")
    rows = report.sheet_rows(ranked, a.withColumn("evidence", F.lit("")), F.lit("Engineer"))
    return rows.select("Resume", "Score", "Rank", "Mandatory Skills", "Assessment", "Experience", "Flags")


@register(f"""WITH {_REPORT} SELECT 'c' || l_orderkey AS id, {_near("s", 0)}::INT AS "matchScore", CASE WHEN s >= 80 THEN 'STRONG MATCH' WHEN s >= 60 THEN 'GOOD MATCH' WHEN s >= 40 THEN 'MODERATE' WHEN s >= 20 THEN 'WEAK MATCH' ELSE 'LOW MATCH' END AS status,
  CASE WHEN years IS NULL THEN 'Not stated' ELSE years::INT || ' Yrs' END AS "experienceYears", 'C' || l_orderkey AS name, ec::DOUBLE AS "extractionConfidence" FROM r2""")
def frontend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the interface shows of them; the names come from the file names."""
    a, people = _people(spark, sf_dir)
    ranked = candidates.score_candidates(a, people).withColumn("rank", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, pos int, section string, body string")
    return candidates.frontend(ranked, a.withColumn("evidence", F.lit("")), none).select("id", "matchScore", "status", "experienceYears", "name", "extractionConfidence")


@register(f"""WITH {_EVAL}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS rank FROM ev WHERE name % 3 <> 0), t AS (SELECT grade FROM rk ORDER BY rank LIMIT 5)
SELECT (SELECT count(*) FROM rk) AS n_labelled, (SELECT count(*) FROM ev WHERE name % 3 = 0) AS n_unlabelled, (SELECT round(avg((grade >= 3)::INT), 6) FROM t)::DOUBLE AS precision_at_5_qualified,
  (SELECT round(min(score) FILTER (grade >= 1) - max(score) FILTER (grade < 1), 6) FROM rk) AS separation, (SELECT count(*) FROM rk x JOIN rk y ON x.grade > y.grade AND x.score < y.score) AS n_inversions,
  (SELECT round(corr(a, b), 6) FROM (SELECT rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY grade DESC) + (count(*) OVER (PARTITION BY grade) - 1) / 2.0 AS b FROM rk)) AS spearman,
  round((SELECT sum((pow(2, grade) - 1) / log2(rank + 1)) FROM rk) / (SELECT sum((pow(2, grade) - 1) / log2(p + 1)) FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC) AS p FROM rk)), 6) AS ndcg_all""")
def evaluate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking held against labels, a third of which are missing, in one row."""
    g = scoring.rank(_graded(spark, sf_dir), ["score"], tie="name")
    ranking = g.select(F.concat(F.lit("in/"), F.col("name").cast("string"), F.lit(".pdf")).alias("path"), "rank", "score")
    known = g.where("name % 3 != 0").select(F.col("name").cast("string").alias("name"), "grade")
    m = evaluation.evaluate(ranking, known)
    return m.select("n_labelled", "n_unlabelled", "precision_at_5_qualified", *[r6(c).alias(c) for c in ("separation", "spearman", "ndcg_all")], "n_inversions")


# ---------------------------------------------------------------- skills and answers

_ALIAS_VALUES = ", ".join(f"('{c}', '{a}')" for c, names in skills.ALIASES.items() for a in (*names, c.lower()))


@register(f"""WITH al(canonical, alias) AS (VALUES {_ALIAS_VALUES}), n(name) AS (VALUES ('k8s'), ('Kubernetes'), ('AWS'), ('react.js'), ('C++'), ('c sharp'), ('COBOL'), ('machine learning'), ('Google Cloud')),
h AS (SELECT name, min(canonical) AS canonical FROM n JOIN al ON alias = lower(name) GROUP BY name)
SELECT n.name, coalesce(array_to_string(list_sort(list(DISTINCT alias) FILTER (CASE WHEN n.name = h.canonical THEN alias <> lower(h.canonical) ELSE alias <> lower(n.name) END)), ','), '') AS aliases FROM n LEFT JOIN h USING (name) LEFT JOIN al USING (canonical) GROUP BY n.name""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("k8s", "Kubernetes", "AWS", "react.js", "C++", "c sharp", "COBOL", "machine learning", "Google Cloud")], "name string")
    return skills.aliases_of(names).select("name", F.array_join("aliases", ",").alias("aliases"))


#: Answers that use other names, come twice, are left out, or quote what isn't there.
_ANSWER = """```json
{"assessments": [
 {"skill": "pytorch or tensorflow", "depth": "USED", "evidence": "trained models", "section": "projects", "confidence": 0.9},
 {"skill": "Python", "depth": "mentioned", "evidence": "Python", "section": "skills", "confidence": "high"},
 {"skill": "python", "depth": "strong", "evidence": "wrote Python services", "section": "experience", "confidence": 1.7},
 {"skill": "C++", "depth": "expert", "evidence": "", "confidence": 0.5},
 {"skill": "Kafka", "depth": "used", "evidence": "ran a cluster of ninety brokers", "confidence": 0}]}
```"""


@register("""SELECT * FROM (VALUES ('Python', 'strong', 'wrote Python services', 'experience', 1.0::DOUBLE, FALSE), ('PyTorch', 'used', 'trained models', 'projects', 0.9::DOUBLE, FALSE), ('C++', 'none', '', NULL, 0.5::DOUBLE, FALSE),
 ('Kafka', 'used', '[unverified] ran a cluster of ninety brokers', NULL, 0.2::DOUBLE, FALSE), ('Go', 'none', '', NULL, NULL, TRUE)) t(skill, depth, evidence, section, confidence, omitted)""")
def answer_match_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, s, "mandatory", alts, "He wrote Python services and trained models.") for s, alts in (("Python", []), ("PyTorch", ["TensorFlow"]), ("C++", []), ("Kafka", []), ("Go", []))]
    asked = spark.createDataFrame(rows, "doc_id int, skill string, importance string, alternatives array<string>, excerpts string")
    answers = judge.parse_answers(spark.createDataFrame([(1, _ANSWER)], "doc_id int, answer string"))
    return judge.match_answers(asked, answers).select("skill", "depth", "evidence", "section", r6("confidence").alias("confidence"), "omitted")


_JD = '{"role_title": "Engineer", "mandatory_skills": ["Python", {"name": "Kubernetes", "alternatives": ["Nomad"]}, {"category": "x"}, 7, "python", "nomad"], "preferred_skills": [{"name": "Terraform", "category": "infra"}, "Python"], "min_years_experience": "five", "education": null, "responsibilities": []}'


@register("""SELECT * FROM (VALUES (1, 'mandatory', 'Python', NULL, '', NULL::DOUBLE, 2), (1, 'mandatory', 'Kubernetes', NULL, 'Nomad', NULL, 2), (1, 'preferred', 'Terraform', 'infra', '', NULL, 2), (1, 'preferred', 'Python', NULL, '', NULL, 2),
 (2, 'preferred', 'SQL', NULL, '', 4.0, 0)) t(jd_id, importance, name, category, alternatives, min_years, n_malformed)""")
def requirements_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed entries are counted, names come once per list, alternatives are no skills."""
    rows = [(1, f"Here you are:\n{_JD}\nDone."), (2, '{"mandatory_skills": "Python", "preferred_skills": ["SQL"], "min_years_experience": 4}')]
    r = skills.parse_requirements(spark.createDataFrame(rows, "jd_id int, answer string"))
    return r.select("jd_id", "min_years", "n_malformed", F.inline("skills")).select("jd_id", "importance", "name", "category", F.array_join("alternatives", ",").alias("alternatives"), "min_years", "n_malformed")


@register("""WITH m AS (SELECT DISTINCT p_brand AS skill FROM part WHERE p_size <= 5), p AS (SELECT DISTINCT p_brand AS skill FROM part WHERE p_size BETWEEN 4 AND 50 AND p_partkey % 3 = 0)
SELECT 'mandatory' AS importance, skill FROM m UNION ALL SELECT 'preferred', skill FROM (SELECT skill FROM p EXCEPT SELECT skill FROM m)""")
def skill_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    m = part.where("p_size <= 5").select(F.col("p_brand").alias("skill")).distinct()
    p = part.where("p_size BETWEEN 4 AND 50 AND p_partkey % 3 = 0").select(F.col("p_brand").alias("skill")).distinct()
    return m.select(F.lit("mandatory").alias("importance"), "skill").unionByName(p.join(m, "skill", "left_anti").select(F.lit("preferred").alias("importance"), "skill"))


@register("SELECT o_custkey, o_orderpriority AS chunk, min(o_orderkey) AS first_seen FROM orders GROUP BY ALL")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks found for several skills, each once, at the place where it came first."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("chunk")).agg(F.min("o_orderkey").alias("first_seen"))


# ---------------------------------------------------------------- layout

_BOXES = "bx AS (SELECT l_suppkey AS page, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS block_id, (CASE WHEN l_linenumber % 2 = 0 THEN 40 ELSE 320 END) + l_quantity / 10 AS x0, l_tax * 5000 + l_discount * 1000 AS y0, l_quantity * 3 + 40 AS w, 10 + l_discount * 20 AS h FROM lineitem)"
_INK = f"""{_BOXES}, by_page AS (SELECT page, w, row_number() OVER (PARTITION BY page ORDER BY w) AS r, count(*) OVER (PARTITION BY page) AS n FROM bx), md AS (SELECT page, w AS m FROM by_page WHERE r = n // 2 + 1),
ex AS (SELECT page, h, unnest(range(floor(x0 / 2)::INT, least(297, floor((x0 + w) / 2)::INT) + 1)) AS bin FROM bx JOIN md USING (page) WHERE w <= least(0.6 * 595, greatest(4 * m, 0.15 * 595))),
ik AS (SELECT page, bin::INT AS bin, sum(greatest(1, h)) AS ink FROM ex GROUP BY ALL)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = F.when(F.col("l_linenumber") % 2 == 0, 40).otherwise(320) + F.col("l_quantity") / 10
    y0 = F.col("l_tax") * 5000 + F.col("l_discount") * 1000
    b = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("block_id"), x0.alias("x0"), y0.alias("y0"), (F.col("l_quantity") * 3 + 40).alias("w"), (10 + F.col("l_discount") * 20).alias("h"))
    return b.select("page", "block_id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


@register(f"WITH {_INK} SELECT page, bin, round(ink, 4) AS ink FROM ik")
def ink_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ink(_boxes(spark, sf_dir), 595.0, ["page"]).select("page", "bin", F.round("ink", 4).alias("ink"))


@register(f"""WITH {_INK}, en AS (SELECT page, min(bin) AS c0, max(bin) AS c1 FROM ik GROUP BY page), bn AS (SELECT page, unnest(range(c0 + floor(0.15 * (c1 - c0))::INT, c1 - floor(0.15 * (c1 - c0))::INT + 1)) AS bin FROM en WHERE c1 > c0),
no AS (SELECT page, bin FROM bn ANTI JOIN ik USING (page, bin)), il AS (SELECT page, bin, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS i FROM no)
SELECT page, min(bin)::INT AS a, (max(bin) + 1)::INT AS b FROM il GROUP BY page, i""")
def gutter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.empty_runs(layout.ink(_boxes(spark, sf_dir), 595.0, ["page"]), ["page"])


@register(f"""WITH {_BOXES}, tb AS (SELECT s_suppkey AS page, 100.0 AS x0, 100.0 AS y0, 400.0 AS x1, 300.0 AS y1 FROM supplier WHERE s_suppkey % 2 = 0)
SELECT bx.page, count(*) AS blocks, count(*) FILTER (bx.x0 + w / 2 BETWEEN tb.x0 AND tb.x1 AND bx.y0 + h / 2 BETWEEN tb.y0 AND tb.y1) AS in_tables FROM bx LEFT JOIN tb USING (page) GROUP BY bx.page""")
def spatial_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("page"), F.lit(100.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(300.0).alias("y1"))
    b = layout.in_tables(_boxes(spark, sf_dir), tables, ["page"])
    return b.groupBy("page").agg(F.count("*").alias("blocks"), F.count_if("in_table").alias("in_tables"))


def _blocks(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 0, "Jane Roe", 18.0, False), (1, 1, "EXPERIENCE", 12.0, False), (1, 2, "Built systems 2019 - 2021", 10.0, False), (1, 3, "Led a team", 10.0, False),
        (1, 4, "Technical Skills:", 10.0, False), (1, 5, "skills", 10.0, False), (1, 6, "Python", 10.0, False), (1, 7, "education", 14.0, False), (1, 8, "B.Sc.", 10.0, False), (1, 9, "Work History", 10.0, True), (1, 10, "Intern", 10.0, False),
    ]
    return spark.createDataFrame(rows, "doc_id int, ord int, text string, font_size double, bold boolean")


@register("""SELECT * FROM (VALUES (1, 0, 'header', 'Jane Roe'), (1, 1, 'experience', 'Built systems 2019 - 2021' || chr(10) || 'Led a team' || chr(10) || 'Intern'), (1, 2, 'skills', 'skills' || chr(10) || 'Python'), (1, 3, 'education', 'B.Sc.')) t(doc_id, pos, section, body)""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by upper case, colon, size and weight; a plain word in a line is none."""
    return layout.sections(_blocks(spark))


_COLUMN = "CASE WHEN {g0} IS NULL OR x1 - x0 > 0.6 * 300 OR (x0 < {g1} - 1 AND x1 > {g0} + 1) THEN -1 WHEN x1 <= {g0} + 1 THEN 0 ELSE 1 END"


@register(f"""WITH {_BOXES}, b0 AS (SELECT page, block_id, x0, y0, x0 + w AS x1 FROM bx), g AS (SELECT s_suppkey AS page, 200.0 AS g0, 310.0 AS g1 FROM supplier WHERE s_suppkey % 3 <> 0),
c0 AS (SELECT b0.*, g0, g1, {_COLUMN.format(g0='g0', g1='g1')} AS c FROM b0 LEFT JOIN g USING (page)),
r AS (SELECT page, coalesce(min(x0) FILTER (c = 1) - max(x1) FILTER (c = 0) >= 1, FALSE) AS apart, max(x1) FILTER (c = 0) AS l, min(x0) FILTER (c = 1) AS r FROM c0 WHERE g0 IS NOT NULL GROUP BY page),
c1 AS (SELECT page, block_id, x0, y0, x1, CASE WHEN apart THEN l ELSE g0 END AS h0, CASE WHEN apart THEN r ELSE g1 END AS h1 FROM c0 LEFT JOIN r USING (page)),
c2 AS (SELECT *, {_COLUMN.format(g0='h0', g1='h1')} AS c FROM c1),
bd AS (SELECT *, sum((c = -1)::INT) OVER (PARTITION BY page ORDER BY round(y0, 1), x0, block_id ROWS UNBOUNDED PRECEDING) AS band FROM c2)
SELECT page, block_id, c AS col, (row_number() OVER (PARTITION BY page ORDER BY band, (c = -1)::INT DESC, c, y0, x0, block_id) - 1)::INT AS ord FROM bd""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of line items on a page for each supplier, 300 points wide for the width rule; two of
    three pages have a gutter, which some boxes reach into."""
    b = _boxes(spark, sf_dir).withColumn("block_id", F.array_join(F.slice(F.split("block_id", "-"), 1, 3), "-"))
    g = read(spark, sf_dir, "supplier").where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("page"), F.lit(200.0).alias("x0"), F.lit(310.0).alias("x1"))
    return layout.reading_order(b, g, ["page"], width=300.0).select("page", "block_id", "col", "ord")


@register("""SELECT l_suppkey AS page, l_orderkey AS block, string_agg(t, chr(10) ORDER BY line) AS text, max(size) AS font_size, sum(bold_chars) / nullif(sum(chars), 0) > 0.6 AS bold, round(min(x0), 6) AS x0
FROM (SELECT l_suppkey, l_orderkey, l_linenumber % 2 AS line, string_agg('part ' || l_partkey, '' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS t, max(l_quantity) AS size, sum(CASE WHEN l_returnflag = 'R' THEN length('part ' || l_partkey) ELSE 0 END) AS bold_chars, sum(length('part ' || l_partkey)) AS chars, min(l_discount * 100) AS x0
  FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of text, here line items, as the blocks of a supplier's page."""
    nth = F.row_number().over(W.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    x = F.col("l_discount") * 100
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("block"), nth.alias("nth"), (F.col("l_linenumber") % 2).alias("line"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), x.alias("x0"), x.alias("y0"), (x + 10).alias("x1"), (x + 10).alias("y1"), F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "R").alias("bold"))
    b = pages.span_blocks(spans, ["page"])
    return b.select("page", "block", "text", "font_size", "bold", r6("x0").alias("x0"))


def _line_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as blocks 12 points apart on one page each; every seventh document failed."""
    d = read(spark, sf_dir, "documents").withColumn("bad", F.col("doc_id") % 7 == 0)
    lines = d.where("not bad").select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("block_id", "text"))
    y = F.col("block_id") * 12.0
    blocks = lines.where(T.strip(F.col("text")) != "").select("doc_id", "page", "block_id", "text", F.lit(40.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 10).alias("y1"), F.lit(10.0).alias("font_size"), F.lit(False).alias("bold"))
    method = F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("native")
    of = d.select("doc_id", F.lit(1).alias("page"), F.when(~F.col("bad"), method).alias("method"), F.when(~F.col("bad") & (F.col("doc_id") % 3 == 0), 80.0).alias("ocr_confidence"), F.when(F.col("bad"), "ValueError: PDF is password-protected").alias("error"))
    return blocks, of


@register(rf"""WITH t0 AS (SELECT doc_id, doc_id % 7 = 0 AS bad, CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN '' ELSE regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, {_ENDS}) <> ''), chr(10)), {_ENDS}) END AS text FROM documents),
{_QUALITY.replace('FROM documents)', 'FROM t0)', 1)}
SELECT t0.doc_id, sha256(t0.text) AS text_sha256, CASE WHEN bad THEN 'none' WHEN t0.doc_id % 3 = 0 THEN 'ocr' ELSE 'native' END AS method, verdict, CASE WHEN bad OR t0.text = '' THEN 0 WHEN t0.doc_id % 3 = 0 THEN round(greatest(0, least(1, 0.6 * q_score + 0.4 * 0.8)), 3) ELSE round(q_score, 3) END::DOUBLE AS confidence,
  NOT bad AND t0.text <> '' AS ok, substr(sha256({_PLAIN.format('t0.text')}), 1, 32) AS exact_fingerprint, CASE WHEN bad THEN 'ValueError: PDF is password-protected' END AS error FROM t0 JOIN q5 USING (doc_id)""")
def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to documents: order, paragraphs, text, quality, fingerprints; unreadable ones are rows."""
    d, _ = extraction.extract(*_line_blocks(spark, sf_dir))
    return d.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "method", "verdict", "confidence", "ok", "exact_fingerprint", "error")


@register()
def screen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from blocks to a ranked, explained list for one job; the tests hold it against
    a plain version on a small table."""
    d, sections = extraction.extract(*_line_blocks(spark, sf_dir))
    d = d.withColumn("path", F.concat(F.lit("in/doc"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    ranked, _, _ = candidates.screen(d, sections, _skills(spark), F.lit("2026-07-01").cast("date"), "Engineer", 3.0)
    return ranked.select("rank", "doc_id", "score", "summary", "explanation", F.array_join("flags", "; ").alias("flags"))


# ---------------------------------------------------------------- names, JSON, HTML


@register("SELECT p_partkey, CASE WHEN n = 1 THEN f ELSE regexp_replace(f, '\\.pdf$', '') || '-' || n || '.pdf' END AS unique_name FROM (SELECT p_partkey, f, row_number() OVER (PARTITION BY lower(f) ORDER BY p_partkey) AS n FROM (SELECT p_partkey, p_brand || '.pdf' AS f FROM part))")
def unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(".pdf")).alias("f"))
    return files.unique_names(p, "f", "p_partkey").select("p_partkey", "unique_name")


_SLUG_SHORT = ", ".join(f"'{k}': '{v}'" for k, v in T.SLUG_SHORT.items())
_SLUG_STOP = ", ".join(f"'{w}'" for w in T.SLUG_STOP)


@register(f"""WITH s AS (SELECT p_partkey, 'Senior ' || p_type || ' Engineer for ' || p_name AS t FROM part), w AS (SELECT p_partkey, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM s),
k AS (SELECT p_partkey, array_to_string(list_filter(list_transform(list_filter(w, lambda x: x NOT IN ({_SLUG_STOP})), lambda x: coalesce(MAP {{{_SLUG_SHORT}}}[x], x)), lambda x: x <> ''), '-') AS g FROM w)
SELECT p_partkey, CASE WHEN length(g) <= 22 THEN g WHEN contains(g[1:22], '-') THEN regexp_replace(g[1:22], '-[^-]*$', '') ELSE g[1:22] END AS slug FROM k""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Senior "), F.col("p_type"), F.lit(" Engineer for "), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(t).alias("slug"))


@register(r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS base, CASE WHEN length(regexp_extract(url, '([^/\\]*)$', 1)) > 0 THEN left(regexp_extract(url, '([^/\\]*)$', 1), 1) || regexp_replace(substr(regexp_extract(url, '([^/\\]*)$', 1), 2), '\.[^.]*$', '') ELSE '' END AS stem FROM pages")
def path_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.basename(F.col("url")).alias("base"), T.stem(F.col("url")).alias("stem"))


@register("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT props::JSON->>'k') AS k_distinct FROM events GROUP BY event_type")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json(T.json_object(F.col("props")), "k long")["k"]
    e = read(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.countDistinct("k").alias("k_distinct"))


@register(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href='))::BIGINT AS n_links FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("(?i)<a\\s[^>]*href=")).cast("long").alias("n_links"))


@register("SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 60), '') AS line FROM documents")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.first_line(F.col("text")), F.lit("")).alias("line"))


_FOLD = "string_split(list_reduce({parts}, lambda a, x: CASE WHEN length(string_split(a, chr(2))[-1]){test} THEN a || {by} || x ELSE a || chr(2) || x END), chr(2))"


@register(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, {_ENDS})), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, {_FOLD.format(parts='p', test=' < 80', by='chr(10)')} AS m FROM p WHERE len(p) > 0), e AS (SELECT doc_id, unnest(m) AS t, generate_subscripts(m, 1) AS i FROM m),
s AS (SELECT doc_id, i, CASE WHEN length(t) <= 320 THEN [t] ELSE {_FOLD.format(parts="list_filter(string_split(regexp_replace(t, '([.!?])[ \t\n\x0B\f\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')", test=' + 1 + length(x) <= 320', by="' '")} END AS c FROM e)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_id, 'experience' AS section, chunk FROM (SELECT doc_id, i, unnest(c) AS chunk, generate_subscripts(c, 1) AS j FROM s)""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one section each, cut into chunks."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit("experience").alias("section"), F.col("text").alias("body"))
    return retrieval.section_chunks(d)


@register("SELECT * FROM (VALUES ('a.pdf', 'pdf', NULL, NULL), ('b.docx', 'pdf', 'suffix docx but content is pdf', NULL), ('c.doc', 'doc', NULL, 'legacy .doc is not read'), ('d.pdf', 'unknown', NULL, 'unknown format'), ('e.docx', 'unknown', NULL, 'unknown format')) t(path, format, warning, error)")
def sniff_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a.pdf", b"%PDF-1.7"), ("b.docx", b"%PDF-1.4"), ("c.doc", bytes.fromhex("d0cf11e0a1")), ("d.pdf", b""), ("e.docx", b"PK\x03\x04 no archive")]
    f = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    return files.typed(f).select("path", "format", "warning", "error")


# ---------------------------------------------------------------- jobs; windows over events (an extension)


@register("""SELECT event_id FROM events WHERE event_type NOT IN ('purchase', 'click') OR epoch(TIMESTAMP '2100-01-01') - floor(epoch(ts)) <= 2.4e9 ORDER BY ts DESC, event_id DESC LIMIT 50""")
def job_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created"), F.when(F.col("event_type").isin("purchase", "click"), "done").otherwise("running").alias("status"))
    return jobs.kept_jobs(e, F.lit("2100-01-01").cast("timestamp"), 2_400_000_000, 50).select(F.col("job_id").alias("event_id"))


@register("SELECT o_orderkey, CASE WHEN n = 0 THEN 10 ELSE least(100, 10 + round(d / n * 90))::INT END AS percent FROM (SELECT o_orderkey, o_orderkey % 7 AS d, o_orderkey % 11 AS n FROM orders)")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", jobs.progress((k % 7).cast("double"), (k % 11).cast("double")).alias("percent"))


@register("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.tumbling(read(spark, sf_dir, "events")).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@register("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h)) AS start_us, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sliding(read(spark, sf_dir, "events")).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@register(_RUNS.format(gap=1_800_000_000).replace("> 1800000000", ">= 1800000000") + " SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us, count(*) AS n FROM r GROUP BY user_id, run")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.sessions(read(spark, sf_dir, "events"))
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("stop").cast("timestamp")).alias("stop_us"), "n")
