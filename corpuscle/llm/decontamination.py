"""Benchmark decontamination by a positional inverted index; DataFrame functions only.

Words: A-Z as a-z, runs of digits, letters a-z and all characters beyond ASCII. A test item's
windows are its runs of LENGTH words, or the item as a whole if it has fewer. Texts are cut into
words once: the index stores every row's words by position, and inverted lists (term, row,
position) of the terms that are among the two rarest of a window. Each posting, moved by its
term's offset in the window, is a place where the window may begin; the lists of a window's two
rarest terms are intersected first, and the lists of all its other terms with what is left, so
that a window is found exactly where each of its terms has a posting in its place. The rarest
terms' lists, let apart by a slop, give proximity matches.

Rows have a number of their own in the index, so that copies of one text, however many, are not
one key.

The tables made from the benchmark are broadcast only if they are within BROADCAST_ROWS and
BROADCAST_BYTES; beyond that the same joins are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, fresh, staged

LENGTH = 10
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 24 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUTSIDE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_list(text: Column) -> Column:
    """The words of a text in order."""
    # lower() is right, and much faster, where all characters are ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _OUTSIDE), "")


def within_bounds(df: DataFrame, *strings: str) -> DataFrame:
    """``df``, to be broadcast if its rows and the bytes of its strings are within the bounds."""
    n, size = df.agg(F.count("*"), F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(32)))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


@dataclass
class Index:
    """tokens: row, doc_id, key (of the text), n_words, w (words by position). windows: pid, len.
    terms: pid, k (place in the window), term. items: pid, item_id. seeds: term, pid, k, role (0
    for the rarest term, 1 for the next), roles, possible (all terms of the window stand in some
    document). postings: term, row, pos."""

    tokens: DataFrame
    windows: DataFrame
    terms: DataFrame
    items: DataFrame
    seeds: DataFrame
    postings: DataFrame

    def begins(self, seeds: DataFrame) -> DataFrame:
        """(row, pid, role, roles, start): where a window would begin, by each posting of a seed."""
        return self.postings.join(within_bounds(seeds, "term"), "term").select("row", "pid", "role", "roles", (F.col("pos") - F.col("k")).alias("start"))

    def matches(self) -> DataFrame:
        """(row, pid, start, len) of the exact occurrences of windows."""
        begin = self.begins(self.seeds.where("possible")).where("start >= 0")
        both = begin.groupBy("row", "pid", "start").agg(F.bit_or(F.col("role") + 1).alias("bits"), F.first("roles").alias("roles"))
        found = staged(both.where(F.col("bits") == F.when(F.col("roles") == 2, 3).otherwise(1)).select("row", "pid", "start"), "decon-begins")
        # all lists of the rows that are left, met with the window's terms in their places
        rows = within_bounds(staged(found.select(F.col("row").alias("_row")).distinct(), "decon-rows"))
        lists = self.tokens.select("row", "w").join(rows, F.col("row") == F.col("_row"), "left_semi").select("row", F.posexplode("w").alias("pos", "term"))
        want = found.join(within_bounds(self.terms, "term"), "pid").select("row", "pid", "start", (F.col("start") + F.col("k")).alias("pos"), "term")
        met = want.join(lists, ["row", "pos", "term"]).groupBy("row", "pid", "start").agg(F.count("*").alias("met"))
        return met.join(within_bounds(self.windows), "pid").where("met = len").select("row", "pid", "start", "len")


def build(docs: DataFrame, items: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The stored index of ``docs`` for the windows of ``items`` (item_id, text)."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    phrases = words.withColumn("i", F.explode(begins)).select("item_id", F.slice("w", F.col("i") + 1, length).alias("w"))
    phrases = staged(phrases.select(F.xxhash64(F.array_join("w", " ")).alias("pid"), "item_id", "w").distinct(), "decon-phrases")
    of = phrases.select("pid", "item_id").distinct()
    terms = staged(phrases.dropDuplicates(["pid"]).select("pid", F.size("w").alias("len"), F.posexplode("w").alias("k", "term")), "decon-terms")
    windows = terms.select("pid", "len").distinct()

    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), content_key(text_col).alias("key"), F.coalesce(word_list(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    tokens = staged(tokens.select("row", "doc_id", "key", F.size("w").cast("long").alias("n_words"), "w"), "decon-tokens")

    vocabulary = within_bounds(terms.select("term").distinct(), "term")
    often = staged(tokens.select(F.explode("w").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df")), "decon-df")
    ranked = terms.join(often, "term", "left").groupBy("pid", "term").agg(F.first(F.coalesce("df", F.lit(0))).alias("df"), F.min("k").alias("k"))
    # terms that no document has rule the exact window out, not what is near it
    rare = F.slice(F.array_sort(F.filter(F.collect_list(F.struct("df", "term", "k")), lambda x: x["df"] > 0)), 1, 2)
    ranked = ranked.groupBy("pid").agg(rare.alias("rare"), (F.min("df") > 0).alias("possible"))
    seeds = staged(ranked.select("pid", "possible", F.size("rare").alias("roles"), F.posexplode("rare").alias("role", "x")).select("x.term", "pid", "x.k", "role", "roles", "possible"), "decon-seeds")
    wanted = within_bounds(seeds.select("term").distinct(), "term")
    postings = tokens.select("row", F.posexplode("w").alias("pos", "term")).join(wanted, "term")
    return Index(tokens, windows, terms.select("pid", "k", "term"), of, seeds, staged(postings.select("term", "row", "pos"), "decon-postings"))


def hits(index: Index) -> DataFrame:
    """One row per row of the index with an occurring window: row, n_hit, items."""
    found = staged(index.matches(), "decon-found")
    places = F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))
    n_hit = found.groupBy("row").agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    items = found.select("row", "pid").distinct().join(within_bounds(index.items, "item_id"), "pid").where("item_id is not null")
    items = items.groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return n_hit.join(items, F.col("row") == F.col("_row"), "left").drop("_row")


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256 (of the ids of items with occurring windows, sorted as strings,
    comma-joined), contaminated (n_hit > 0), items.

    Null and empty texts have no words; items without words have no window; an item without id
    counts for n_hit alone; items of equal id are one. Repeated documents each have their row;
    texts of any length are read whole; other columns of either table are ignored, whatever
    their names. Without documents the result is empty, without items nothing is contaminated.
    """
    index = build(docs, items, length, id_col, text_col)
    found = hits(index).withColumnRenamed("row", "_row")
    out = index.tokens.select("row", "doc_id", "n_words").join(found, F.col("row") == F.col("_row"), "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def clean(docs: DataFrame, items: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of an item; columns as they are, whatever
    their names. Null texts and texts without words stay; of repeated rows all stay or go; an
    empty table of either kind changes nothing."""
    index = build(docs, items, length, id_col, text_col)
    hit = index.matches().select("row").distinct().withColumnRenamed("row", "_row")
    taken = fresh("key", docs)
    bad = index.tokens.select("row", "key").join(hit, F.col("row") == F.col("_row"), "left_semi").select(F.col("key").alias(taken)).distinct()
    bad = within_bounds(staged(bad, "decon-bad"))
    return docs.join(bad, content_key(text_col) == F.col(taken), "left_anti")


def proximity(docs: DataFrame, items: DataFrame, slop: int = 5, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, apart): a window's two rarest terms, of those that any document has, stand
    in the document as in the window, but for ``apart`` words more or fewer between them (0: in
    place), ``slop`` at most. The least ``apart`` of each document row and item. Windows of one
    such term match where it stands. Null texts, items without words or id match nothing; other
    columns are ignored."""
    index = build(docs, items, length, id_col, text_col)
    begin = index.begins(index.seeds).distinct()
    one, two = begin.where("role = 0"), begin.where("role = 1").select("row", "pid", F.col("start").alias("other"))
    # places are met by slop-wide cells, own and next, so that a common term's list isn't crossed whole
    width = slop + 1
    one = one.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start") / width) + i for i in (-1, 0, 1)])))
    two = two.withColumn("cell", F.floor(F.col("other") / width))
    near = one.where("roles = 2").join(two, ["row", "pid", "cell"]).select("row", "pid", F.abs(F.col("start") - F.col("other")).alias("apart")).where(F.col("apart") <= slop)
    near = near.unionAll(one.where("roles = 1").select("row", "pid", F.lit(0).alias("apart")))
    near = near.groupBy("row", "pid").agg(F.min("apart").alias("apart")).join(within_bounds(index.items, "item_id"), "pid").where("item_id is not null")
    near = near.groupBy("row", "item_id").agg(F.min("apart").alias("apart")).withColumnRenamed("row", "_row")
    return index.tokens.select("row", "doc_id").join(near, F.col("row") == F.col("_row")).select("doc_id", "item_id", "apart")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


_SQL_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, w FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + {LENGTH}], ' ') AS phrase, least(len(w), {LENGTH}) AS n
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {LENGTH}, 0) + 1)) AS s FROM i)),
runs AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT DISTINCT a.r, a.s, a.n, win.item_id FROM (SELECT r, s, n, array_to_string(w[s + 1 : s + n], ' ') AS phrase FROM runs) a JOIN win USING (n, phrase)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""
