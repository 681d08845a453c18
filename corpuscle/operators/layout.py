"""Blocks on pages: columns, reading order, paragraphs, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.text import heading_key, strip

#: Shares of the page or of typical blocks at which the layout rules switch.
BIN, FULL, MARGIN, GUTTER_SHARE, GUTTER_LEAST, SIDE = 2.0, 0.60, 0.15, 0.030, 12.0, 0.25
OUTLIER, OUTLIER_FLOOR = 4.0, 0.15
SAME_LEFT, SAME_SIZE, GAP = 14.0, 0.15, 1.9

#: Headings of each canonical section.
HEADINGS = {
    "summary": ("summary", "professional summary", "profile", "objective", "career objective", "about me", "about", "professional profile"),
    "experience": ("experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history", "relevant experience", "industry experience", "internships", "internship", "internship experience", "positions"),
    "education": ("education", "academic background", "academics", "qualifications", "educational qualifications", "academic qualifications"),
    "skills": ("skills", "technical skills", "core skills", "key skills", "skills summary", "technical proficiencies", "competencies", "core competencies", "technologies", "tech stack", "expertise", "areas of expertise", "tools", "tools and technologies"),
    "projects": ("projects", "personal projects", "key projects", "selected projects", "academic projects", "project experience", "portfolio"),
    "certifications": ("certifications", "certification", "certificates", "licenses", "licenses and certifications", "courses", "training", "professional development"),
    "awards": ("awards", "honors", "honours", "achievements", "accomplishments", "awards and honors", "recognition"),
    "publications": ("publications", "papers", "research", "patents", "research experience", "conference presentations"),
    "languages": ("languages", "language proficiency"),
    "interests": ("interests", "hobbies", "activities", "extracurricular", "extracurricular activities", "volunteering", "volunteer experience", "community involvement"),
    "contact": ("contact", "contact information", "personal details", "personal information", "details"),
}


def section_of(line: Column) -> Column:
    known = F.create_map(*[F.lit(x) for canon, names in HEADINGS.items() for n in names for x in (n, canon)])
    return F.try_element_at(known, heading_key(line))


def heading(line: Column, size: Column, median: Column, bold: Column) -> Column:
    """The section that a line opens: a known heading of at most 48 characters and 5 words that
    also looks like one (upper case, bold, title case, a colon at its end, or large)."""
    t = F.trim(line)
    cased = t.rlike("\\p{L}")
    upper = cased & (F.upper(t) == t) & (F.lower(t) != t)
    # every run of letters begins upper and goes on lower
    title = t.rlike("\\p{Lu}") & ~t.rlike("\\p{Lu}\\p{Lu}|\\p{Ll}\\p{Lu}|(?<!\\p{L})\\p{Ll}")
    looks = upper | F.coalesce(bold, F.lit(False)) | title | t.endswith(":") | F.coalesce(size >= median * 1.12, F.lit(False))
    short = (F.length(t) <= 48) & (F.size(F.split(t, "\\s+")) <= 5) & (t != "")
    return F.when(short & looks, section_of(t))


def sections(blocks: DataFrame) -> DataFrame:
    """blocks: (doc_id, ord, text, font_size, bold). (doc_id, pos, section, body): the last
    heading, a block's first line, tags what follows, the block's other lines included; before
    the first one it is ``header``; sections in the order of their first text. Blank texts and
    sections without text are left out."""
    sized = blocks.where("font_size > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.median("font_size").alias("_m"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    b = blocks.join(sized, F.col("doc_id") == F.col("_id"), "left").withColumn("_h", heading(lines[0], F.col("font_size"), F.col("_m"), F.col("bold")))
    order = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    b = b.withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(order), F.lit("header")))
    b = b.withColumn("_body", strip(F.when(F.col("_h").isNull(), F.col("text")).otherwise(rest))).where("_body != ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_body"))), lambda x: x["_body"]), "\n")
    s = b.groupBy("doc_id", "section").agg(F.min("ord").alias("_first"), body.alias("body"))
    return s.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("_first")) - 1).alias("pos"), "section", "body")


def ink(boxes: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """boxes: keys, x0, y0, x1, y1. (keys, bin, ink): heights over each 2-point bin, wide boxes
    left out. The typical width is the upper median."""
    w = boxes.withColumn("_w", F.col("x1") - F.col("x0"))
    # the upper median without collecting a page's boxes: the row in the middle
    middle = w.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_w"))).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    middle = middle.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col("_w").alias("_median"))
    w = w.join(middle, keys)
    cut = F.least(F.lit(FULL * width), F.greatest(OUTLIER * F.col("_median"), F.lit(OUTLIER_FLOOR * width)))
    last = int(-(-width // BIN)) - 1
    narrow = w.where(F.col("_w") <= cut)
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("x0") / BIN)), F.least(F.lit(last), F.floor(F.col("x1") / BIN))
    each = narrow.where(hi >= lo).select(*keys, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("bin"), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("h"))
    return each.groupBy(*keys, "bin").agg(F.sum("h").alias("ink"))


def empty_runs(profile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): runs of empty bins (b exclusive) inside the inner 70 % of the inked extent."""
    ends = profile.groupBy(*keys).agg(F.min("bin").alias("c0"), F.max("bin").alias("c1"))
    trim = F.floor(MARGIN * (F.col("c1") - F.col("c0")))
    bins = ends.where("c1 > c0").select(*keys, F.explode(F.sequence((F.col("c0") + trim).cast("int"), (F.col("c1") - trim).cast("int"))).alias("bin"))
    none = bins.join(profile.select(*keys, "bin"), [*keys, "bin"], "left_anti")
    island = F.col("bin") - F.row_number().over(W.partitionBy(*keys).orderBy("bin"))
    return none.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("bin").cast("int").alias("a"), (F.max("bin") + 1).cast("int").alias("b")).drop("_i")


def gutters(boxes: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """(keys, x0, x1) of each page's dominant gutter; pages without one have no row."""
    runs = empty_runs(ink(boxes, width, keys), keys).select(*keys, (F.col("a") * BIN).alias("gx0"), (F.col("b") * BIN).alias("gx1"))
    runs = runs.where(F.col("gx1") - F.col("gx0") >= max(GUTTER_LEAST, GUTTER_SHARE * width))
    many = boxes.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 4").select(*keys)
    body = boxes.where(F.col("x1") - F.col("x0") <= FULL * width)
    span = body.groupBy(*keys).agg((F.max("y1") - F.min("y0")).alias("_span")).where("_span > 0")
    left, right = F.col("x1") <= F.col("gx0") + 1, F.col("x0") >= F.col("gx1") - 1
    height = lambda side: F.max(F.when(side, F.col("y1"))) - F.min(F.when(side, F.col("y0")))
    sides = runs.join(many, keys).join(body, keys).groupBy(*keys, "gx0", "gx1").agg(F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), height(left).alias("hl"), height(right).alias("hr"))
    good = sides.where("nl >= 2 and nr >= 2").join(span, keys).withColumn("balance", F.least("hl", "hr") / F.col("_span")).where(F.col("balance") >= SIDE)
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.col("balance") + 0.001 * (F.col("gx1") - F.col("gx0"))), "gx0"))
    return good.withColumn("_b", best).where("_b = 1").select(*keys, F.col("gx0").alias("x0"), F.col("gx1").alias("x1"))


def column_of(x0: Column, x1: Column, g0: Column, g1: Column, width: float) -> Column:
    """-1 for a block that takes most of the page's width or reaches into the gutter, 0 left of it,
    1 right; -1 without a gutter."""
    wide = (x1 - x0 > FULL * width) | ((x0 < g1 - 1) & (x1 > g0 + 1))
    return F.when(g0.isNull() | wide, -1).when(x1 <= g0 + 1, 0).otherwise(1)


def widened(blocks: DataFrame, gutter: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, x0, x1): each page's gutter from the last right edge of its left column to the first
    left edge of its right one; as it was where one is empty or nothing lies between them."""
    g = gutter.select(*keys, F.col("x0").alias("_g0"), F.col("x1").alias("_g1"))
    b = blocks.join(g, keys).withColumn("_c", column_of(F.col("x0"), F.col("x1"), F.col("_g0"), F.col("_g1"), width))
    edges = b.groupBy(*keys, "_g0", "_g1").agg(F.max(F.when(F.col("_c") == 0, F.col("x1"))).alias("_l"), F.min(F.when(F.col("_c") == 1, F.col("x0"))).alias("_r"))
    apart = F.coalesce(F.col("_r") - F.col("_l") >= 1, F.lit(False))
    return edges.select(*keys, F.when(apart, F.col("_l")).otherwise(F.col("_g0")).alias("x0"), F.when(apart, F.col("_r")).otherwise(F.col("_g1")).alias("x1"))


def reading_order(blocks: DataFrame, gutter: DataFrame, keys: list[str], id_col: str = "block_id", width: float = 595.0) -> DataFrame:
    """Adds col (-1 full width, 0 left, 1 right) and ord: bands between full-width blocks, in a
    band the left column, then the right; pages without gutter by y (to 0.1) and x. The gutter,
    one that the caller knows or that of ``gutters``, is widened to the columns' edges first."""
    g = widened(blocks, gutter, keys, width).select(*keys, F.col("x0").alias("_g0"), F.col("x1").alias("_g1"))
    b = blocks.join(g, keys, "left").withColumn("col", column_of(F.col("x0"), F.col("x1"), F.col("_g0"), F.col("_g1"), width).cast("int"))
    b = b.withColumn("_full", (F.col("col") == -1).cast("int"))
    b = b.withColumn("_band", F.sum("_full").over(W.partitionBy(*keys).orderBy(F.round("y0", 1), "x0", id_col).rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy(*keys).orderBy("_band", F.desc("_full"), "col", "y0", "x0", id_col)
    return b.withColumn("ord", (F.row_number().over(w) - 1).cast("int")).drop("_g0", "_g1", "_full", "_band")


def in_tables(blocks: DataFrame, tables: DataFrame, keys: list[str], id_col: str = "block_id") -> DataFrame:
    """Adds in_table: the block's centre lies in a table of its page, borders included."""
    t = tables.select(*keys, *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = blocks.join(t, keys).where(cx.between(F.col("tx0"), F.col("tx1")) & cy.between(F.col("ty0"), F.col("ty1"))).select(*keys, id_col).distinct().withColumn("in_table", F.lit(True))
    return blocks.join(inside, [*keys, id_col], "left").withColumn("in_table", F.coalesce("in_table", F.lit(False)))


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """blocks: (doc_id, page, ord, col, text, x0, y0, x1, y1, font_size, in_table, is_heading), and
    bold and confidence where there are such. Blocks that continue the one before become one:
    same page, column and table flag, left edges within 14 points, sizes within 15 % (or
    unknown), no heading begins, a gap of at most 1.9 typical heights (the upper median of those
    above 0; 12 without any). Each block is compared with what was merged so far, so a document's
    blocks are folded in one array expression; ord counts the paragraphs of the document."""
    more = [(c, t) for c, t in (("bold", "boolean"), ("confidence", "double")) if c in blocks.columns]
    kinds = dict(blocks.dtypes)
    fields = ["page", "col", "text", "x0", "y0", "x1", "y1", "font_size", "in_table", "is_heading", *[c for c, _ in more]]
    item = F.struct("ord", *fields)
    tall = F.array_sort(F.filter(F.transform("_b", lambda b: b["y1"] - b["y0"]), lambda h: h > 0))
    typical = F.coalesce(F.get(tall, F.floor(F.size(tall) / 2).cast("int")), F.lit(12.0))
    d = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_b")).withColumn("_gap", GAP * typical)
    # what a block is compared with: of the merged one its left edge, its end and its first block's size
    kept = ["page", "col", "x0", "y1", "font_size", "in_table"]
    state = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in kept) + ",n:int,at:array<int>>"

    def follows(p: Column, b: Column) -> Column:
        sizes = p["font_size"].isNull() | b["font_size"].isNull() | (F.abs(p["font_size"] - b["font_size"]) <= SAME_SIZE * F.greatest(p["font_size"], b["font_size"]))
        gap = b["y0"] - p["y1"]
        place = (p["page"] == b["page"]) & (p["col"] == b["col"]) & (p["in_table"] == b["in_table"]) & (F.abs(p["x0"] - b["x0"]) <= SAME_LEFT)
        return F.coalesce(place & sizes & ~F.coalesce(b["is_heading"], F.lit(False)) & (gap >= 0) & (gap <= F.col("_gap")), F.lit(False))

    def step(p: Column, b: Column) -> Column:
        n = lambda more: [(p["n"] + more).alias("n"), F.concat(p["at"], F.array(p["n"] + more)).alias("at")]
        own = {"x0": F.least(p["x0"], b["x0"]), "y1": b["y1"]}
        same = F.struct(*[own.get(c, p[c]).cast(kinds[c]).alias(c) for c in kept], *n(0)).cast(state)
        return F.when((p["n"] > 0) & follows(p, b), same).otherwise(F.struct(*[b[c].alias(c) for c in kept], *n(1)).cast(state))

    start = F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in kept], F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")).cast(state)
    # the fold only numbers the blocks; their texts are joined once, as growing ones would be copied at each step
    each = d.select("doc_id", F.inline(F.arrays_zip(F.aggregate("_b", start, step)["at"].alias("_n"), F.col("_b").alias("_p"))))
    first = lambda c: F.min_by(F.col(f"_p.{c}"), "_p.ord")
    out = {c: first(c) for c in fields} | {"x0": F.min("_p.x0"), "x1": F.max("_p.x1"), "y1": F.max_by("_p.y1", "_p.ord")}
    out["text"] = F.when(F.count("*") == 1, F.first("_p.text")).when(F.count("_p.text") == F.count("*"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p.ord", "_p.text"))), lambda x: x["text"]), "\n"))
    if "confidence" in fields:
        mean = lambda s, c: F.when(s.isNotNull() & c.isNotNull(), F.bround((s + c) / 2, 2)).otherwise(s)
        all_c = F.transform(F.array_sort(F.collect_list(F.struct("_p.ord", F.col("_p.confidence").cast("double").alias("c")))), lambda x: x["c"])
        out["confidence"] = F.aggregate(F.slice(all_c, F.lit(2), F.greatest(F.size(all_c) - 1, F.lit(0))), all_c[0], mean)
    return each.groupBy("doc_id", (F.col("_n") - 1).alias("ord")).agg(*[out[c].alias(c) for c in fields]).select("doc_id", "page", "ord", *fields[1:])


def cluster_lines(words: DataFrame) -> DataFrame:
    """words: (doc_id, page, word_id, x0, y0, x1, y1, ...). Adds line: in the order of y, then x, a
    word joins one of the last four lines, the latest first, whose centre is within 0.6 of the
    greater of their heights (1 at least for a word); a line's centre and height grow with its
    words. Each page is folded in one array expression that keeps four lines."""
    d = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "word_id", "y1"))).alias("_w"))
    line = "struct<top:double,end:double,h:double>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("lines"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, w: Column) -> Column:
        tall = F.greatest(F.lit(1.0), w["y1"] - w["y0"])
        middle = (w["y0"] + w["y1"]) / 2
        near = lambda i: F.abs(middle - (s["lines"][i]["top"] + s["lines"][i]["end"]) / 2) <= 0.6 * F.greatest(tall, s["lines"][i]["h"])
        have = F.size(s["lines"])
        places = F.filter(F.array(*[F.lit(i) for i in (3, 2, 1, 0)]), lambda i: (i < have) & near(i))
        hit = F.get(places, F.lit(0))
        top, end = (lambda x: F.least(x["top"], w["y0"])), (lambda x: F.greatest(x["end"], w["y1"]))
        grown = F.transform(s["lines"], lambda x, i: F.when(i == hit, F.struct(top(x).alias("top"), end(x).alias("end"), (end(x) - top(x)).alias("h"))).otherwise(x))
        new = F.array(F.struct(w["y0"].cast("double").alias("top"), w["y1"].cast("double").alias("end"), tall.cast("double").alias("h")))
        lines = F.when(hit.isNull(), F.concat(F.slice(s["lines"], F.greatest(have - 2, F.lit(1)), F.lit(3)), new)).otherwise(grown)
        number = F.when(hit.isNull(), s["n"]).otherwise(s["n"] - have + hit)
        return F.struct(lines.cast(f"array<{line}>").alias("lines"), (s["n"] + hit.isNull().cast("int")).alias("n"), F.concat(s["at"], F.array(number.cast("int"))).alias("at"))

    at = d.select("doc_id", "page", F.inline(F.arrays_zip(F.transform("_w", lambda w: w["word_id"]).alias("word_id"), F.aggregate("_w", start, step)["at"].alias("line"))))
    return words.join(at, ["doc_id", "page", "word_id"])


#: Words that a reader is less sure of are dropped; when a page is read again, and how.
WORD_CONFIDENCE, AGAIN_CONFIDENCE, AGAIN_WORDS = 30.0, 72.0, 60


def read_words(raw: DataFrame, scale: Column | float) -> DataFrame:
    """raw: (doc_id, page, word_id, text, conf as text, left, top, width, height) in pixels. Words
    that are not blank and sure enough (what is no number counts as -1), in points."""
    sure = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    kept = raw.where((strip(F.coalesce("text", F.lit(""))) != "") & (sure >= WORD_CONFIDENCE))
    box = {"x0": F.col("left") * s, "y0": F.col("top") * s, "x1": (F.col("left") + F.col("width")) * s, "y1": (F.col("top") + F.col("height")) * s}
    return kept.select("doc_id", "page", "word_id", strip(F.col("text")).alias("text"), sure.alias("conf"), *[c.alias(n) for n, c in box.items()])


def line_blocks(words: DataFrame, gutter: DataFrame, width: float = 595.0) -> DataFrame:
    """Words of ``read_words`` as blocks, one a line; a line with words in both columns becomes one
    block a column. (doc_id, page, line, col, text, x0, y0, x1, y1, confidence: the words' mean)."""
    g = gutter.select("doc_id", "page", F.col("x0").alias("_g0"), F.col("x1").alias("_g1"))
    w = cluster_lines(words).join(g, ["doc_id", "page"], "left")
    w = w.withColumn("_c", column_of(F.col("x0"), F.col("x1"), F.col("_g0"), F.col("_g1"), width))
    of = W.partitionBy("doc_id", "page", "line")
    crosses = (F.min(F.when(F.col("_c") >= 0, F.col("_c"))).over(of) == 0) & (F.max("_c").over(of) == 1)
    w = w.withColumn("col", F.when(F.coalesce(crosses, F.lit(False)), F.col("_c")).otherwise(-1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda x: x["text"]), " ")
    box = [F.round(f(c), 2).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return w.groupBy("doc_id", "page", "line", "col").agg(text.alias("text"), *box, F.round(F.avg("conf"), 2).alias("confidence"))


def attempts(words: DataFrame, keys: list[str]) -> DataFrame:
    """Per attempt (keys): mean_confidence, n_words and the score that attempts are compared by."""
    a = words.groupBy(*keys).agg(F.avg("conf").alias("mean_confidence"), F.count("*").alias("n_words"))
    return a.withColumn("score", attempt_score(F.col("mean_confidence"), F.col("n_words")))


def attempt_score(confidence: Column, n_words: Column) -> Column:
    """Confidence (0-100) weighed by how much was read; 250 words are a full page."""
    return confidence / 100 * (0.35 + 0.65 * F.least(F.lit(1.0), n_words / 250))


def weak(confidence: Column, n_words: Column) -> Column:
    """Is a first attempt so poor that others are made?"""
    return (confidence < AGAIN_CONFIDENCE) | (n_words < AGAIN_WORDS)


def best_attempts(tried: DataFrame, keys: list[str], nth: str) -> DataFrame:
    """tried: keys, ``nth``, mean_confidence, n_words, score. The first attempt of each page unless
    it is weak and a later one is better; of equals the earliest."""
    first = F.min_by(F.struct("mean_confidence", "n_words"), nth).over(W.partitionBy(*keys))
    lead = F.min(nth).over(W.partitionBy(*keys))
    t = tried.withColumn("_go", weak(first["mean_confidence"], first["n_words"])).withColumn("_lead", lead)
    t = t.where(F.col("_go") | (F.col(nth) == F.col("_lead"))).drop("_go", "_lead")
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), nth))
    return t.withColumn("_n", best).where("_n = 1").drop("_n")
