"""Requirements: parsing, aliases, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import first_line, json_object, strip

#: Aliases of canonical skills.
ALIASES = {
    "JavaScript": ("js", "java script", "ecmascript"),
    "TypeScript": ("ts",),
    "PostgreSQL": ("postgres", "psql", "postgre"),
    "Kubernetes": ("k8s",),
    "Amazon Web Services": ("aws",),
    "Google Cloud Platform": ("gcp", "google cloud"),
    "Microsoft Azure": ("azure",),
    "Continuous Integration": ("ci", "ci/cd", "cicd"),
    "Natural Language Processing": ("nlp",),
    "Machine Learning": ("ml",),
    "React": ("react.js", "reactjs"),
    "Node.js": ("node", "nodejs"),
    "C++": ("cpp", "cplusplus"),
    "C#": ("c sharp", "csharp"),
}
REQUIREMENTS = "struct<role_title:string,mandatory_skills:string,preferred_skills:string,min_years_experience:string,education:string,responsibilities:string>"
ITEM = "struct<name:string,category:string,alternatives:array<string>>"


def alias_table(spark: SparkSession) -> DataFrame:
    """(canonical, alias) of every alias, and of the canonical name in lower case."""
    rows = [(c, a) for c, names in ALIASES.items() for a in (*names, c.lower())]
    return spark.createDataFrame(rows, "canonical string, alias string")


def aliases_of(names: DataFrame) -> DataFrame:
    """names: (name). (name, aliases): other names of the same skill, sorted; none if unknown. The
    canonical spelling itself has its aliases only; other spellings have the canonical name too."""
    t = alias_table(names.sparkSession)
    low = F.lower(F.trim("name"))
    n = names.select("name").distinct().withColumn("_low", low)
    hit = n.join(F.broadcast(t.select("canonical", F.col("alias").alias("_low"))), "_low").groupBy("name", "_low").agg(F.min("canonical").alias("canonical"))
    every = hit.join(F.broadcast(t), "canonical").where(F.when(F.trim("name") == F.col("canonical"), F.col("alias") != F.lower("canonical")).otherwise(F.col("alias") != F.col("_low")))
    found = every.groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return names.join(found, "name", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def distinct_skills(items: Column) -> Column:
    """items: array<struct<name, category, alternatives>>. Kept in order: an item whose name, or
    an alternative of whose earlier item, was there before (in any case) is left out."""
    item = "array<struct<name:string,category:string,alternatives:array<string>>>"
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(item).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        name = strip(x["name"])
        alts = F.filter(F.transform(F.coalesce(x["alternatives"], F.array().cast("array<string>")), lambda a: strip(a)), lambda a: (a != "") & (F.lower(a) != F.lower(name)))
        skip = (name == "") | F.array_contains(acc["seen"], F.lower(name))
        seen = F.concat(acc["seen"], F.array(F.lower(name)), F.transform(alts, F.lower))
        kept = F.concat(acc["kept"], F.array(F.struct(name.alias("name"), x["category"].alias("category"), alts.alias("alternatives"))))
        return F.when(skip, acc).otherwise(F.struct(seen.alias("seen"), kept.alias("kept")))

    return F.aggregate(items, start, step)["kept"]


def parse_requirements(answers: DataFrame) -> DataFrame:
    """(jd_id, answer) -> jd_id, role_title, min_years, education, skills (importance, pos, name,
    category, alternatives), n_malformed. Entries may be strings or objects with a name; others
    are counted as malformed; a value that is no list holds no skill; years that are no number
    are null."""
    j = answers.select("jd_id", F.from_json(json_object(F.col("answer")), REQUIREMENTS).alias("r"))

    def entries(raw: Column) -> Column:
        return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))

    def typed(raw: Column) -> Column:
        obj = lambda e: F.from_json(F.when(e.startswith("{"), e), ITEM)
        one = lambda e: F.when(e.startswith("{"), F.struct(obj(e)["name"].alias("name"), obj(e)["category"].alias("category"), F.coalesce(obj(e)["alternatives"], F.array().cast("array<string>")).alias("alternatives"))).otherwise(F.struct(F.trim(e).alias("name"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("alternatives")))
        good = lambda e: ~e.rlike("^-?[0-9.]+$|^\\[|^(true|false|null)$") & (~e.startswith("{") | (F.coalesce(obj(e)["name"], F.lit("")) != ""))
        return F.transform(F.filter(entries(raw), good), one)

    m, p = F.col("r.mandatory_skills"), F.col("r.preferred_skills")
    bad = F.size(entries(m)) + F.size(entries(p)) - F.size(typed(m)) - F.size(typed(p))
    tag = lambda arr, imp: F.transform(arr, lambda x: F.struct(F.lit(imp).alias("importance"), x["name"].alias("name"), x["category"].alias("category"), x["alternatives"].alias("alternatives")))
    skills = F.concat(tag(distinct_skills(typed(m)), "mandatory"), tag(distinct_skills(typed(p)), "preferred"))
    return j.select("jd_id", F.col("r.role_title").alias("role_title"), F.col("r.min_years_experience").try_cast("double").alias("min_years"), F.col("r.education").alias("education"), skills.alias("skills"), bad.alias("n_malformed"))


#: The vocabulary of the rule that reads requirements without a model, how some of its
#: terms are spelled, and the words from which on skills are preferred ones.
VOCABULARY = (
    "python java javascript typescript go golang rust c++ c# ruby php scala kotlin swift sql postgresql mysql mongodb redis cassandra elasticsearch snowflake bigquery "
    "kafka spark flink airflow hadoop dbt kinesis aws azure gcp kubernetes docker terraform ansible jenkins pytorch tensorflow scikit-learn pandas numpy langchain "
    "react angular vue django flask fastapi node express graphql rest git linux bash ci/cd microservices"
).split()
SPELLED = {
    "sql": "SQL", "aws": "AWS", "gcp": "GCP", "ci/cd": "CI/CD", "pytorch": "PyTorch", "tensorflow": "TensorFlow", "postgresql": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB",
    "javascript": "JavaScript", "typescript": "TypeScript", "graphql": "GraphQL", "bigquery": "BigQuery", "scikit-learn": "scikit-learn", "numpy": "NumPy", "fastapi": "FastAPI", "nodejs": "Node.js",
    "c++": "C++", "c#": "C#", "rest": "REST", "dbt": "dbt",
}
PREFERRED_FROM = r"\b(?:nice to have|preferred|bonus|desirable)\b"


def requirements_by_rule(jobs: DataFrame, most: tuple[int, int] = (8, 6)) -> DataFrame:
    """jobs: (jd_id, text). jd_id, role_title (first line), min_years (first number of years),
    mandatory and preferred: terms of VOCABULARY that stand by themselves before and after the
    first word of PREFERRED_FROM, in the vocabulary's order; preferred without the mandatory ones."""
    low = F.lower(F.coalesce("text", F.lit("")))
    halves = F.split(low, PREFERRED_FROM, 2)
    quoted = lambda t: "".join("\\" + c if not c.isalnum() else c for c in t)

    def held(part: Column) -> Column:
        said = lambda t: SPELLED.get(t, t.title())
        return F.array_compact(F.array(*[F.when(part.rlike(f"(?<![a-z0-9]){quoted(t)}(?![a-z0-9])"), F.lit(said(t))) for t in VOCABULARY]))

    mandatory, preferred = held(halves[0]), held(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    years = F.regexp_extract(low, r"(\d{1,2})\s*\+?\s*years?", 1).try_cast("double")
    j = jobs.select("jd_id", F.coalesce(first_line(F.col("text")), F.lit("Role")).alias("role_title"), years.alias("min_years"), mandatory.alias("m"), preferred.alias("p"))
    return j.select("jd_id", "role_title", "min_years", F.slice("m", 1, most[0]).alias("mandatory"), F.slice(F.array_except("p", "m"), 1, most[1]).alias("preferred"))
