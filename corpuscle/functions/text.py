"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens are lower-cased runs that may hold + # . - after their first character.
TOKEN = "([a-z0-9][a-z0-9+#.\\-]*)"

#: Words dropped from file-name slugs, and how others are shortened.
SLUG_STOP = (
    "a", "an", "the", "and", "or", "for", "of", "to", "in", "at",
    "with", "role", "position", "job", "opening", "remote", "hybrid",
    "onsite", "fulltime", "full", "time", "contract", "resume", "cv",
)
SLUG_SHORT = {
    "senior": "sr", "junior": "jr", "engineer": "eng",
    "engineering": "eng", "developer": "dev", "development": "dev",
    "manager": "mgr", "management": "mgt", "software": "sw",
    "machine": "ml", "learning": "", "scientist": "sci",
    "analyst": "anlt", "architect": "arch", "specialist": "spec",
    "administrator": "admin", "associate": "assoc",
}

#: What follows an e-mail, phone or web address in contact lines.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
URL = r"(?i)(https?://|www\.|linkedin\.com|github\.com)"


#: What counts as white space at the ends of a text: also separators and the other scripts' spaces.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, f"\\A{BLANK}|{BLANK}\\z", "")


def nearest(x: Column, digits: int) -> Column:
    """The nearest number with so many decimals to a double's exact value; of two the even one.
    (``round`` and ``bround`` go by the shortest decimal that stands for the double.)"""
    p = 10.0**digits
    n = F.floor(x * p)
    low, high = n / p, (n + 1) / p
    return F.when(x - low < high - x, low).when(x - low > high - x, high).when(n % 2 == 0, low).otherwise(high)


def g(x: Column) -> Column:
    """A number of at most six significant digits without trailing zeros: 5.0 is 5, 2.50 is 2.5."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))).cast("int"))
    shown = F.format_number(F.round(x * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits), 6)
    return F.regexp_replace(F.regexp_replace(shown, ",", ""), "\\.?0+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def plain(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 is one space; trimmed. What fingerprints read."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def quote_form(text: Column) -> Column:
    """The form in which quotes and excerpts are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), "\\s+", " "))


def skill_key(name: Column) -> Column:
    """Without parentheses and all but a-z, 0-9, + and #."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "\\(.*?\\)", " ")), "[^a-z0-9+#]+", "")


def heading_key(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[^a-z& ]+", " "), "\\s+", " "))


def first_line(text: Column, most: int = 60) -> Column:
    """The first line that is not blank, trimmed; null without one."""
    return F.substring(F.get(F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda x: strip(x)), lambda x: x != ""), F.lit(0)), 1, most)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]*$", "")


def slug(text: Column, most: int = 22) -> Column:
    """Short file-name form, cut at a word's end."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    short = F.create_map(*[F.lit(x) for kv in SLUG_SHORT.items() for x in kv])
    kept = F.filter(F.transform(F.filter(words, lambda w: ~w.isin(*SLUG_STOP)), lambda w: F.coalesce(F.try_element_at(short, w), w)), lambda w: w != "")
    kept = F.when(F.size(kept) > 0, kept).when(F.size(words) > 0, words).otherwise(F.array(F.lit("untitled")))
    whole = F.array_join(kept, "-")
    cut = F.substring(whole, 1, most)
    return F.when(F.length(whole) <= most, whole).when(cut.contains("-"), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)


def grounded(quote: Column, excerpts: Column) -> Column:
    """Does a quote stand in the excerpts? An empty one does; a quote of more than three words
    also if its first six words do."""
    q, hay = quote_form(quote), quote_form(excerpts)
    parts = F.split(q, " ")
    window = F.array_join(F.slice(parts, 1, 6), " ")
    return (q == "") | hay.contains(q) | ((F.size(parts) > 3) & hay.contains(window))


def unfenced(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))


def json_object(text: Column) -> Column:
    """The answer's outermost braces; null if it has none."""
    t = unfenced(text)
    found = F.regexp_extract(t, "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)


def paragraphs(body: Column, least: int = 80) -> Column:
    """Paragraphs between blank lines; one follows the paragraph before it, on a line of its own,
    as long as that is shorter than ``least``."""
    parts = F.filter(F.transform(F.split(body, "\\n\\s*\\n"), lambda x: strip(x)), lambda p: p != "")
    none = F.array().cast("array<string>")
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws("\n", last(acc), p)))
        return F.when((F.size(acc) > 0) & (F.length(F.try_element_at(acc, F.lit(-1))) < least), joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, none, step)


def packed(text: Column, most: int = 320) -> Column:
    """A text of at most ``most`` characters as it is; else its sentences, packed greedily into
    pieces of that size. A longer sentence is a piece of its own."""
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        end = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(end) + 1 + F.length(s) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", end, s)))).otherwise(F.concat(acc, F.array(s)))

    sentences = F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: s != "")
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(sentences, none, step))


def chunks(body: Column, most: int = 320, least: int = 80) -> Column:
    """Paragraphs of a section, the long ones packed by sentences."""
    return F.flatten(F.transform(paragraphs(body, least), lambda p: packed(p, most)))
