"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content, and the pattern of an id in a query.
STOP_WORDS = (
    "a an the is are was were be been being in on at to of and or for with that this these those it its as by from has have had "
    "not but if then so do does did you your we our they their he she his her i my me them than which who what when where how "
    "can will would could should into about also"
).split()
STRUCTURED_ID = r"\b[A-Z]{1,5}(?:[0-9]{1,4}|(?:\.[A-Z0-9]{1,5})+)\b"
WEEK_US = 7 * 24 * 3600 * 1_000_000


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector is missing or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squash(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def weeks_between(earlier: Column, later: Column) -> Column:
    """Whole weeks passed, 0 at least."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / WEEK_US)).cast("int")


def decayed(confidence: Column, factor: Column, weeks: Column) -> Column:
    return confidence * F.pow(factor, weeks)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def content_words(text: Column) -> Column:
    """Distinct words of letters and apostrophes, longer than two, without stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z']+"), 0)
    low = F.transform(found, lambda w: F.lower(w))
    return F.array_distinct(F.filter(low, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def support(answer: Column, evidence: Column) -> Column:
    """Share of the answer's content words that the evidence has; 0 without any."""
    return F.when(F.size(answer) > 0, F.size(F.array_intersect(answer, evidence)) / F.size(answer)).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def strip(text: Column) -> Column:
    """Blanks, tabs and line ends off both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def normal_title(title: Column) -> Column:
    """Title without outer space and leading #, inner space single, lower case."""
    return F.lower(F.regexp_replace(strip(F.regexp_replace(strip(title), "^#+", "")), r"\s+", " "))


def first_structured_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, STRUCTURED_ID, 0), F.lit(""))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a proportion, within [0, 1]; null for n = 0."""
    p, nn = k / F.nullif(n, F.lit(0)), n.cast("double")
    mid = p + z * z / (2 * nn)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * nn)) / nn)
    scale = 1 + z * z / nn
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / scale)), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / scale))


def sign_test(better: Column, worse: Column) -> Column:
    """Exact two-sided sign test; 1 without any change. The binomial terms run in logarithms."""
    n, k = (better + worse).cast("int"), F.least(better, worse).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        here = F.when(i == 0, s["log"]).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(here.alias("log"), (s["sum"] + F.exp(here)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), k), start, step)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def video_id(url: Column) -> Column:
    """The 11 characters of a video id in a url; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|embed/|shorts/)([a-zA-Z0-9_-]{11})", 1), F.lit(""))


def uuid_or_null(text: Column) -> Column:
    return F.when(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(text))


def is_kebab(name: Column) -> Column:
    return name.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def iso_time(at: Column) -> Column:
    """A time in UTC as ISO 8601 with microseconds and offset, as in 2024-06-01T00:00:00.000000+00:00."""
    us = F.unix_micros(at)
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(us / 1_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("+00:00"))


def parsed_time(text: Column) -> Column:
    """The time that an ISO 8601 text names (Z, an offset or none, which is UTC); null for anything else."""
    whole = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & text.contains(":"), text).otherwise(F.concat(text, F.when(text.contains(":"), "Z").otherwise("T00:00:00Z")))
    full = F.regexp_replace(F.regexp_replace(zoned, r"([T ]\d{2}:\d{2})(?=Z|[+-])", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(whole), full.try_cast("timestamp"))


def window_hours(text: Column) -> Column:
    """'3d' or '12h' in hours; null for anything else."""
    n, unit = F.regexp_extract(text, "^([0-9]+)([dh])$", 1), F.regexp_extract(text, "^([0-9]+)([dh])$", 2)
    return F.when(unit == "d", n.try_cast("int") * 24).when(unit == "h", n.try_cast("int"))
