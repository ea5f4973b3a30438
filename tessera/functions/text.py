"""Text and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config

Text = Column | str
TOKEN = "[a-z_][a-z0-9_]*|[0-9]+"
STRIP = r"^\s+|\s+$"


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Text) -> Column:
    """Identifiers and numbers in lower case; an identifier with underscores is followed by its parts. Duplicates stay."""
    low = F.lower(_col(text))
    found = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))

    def parts(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("_")), F.concat(F.array(x), F.filter(F.split(x, "_"), lambda p: p != ""))).otherwise(F.array(x))

    # most texts have no underscore, and so no parts
    return F.when(F.contains(low, F.lit("_")), F.flatten(F.transform(found, parts))).otherwise(found)


def token_estimate(text: Text) -> Column:
    """A quarter of the length, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.length(_col(text)) / F.lit(4.0)).cast("int"))


def content_hash(text: Text) -> Column:
    return F.sha2(_col(text), 256)


def chunk_header(path: Text, language: Text, role: Text) -> Column:
    r = _col(role)
    line = F.when(r.isNotNull() & (r != ""), F.concat(F.lit("# Role: "), r, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("# File: "), _col(path), F.lit("\n# Language: "), _col(language), F.lit("\n"), line, F.lit("---\n"))


def not_blank(text: Text) -> Column:
    return F.coalesce(_col(text).rlike(r"\S"), F.lit(False))


def shortened(text: Text, most: int = 500) -> Column:
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def speaker(role: Text) -> Column:
    return F.when(_col(role) == "user", "User").otherwise("Assistant")


def bare(text: Text) -> Column:
    """Without white space around, then without double quotes around, then without white space again."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(text), STRIP, ""), '^"+|"+$', ""), STRIP, "")


def list_items(text: Text, most: int) -> Column:
    """The first ``most`` items of a numbered, bulleted or plain list of lines, marks and quotes removed."""
    mark = r"^\s*(?:\d+[.)]|[-*•])\s*(.+)$"
    lines = F.filter(F.transform(F.split(_col(text), r"\r?\n"), lambda x: F.regexp_replace(x, STRIP, "")), lambda x: x != "")
    items = F.transform(lines, lambda x: bare(F.when(x.rlike(mark), F.regexp_extract(x, mark, 1)).otherwise(x)))
    return F.slice(F.filter(items, lambda x: x != ""), 1, max(most, 0)) if most > 0 else F.array().cast("array<string>")


def keyword_coverage(answer: Text, keywords: Text) -> Column:
    """Share of the keywords that the answer contains, in any case; no keywords or answer: 0."""
    k, low = _col(keywords), F.lower(_col(answer))
    return F.coalesce(F.try_divide(F.size(F.filter(k, lambda x: F.contains(low, F.lower(x)))).cast("double"), F.size(k).cast("double")), F.lit(0.0))


def keyword_hit(answer: Text, keywords: Text, least: float = 0.5) -> Column:
    return keyword_coverage(answer, keywords) >= least


def judge_response(raw: Text) -> Column:
    """struct(verdict, reasoning, score) of a grader's output: the object from the first brace to the last.

    Without one, or with an unknown verdict: verdict ``error``, score 0.
    """
    found = F.from_json(F.regexp_extract(_col(raw), r"(?s)(\{.*\})", 1), "verdict string, reasoning string")
    verdict = F.lower(F.regexp_replace(found["verdict"], STRIP, ""))
    known = F.coalesce(verdict.isin(*config.VERDICTS), F.lit(False))
    score = F.lit(0.0)
    for name, value in config.VERDICTS.items():
        score = F.when(verdict == name, value).otherwise(score)
    return F.struct(F.when(known, verdict).otherwise("error").alias("verdict"), F.coalesce(found["reasoning"], F.lit("")).alias("reasoning"), F.when(known, score).otherwise(0.0).alias("score"))


def rounded(x: Text, digits: int) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, ties to even: 2.675 is a little less than it looks and gives 2.67.

    The product with the power of ten is made without error, as a double and what that leaves (by splitting the factor in halves of
    its digits); where the double lies half way between two whole numbers the rest decides. Null, NaN and infinite values
    stay; of numbers so large that the product has no half (2**52 and more) the shortest decimal form is rounded.
    """
    if not 0 <= digits <= 8:
        raise ValueError("digits is 0 to 8")
    v, scale = _col(x).cast("double"), float(10**digits)
    product = v * F.lit(scale)
    big = v * F.lit(134217729.0)
    high = big - (big - v)
    rest = (high * F.lit(scale) - product) + (v - high) * F.lit(scale)
    near = F.rint(product)
    half = product - near
    # on a tie of the double, rint has gone to the even side; the rest says on which side of the tie the number is
    near = near + F.when((half == 0.5) & (rest > 0), 1.0).when((half == -0.5) & (rest < 0), -1.0).otherwise(0.0)
    return F.when(F.abs(product) < float(2**52), near / F.lit(scale)).when(F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.bround(v, digits))


def mean(values: Text, digits: int = 2) -> Column:
    """Aggregate: rounded average, 0 for nothing."""
    return F.coalesce(rounded(F.avg(_col(values)), digits), F.lit(0.0))


def cosine(a: Text, b: Text) -> Column:
    """Cosine similarity of two float arrays, in double; 0 if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    x, y = _col(a), _col(b)
    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))


def dot(a: Text, b: Text) -> Column:
    """Inner product in double; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
