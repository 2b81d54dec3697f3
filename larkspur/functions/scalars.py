"""Scalar functions over columns; all are built-in expressions, none runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and what they become (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def strip_accents(x: Column) -> Column:
    return F.translate(F.translate(x, ACCENTED, PLAIN), ACCENTED.upper(), PLAIN.upper())


def normalised_name(x: Column) -> Column:
    """Without accents, in lower case, hyphens as spaces, trimmed."""
    return F.trim(F.replace(F.lower(strip_accents(x)), F.lit("-"), F.lit(" ")))


def folded(x: Column) -> Column:
    return F.lower(F.trim(x))


def token_similarity(source: Column, target: Column) -> Column:
    """For two normalised names: (share, distance). A token of the source costs 0 against an equal token or one that is
    a prefix either way, its edit distance if that is at most one, and has no match otherwise."""
    a, b = F.split(source, " "), F.split(target, " ")

    def cost(s: Column, t: Column) -> Column:
        d = F.levenshtein(s, t)
        return F.when(F.startswith(t, s) | F.startswith(s, t), F.lit(0)).when(d <= 1, d)

    best = F.transform(a, lambda s: F.array_min(F.transform(b, lambda t: cost(s, t))))
    found = F.filter(best, lambda x: x.isNotNull())
    return F.struct((F.size(found) / F.size(a)).alias("share"), F.aggregate(found, F.lit(0), lambda s, x: s + x).alias("distance"))


def clock_seconds(x: Column) -> Column:
    """Seconds of a clock text HH:MM:SS(.fff); null if it is none."""
    p = F.split(x, ":")
    return F.when(x.rlike(r"^\d+:\d{2}:\d{2}(\.\d+)?$"), p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double"))


def short_date(x: Column) -> Column:
    """A date dd/MM/yy; years from 69 on belong to the century before 2000."""
    d = F.to_date(x, "dd/MM/yy")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def money(x: Column) -> Column:
    return F.regexp_replace(x, "[$,]", "").try_cast("double")


def percent(x: Column) -> Column:
    return F.replace(x, F.lit("%"), F.lit("")).try_cast("double") / 100


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clipped(x, -500.0, 500.0)))


def sane(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def floored(probabilities: list[Column], floor: float = 0.005) -> list[Column]:
    """Probabilities, none under the floor, that sum to one."""
    p = [F.greatest(F.lit(floor), F.least(F.lit(1.0), x)) for x in probabilities]
    total = sum(p[1:], p[0])
    return [x / total for x in p]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def argmax(xs: Column) -> Column:
    """The first place (from 0) of the largest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def path_length(n: Column) -> Column:
    """The mean length of an unsuccessful search in a binary search tree of n keys."""
    n = n.cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n)


def hellinger(left_pos: Column, left_neg: Column, pos: Column, neg: Column) -> Column:
    """How far a split moves the two classes apart; 0 if a class is empty."""
    part = lambda p, n: F.pow(F.sqrt(F.try_divide(p, pos)) - F.sqrt(F.try_divide(n, neg)), F.lit(2.0))
    return F.coalesce(part(left_pos, left_neg) + part(pos - left_pos, neg - left_neg), F.lit(0.0))


def gini(pos: Column, n: Column) -> Column:
    p = F.try_divide(pos, n)
    return F.coalesce(1 - p * p - (1 - p) * (1 - p), F.lit(0.0))


def weekday(x: Column) -> Column:
    """Monday is 0."""
    return F.weekday(x)


def unit(seed: int, purpose: str, *ids: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the purpose and the ids alone."""
    return F.conv(F.substring(draw(seed, purpose, *ids), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw(seed: int, purpose: str, *ids: Column) -> Column:
    """A hash to order rows at random by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[x.cast("string") for x in ids]))
