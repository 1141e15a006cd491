"""Small classifications over single columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope.constants import CATEGORY_KEYWORDS


def trust_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "80-100").when(score >= 60, "60-79").when(score >= 40, "40-59")
        .when(score >= 20, "20-39").when(score >= 0, "0-19")
    )


def trust_color(score: Column) -> Column:
    """Null and 0 both mean "not scored"."""
    return (
        F.when(F.coalesce(score, F.lit(0)) == 0, "unscored")
        .when(score >= 70, "green").when(score >= 50, "yellow").otherwise("red")
    )


def facility_class(facility_type: Column) -> Column:
    t = F.lower(F.coalesce(facility_type, F.lit("")))
    return F.when(t.contains("hospital"), "hospital").when(t.contains("clinic"), "clinic").otherwise("other")


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def _categories(test) -> str:
    cases = [f"if({test(kws)}, '{c}', null)" for c, kws in CATEGORY_KEYWORDS.items()]
    return f"array_compact(array({', '.join(cases)}))"


def _any_keyword(name: str, keywords: list[str]) -> str:
    return " or ".join(f"contains({name}, '{k}')" for k in keywords)


def categories_of(text: str) -> Column:
    """Categories with a keyword inside the column ``text``, as an array, in lexicon order.

    The lexicon is fixed and small, so it is inlined: no join, no shuffle. The lower-cased
    text is bound once through a one-element array.
    """
    found = _categories(lambda kws: _any_keyword("t", kws))
    return F.expr(f"get(transform(array(lower({text})), t -> {found}), 0)")


def categories_of_claims(claims: str, min_confidence: float | None = None) -> Column:
    """Categories hit by any claim of a facility's claim array column."""
    sure = claims if min_confidence is None else f"filter({claims}, c -> c.confidence >= {min_confidence}D)"
    found = _categories(lambda kws: f"exists(names, n -> {_any_keyword('n', kws)})")
    return F.expr(f"get(transform(array(transform({sure}, c -> lower(c.capability))), names -> {found}), 0)")
