"""Lexical search by bounds: equal to scoring everything, with few pairs scored."""

import random

import pytest
from tests.test_search import relevance, world

from claimscope.operators import lexical
from claimscope.operators.substrings import standing_in

WORDS = ["dialysis", "hospital", "care", "trauma", "beds", "staff", "icu", "bihar", "goa", "new", "delhi", "delhi-1", "clinic", "phc", "in", "eye", "xyzzy", "bi-2,"]


def log(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 6))).title() for _ in range(n)] + ["", "  ", None]


def brute(fac, queries, k):
    out = []
    for i, q in enumerate(queries):
        scored = [(f["facility_id"], *relevance(f, q)) for f in fac] if q is not None else []
        best = sorted((s for s in scored if s[1] > 0), key=lambda s: (-s[1], s[0]))[:k]
        out += [(i, n + 1, fid, score, trust, tuple(hit)) for n, (fid, score, trust, hit) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n,k,seed", [(300, 3, 1), (60, 1, 2), (4, 7, 3)])
def test_equals_scoring_everything(spark, n, k, seed):
    fac, raw, structured, trust = world(spark, n, seed)
    queries = log(60, seed)
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = sorted((r.query_id, r.rank, r.facility_id, r.score, r.trust_score, tuple(r.matching_capabilities)) for r in lexical.lexical_search(table, raw, structured, trust, k).collect())
    assert got == brute(fac, queries, k)


def test_few_pairs_are_scored(spark):
    """Common words, one place with two fifths of all facilities, and queries that repeat each other."""
    fac, raw, structured, trust = world(spark, 3000, 7)
    queries = [q for q in log(200, 7) if q] * 3
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    terms = lexical.Terms(table, raw, structured)
    _, pairs = lexical.ranked_needs(terms, trust, 5)
    needs = terms.needs.count()
    assert needs <= 201
    scored = pairs["heads"].unionByName(pairs["opened"]).select("need", "facility_id").distinct().count()
    assert scored < 0.15 * needs * len(fac), (scored, needs * len(fac))


def test_standing_in_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  c") for _ in range(rng.randint(0, 14))) for _ in range(120)] + [None]
    terms = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 6))) for _ in range(60)] + [" ", "", None]
    got = {(r.text, r.term) for r in standing_in(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(x, t) for x in texts for t in terms if x and t and t in x}
