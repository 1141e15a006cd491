"""What line deduplication and the quality rules leave out on the way, and that their results stay whole."""

import random

from claimscope.llm import linededup, quality
from claimscope.llm.shared import small_batches
from tests.llm.conftest import rows_of
from tests.llm.test_groups import brute_lines

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_lines_around_one_passage_are_no_candidates(docs):
    r = random.Random(3)
    passage = words(r, 12)
    rows = [(i, " ".join([*words(r, 15), *passage, *words(r, 15)])) for i in range(60)]
    d = docs(*rows)
    lines = linededup.tokenized(linededup.lines_of(d)).selectExpr("struct(doc_id, row, line) AS a", "size(toks) AS n", "toks")
    assert linededup._shared(lines).count() == 0
    assert linededup._candidates(linededup._kinds(d)).count() < 30
    assert linededup.duplicates(d).count() == 0


def test_lines_about_the_threshold(docs):
    r = random.Random(4)
    rows = []
    for i in range(40):
        base = words(r, r.choice([1, 3, 5, 6, 7, 9, 12, 25, 60]))
        for k in range(4):
            line = list(base)
            for _ in range(k):
                line[r.choice([0, -1, r.randrange(len(line))])] = f"x{r.randrange(10**6)}"
            rows.append((4 * i + k, " ".join(line + words(r, r.choice([0, 0, 1, 3]))) + "\n" + " ".join(base)))
    r.shuffle(rows)
    assert rows_of(linededup.dedup_report(docs(*rows))) == brute_lines(rows)


def test_texts_are_measured_once(spark, docs):
    r = random.Random(5)
    d = docs(*((i, " ".join(words(r, 30))) for i in range(80)))
    before = spark.conf.get(BATCH)
    kept = quality.keep(d)
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().toString()
    assert kept.columns == d.columns and kept.count() == quality.judge(d).where("kept").count()
    with small_batches(spark, 7):
        assert spark.conf.get(BATCH) == "7"
    assert spark.conf.get(BATCH) == before
