"""Edit-distance join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glosswerk.operators import citations, fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters", [2, 3, 5, 10])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é漢"])
def test_against_all_pairs(spark, letters, alphabet):
    r = random.Random(letters)

    def text():
        return "".join(r.choice(alphabet) for _ in range(r.choice([1, 3, 8, 9, 10, 19, 20, 21, 40])))

    def edited(t):
        t = list(t)
        for _ in range(r.randrange(0, 1 + len(t) // letters + 1)):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randrange(2)] = [r.choice(alphabet)] * r.randrange(2)
        return "".join(t)

    right = [text() for _ in range(60)]
    left = [edited(r.choice(right)) for _ in range(60)] + [text() for _ in range(20)] + ["", None]
    want = {(a, b, d) for a in left if a for b in right if (d := distance(a, b)) <= max(len(a), len(b)) // letters}
    got = fuzzy.pairs(*(spark.createDataFrame([(t,) for t in x], "text string") for x in (left, right + ["", None])), letters=letters)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_join_is_on_grams_alone(spark):
    one = spark.createDataFrame([("some title of a work",)], "text string")
    plan = fuzzy.pairs(one, one)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_title_match_of_an_audit(spark):
    text = "Smith (2010) and Lee (2011) and Roe (1999)\n- Smith, J. (2010). A theory of evrything new. *Journal*, 3.\n- Lee, K. (2011). Nothing like it. *Journal*, 4."
    files = spark.createDataFrame([("f", text)], "file string, content string")
    bib = spark.createDataFrame([("s2", ["Smith, J."], "A Theory of Everything New", 2010, None, 1), ("s1", ["Smith, J."], "A theory of everything new", 2010, None, 0), ("l", ["Lee, K."], "Quite another thing", 2011, None, 2)], "id string, authors array<string>, title string, year int, doi string, pos long")
    audited = citations.audit(files, bib)
    assert audited.where(F.col("title_match").isNotNull()).count() == 0
    got = {r.lookup_key: r.title_match for r in citations.match_titles(audited, files, bib).collect()}
    assert got == {"smith_2010": "s1", "lee_2011": None, "roe_1999": None}
    assert citations.match_titles(audited, files, bib).columns == audited.columns


def test_texts_of_few_words_do_not_meet_all_others(spark):
    """All grams of these texts are common ones; joins still make few rows beside 6 million pairs."""
    r = random.Random(1)
    words = ["large", "small", "hot", "cold", "green", "shiny", "round", "plain"]
    texts = [[(" ".join(r.choice(words) for _ in range(3)) + f" for brand {r.randrange(25)} number{r.randrange(50)}",) for _ in range(2500)] for _ in range(2)]
    a, b = (spark.createDataFrame(t, "text string") for t in texts)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {tuple(x) for x in fuzzy.pairs(a, b).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows = 0
    for e in range(before, store.executionsCount()):
        run = store.executionsList().apply(e)
        nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for n in (nodes.apply(k) for k in range(nodes.size())):
            made = [m for m in (n.metrics().apply(k) for k in range(n.metrics().size())) if m.name() == "number of output rows"]
            if "Join" in n.name() and made and values.contains(made[0].accumulatorId()):
                rows += int(values.apply(made[0].accumulatorId()).replace(",", ""))
    assert 0 < rows < 200_000
    some = [(x, y) for (x,) in texts[0][:4] for (y,) in texts[1]]
    assert {(x, y, d) for x, y in some if (d := distance(x, y)) <= max(len(x), len(y)) // 10} == {p for p in got if p[0] in {x for (x,) in texts[0][:4]}}
