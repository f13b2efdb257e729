import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from compare import connect, differences
from conftest import SF
from pyspark.sql import functions as F

from veilframe.llm.mixing import held_scale, mix, rake, sample
from veilframe.llm.oracle import ORACLE
from veilframe.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLE[name], connect(SF)) == []


def test_raking_meets_all_marginals(spark):
    rows = [(f"={s}", f"={g}", f"={t}", 10 + 7 * i + 3 * j + 13 * k * i) for i, s in enumerate("abc") for j, g in enumerate("xy") for k, t in enumerate("pq")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 1, "b": 1, "c": 2}, "lang": {"x": 3, "y": 1}, "topic": {"p": 1, "q": 1}}
    done = rake(cells, targets, rounds=25).collect()
    total = sum(r.tokens for r in done)
    for d, shares in targets.items():
        for value, share in shares.items():
            have = sum(r.tokens * r.rate for r in done if r[d] == f"={value}") / total
            assert have == pytest.approx(share / sum(shares.values()), abs=1e-9)


def test_sample_has_the_wanted_shares(spark):
    docs = spark.range(40_000).selectExpr(
        "id AS doc_id", "'one two three' AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 3)) AS source", "IF(id % 10 < 8, 'en', 'de') AS lang"
    )
    got = sample(docs, targets={"lang": {"en": 1, "de": 1}}, fraction=0.3)
    assert got.columns == docs.columns
    counts = dict(got.groupBy("lang").count().collect())
    assert 0.95 < counts["en"] / counts["de"] < 1.05 and abs(sum(counts.values()) / 12_000 - 1) < 0.05


def test_one_tiny_cell_does_not_lower_the_held_share(spark):
    docs = spark.range(20_000).selectExpr(
        "id AS doc_id", "'one two three' AS text", "IF(id = 0, NULL, concat('s', id % 2)) AS source", "IF(id = 0, NULL, IF(id % 10 < 8, 'en', 'de')) AS lang"
    )
    options = {"fraction": 0.5, "rounds": 2}
    assert mix(docs, **options).where("mixing.kept").count() < 2_000  # the one document of a source and language of its own sets the scale
    most, share, kept = mix(docs, **options, hold=True).selectExpr(
        "max(mixing.probability)", "sum(mixing.tokens * mixing.probability) / sum(mixing.tokens)", "count_if(mixing.kept)"
    ).first()
    assert most == 1 and share == pytest.approx(0.5, abs=1e-9) and kept == pytest.approx(10_000, rel=0.03)


def test_held_scale(spark):
    table = lambda *rows: spark.createDataFrame(rows, "tokens long, rate double").coalesce(1)
    cells = table((1, 500.0), (9, 20.0), (90, 1.0), (900, 0.5))
    for fraction in (0.01, 0.2, 0.5, 0.9, 1.0):
        scale = held_scale(cells, fraction)
        assert sum(r.tokens * min(1.0, r.rate * scale) for r in cells.collect()) == pytest.approx(fraction * 1000)
    assert held_scale(table((10, 0.0), (10, 2.0)), 0.8) >= 0.5  # all that has a rate is kept
    assert held_scale(table((10, 0.0)), 0.5) == held_scale(table((10, 0.0)).limit(0), 0.5) == 0


def test_odd_rows(odd_docs, no_docs):
    got = mix(odd_docs)
    assert got.columns == [*odd_docs.columns, "mixing"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(r.mixing.tokens >= 1 and 0 <= r.mixing.probability <= 1 for r in rows)
    assert {"short", "long"} <= {r.mixing.topic for r in rows} <= {"short", "long", "prose", "table"}
    assert mix(no_docs).collect() == [] and sample(no_docs).collect() == []
    # A null value can be named; values that are not named get nothing.
    only = mix(odd_docs, targets={"lang": {None: 1.0}}).where("mixing.rate > 0")
    assert {r.lang for r in only.collect()} == {None}
    assert sample(odd_docs, targets={"lang": {}}).count() == 0
    assert sample(odd_docs.withColumn("mixing", F.lit(1))).columns == [*odd_docs.columns, "mixing"]


def test_the_query_keeps_the_share_asked_for(spark):
    n, kept = QUERIES["op6_mixing"](spark, SF).selectExpr("sum(n_tokens)", "sum(n_tokens * probability)").first()
    assert kept / n == pytest.approx(0.5, abs=1e-4)
