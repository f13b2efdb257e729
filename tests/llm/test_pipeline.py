import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from veilframe.llm.mixing import mix
from veilframe.session import materialize


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first stage and after each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_rows(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    counts = [s.count() for s in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    for before, after in zip(steps[:-1], steps[1:], strict=True):
        assert after.select(*before.columns).exceptAll(before).count() == 0  # no row is changed or added


def test_quality_keeps_clean_documents(steps, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    good, bad = ([i for i, q in labels.items() if q == v] for v in (1, 0))
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.5 * len(bad)  # learned from a handful of bad documents


def test_exact_dedup_keeps_the_largest_id(steps):
    largest = {}
    for r in steps[1].collect():
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(largest.values())


def test_near_dedup_keeps_one_of_each_group(steps):
    from test_jaccard import brute_force

    found = brute_force([(r.doc_id, r.text) for r in steps[2].collect()], 5, 80)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({c for _, _, c in found})


def test_mixing_follows_the_calibrated_fates(steps):
    fates = {r.doc_id: r.mixing for r in mix(steps[3], fraction=0.8, flatten=0.9, hold=True).collect()}
    assert sorted(r.doc_id for r in steps[4].collect()) == sorted(i for i, m in fates.items() if m.kept)
    assert sum(m.tokens * m.probability for m in fates.values()) == pytest.approx(0.8 * sum(m.tokens for m in fates.values()))


def test_a_rare_source_does_not_empty_the_mixture(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "'one two three' AS text", "IF(id = 0, 'rare', 'hot') AS source", "IF(id = 0, NULL, 'en') AS lang")
    assert dict(pipeline.STAGES)["mixing"](spark, docs, SF).count() == pytest.approx(8_000, rel=0.03)


def test_ids_equal_the_library(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in steps[5].collect())


def test_run_is_all_stages(steps, spark):
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in steps[5].collect())


def test_odd_rows_through_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            out = materialize(stage(spark, docs, SF), name)
            assert out.columns == docs.columns or name == "encoding"
            docs = out
