"""The pipeline's stages beside plain versions, each on its own input."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tests.llm.test_exact import plain_components, plain_phrases
from tests.llm.test_learned import plain_spans

SF = "/root/testdata/sf0.001"


def names(df):
    assert tuple(df.columns) == cp.COLUMNS
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_stages_are_the_dealt_ones():
    assert [f.__name__ for _, f in cp.STAGES] == ["keep_good", "keep_one_of_each", "drop_contaminated", "mask_personal", "encode_pieces"]


def test_near_duplicates_leave_one(spark, frame, odd_rows):
    got = names(cp.keep_one_of_each(spark, frame(odd_rows), SF))
    roots = {c for _, _, c in plain_components([(r[0], r[1]) for r in odd_rows])}
    assert len(got) == len(roots) + sum(r[0] is None for r in odd_rows)


def test_contaminated_go(spark, frame, odd_rows):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = odd_rows + rows_of(["before " + bench[0][1] + " after"], 900)
    got = names(cp.drop_contaminated(spark, frame(rows), SF))
    assert len(got) == sum(n == 0 for _, _, n, _ in plain_phrases([(r[0], r[1]) for r in rows], bench)) == len(rows) - 1


def test_personal_data_is_masked(spark, frame, odd_rows):
    rows = odd_rows + rows_of(["call +1 (743) 555-3824 or me@host.org"], 900)
    got = {r["doc_id"]: r for r in cp.mask_personal(spark, frame(rows), SF).collect() if r["doc_id"] is not None}
    assert got[900]["text"] == "call <phone> or <email>" and got[900]["n_chars"] == len("call <phone> or <email>")
    assert all(got[r[0]]["text"] == r[1] for r in odd_rows if r[0] not in (None, 3) and not plain_spans(r[1]))


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = cp.keep_good(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = labels.where("quality = 1").join(good.select("doc_id"), "doc_id", "left_anti").count()
    assert lost <= 0.05 * labels.where("quality = 1").count()
    out = cp.run(spark, SF)
    assert out.where(~F.col("round_trip")).count() == 0
    assert 0 < out.count() < docs.count()
    assert cp.encode_pieces(spark, docs.limit(0), SF).count() == 0


def test_pieces_take_one_worker(spark, frame, odd_rows):
    plan = cp.encode_pieces(spark, frame(odd_rows), SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty_table(spark, frame):
    for _, stage in cp.STAGES:
        assert stage(spark, frame([]).select(*cp.COLUMNS), SF).count() == 0
