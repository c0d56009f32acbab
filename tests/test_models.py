import math

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import balance, bayesnet, decide, features, naive_bayes, novelty
from vitalgrid.operators.bayesnet import ACTIVITY_STATES, PARENTS, VARIABLES
from vitalgrid.sources import scans

TEXT = """network unknown {
}
variable Activity {
  type discrete [ 4 ] { SITTING, WALKING, WALKING_DOWN, WALKING_UP };
}
variable HR_RATE {
  type discrete [ 4 ] { [60_70], _70_75], _75_1.2e+02], _1.2e+02_200] };
}
probability ( Activity ) {
  table 0.4, 0.3, 0.2, 0.1;
}
probability ( HR_RATE | Activity ) {
  (SITTING) 0.7, 0.1, 0.1, 0.1;
  (WALKING) 0.25, 0.25, 0.25, 0.25;
  (WALKING_DOWN) 0.0, 0.5, 0.5, 0.0;
  (WALKING_UP) 1.0, 0.0, 0.0, 0.0;
}
"""


def test_network_file(spark, tmp_path):
    (tmp_path / "small.bif").write_text(TEXT)
    net = scans.read_networks(spark, str(tmp_path / "small.bif"))
    cuts = scans.network_cuts(scans.network_states(net)).collect()
    assert [(c["network"], c["variable"], c["cuts"]) for c in cuts] == [("small", "HR_RATE", [60.0, 70.0, 75.0, 120.0, 200.0])]
    tables = {(r["variable"], r["given"], r["state"]): r["p"] for r in scans.network_tables(net).collect()}
    assert len(tables) == 4 + 16
    assert tables[("Activity", "", 1)] == 0.3
    assert tables[("HR_RATE", "2", 1)] == 0.5 and tables[("HR_RATE", "3", 0)] == 1.0


@pytest.fixture(scope="module")
def tables(spark):
    cells = spark.range(600).select(
        F.lit("n").alias("network"),
        *[(F.pmod(F.xxhash64(F.col("id"), F.lit(v)), F.lit(4))).cast("int").alias(v) for v in VARIABLES],
    )
    return bayesnet.fit_tables(bayesnet.cell_counts(cells, ["network"]), ["network"])


def test_tables_are_complete_and_sum_to_one(tables):
    sums = tables.groupBy("variable", "given").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == sum(4 ** len(p) for p in PARENTS.values())
    assert all(r["n"] == 4 and abs(r["s"] - 1) < 1e-9 for r in sums)


def test_posteriors_sum_to_one(tables):
    joint = bayesnet.joint_table(tables, ["network"])
    assert joint.count() == 1024 and abs(joint.agg(F.sum("joint")).first()[0] - 1) < 1e-9
    post = bayesnet.posterior_table(joint, ["network"])
    for v in VARIABLES:
        others = [o for o in VARIABLES if o != v]
        whole = post.groupBy(*others).agg(F.sum(f"post_{v}").alias("s")).collect()
        assert all(abs(r["s"] - 1) < 1e-9 or r["s"] == 0 for r in whole)


def test_bins(spark):
    values = [59.0, 60.0, 70.0, 70.1, 75.0, 120.0, 200.0, 200.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts = F.array(*[F.lit(c) for c in (60.0, 70.0, 75.0, 120.0, 200.0)])
    got = [r[0] for r in df.select(bayesnet.bin_index(F.col("v"), cuts)).collect()]
    assert got == [None, 0, 0, 1, 1, 2, 3, None]


def test_out_of_range_is_novel(spark, tables, monkeypatch):
    table = bayesnet.posterior_table(bayesnet.joint_table(tables, ["network"]), ["network"])
    row = [("n", "e", 0, 0, 0, None, 0)]
    df = spark.createDataFrame(
        row, "network string, id string, Activity int, HR_RATE int, GSR_RESISTANCE int, SKTMP_TEMPERATURE int, RRI_INTERVAL int"
    ).withColumns({f"event_{v}": F.lit(v) for v in VARIABLES})
    for limit in (0, 10_000):
        monkeypatch.setattr(bayesnet, "BROADCAST_ROWS", limit)
        out = novelty.decide(bayesnet.posteriors(df, table, ["network"], ["id"]), 0.15).first()
        assert all(out[f"post_{v}"] == 0.0 for v in VARIABLES)
        assert out["novel"] and len(out["violations"]) == 5
        assert out["violations"][0]["out_event"] == "SKTMP_TEMPERATURE"
        assert out["violations"][0]["in_events"] == ["Activity", "GSR_RESISTANCE", "HR_RATE", "RRI_INTERVAL"]


def test_quartiles(spark):
    df = spark.range(1, 9).select(F.lit("n").alias("network"), F.col("id").cast("double").alias("HR_RATE"))
    cuts = bayesnet.cut_points(df, ["network"], ["HR_RATE"]).first()["cuts"]
    assert cuts == [1.0, 2.0, 4.0, 6.0, 8.0]


def votes(spark, labels):
    return spark.createDataFrame([("u", v) for v in labels], "k string, label string")


def test_vote(spark):
    one = decide.vote(votes(spark, ["SITTING"] + ["WALKING_UP"] * 5), ["k"], "label").first()
    assert (one["activity"], one["score"], one["n_top"]) == ("SITTING", 3, 1)
    tie = decide.vote(votes(spark, ["WALKING", "SITTING"]), ["k"], "label").first()
    assert (tie["activity"], tie["n_top"]) == ("SITTING", 2)
    plain = decide.vote(votes(spark, ["SITTING"] + ["WALKING_UP"] * 5), ["k"], "label", decide.EQUAL_WEIGHTS).first()
    assert plain["activity"] == "WALKING_UP"


def test_no_vote_is_invented(spark):
    none = decide.vote(votes(spark, [None, "RUNNING"]), ["k"], "label").first()
    assert (none["activity"], none["score"], none["n_top"]) == (None, None, 0)
    only = decide.vote(votes(spark, ["WALKING_UP", "WALKING_UP"]), ["k"], "label").first()
    assert (only["activity"], only["score"], only["n_top"]) == ("WALKING_UP", 0, 1)
    df = spark.createDataFrame([("RUNNING", None), ("WALKING_UP", None)], "a string, b string")
    assert [r[0] for r in df.select(decide.vote_in_row(["a", "b"])).collect()] == [None, "WALKING_UP"]


def test_no_label_for_a_missing_feature(spark):
    rows = [("u", n, v) for n, v in (("SITTING", 1.0), ("SITTING", 1.2), ("WALKING", 5.0), ("WALKING", 5.5))]
    params = naive_bayes.fit_gaussian(spark.createDataFrame(rows, "k string, label string, f double"), ["k"], "label", ["f"], ["SITTING", "WALKING"])
    new = spark.createDataFrame([("u", 5.1), ("u", None), ("u", float("nan"))], "k string, f double")
    got = naive_bayes.score_gaussian(new, params, ["k"], ["f"], ["SITTING", "WALKING"], ["f"]).collect()
    assert sorted(str(r["prediction"]) for r in got) == ["None", "None", "WALKING"]


def test_results_of_two_devices_have_two_ids(spark):
    from vitalgrid.plans import scoring

    df = spark.createDataFrame([("d1", "u", 3), ("d2", "u", 3)], "deviceid string, userid string, window long")
    got = scoring.result_rows(df, "accelerometer", 10_000, F.lit("SITTING"), keys=("deviceid", "userid"))
    assert got.select("eventId").distinct().count() == 2


def test_a_single_row_is_copied_in_blocks(spark):
    from vitalgrid.operators import balance

    rows = spark.range(100_000).select(F.lit("d").alias("d"), F.lit("WALKING").alias("activity"), F.col("id").alias("time_stamp"))
    one = spark.createDataFrame([("d", "WALKING_UP", 1)], "d string, activity string, time_stamp long")
    out = balance.oversample(rows.unionByName(one), ["d"], "activity", ["time_stamp"], 20_000)
    copies = out.where("activity = 'WALKING_UP'").withColumn("part", F.spark_partition_id())
    assert copies.count() == 50_000 and copies.select("copy_no").distinct().count() == 50_000
    assert copies.groupBy("part").count().count() > 1


def test_vote_in_row(spark):
    df = spark.createDataFrame([("SITTING", "WALKING_UP", None)], "a string, b string, c string")
    assert df.select(decide.vote_in_row(["a", "b", "c"])).first()[0] == "SITTING"


def test_impute(spark):
    df = spark.createDataFrame([(0, None, 0), (1, 4, 0), (None, None, None)], "a int, b int, c int")
    got = [tuple(r) for r in decide.impute_most_frequent(df, ["a", "b", "c"]).collect()]
    assert got == [(0, 0, 0), (1, 0, 0), (None, None, None)]


def test_features_of_small_windows(spark):
    rows = [("u", 0, 1.0, 2.0, 5.0), ("u", 1, 1.0, 3.0, 5.0), ("v", 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "userid string, t long, x double, y double, z double")
    got = {r["userid"]: r for r in features.axis_features(df, ["userid"], "t", 10).collect()}
    assert got["u"]["corr_xy"] == 0.0 and got["u"]["var_y"] == 0.5
    assert got["v"]["avg_x"] == 1.0 and got["v"]["std_x"] == 0.0 and got["v"]["corr_xz"] == 0.0


@pytest.mark.parametrize("piece_ms", [None, 5])
def test_slopes(spark, piece_ms):
    df = spark.createDataFrame([("u", 0, 10.0), ("u", 10, 20.0), ("u", 20, 50.0)], "k string, t long, v double")
    got = features.slopes(df, ["k"], "t", ["v"], piece_ms).orderBy("t").collect()
    assert [r["slope_v"] for r in got] == [0.0, 1.0, 3.0]


def test_oversampling_reaches_the_target(spark):
    labels = ["WALKING"] * 14 + ["SITTING"] * 10 + ["WALKING_UP"] * 5 + ["WALKING_DOWN"] * 12
    df = spark.createDataFrame([("d", n, i) for i, n in enumerate(labels)], "d string, label string, t long")
    out = balance.oversample(df, ["d"], "label", ["t"], 4)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"WALKING": 14, "SITTING": 12, "WALKING_UP": 12, "WALKING_DOWN": 12}
    assert out.where("copy_no = 0").count() == len(labels)


def test_gaussian_against_the_formula(spark):
    rows = [("m", "SITTING", 1.0), ("m", "SITTING", 3.0), ("m", "WALKING", 10.0), ("m", "WALKING", 14.0)]
    df = spark.createDataFrame(rows, "m string, label string, f double")
    labels = ["SITTING", "WALKING", "WALKING_UP"]
    model = naive_bayes.fit_gaussian(df, ["m"], "label", ["f"], labels)
    out = naive_bayes.score_gaussian(
        spark.createDataFrame([("m", 2.5), ("m", 9.0), ("other", 1.0)], "m string, f double"), model, ["m"], ["f"], labels, ["f"]
    )
    assert {(r["f"], r["prediction"]) for r in out.collect()} == {(2.5, "SITTING"), (9.0, "WALKING")}
    row = model.first()
    assert row["class_SITTING"]["mean_f"] == 2.0 and abs(row["class_SITTING"]["var_f"] - 1.0) < 1e-8
    assert row["class_WALKING_UP"] is None


def test_multinomial_smoothing(spark):
    df = spark.createDataFrame([("m", "SITTING", 0, 1), ("m", "WALKING", 1, 1)], "m string, label string, a int, b int")
    model = naive_bayes.fit_multinomial(df, ["m"], "label", ["a", "b"], ["SITTING", "WALKING"], 3)
    logp = model.first()["class_SITTING"]["logp"]
    assert [round(math.exp(v) * 8) for v in logp] == [2, 1, 1, 1, 2, 1]


def test_split_is_repeatable(spark):
    df = spark.range(1000).selectExpr("cast(id as string) id")
    train, test = balance.key_split(df, ["id"], 3, 4)
    again, _ = balance.key_split(df.repartition(7), ["id"], 3, 4)
    assert sorted(train.collect()) == sorted(again.collect())
    assert train.count() + test.count() == 1000 and 650 < train.count() < 850


def test_activity_states():
    assert ACTIVITY_STATES == ["SITTING", "WALKING", "WALKING_DOWN", "WALKING_UP"]


def test_slopes_are_scored_for_users_with_a_model(spark):
    from vitalgrid.plans import scoring
    from vitalgrid.sources.registry import LABELS

    train = [("u", "SITTING", 0.0, 0.0), ("u", "SITTING", 0.002, 0.0), ("u", "WALKING", 1.0, 1.0), ("u", "WALKING", 1.2, 1.0)]
    schema = "userid string, label string, avg_slope_pressure double, avg_slope_temperature double"
    params = naive_bayes.fit_gaussian(
        spark.createDataFrame(train, schema), ["userid"], "label", features.SLOPE_FEATURES, LABELS
    )
    rows = [("u", 0, 1.0, 1.0), ("u", 10, 1.0, 1.0), ("u", 100, 0.0, 0.0), ("u", 110, 22.0, 20.0), ("x", 0, 1.0, 1.0)]
    readings = spark.createDataFrame(rows, "userid string, time_stamp long, air_pressure double, temperature double")
    out = {r["time_stamp"]: r["result"] for r in scoring.score_slopes(readings, params, 100).collect()}
    assert out == {0: "SITTING", 100: "WALKING"}


def test_labelled_lines(spark):
    line = ",".join(['"e1"', '"band"', '"WALKING"', "7", "1456939604898", '"user_a"'] + ["1"] * 34)
    row = scans.parse_labelled_lines(spark.createDataFrame([(line,)], "value string")).first()
    assert (row["EVENT_ID"], row["ACTIVITY_TRAIN"], row["USER_ID"]) == ("e1", "WALKING", "user_a")
    assert row["ACCEL_X"] == 1.0 and row["ALT_TOTAL_LOSS"] == 1 and len(row) == 40


def test_model_names(spark):
    names = [
        "hdfs:/m/accelerometer_a@x.org_FEA_.MDL", "/m/sk_gyroscope_b_c@x.org_FEA_.mdl", "/m/sk_gyroscope_b_c@x.org_FEA_.mdl",
        "/m/sk_aggr_a@x.org_labelEncoder", "/m/aggregation_a@x.org_AGR_.MDL", "/m/readme.txt",
    ]
    out = scans.parse_model_names(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert {(r["sensor"], r["userid"], r["kind"]) for r in out} == {
        ("accelerometer", "a@x.org", "forest"), ("gyroscope", "b_c@x.org", "plain")
    }


def test_lookup_paths_agree(spark):
    from vitalgrid.operators import joins

    rows = spark.range(200).selectExpr("id", "id % 7 as k")
    table = spark.createDataFrame([(i, i * 10) for i in range(5)], "k long, v long")
    plain = sorted(rows.join(table, "k").select("id", "v").collect())
    for small in (None, 2, 100):
        got = joins.salted_lookup(rows, table, ["k"], ["id"], small_rows=small).select("id", "v").collect()
        assert sorted(got) == plain


def test_a_value_that_equals_its_mean_is_not_above_it(spark):
    # 0.3 + 0.2 + 0.1 sums below 0.6, and so does 0.1 forty times below its true sum
    values = [("a", 0.3), ("a", 0.2), ("a", 0.1), *[("b", 2.11)] * 60, ("c", 1.0), ("c", 2.5), ("d", None), ("e", 1e30), ("e", 1e-30)]
    rows = spark.createDataFrame(values, "u string, x double").coalesce(1)
    params = rows.groupBy("u").agg(*features.mean_parts("x"))
    got = {(r["u"], r["x"]): r["above"] for r in rows.join(params, "u").select("u", "x", features.above_mean("x").alias("above")).collect()}
    assert got == {
        ("a", 0.3): True, ("a", 0.2): False, ("a", 0.1): False, ("b", 2.11): False, ("c", 1.0): False, ("c", 2.5): True,
        ("d", None): None, ("e", 1e30): True, ("e", 1e-30): False}
