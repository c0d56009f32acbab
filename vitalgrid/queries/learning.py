"""Model fitting and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions.scalars import rounded, stable_id
from vitalgrid.operators import decide, features, forest_table, forests, joins, naive_bayes
from vitalgrid.operators.ordered import fit_piece_ms
from vitalgrid.plans import aggregator, scoring, training
from vitalgrid.queries.base import query, r6
from vitalgrid.queries.decisions import CODED_SQL, _THREE, coded_windows
from vitalgrid.queries.ingest import W
from vitalgrid.queries.decisions import _VOTERS, _vote_sql
from vitalgrid.queries.joins import aligned_predictions, sensor_predictions
from vitalgrid.queries.windows import SLOPE_SQL
from vitalgrid.session import scratch_path, stored
from vitalgrid.sources import event_view as view
from vitalgrid.sources import scans
from vitalgrid.sources.registry import LABELS

DAY = 86_400_000
R = view.READINGS_SQL
PI2 = "(2 * pi())"

# Slopes per million milliseconds, labelled by the window's smallest label, per device.
GNB_SQL = f"""{SLOPE_SQL}, f AS (SELECT userid, win, avg(sx) AS p, avg(sy) AS t FROM sloped GROUP BY ALL),
lab AS (SELECT DISTINCT deviceid, userid, time_stamp // {W} AS win, min(activity) OVER (PARTITION BY userid, time_stamp // {W}) AS label
  FROM readings WHERE sensor = 'barometer'),
data AS (SELECT deviceid, f.userid, f.win, label, p, t FROM f JOIN lab ON f.userid = lab.userid AND f.win = lab.win WHERE label <> 'NONE'),
params AS (SELECT deviceid, label, count(*) AS n, avg(p) AS mp, avg(t) AS mt, var_pop(p) + 1e-9 AS vp, var_pop(t) + 1e-9 AS vt
  FROM data GROUP BY ALL)"""


def gnb_windows(spark, sf_dir):
    rows = barometer_rows(spark, sf_dir)
    piece = fit_piece_ms(view.events(spark, sf_dir, False), ["userid"], "time_stamp", DAY)
    sloped = features.slope_features(rows, ["userid"], "time_stamp", W, piece_ms=piece)
    return sloped.select(
        "userid", "window", (F.col("avg_slope_pressure") * 1e6).alias("p"), (F.col("avg_slope_temperature") * 1e6).alias("t")
    )


def barometer_rows(spark, sf_dir):
    return view.readings(spark, sf_dir, sensors=["barometer"]).select(
        "deviceid", "userid", "time_stamp", F.col("x").alias("air_pressure"), F.col("y").alias("temperature"), "activity"
    )


def gnb_data(spark, sf_dir):
    labels = barometer_rows(spark, sf_dir).groupBy(
        "deviceid", "userid", F.floor(F.col("time_stamp") / W).cast("bigint").alias("window")
    ).agg(F.min("activity").alias("label"))
    joined = gnb_windows(spark, sf_dir).join(labels, ["userid", "window"]).where("label <> 'NONE'")
    return joined.select("deviceid", "userid", F.col("window").alias("win"), "label", "p", "t")


@query(
    "fit_gaussian_nb",
    f"""WITH {GNB_SQL} SELECT deviceid, label, n, {r6('mp')} AS mean_p, {r6('mt')} AS mean_t, {r6('vp')} AS var_p, {r6('vt')} AS var_t FROM params""",
)
def fit_gaussian_nb(spark, sf_dir):
    model = naive_bayes.fit_gaussian(gnb_data(spark, sf_dir), ["deviceid"], "label", ["p", "t"], LABELS)
    items = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"class_{n}").alias("c")) for n in LABELS])
    long = model.select("deviceid", F.explode(items).alias("e")).where("e.c IS NOT NULL")
    return long.select(
        "deviceid", "e.label", "e.c.n", *[rounded(f"e.c.{c}").alias(c) for c in ("mean_p", "mean_t", "var_p", "var_t")]
    )


@query(
    "score_gaussian_nb",
    f"""WITH {GNB_SQL}, tot AS (SELECT deviceid, CAST(sum(n) AS DOUBLE) AS total FROM params GROUP BY 1),
    s AS (SELECT d.userid, d.win, q.label, ln(q.n / total) - ln({PI2} * vp) / 2 - (d.p - mp) * (d.p - mp) / (2 * vp)
      - ln({PI2} * vt) / 2 - (d.t - mt) * (d.t - mt) / (2 * vt) AS score
      FROM data d JOIN params q ON d.deviceid = q.deviceid JOIN tot ON d.deviceid = tot.deviceid),
    r AS (SELECT *, row_number() OVER (PARTITION BY userid, win ORDER BY score DESC, CASE label WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1
      WHEN 'WALKING_UP' THEN 2 ELSE 3 END) AS rn FROM s)
    SELECT userid, win, label AS prediction FROM r WHERE rn = 1""",
)
def score_gaussian_nb(spark, sf_dir):
    data = gnb_data(spark, sf_dir)
    model = naive_bayes.fit_gaussian(data, ["deviceid"], "label", ["p", "t"], LABELS)
    out = naive_bayes.score_gaussian(data, model, ["deviceid"], ["p", "t"], LABELS, ["userid", "win"])
    return out.select("userid", "win", "prediction")


MNB_SQL = f"""{CODED_SQL}, truth AS (SELECT userid, time_stamp // {W} AS win, min(activity) AS label FROM (SELECT *, {view.ACTIVITY_SQL} AS activity FROM ev)
  GROUP BY ALL), data AS (SELECT c.userid, 'u' || (CAST(substr(c.userid, 6) AS BIGINT) % 7) AS model, c.win, label, {', '.join(f"coalesce({s}, 4) AS {s}" for s in _THREE)}
  FROM coded c JOIN truth t ON c.userid = t.userid AND c.win = t.win WHERE label <> 'NONE'),
long AS (SELECT model, userid, win, label, unnest([0, 1, 2]) AS slot, unnest([accelerometer, gyroscope, barometer]) AS code FROM data),
classes AS (SELECT model, label, count(*) AS n FROM data GROUP BY ALL),
grid AS (SELECT model, label, n, slot, code FROM classes, (SELECT unnest(range(3)) AS slot), (SELECT unnest(range(5)) AS code)),
hits AS (SELECT model, label, slot, code, count(*) AS h FROM long GROUP BY ALL),
params AS (SELECT g.model, g.label, g.n, g.slot, g.code, ln((coalesce(h, 0) + 1e0) / (3 * n + 15e0)) AS logp
  FROM grid g LEFT JOIN hits x ON g.model = x.model AND g.label = x.label AND g.slot = x.slot AND g.code = x.code)"""


def mnb_data(spark, sf_dir):
    coded = coded_windows(spark, sf_dir)
    truth = view.readings(spark, sf_dir).groupBy("userid", F.floor(F.col("time_stamp") / W).cast("bigint").alias("win")).agg(
        F.min("activity").alias("label")
    )
    joined = coded.join(truth, ["userid", "win"]).where("label <> 'NONE'")
    return joined.withColumn("model", F.expr("concat('u', cast(substr(userid, 6) as bigint) % 7)")).withColumns(
        {s: F.coalesce(s, F.lit(decide.MISSING_CODE)) for s in _THREE}
    )


@query(
    "fit_multinomial_nb",
    f"WITH {MNB_SQL} SELECT model, label, n, slot * 5 + code AS feature, {r6('logp')} AS logp FROM params",
)
def fit_multinomial_nb(spark, sf_dir):
    model = naive_bayes.fit_multinomial(mnb_data(spark, sf_dir), ["model"], "label", _THREE, LABELS, 5)
    items = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"class_{n}").alias("c")) for n in LABELS])
    long = model.select("model", F.explode(items).alias("e")).where("e.c IS NOT NULL")
    flat = long.select("model", "e.label", "e.c.n", F.posexplode("e.c.logp").alias("feature", "lp"))
    return flat.select("model", "label", "n", F.col("feature").cast("bigint").alias("feature"), rounded("lp").alias("logp"))


@query(
    "score_multinomial_nb",
    f"""WITH {MNB_SQL}, tot AS (SELECT model, sum(n) AS total FROM classes GROUP BY 1),
    s AS (SELECT l.userid, l.win, p.label, ln(any_value(p.n) / CAST(any_value(total) AS DOUBLE)) + sum(logp) AS score FROM long l
      JOIN params p ON l.model = p.model AND l.slot = p.slot AND l.code = p.code JOIN tot ON l.model = tot.model GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY userid, win ORDER BY round(score, 9) DESC, CASE label WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1
      WHEN 'WALKING_UP' THEN 2 ELSE 3 END) AS rn FROM s)
    SELECT userid, win, label AS prediction FROM r WHERE rn = 1""",
)
def score_multinomial_nb(spark, sf_dir):
    data = mnb_data(spark, sf_dir)
    model = naive_bayes.fit_multinomial(data, ["model"], "label", _THREE, LABELS, 5)
    out = naive_bayes.score_multinomial(data, model, ["model"], _THREE, LABELS, 5, ["userid", "win"])
    return out.select("userid", "win", "prediction")


def _accelerometer(spark, sf_dir):
    rows = view.readings(spark, sf_dir, sensors=["accelerometer"]).where("activity <> \'NONE\'")
    return forests.with_label_index(rows)


@query("sensor_forest")
def sensor_forest(spark, sf_dir):
    """Forest on raw axes, scored on the rows it has not seen."""
    from vitalgrid.operators.balance import key_split

    train, test = key_split(_accelerometer(spark, sf_dir), ["eventId"], 3, 4)
    model = forests.fit_forest(train, ["x", "y", "z"], prefix="accelerometer_")
    scored = forests.score_all(test, {"accelerometer": model})
    return scored.select("eventId", "activity", forests.predicted_label("accelerometer_prediction").alias("prediction"))


@query("trained_model_error")
def trained_model_error(spark, sf_dir):
    """The whole generation of one sensor's model, with its error per device."""
    return training.train_and_test(
        view.readings(spark, sf_dir), ["x", "y", "z"], "gyroscope", ["time_stamp", "eventId"], "deviceid",
        settings=forests.EARLIER_SENSOR_FOREST,
    )[1]


@query("windowed_forest")
def windowed_forest(spark, sf_dir):
    """Forest on the twelve window features, scored on windows it has not seen."""
    from vitalgrid.operators.balance import key_split

    rows = view.readings(spark, sf_dir, sensors=["gyroscope"]).where("activity <> \'NONE\'")
    f = stored(forests.with_label_index(features.axis_features(rows, ["userid", "activity"], "time_stamp", W)), "train")
    train, test = key_split(f, ["userid", "window"], 3, 4)
    model = forests.fit_forest(train, features.AXIS_FEATURES, prefix="gyroscope_", settings={"numTrees": 10, "maxDepth": 5})
    scored = forests.score_all(test, {"gyroscope": model})
    return scored.select("userid", F.col("window").alias("win"), "activity",
                         forests.predicted_label("gyroscope_prediction").alias("prediction"))


# A target that trees separate exactly: the activity is a function of one code, shifted per sensor or owner.
CODES = 4
_LABEL_LIST = ", ".join(f"'{n}'" for n in LABELS)


def _coded(spark, sf_dir, shift):
    rows = view.readings(spark, sf_dir, labels=False).select("eventId", "userid", "sensor", "time_stamp")
    code = F.pmod(F.col("eventId").cast("bigint"), F.lit(CODES))
    names = F.array(*[F.lit(n) for n in LABELS])
    rows = rows.withColumn("code", code.cast("double"))
    return forests.with_label_index(rows.withColumn("activity", F.get(names, F.pmod(code + shift, F.lit(CODES)).cast("int"))))


@query(
    "separable_forests",
    f"""WITH {R}, t AS (SELECT *, CAST(eventId AS BIGINT) % {CODES} AS code, list_position([{', '.join(f"'{s}'" for s in view.SENSORS)}], sensor) - 1 AS i,
      CAST(('0x' || substr(md5(eventId), 1, 8)) AS BIGINT) % 4 AS bucket FROM readings)
    SELECT eventId, sensor, ([{_LABEL_LIST}])[CAST((code + i) % {CODES} + 1 AS BIGINT)] AS prediction FROM t WHERE bucket = 3""",
)
def separable_forests(spark, sf_dir):
    """One forest per sensor with the settings in use; unseen rows must get the true label."""
    from functools import reduce

    from vitalgrid.operators.balance import key_split

    order = F.array(*[F.lit(s) for s in view.SENSORS])
    rows = stored(_coded(spark, sf_dir, F.array_position(order, F.col("sensor")) - 1), "coded")
    train, test = key_split(rows, ["eventId"], 3, 4)
    parts = []
    for s in view.SENSORS:
        model = forests.fit_forest(train.where(F.col("sensor") == s), ["code"], prefix=f"{s}_", settings=forests.SENSOR_FOREST)
        scored = forests.score_all(test.where(F.col("sensor") == s), {s: model})
        parts.append(scored.select("eventId", "sensor", forests.predicted_label(f"{s}_prediction").alias("prediction")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "forests_by_user",
    f"""WITH {R}, t AS (SELECT eventId, CAST(eventId AS BIGINT) % {CODES} AS code, CAST(substr(userid, 6) AS BIGINT) % 3 AS g FROM readings)
    SELECT eventId, 'u' || g AS owner, ([{_LABEL_LIST}])[CAST((code + g) % {CODES} + 1 AS BIGINT)] AS prediction FROM t WHERE g < 2""",
)
def forests_by_user(spark, sf_dir):
    """Models saved under their owners' names, listed from the catalog, loaded and used for
    their owners' rows; owners without a model drop out."""
    group = F.col("userid").substr(6, 20).cast("bigint") % 3
    rows = stored(_coded(spark, sf_dir, group).withColumn("owner", F.concat(F.lit("u"), group.cast("string"))), "coded")
    folder = scratch_path(spark, "models")
    for owner in ("u0", "u1"):
        model = forests.fit_forest(
            rows.where(F.col("owner") == owner), ["code"], prefix=f"{owner}_", settings=forests.EARLIER_SENSOR_FOREST)
        forests.save_model(model, f"{folder}/code_{owner}_FEA_.MDL")
    listed = scans.list_models(spark, folder).where("sensor = 'code'").collect()  # one row per saved model
    models = {r["userid"]: forests.load_model(r["path"]) for r in listed}
    out = forests.score_by_owner(rows, models, "owner")
    return out.select("eventId", "owner", forests.predicted_label("prediction").alias("prediction"))


OWNERS = 6


@query(
    "forests_of_owners",
    f"""WITH {R}, t AS (SELECT eventId, userid, time_stamp, CAST(eventId AS BIGINT) % {CODES} AS code, CAST(substr(userid, 6) AS BIGINT) % {OWNERS + 1} AS g FROM readings)
    SELECT md5('forest_code|' || eventId) AS eventId, 'forest_code' AS processor_name, userid, time_stamp,
    ([{_LABEL_LIST}])[CAST((code + g) % {CODES} + 1 AS BIGINT)] AS result FROM t WHERE g < {OWNERS}""",
)
def forests_of_owners(spark, sf_dir):
    """Saved forests of many owners read as one table of nodes and used in one plan; results as published rows."""
    group = F.col("userid").substr(6, 20).cast("bigint") % (OWNERS + 1)
    rows = stored(_coded(spark, sf_dir, group).withColumn("owner", F.concat(F.lit("u"), group.cast("string"))), "coded")
    folder = scratch_path(spark, "models")
    settings = forests.EARLIER_SENSOR_FOREST
    for i in range(OWNERS):
        model = forests.fit_forest(rows.where(F.col("owner") == f"u{i}"), ["code"], settings=settings)
        forests.save_model(model, f"{folder}/code_u{i}_FEA_.MDL")
    trees = stored(forest_table.forest_rows(forest_table.saved_nodes(spark, folder).withColumnRenamed("userid", "owner"), "owner"), "forests")
    out = forest_table.score_with_owner(
        rows.select("owner", "eventId", "userid", "time_stamp", "code"), trees, "owner", ["code"], ["eventId"], settings["maxDepth"])
    return out.select(
        stable_id(F.lit("forest_code"), F.col("eventId")).alias("eventId"), F.lit("forest_code").alias("processor_name"), "userid", "time_stamp",
        forests.predicted_label("prediction").alias("result"))


@query("embedding_forest")
def embedding_forest(spark, sf_dir):
    """The same learner on wide vectors: the embeddings table."""
    from pyspark.ml.functions import array_to_vector

    rows = view.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label_idx"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("v"),
    )
    model = forests.fit_forest(rows, [], settings=forests.EARLIER_SENSOR_FOREST, vector="v")
    return model.transform(rows).select("vec_id", "label_idx", "prediction")


@query("stacked_forest")
def stacked_forest(spark, sf_dir):
    """Sensor models score one table in turn; a second forest decides over them."""
    return training.stacked(
        view.readings(spark, sf_dir).where("activity <> 'NONE'"),
        {"accelerometer": ["x", "y", "z"], "gyroscope": ["x", "z"], "barometer": ["y", "z"]},
    ).select("eventId", "activity", "prediction")


SLOTS = 7


@query(
    "cross_fitted_stack",
    f"""WITH {R} SELECT eventId, CAST(CAST(('0x' || substr(md5(eventId), 1, 8)) AS BIGINT) % 2 AS INTEGER) AS fold,
    ([{_LABEL_LIST}])[CAST(eventId AS BIGINT) % {CODES} + 1] AS prediction FROM readings""",
)
def cross_fitted_stack(spark, sf_dir):
    """Seven sensor forests and their stack with the settings in use, each row scored by models that have not seen it."""
    rows = _coded(spark, sf_dir, F.lit(0)).select("eventId", "activity", *[(F.col("code") * (i + 1)).alias(f"v{i}") for i in range(SLOTS)])
    out = training.cross_fitted(rows, {f"s{i}": [f"v{i}"] for i in range(SLOTS)})
    return out.select("eventId", "fold", "prediction")


@query("saved_models")
def saved_models(spark, sf_dir):
    """A forest and a table of parameters, saved and loaded before scoring."""
    rows = _accelerometer(spark, sf_dir)
    path = scratch_path(spark, "forest")
    forests.save_model(
        forests.fit_forest(rows, ["x", "y", "z"], prefix="accelerometer_", settings=forests.EARLIER_SENSOR_FOREST), path
    )
    scored = forests.score_all(rows, {"accelerometer": forests.load_model(path)})
    return scored.select("eventId", "accelerometer_prediction")


@query(
    "saved_parameters",
    f"""WITH {GNB_SQL} SELECT deviceid, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_classes FROM params GROUP BY 1""",
)
def saved_parameters(spark, sf_dir):
    model = naive_bayes.fit_gaussian(gnb_data(spark, sf_dir), ["deviceid"], "label", ["p", "t"], LABELS)
    path = scratch_path(spark, "parameters")
    model.write.parquet(path)
    known = sum((F.when(F.col(f"class_{n}").isNotNull(), 1).otherwise(0) for n in LABELS), F.lit(0))
    return spark.read.parquet(path).select("deviceid", "n", known.cast("bigint").alias("n_classes"))


@query(
    "models_by_user",
    f"""WITH {R}, {view.KNOWN_SQL}, m AS (SELECT userid, avg(x) AS mx FROM readings WHERE userid IN (SELECT userid FROM known) GROUP BY 1)
    SELECT eventId, x > mx AS above FROM readings JOIN m ON readings.userid = m.userid""",
)
def models_by_user(spark, sf_dir):
    """Each row meets its own user's parameters; users without any drop out.

    Whether a row that equals its user's mean is above it must not hang on the order of a sum."""
    rows = view.readings(spark, sf_dir, labels=False)
    mine = joins.keep_known(rows, view.known_users(spark, sf_dir), "userid", ["eventId"])
    params = mine.groupBy("userid").agg(*features.mean_parts("x"))
    out = joins.salted_lookup(rows, params, ["userid"], ["eventId"])
    return out.select("eventId", features.above_mean("x").alias("above"))


@query("scored_and_published")
def scored_and_published(spark, sf_dir):
    """The serving plan: features, forest, result messages."""
    rows = view.readings(spark, sf_dir)
    labelled = rows.where("activity <> 'NONE' AND sensor = 'accelerometer'")
    windows = features.axis_features(labelled, ["userid", "activity"], "time_stamp", W)
    train = stored(forests.with_label_index(windows), "train")
    model = forests.fit_forest(train, features.AXIS_FEATURES, prefix="accelerometer_", settings=forests.EARLIER_SENSOR_FOREST)
    return scoring.score_windows(
        rows, view.known_users(spark, sf_dir), "accelerometer", model, W, rounding="round"
    )


# --- the three ways to decide on one activity -----------------------------------


@query(
    "activity_by_vote",
    f"""WITH v AS (WITH {_vote_sql(decide.VOTE_WEIGHTS, _VOTERS, 'userid, anchor')})
    SELECT md5('activity_voting|' || userid || '|' || anchor) AS eventId, 'activity_voting' AS processor_name,
    userid, anchor AS time_stamp, activity FROM v""",
)
def activity_by_vote(spark, sf_dir):
    return aggregator.by_vote(aligned_predictions(spark, sf_dir))


@query("activity_by_forest")
def activity_by_forest(spark, sf_dir):
    """Forest over sensor slots, trained on the votes."""
    rows = stored(aligned_predictions(spark, sf_dir), "aligned")
    votes = aggregator.by_vote(rows).select("userid", F.col("time_stamp").alias("anchor"), "activity")
    slots = stored(aggregator.forest_slots(rows).join(votes, ["userid", "anchor"]), "slots")
    model = aggregator.fit_forest(slots, "activity", forests.EARLIER_STACK_FOREST)
    return aggregator.by_forest(rows, model)


def _last(s: str) -> str:
    return f"last_value({s} IGNORE NULLS) OVER w AS {s}"


@query(
    "activity_by_naive_bayes",
    f"""WITH {MNB_SQL}, filled AS (SELECT userid, win, {', '.join(_last(s) for s in _THREE)} FROM coded
      WINDOW w AS (PARTITION BY userid ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    listed AS (SELECT userid, win, unnest([accelerometer, gyroscope, barometer]) AS c FROM filled),
    counted AS (SELECT userid, win, c, count(*) AS n FROM listed WHERE c IS NOT NULL GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY userid, win ORDER BY n DESC, c) AS rn FROM counted),
    whole AS (SELECT f.userid, 'u' || (CAST(substr(f.userid, 6) AS BIGINT) % 7) AS model, f.win, unnest([0, 1, 2]) AS slot,
      unnest([{', '.join(f'coalesce({s}, c)' for s in _THREE)}]) AS code
      FROM filled f JOIN best b ON f.userid = b.userid AND f.win = b.win AND rn = 1),
    tot AS (SELECT model, sum(n) AS total FROM classes GROUP BY 1),
    s AS (SELECT l.userid, l.win, p.label, ln(any_value(p.n) / CAST(any_value(total) AS DOUBLE)) + sum(logp) AS score FROM whole l
      JOIN params p ON l.model = p.model AND l.slot = p.slot AND l.code = p.code JOIN tot ON l.model = tot.model GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY userid, win ORDER BY round(score, 9) DESC, CASE label WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1
      WHEN 'WALKING_UP' THEN 2 ELSE 3 END) AS rn FROM s)
    SELECT md5('activity_naivebayes|' || userid || '|' || (win * {W})) AS eventId, 'activity_naivebayes' AS processor_name,
    userid, win * {W} AS time_stamp, label AS activity FROM r WHERE rn = 1""",
)
def activity_by_naive_bayes(spark, sf_dir):
    params = naive_bayes.fit_multinomial(mnb_data(spark, sf_dir), ["model"], "label", _THREE, LABELS, 5)
    key = F.expr("concat('u', cast(substr(userid, 6) as bigint) % 7)")
    return aggregator.by_naive_bayes(sensor_predictions(spark, sf_dir), params, ["model"], _THREE, W, 3, key)


@query(
    "activity_points",
    f"""WITH v AS (WITH {_vote_sql(decide.VOTE_WEIGHTS, _VOTERS, 'userid, anchor')})
    SELECT 'activity_prediction' AS name, anchor AS timestamp, userid, CASE activity WHEN 'SITTING' THEN 1e0 WHEN 'WALKING' THEN 2e0
    WHEN 'WALKING_UP' THEN 3e0 ELSE 4e0 END AS value FROM v""",
)
def activity_points(spark, sf_dir):
    points = aggregator.activity_points(activity_by_vote(spark, sf_dir))
    return points.select("name", "timestamp", F.col("tags")["userid"].alias("userid"), "value")


# Barometer serving: every user against the user's own parameters.
USER_GNB_SQL = GNB_SQL.replace("SELECT deviceid, label, count(*) AS n, avg(p)", "SELECT userid, label, count(*) AS n, avg(p)")


@query(
    "slopes_scored_by_user",
    f"""WITH {USER_GNB_SQL}, tot AS (SELECT userid, CAST(sum(n) AS DOUBLE) AS total FROM params GROUP BY 1),
    s AS (SELECT f.userid, f.win, q.label, round(ln(q.n / total) - ln({PI2} * vp) / 2 - (f.p - mp) * (f.p - mp) / (2 * vp)
      - ln({PI2} * vt) / 2 - (f.t - mt) * (f.t - mt) / (2 * vt), 9) AS score
      FROM f JOIN params q ON f.userid = q.userid JOIN tot ON f.userid = tot.userid),
    r AS (SELECT *, row_number() OVER (PARTITION BY userid, win ORDER BY score DESC, CASE label WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1
      WHEN 'WALKING_UP' THEN 2 ELSE 3 END) AS rn FROM s)
    SELECT md5('naivebayes_barometer|' || userid || '|' || (win * {W})) AS eventId, 'naivebayes_barometer' AS processor_name,
    userid, win * {W} AS time_stamp, label AS result FROM r WHERE rn = 1""",
)
def slopes_scored_by_user(spark, sf_dir):
    data = gnb_data(spark, sf_dir)
    params = naive_bayes.fit_gaussian(data, ["userid"], "label", ["p", "t"], LABELS)
    windows = gnb_windows(spark, sf_dir)
    scored = naive_bayes.score_gaussian(windows, params, ["userid"], ["p", "t"], LABELS, ["window"])
    return scoring.result_rows(scored, "barometer", W, F.col("prediction"), "naivebayes")
