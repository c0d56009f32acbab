"""Votes, imputation, error measures, class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions.scalars import rounded, sorted_label_code
from vitalgrid.functions.timekeys import floor_window
from vitalgrid.operators import balance, decide
from vitalgrid.operators.ordered import fit_piece_ms
from vitalgrid.queries.base import query, r6
from vitalgrid.queries.ingest import PREDICTION_FILE_SQL, W, stored_predictions
from vitalgrid.queries.joins import ALIGNED_SQL, aligned_predictions, windowed_labels
from vitalgrid.sources import event_view as view
from vitalgrid.sources.registry import LABELS

DAY = 86_400_000
R = view.READINGS_SQL


def _vote_sql(weights: dict[str, int], source: str, keys: str, final: str | None = None) -> str:
    """The rule: labels that got a vote are ranked by votes times weight, equals by the order of the labels."""
    listed = ", ".join(f"('{n}', {w}, {i})" for i, (n, w) in enumerate(weights.items()))
    final = final or f"""SELECT {keys}, activity, score, coalesce(n_top, 0) AS n_top
    FROM (SELECT DISTINCT {keys} FROM voters) LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) USING ({keys}) LEFT JOIN ties USING ({keys})"""
    return f"""{source}, weights(activity, w, pos) AS (VALUES {listed}),
    scored AS (SELECT {keys}, activity, pos, CAST(count(*) * w AS BIGINT) AS score
      FROM voters JOIN weights ON label = activity GROUP BY {keys}, activity, pos, w),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, pos) AS rn,
      max(score) OVER (PARTITION BY {keys}) AS top FROM scored),
    ties AS (SELECT {keys}, count(*) AS n_top FROM ranked WHERE score = top GROUP BY {keys})
    {final}"""


_VOTERS = f"{ALIGNED_SQL}, voters AS (SELECT a.userid, a.anchor, p.label FROM aligned a JOIN predictions p ON a.eventId = p.eventId)"


@query("weighted_vote", "WITH " + _vote_sql(decide.VOTE_WEIGHTS, _VOTERS, "userid, anchor"))
def weighted_vote(spark, sf_dir):
    return decide.vote(aligned_predictions(spark, sf_dir), ["userid", "anchor"], "label")


_DAILY = f"{view.PREDICTIONS_SQL}, voters AS (SELECT userid, time_stamp // {DAY} AS day, label FROM predictions)"


@query("majority_vote", "WITH " + _vote_sql(decide.EQUAL_WEIGHTS, _DAILY, "userid, day"))
def majority_vote(spark, sf_dir):
    from vitalgrid.queries.joins import sensor_predictions

    rows = sensor_predictions(spark, sf_dir).withColumn("day", floor_window("time_stamp", DAY))
    return decide.vote(rows, ["userid", "day"], "label", decide.EQUAL_WEIGHTS)


@query(
    "tied_votes",
    "WITH " + _vote_sql(decide.EQUAL_WEIGHTS, _DAILY, "userid, day", "SELECT n_top, count(*) AS n FROM ties GROUP BY 1"),
)
def tied_votes(spark, sf_dir):
    return majority_vote(spark, sf_dir).groupBy("n_top").agg(F.count(F.lit(1)).alias("n"))


_THREE = ["accelerometer", "gyroscope", "barometer"]
CODED_SQL = f"""{view.PREDICTIONS_SQL}, w AS (SELECT userid, time_stamp // {W} AS win, sensor, min(CASE label
  WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1 WHEN 'WALKING_DOWN' THEN 2 ELSE 3 END) AS code
  FROM predictions WHERE sensor IN ('accelerometer', 'gyroscope', 'barometer') GROUP BY ALL),
coded AS (SELECT userid, win, {', '.join(f"max(CASE WHEN sensor = '{s}' THEN code END) AS {s}" for s in _THREE)} FROM w GROUP BY ALL)"""


def coded_windows(spark, sf_dir):
    from vitalgrid.operators.joins import outer_by_pivot

    rows = windowed_labels(spark, sf_dir).withColumn("code", sorted_label_code("label"))
    return outer_by_pivot(rows, ["userid", "win"], "sensor", "code", _THREE)


@query(
    "impute_missing_class",
    f"""WITH {CODED_SQL}, listed AS (SELECT userid, win, unnest([accelerometer, gyroscope, barometer]) AS c FROM coded),
    counted AS (SELECT userid, win, c, count(*) AS n FROM listed WHERE c IS NOT NULL GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY userid, win ORDER BY n DESC, c) AS rn FROM counted)
    SELECT coded.userid, coded.win, {', '.join(f"coalesce({s}, c) AS {s}" for s in _THREE)}
    FROM coded JOIN best ON coded.userid = best.userid AND coded.win = best.win AND rn = 1""",
)
def impute_missing_class(spark, sf_dir):
    return decide.impute_most_frequent(coded_windows(spark, sf_dir), _THREE)


@query(
    "error_rate",
    f"""WITH {PREDICTION_FILE_SQL} SELECT count(*) AS n, {r6('avg(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END)')} AS error FROM stored""",
)
def error_rate(spark, sf_dir):
    return decide.error_rate(stored_predictions(spark, sf_dir), "label", "prediction").withColumn("error", rounded("error"))


@query(
    "confusion_table",
    f"""WITH {PREDICTION_FILE_SQL} SELECT label, {', '.join(f"count(CASE WHEN prediction = '{n}' THEN 1 END) AS pred_{n.lower()}" for n in LABELS)}
    FROM stored GROUP BY 1""",
)
def confusion_table(spark, sf_dir):
    out = decide.confusion(stored_predictions(spark, sf_dir), "label", "prediction", LABELS)
    return out.toDF(*[c.lower() for c in out.columns])


_BALANCE = f"""{R}, counts AS (SELECT deviceid, activity, count(*) AS n FROM readings WHERE activity <> 'NONE' GROUP BY ALL),
targets AS (SELECT deviceid, CAST(sum(CASE WHEN activity IN ('WALKING', 'SITTING') THEN n ELSE 0 END) AS BIGINT) // 2 AS target FROM counts GROUP BY 1)"""


def _labelled(spark, sf_dir):
    return view.readings(spark, sf_dir).where("activity <> 'NONE'").select("deviceid", "activity", "time_stamp", "eventId", "y")


@query("balance_targets", f"WITH {_BALANCE} SELECT deviceid, activity, n, target FROM counts JOIN targets USING (deviceid)")
def balance_targets(spark, sf_dir):
    return balance.class_targets(_labelled(spark, sf_dir), ["deviceid"], "activity")


@query(
    "oversample_minorities",
    f"""WITH {_BALANCE}, indexed AS (SELECT r.deviceid, r.activity, eventId, n, target,
      row_number() OVER (PARTITION BY r.deviceid, r.activity ORDER BY time_stamp, eventId) AS i
      FROM readings r JOIN counts c ON r.deviceid = c.deviceid AND r.activity = c.activity JOIN targets t ON r.deviceid = t.deviceid),
    copies AS (SELECT *, CASE WHEN n < target THEN target // n + CASE WHEN i <= target % n THEN 1 ELSE 0 END ELSE 1 END AS times FROM indexed)
    SELECT deviceid, activity, eventId, CAST(unnest(range(times)) AS BIGINT) AS copy_no FROM copies""",
)
def oversample_minorities(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    piece = fit_piece_ms(rows, ["deviceid", "activity"], "time_stamp", 3 * DAY)
    out = balance.oversample(rows, ["deviceid"], "activity", ["time_stamp", "eventId"], piece)
    return out.select("deviceid", "activity", "eventId", "copy_no")


@query(
    "append_copies",
    f"""WITH {R} SELECT activity, count(*) + count(CASE WHEN activity = 'WALKING_UP' THEN 1 END) AS n FROM readings
    WHERE activity <> 'NONE' GROUP BY 1""",
)
def append_copies(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    both = rows.unionByName(rows.where("activity = 'WALKING_UP'"))
    return both.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "key_split",
    f"""WITH {R}, b AS (SELECT eventId, CAST(('0x' || substr(md5(eventId), 1, 8)) AS BIGINT) % 4 AS bucket FROM readings)
    SELECT CASE WHEN bucket < 3 THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(CAST(eventId AS BIGINT)) AS BIGINT) AS id_sum FROM b GROUP BY 1""",
)
def key_split(spark, sf_dir):
    train, test = balance.key_split(view.readings(spark, sf_dir).select("eventId"), ["eventId"], 3, 4)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("eventId").cast("bigint")).alias("id_sum")
    )
