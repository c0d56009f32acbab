"""Bayesian network: fit, files, posteriors, novelty."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.config import NoveltySettings
from vitalgrid.functions.scalars import rounded
from vitalgrid.operators import align, bayesnet, novelty
from vitalgrid.operators.bayesnet import ACTIVITY_STATES, PARENTS, SIGNALS, VARIABLES
from vitalgrid.operators.ordered import fit_piece_ms
from vitalgrid.plans import novelty as novelty_plan
from vitalgrid.queries.base import query, r6
from vitalgrid.queries.joins import align_sql
from vitalgrid.session import scratch_path, stored
from vitalgrid.sources import event_view as view
from vitalgrid.sources import scans

DAY = 86_400_000
P = view.PHYSIO_SQL
_LABEL_STATE = "CASE activity WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1 WHEN 'WALKING_DOWN' THEN 2 ELSE 3 END"

# Cut points per device from the whole list of values.
CUTS_SQL = f"""{P}, long AS ({' UNION ALL '.join(f"SELECT network, '{s}' AS variable, {s} AS v FROM physio" for s in SIGNALS)}),
cume AS (SELECT network, variable, v, count(*) OVER (PARTITION BY network, variable) AS total,
  count(*) OVER (PARTITION BY network, variable ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM long),
cuts AS (SELECT network, variable, min(v) AS c0, min(CASE WHEN c * 4 >= total THEN v END) AS c1,
  min(CASE WHEN c * 4 >= total * 2 THEN v END) AS c2, min(CASE WHEN c * 4 >= total * 3 THEN v END) AS c3, max(v) AS c4
  FROM cume GROUP BY ALL)"""


def _state_sql(s: str) -> str:
    k = f"k{SIGNALS.index(s)}"
    return (
        f"CASE WHEN {s} >= {k}.c0 AND {s} <= {k}.c1 THEN 0 WHEN {s} > {k}.c1 AND {s} <= {k}.c2 THEN 1 "
        f"WHEN {s} > {k}.c2 AND {s} <= {k}.c3 THEN 2 WHEN {s} > {k}.c3 AND {s} <= {k}.c4 THEN 3 END"
    )


_CUT_JOINS = " ".join(
    f"JOIN cuts k{i} ON p.network = k{i}.network AND k{i}.variable = '{s}'" for i, s in enumerate(SIGNALS)
)
# Signals are judged shifted by a tenth, so that some leave the fitted range.
SHIFT = 1.03
STATES_SQL = f"""{CUTS_SQL}, states AS (SELECT p.event_id, p.network, {_LABEL_STATE} AS Activity,
  {', '.join(f'{_state_sql(s)} AS {s}' for s in SIGNALS)} FROM physio p {_CUT_JOINS}),
judged AS (SELECT p.* EXCLUDE (activity, {', '.join(SIGNALS)}), {_LABEL_STATE} AS Activity, {', '.join(f'{_state_sql(s)} AS {s}' for s in SIGNALS)}
  FROM (SELECT * REPLACE ({', '.join(f'{s} * {SHIFT}e0 AS {s}' for s in SIGNALS)}) FROM physio) p {_CUT_JOINS})"""


def _cpt_sql() -> str:
    parts, four = [], "(SELECT unnest(range(4)) AS {c})"
    for v, ps in PARENTS.items():
        cols = [*ps, v]
        grid = ", ".join(["(SELECT DISTINCT network FROM states) n"] + [f"{four.format(c=c)} g{i}" for i, c in enumerate(cols)])
        on = " AND ".join(["g.network = h.network"] + [f"g.{c} = h.{c}" for c in cols])
        given = " || ',' || ".join(f"g.{p}" for p in ps) if len(ps) > 1 else (f"CAST(g.{ps[0]} AS VARCHAR)" if ps else "''")
        over = ", ".join(["g.network"] + [f"g.{p}" for p in ps])
        parts.append(
            f"""SELECT network, variable, given, state, CASE WHEN total = 0 THEN 0.25e0 ELSE n / CAST(total AS DOUBLE) END AS p FROM (
            SELECT g.network, '{v}' AS variable, {given} AS given, g.{v} AS state, coalesce(h.n, 0) AS n,
            sum(coalesce(h.n, 0)) OVER (PARTITION BY {over}) AS total
            FROM (SELECT * FROM {grid}) g LEFT JOIN (SELECT network, {', '.join(cols)}, count(*) AS n FROM states GROUP BY ALL) h ON {on})"""
        )
    return " UNION ALL ".join(parts)


CPT_SQL = f"{STATES_SQL}, cpt AS ({_cpt_sql()})"


def _join_cpt(v: str, alias: str) -> str:
    ps = PARENTS[v]
    given = " || ',' || ".join(f"s.{p}" for p in ps) if len(ps) > 1 else (f"CAST(s.{ps[0]} AS VARCHAR)" if ps else "''")
    return (
        f"JOIN cpt {alias} ON {alias}.network = s.network AND {alias}.variable = '{v}' AND {alias}.given = {given} "
        f"AND {alias}.state = s.{v}"
    )


_FULL = ", ".join(f"(SELECT unnest(range(4)) AS {v})" for v in VARIABLES)
JOINT_SQL = f"""{CPT_SQL}, joint AS (SELECT s.*, {' * '.join(f'c{i}.p' for i in range(5))} AS joint
  FROM (SELECT * FROM (SELECT DISTINCT network FROM states), {_FULL}) s {' '.join(_join_cpt(v, f'c{i}') for i, v in enumerate(VARIABLES))}),
post AS (SELECT *, {', '.join(
    f"round(coalesce(joint / nullif(sum(joint) OVER (PARTITION BY network, {', '.join(o for o in VARIABLES if o != v)}), 0), 0), 12) AS post_{v}"
    for v in VARIABLES)} FROM joint),
answers AS (SELECT j.event_id, j.user_id, j.time_stamp, {', '.join(f'j.event_{v} AS event_{v}' for v in VARIABLES)},
  {', '.join(f'coalesce(post_{v}, 0) AS post_{v}' for v in VARIABLES)}
  FROM judged j LEFT JOIN post ON j.network = post.network AND {' AND '.join(f'j.{v} = post.{v}' for v in VARIABLES)})"""


def _below(thr: float) -> str:
    return " + ".join(f"CASE WHEN post_{v} < {thr} THEN 1 ELSE 0 END" for v in VARIABLES)


def fitted(spark, sf_dir):
    """(physio rows, cut points, conditional tables), one network per device."""
    rows = view.physio(spark, sf_dir)
    cuts, tables = novelty_plan.fit(rows, ["network"], ["event_id"])
    return rows, cuts, tables


def answers(spark, sf_dir):
    rows, cuts, tables = fitted(spark, sf_dir)
    shifted = rows.withColumns({s: F.col(s) * SHIFT for s in SIGNALS})
    return novelty_plan.judge(shifted, cuts, tables, ["network"], ["event_id"])


@query(
    "signal_cut_points",
    f"WITH {CUTS_SQL} SELECT network, variable, {', '.join(f'{r6(f'c{i}')} AS c{i}' for i in range(5))} FROM cuts",
)
def signal_cut_points(spark, sf_dir):
    cuts = bayesnet.cut_points(view.physio(spark, sf_dir), ["network"], SIGNALS)
    return cuts.select("network", "variable", *[rounded(F.col("cuts")[i]).alias(f"c{i}") for i in range(5)])


@query(
    "signal_bins",
    f"WITH {STATES_SQL} SELECT event_id, {', '.join(f'{s} AS state_{s.lower()}' for s in SIGNALS)} FROM judged",
)
def signal_bins(spark, sf_dir):
    rows = view.physio(spark, sf_dir)
    cuts = bayesnet.cut_points(rows, ["network"], SIGNALS)
    shifted = rows.withColumns({s: F.col(s) * SHIFT for s in SIGNALS})
    binned = bayesnet.bin_signals(shifted, cuts, ["network"], SIGNALS, ["event_id"])
    return binned.select("event_id", *[F.col(f"state_{s}").alias(f"state_{s.lower()}") for s in SIGNALS])


@query("network_fit", f"WITH {CPT_SQL} SELECT network, variable, given, CAST(state AS INTEGER) AS state, {r6('p')} AS p FROM cpt")
def network_fit(spark, sf_dir):
    return fitted(spark, sf_dir)[2].withColumn("p", rounded("p"))


@query("network_file_scan", f"WITH {CPT_SQL} SELECT network, variable, given, CAST(state AS INTEGER) AS state, {r6('p')} AS p FROM cpt")
def network_file_scan(spark, sf_dir):
    """Fitted networks written as text, one file's worth per row, scanned again."""
    _, cuts, tables = fitted(spark, sf_dir)
    text = scans.network_text(tables, cuts, ACTIVITY_STATES, PARENTS)
    path = scratch_path(spark, "networks")
    text.write.parquet(path)
    return scans.network_tables(spark.read.parquet(path)).withColumn("p", rounded("p"))


@query(
    "network_file_cuts",
    f"WITH {CUTS_SQL} SELECT network, variable, {', '.join(f'{r6(f'c{i}')} AS c{i}' for i in range(5))} FROM cuts",
)
def network_file_cuts(spark, sf_dir):
    _, cuts, tables = fitted(spark, sf_dir)
    path = scratch_path(spark, "networks")
    scans.network_text(tables, cuts, ACTIVITY_STATES, PARENTS).write.parquet(path)
    back = scans.network_cuts(scans.network_states(spark.read.parquet(path)))
    return back.select("network", "variable", *[rounded(F.col("cuts")[i]).alias(f"c{i}") for i in range(5)])


@query(
    "posteriors",
    f"WITH {JOINT_SQL} SELECT event_id, {', '.join(f'{r6(f'post_{v}')} AS post_{v.lower()}' for v in VARIABLES)} FROM answers",
)
def posteriors(spark, sf_dir):
    return answers(spark, sf_dir).select("event_id", *[rounded(f"post_{v}").alias(f"post_{v.lower()}") for v in VARIABLES])


NOVEL_SQL = f"{JOINT_SQL}, novel AS (SELECT *, ({_below(0.15)}) AS n_low FROM answers)"


@query(
    "novelty_decision",
    f"WITH {NOVEL_SQL} SELECT event_id, CAST(n_low AS BIGINT) AS n_violations, n_low > 0 AS novel_any, n_low * 2 > 5 AS novel_majority FROM novel",
)
def novelty_decision(spark, sf_dir):
    a = novelty.decide(answers(spark, sf_dir), 0.15).withColumnRenamed("novel", "novel_any")
    both = novelty.decide(a, 0.15, "majority")
    return both.select(
        "event_id", F.size("violations").cast("bigint").alias("n_violations"), "novel_any",
        F.col("novel").alias("novel_majority"),
    )


# The five signals, aligned on the slowest one of a user: a record per anchor that all have answered.
PHYSIO_STEP = DAY
LIVE = NoveltySettings(window_rows=5, rate_threshold=0.5)
_READ = {"Activity": "activity", **{s: s for s in SIGNALS}}
_PHYSIO_SLOTS = f"""rows AS (SELECT userid, sensor, time_stamp, eventId FROM readings), {align_sql('userid', 'rows', 'HR_RATE', PHYSIO_STEP)},
slots AS (SELECT a.userid AS user_id, a.anchor AS time_stamp, any_value(r.deviceid) AS network,
  {', '.join(f"max(CASE WHEN a.sensor = '{v}' THEN r.{c} END) AS {c}, max(CASE WHEN a.sensor = '{v}' THEN a.eventId END) AS event_{v}" for v, c in _READ.items())}
  FROM aligned a JOIN readings r ON r.eventId = a.eventId GROUP BY 1, 2 HAVING count(*) = 5)"""
PHYSIO_ALIGNED_SQL = f"{view.PHYSIO_EVENTS_SQL}, {_PHYSIO_SLOTS}"
_LIVE_STATES = f"""{CUTS_SQL}, {view.PHYSIO_EVENTS_SQL.split('FROM events), ', 1)[1]}, {_PHYSIO_SLOTS},
states AS (SELECT p.event_id, p.network, {_LABEL_STATE} AS Activity, {', '.join(f'{_state_sql(s)} AS {s}' for s in SIGNALS)} FROM physio p {_CUT_JOINS}),
judged AS (SELECT p.* EXCLUDE (activity, {', '.join(SIGNALS)}), time_stamp AS event_id, {_LABEL_STATE} AS Activity, {', '.join(f'{_state_sql(s)} AS {s}' for s in SIGNALS)}
  FROM (SELECT * REPLACE ({', '.join(f'{s} * {SHIFT}e0 AS {s}' for s in SIGNALS)}) FROM slots) p {_CUT_JOINS})"""
LIVE_SQL = f"""{JOINT_SQL.replace(STATES_SQL, _LIVE_STATES)}, novel AS (SELECT *, ({_below(0.15)}) AS n_low FROM answers),
rated AS (SELECT *, CASE WHEN count(*) OVER w = {LIVE.window_rows} THEN sum(CASE WHEN n_low > 0 THEN 1 ELSE 0 END) OVER w / {LIVE.window_rows}e0 END AS novel_rate
  FROM novel WINDOW w AS (PARTITION BY user_id ORDER BY time_stamp ROWS BETWEEN {LIVE.window_rows - 1} PRECEDING AND CURRENT ROW))"""


def network_of(user):
    """The network that judges a user: the one of the user's device."""
    return F.concat(F.lit("dev_"), F.substring(user, 6, 20).cast("long") % 10)


def physio_slots(spark, sf_dir):
    ev = view.events(spark, sf_dir)
    rows = stored(view.physio_events(ev), "physio-events")
    piece = fit_piece_ms(rows, ["userid"], "time_stamp", 5 * DAY)
    aligned = align.align(rows, ["userid"], list(_READ), "HR_RATE", PHYSIO_STEP, piece_ms=piece)
    return novelty_plan.aligned_slots(aligned, "userid", "anchor")


@query(
    "physio_aligned",
    f"""WITH {PHYSIO_ALIGNED_SQL} SELECT user_id, time_stamp, activity, {', '.join(f'{r6(s)} AS {s.lower()}' for s in SIGNALS)},
    {', '.join(f'event_{v}' for v in _READ)} FROM slots""",
)
def physio_aligned(spark, sf_dir):
    """Five signals of a user aligned in time, a record per anchor."""
    return physio_slots(spark, sf_dir).select(
        "user_id", "time_stamp", "activity", *[rounded(s).alias(s.lower()) for s in SIGNALS], *[f"event_{v}" for v in _READ])


PHYSIO_NOVELTY_SQL = f"""WITH {LIVE_SQL} SELECT user_id, time_stamp, {r6('novel_rate')} AS novel_rate, coalesce(novel_rate > {LIVE.rate_threshold}, false) AS alarm,
    n_low > 0 AS novel FROM rated"""


@query("physio_novelty", PHYSIO_NOVELTY_SQL)
def physio_novelty(spark, sf_dir):
    """The whole chain in batch: align, judge, rate."""
    _, cuts, tables = fitted(spark, sf_dir)
    rows = physio_slots(spark, sf_dir).withColumn("network", network_of("user_id")).withColumns({s: F.col(s) * SHIFT for s in SIGNALS})
    decided = novelty_plan.decide(rows, cuts, tables, ["network"], ["user_id", "event_id"], LIVE)
    rated_ = novelty_plan.rate(decided.select("event_id", "user_id", "time_stamp", "novel"), ["user_id"], ["time_stamp", "event_id"], LIVE, 5 * DAY)
    return rated_.select("user_id", "time_stamp", rounded("novel_rate").alias("novel_rate"), "alarm", "novel")


# A high rate threshold: shifted signals are often novel.
SETTINGS = NoveltySettings(rate_threshold=0.8)
N = SETTINGS.window_rows
RATE_SQL = f"""{NOVEL_SQL}, rated AS (SELECT *, CASE WHEN count(*) OVER w = {N} THEN sum(CASE WHEN n_low > 0 THEN 1 ELSE 0 END) OVER w / {N}e0 END AS novel_rate
  FROM novel WINDOW w AS (PARTITION BY user_id ORDER BY time_stamp, event_id ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)),
alarms AS (SELECT *, coalesce(novel_rate > 0.8, false) AS alarm FROM rated)"""


def rated(spark, sf_dir, records=True, keep_points=False):
    """Judged rows with their trailing rate; without ``records`` only the flag of a
    row is kept, not its violations."""
    rows, cuts, tables = fitted(spark, sf_dir)
    shifted = rows.withColumns({s: F.col(s) * SHIFT for s in SIGNALS})
    decided = novelty_plan.decide(shifted, cuts, tables, ["network"], ["event_id"], SETTINGS)
    columns = ["event_id", "user_id", "time_stamp", "novel"] + (["violations"] if records else [])
    return novelty_plan.rate(
        decided.select(*columns), ["user_id"], ["time_stamp", "event_id"], SETTINGS, 5 * DAY, keep_points
    )


@query("trailing_novelty_rate", f"WITH {RATE_SQL} SELECT event_id, {r6('novel_rate')} AS novel_rate, alarm FROM alarms")
def trailing_novelty_rate(spark, sf_dir):
    return rated(spark, sf_dir, records=False).select("event_id", rounded("novel_rate").alias("novel_rate"), "alarm")


@query(
    "novelty_rate_by_time",
    f"""WITH {NOVEL_SQL} SELECT user_id, time_stamp // {DAY} AS win, count(*) AS n,
    {r6('avg(CASE WHEN n_low > 0 THEN 1e0 ELSE 0e0 END)')} AS novel_rate FROM novel GROUP BY ALL""",
)
def novelty_rate_by_time(spark, sf_dir):
    decided = novelty.decide(answers(spark, sf_dir), 0.15)
    out = novelty.time_rate(decided, ["user_id"], "time_stamp", DAY)
    return out.select("user_id", F.col("window").alias("win"), "n", rounded("novel_rate").alias("novel_rate"))


def _violation_rows(source: str) -> str:
    """One row per violation; ``slot`` is its place among the record's violations, from 0."""
    parts = []
    below = [f"CASE WHEN post_{v} < 0.15 THEN 1 ELSE 0 END" for v in novelty.EVENT_SLOTS]
    for k, v in enumerate(novelty.EVENT_SLOTS):
        ins = [f"event_{'Activity' if s == v else s}" for s in SIGNALS]
        parts.append(
            f"SELECT *, CAST({' + '.join(['0', *below[:k]])} AS INTEGER) AS slot, event_{v} AS out_event, post_{v} AS percentage, {', '.join(f'{e} AS in_event_{i + 1}' for i, e in enumerate(ins))} "
            f"FROM {source} WHERE post_{v} < 0.15"
        )
    return " UNION ALL ".join(parts)


NOVELTY_TABLE_SQL = f"""WITH {RATE_SQL}, violated AS ({_violation_rows('alarms')})
    SELECT md5(md5(user_id || '|' || time_stamp || '|' || event_id) || '|' || slot) AS row_id,
    md5(user_id || '|' || time_stamp || '|' || event_id) AS novel_point_id, in_event_1, in_event_2, in_event_3, in_event_4, out_event,
    {r6('percentage')} AS result_percentage, {r6('novel_rate')} AS novel_rate, time_stamp AS novel_time_stamp, user_id,
    true AS novel_flag FROM violated WHERE alarm"""


@query("novelty_table", NOVELTY_TABLE_SQL)
def novelty_table(spark, sf_dir):
    out = novelty.novelty_rows(rated(spark, sf_dir))
    return out.drop("novel_event_id").withColumns(
        {c: rounded(c) for c in ("result_percentage", "novel_rate")}
    )


ALARM_POINTS_SQL = f"""WITH {RATE_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_stamp, event_id) AS i FROM alarms),
    violated AS ({_violation_rows('numbered')})
    SELECT a.user_id, a.event_id AS alarm_event_id, v.event_id, v.out_event, {r6('v.percentage')} AS percentage
    FROM numbered a JOIN violated v ON a.user_id = v.user_id AND v.i > a.i - {N} AND v.i <= a.i WHERE a.alarm"""


@query("alarm_points", ALARM_POINTS_SQL)
def alarm_points(spark, sf_dir):
    """Every alarm with all the violations of its trailing rows."""
    points = novelty.alarm_points(rated(spark, sf_dir, keep_points=True), ["user_id"], ["time_stamp", "event_id"])
    return points.select(
        "user_id", "alarm_event_id", "event_id", "out_event", rounded("result_percentage").alias("percentage")
    )


@query(
    "physio_records",
    f"""WITH {view.EVENTS_SQL}, r AS (SELECT userid, time_stamp // {DAY} AS win, event_type, event_id, value,
      row_number() OVER (PARTITION BY userid, time_stamp // {DAY}, event_type ORDER BY time_stamp DESC, event_id DESC) AS rn FROM ev)
    SELECT userid, win, {', '.join(
        f"{r6(f"coalesce(max(CASE WHEN event_type = '{t}' THEN value END), 0)")} AS {v.lower()}, "
        f"max(CASE WHEN event_type = '{t}' THEN 'e' || event_id END) AS id_{v.lower()}" for t, v in view.PHYSIO_OF.items())}
    FROM r WHERE rn = 1 GROUP BY ALL""",
)
def physio_records(spark, sf_dir):
    """Five slots per user and day, the latest event of each; a missing slot is 0."""
    from vitalgrid.functions.timekeys import floor_window

    rows = view.events(spark, sf_dir, False).withColumn("win", floor_window("time_stamp", DAY))
    out = novelty_plan.slot_records(
        rows, ["userid", "win"], "event_type", "value", F.concat(F.lit("e"), F.col("event_id")),
        ["time_stamp", "event_id"], {t: v.lower() for t, v in view.PHYSIO_OF.items()},
    )
    return out.withColumns({v.lower(): rounded(v.lower()) for v in view.PHYSIO_OF.values()})
