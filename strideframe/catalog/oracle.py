"""The registered queries in ANSI SQL, written independently of the operators."""

from __future__ import annotations

from strideframe.catalog import tables as views

# --- views ------------------------------------------------------------------------------------

SIGNALS = """
signals AS (
  SELECT CAST(user_id AS INTEGER) AS "TRIAL", ts, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS "TIME"
  FROM events)"""

INTERIM = (
    SIGNALS
    + """,
interim AS (
  SELECT "TRIAL", "TIME", value AS a, CAST(extract(minute FROM ts) AS DOUBLE) AS g, event_type AS "ACTIVITY",
         CASE WHEN event_type <> 'error' THEN length(event_type) / 2.0::DOUBLE END AS "SPEED",
         CASE WHEN event_type <> 'error' THEN CAST("TRIAL" % 3 - 1 AS BIGINT) END AS "INCLINE"
  FROM signals)"""
)

LABELLED = """
labelled AS (
  SELECT CAST(user_id AS INTEGER) AS "TRIAL", epoch_us(ts) // 1000 AS "TIME", event_id, event_type AS "ACTIVITY",
         CASE WHEN event_type <> 'error' THEN length(event_type) / 2.0::DOUBLE END AS "SPEED",
         CASE WHEN event_type <> 'error' THEN user_id % 3 - 1 END AS "INCLINE", value, ts
  FROM events)"""


def _list(words: list) -> str:
    return "[" + ", ".join(f"'{w}'" if isinstance(w, str) else str(w) for w in words) + "]"


def _pick(words: list, index: str) -> str:
    return f"{_list(words)}[({index}) + 1]"


FILES = f"""
files AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 23 = 7 THEN 'P' || (o_custkey % 17 + 100)
              WHEN o_orderkey % 23 = 11 THEN 'notes'
              ELSE 'P' || (o_custkey % 17 + 1) END AS participant,
         'P' || (o_custkey % 17 + 1) || '_' || {_pick(views.FILE_WORDS, "o_orderkey % 6")} || '_' || (o_orderkey % 4)
           || '_' || (o_orderkey % 10) || 'ms_' || (o_orderkey % 12) || {_pick(views.SLOPE_WORDS, "o_orderkey % 5 % 3")}
           || '.c3d' AS filename
  FROM orders)"""

TRIAL_FILES = (
    FILES
    + """,
trial_files AS (
  SELECT *, CAST(substr(participant, 2) AS BIGINT) AS no FROM files
  WHERE regexp_full_match(participant, 'P\\d{1,2}') AND substr(participant, 2) NOT IN ('15', '16')
    AND filename LIKE '%.c3d' AND regexp_matches(lower(filename), 'walk|jog|run|jump')
    AND lower(filename) NOT LIKE '%transition%')"""
)

RECORDINGS = f"""
recordings AS (
  SELECT 'P' || (r % 5 + 1) AS participant, r % 5 + 1 AS no, vec_id // {views.RECORDINGS} AS frame,
         'P' || (r % 5 + 1) || '_' || {_pick(views.FILE_WORDS[:4], "r % 4")} || '_' || (r % 3 + 1) || '_' || (r % 10)
           || 'ms_' || (r % 12) || {_pick(views.SLOPE_WORDS, "r % 3")} || '_take' || r || '.c3d' AS filename,
         CASE WHEN p = 62 THEN 'Left Foot Sensor.lfs' WHEN p = 63 THEN 'Right Foot Sensor.rfs'
              ELSE {_pick(views.RAW_MEASURES, "p // 21 % 4")}
                || CASE WHEN r % 5 = 1 AND p // 3 % 7 = 0 THEN '' ELSE '_' || {_pick(views.RAW_PLACES, "p // 3 % 7")} END
                || '.' || {_pick(views.RAW_DIMENSIONS, "p % 3")} END AS label,
         CAST(v AS DOUBLE) AS value, {_pick(views.RATES, "r % 3")} AS rate
  FROM (SELECT vec_id, vec_id % {views.RECORDINGS} AS r, unnest(range(64)) AS p, unnest(embedding) AS v
        FROM embeddings)),
lowered AS (
  SELECT * REPLACE (CASE WHEN no = 2 THEN regexp_replace(lower(label), '^(global angle|highg|accel|gyro|mag)\\.', '\\1_pelvis.')
                         ELSE lower(label) END AS label) FROM recordings)"""

FEATURE_NAMES = f"""
named AS (
  SELECT p_partkey, p_retailprice AS importance,
         CASE WHEN p_partkey % 13 = 0 THEN 'value'
              WHEN p_partkey % 11 = 0 THEN stat || '_left foot sensor.lfs'
              WHEN p_partkey % 11 = 1 THEN stat || '_right foot sensor.rfs'
              ELSE stat || '_' || {_pick(views.MEASURES, "p_partkey % 5")} || '_' || {_pick(views.PLACES, "p_partkey % 7")}
                || '.' || {_pick(views.RAW_DIMENSIONS, "p_partkey % 3")} END AS feature
  FROM (SELECT *, {_pick(views.STATISTICS, "p_partkey % 4")} AS stat FROM part)),
parsed AS (
  SELECT p_partkey, feature, importance,
         CASE WHEN imu OR foot THEN regexp_extract(feature, '^(.*?)_', 1) END AS statistic,
         CASE WHEN imu THEN regexp_extract(feature, '^(.*?)_(.*?)_(.*?)\\.(.*?)$', 2) END AS measure,
         CASE WHEN imu THEN regexp_extract(feature, '^(.*?)_(.*?)_(.*?)\\.(.*?)$', 3)
              WHEN foot THEN regexp_extract(feature, '_(left foot sensor|right foot sensor)', 1) END AS location,
         CASE WHEN imu THEN regexp_extract(feature, '\\.(.*?)$', 1) END AS dimension
  FROM (SELECT *, regexp_matches(feature, '^(.*?)_(.*?)_(.*?)\\.(.*?)$') AS imu,
               feature LIKE '%foot sensor.%' AS foot FROM named)),
pairs AS (
  SELECT 'statistic' AS component, statistic AS value, importance FROM parsed WHERE statistic IS NOT NULL
  UNION ALL SELECT 'measure', measure, importance FROM parsed WHERE measure IS NOT NULL
  UNION ALL SELECT 'location', location, importance FROM parsed WHERE location IS NOT NULL
  UNION ALL SELECT 'dimension', dimension, importance FROM parsed WHERE dimension IS NOT NULL)"""

CLASSES = """
classes AS (
  SELECT event_type AS label, CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS prediction FROM events)"""

VALUES_VIEW = """
vals AS (
  SELECT l_quantity AS y, round(l_extendedprice / 2000, 2) AS p FROM lineitem)"""


# --- rolling windows and features -------------------------------------------------------------

CHANNELS = {"accel_shank_l.x": "a", "gyro_pelvis.z": "g"}
STAT_SQL = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_samp", "first": "first_value", "last": "last_value"}
WINDOW = """WINDOW w AS (PARTITION BY "TRIAL" ORDER BY "TIME" RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"""


def _stats(stats: list[str]) -> str:
    return ", ".join(
        f'round({STAT_SQL[s]}({column}) OVER w, 6) AS "{s}_{channel}"' for channel, column in CHANNELS.items() for s in stats
    )


def _rolling(stats: list[str]) -> str:
    return f"""WITH {INTERIM},
rolled AS (SELECT "TRIAL", "TIME", {_stats(stats)} FROM interim {WINDOW})
SELECT * FROM rolled WHERE "TIME" > 8"""


FOUR = ["min", "max", "mean", "std"]

LAST_LABELS = """
last_labels AS (
  SELECT "TRIAL", arg_max("ACTIVITY", "TIME") AS "ACTIVITY" FROM interim GROUP BY "TRIAL"),
last_rows AS (
  SELECT i."TRIAL", i."ACTIVITY", i."SPEED", i."INCLINE"
  FROM interim i JOIN (SELECT "TRIAL", max("TIME") AS "TIME" FROM interim GROUP BY "TRIAL") m
    ON i."TRIAL" = m."TRIAL" AND i."TIME" = m."TIME")"""

DAYS = 48 * 3_600_000
IRREGULAR = f"""WITH {LABELLED}
SELECT "TRIAL", "TIME", event_id,
       round(min(value) OVER w, 6) AS min_value, round(max(value) OVER w, 6) AS max_value,
       round(avg(value) OVER w, 6) AS mean_value, round(stddev_samp(value) OVER w, 6) AS std_value,
       round(arg_min(value, event_id) OVER w, 6) AS first_value,
       round(arg_max(value, event_id) OVER w, 6) AS last_value
FROM labelled
WINDOW w AS (PARTITION BY "TRIAL" ORDER BY "TIME" RANGE BETWEEN {DAYS - 1} PRECEDING AND CURRENT ROW)"""

TIME_RESET = f"""WITH {SIGNALS},
starts AS (SELECT "TRIAL", min("TIME" + "TRIAL" % 2 * 5) AS first_time FROM signals GROUP BY "TRIAL"),
stepped AS (SELECT *, "TRIAL" - lag("TRIAL") OVER (ORDER BY "TRIAL") AS step FROM starts)
SELECT "TRIAL", CAST(first_time AS BIGINT) AS first_time FROM stepped WHERE step = 1 AND first_time <> 0"""

REATTACH = f"""WITH {LABELLED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY "TRIAL" ORDER BY "TIME" DESC, event_id DESC) AS r FROM labelled)
SELECT l."TRIAL", l."TIME", l.event_id, k."ACTIVITY", k."SPEED", k."INCLINE"
FROM labelled l JOIN ranked k ON l."TRIAL" = k."TRIAL" AND k.r = 1"""

EXTRACTION = f"""WITH {INTERIM}, {LAST_LABELS},
rolled AS (SELECT "TRIAL", "TIME", {_stats(FOUR)} FROM interim {WINDOW})
SELECT r.*, k."ACTIVITY", k."SPEED", k."INCLINE" FROM rolled r JOIN last_rows k ON r."TRIAL" = k."TRIAL"
WHERE r."TIME" > 8"""

SCHEMA_CHECK = f"""WITH {INTERIM}
SELECT "TRIAL", count(*) AS rows, min("TIME") AS first_time FROM interim WHERE "TIME" > 8 GROUP BY "TRIAL" """

LINE_TIES = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"

ROW_POSITION = f"""
SELECT l_returnflag, {LINE_TIES},
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, {LINE_TIES}) - 1 AS position
FROM lineitem"""


def _long_trials() -> str:
    stats = ", ".join(
        f"round({STAT_SQL[s]}({c}) OVER w, {4 if s == 'std' else 6}) AS {s}_{c}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        for s in FOUR
    )
    return f"""WITH lines AS (
  SELECT ascii(l_returnflag) - 65 AS "TRIAL", *,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, {LINE_TIES}) - 1 AS "TIME" FROM lineitem),
rolled AS (
  SELECT "TRIAL", "TIME", {stats} FROM lines
  WINDOW w AS (PARTITION BY "TRIAL" ORDER BY "TIME" RANGE BETWEEN 999 PRECEDING AND CURRENT ROW))
SELECT * FROM rolled WHERE "TIME" > 998"""


# --- split, balance, weights ------------------------------------------------------------------

STRATUM = """coalesce("ACTIVITY", '') || '_' || coalesce(CAST("SPEED" AS VARCHAR), '') || '_'
  || coalesce(CAST("INCLINE" AS VARCHAR), '')"""


def _parted(source: str, key: str, train_size: str, gap: int, ties: str = "") -> str:
    """Position in the stratum; the trial at position k; the first later position of another trial."""
    return f"""keyed AS (SELECT *, {key} AS k FROM {source} WHERE ({key}) IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "TRIAL", "TIME"{ties}) - 1 AS pos,
                  count(*) OVER (PARTITION BY k) AS n FROM keyed),
at_k AS (SELECT k, n, CAST(floor({train_size}::DOUBLE * n) AS BIGINT) AS start,
                max("TRIAL") FILTER (WHERE pos = CAST(floor({train_size}::DOUBLE * n) AS BIGINT)) AS t
         FROM placed GROUP BY k, n),
moved AS (SELECT a.k, coalesce(min(p.pos) FILTER (WHERE p.pos >= a.start AND p."TRIAL" <> a.t), a.start) AS cut
          FROM at_k a JOIN placed p ON a.k = p.k GROUP BY a.k, a.start),
parted AS (SELECT p.*, CASE WHEN pos < cut THEN 'train' WHEN pos >= cut + {gap} THEN 'test' ELSE 'gap' END AS part
           FROM placed p JOIN moved m ON p.k = m.k)"""


def _split(key: str, train_size: str, gap: int) -> str:
    return f"{LABELLED},\n{_parted('labelled', key, train_size, gap, ', event_id')}"


SPLIT = f"""WITH {_split('"ACTIVITY"', "0.8", 5)}
SELECT "TRIAL", "TIME", event_id, "ACTIVITY", value, part FROM parted"""

SPLIT_STRATA = f"""WITH {_split(STRATUM, "0.29", 3)}
SELECT "TRIAL", "TIME", event_id, "ACTIVITY", value, part FROM parted"""

BALANCE = f"""WITH {_split('"ACTIVITY"', "0.8", 5)},
shares AS (SELECT part, "INCLINE", count(*) / sum(count(*)) OVER (PARTITION BY part) AS share
           FROM parted GROUP BY part, "INCLINE")
SELECT a."INCLINE", round(a.share, 6) AS proportion, round(b.share, 6) AS proportion_test,
       round(abs(a.share - b.share), 6) AS diff
FROM shares a JOIN shares b ON a."INCLINE" = b."INCLINE" AND a.part = 'train' AND b.part = 'test'
WHERE abs(a.share - b.share) > 0.0001"""

LABEL_ORDER = f"""WITH {LABELLED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY "ACTIVITY" ORDER BY "TRIAL", "TIME", event_id) AS r FROM labelled)
SELECT "ACTIVITY", "TRIAL", "TIME" FROM ranked WHERE r = 1"""

COUNTS = """
SELECT event_type AS "ACTIVITY", count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS proportion,
       upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS display
FROM events GROUP BY event_type"""

WEIGHTS = """
SELECT event_id, event_type AS "ACTIVITY",
       round(1.0 / (count(*) OVER (PARTITION BY event_type) / (count(*) OVER ())), 6) AS weight
FROM events"""

NULL_TARGETS = """
SELECT event_id, length(event_type) / 2.0::DOUBLE AS "SPEED", value FROM events WHERE event_type <> 'error'"""

ENCODE = """
SELECT event_id, event_type AS "ACTIVITY", dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events"""

SCALER = f"""WITH {_split('"ACTIVITY"', "0.8", 5)},
hours AS (SELECT event_id, part, value, CAST(extract(hour FROM ts) AS DOUBLE) AS h FROM parted WHERE part <> 'gap'),
fitted AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(h) AS mh, stddev_pop(h) AS sh
           FROM hours WHERE part = 'train')
SELECT event_id, part, round((value - mv) / CASE WHEN sv = 0 THEN 1 ELSE sv END, 6) AS value,
       round((h - mh) / CASE WHEN sh = 0 THEN 1 ELSE sh END, 6) AS hour
FROM hours, fitted"""


# --- least squares ------------------------------------------------------------------------------

FEATURES = f"""{INTERIM}, {LAST_LABELS},
rolled AS (SELECT "TRIAL", "TIME", min(a) OVER w AS x1, max(a) OVER w AS x2, min(g) OVER w AS x3, max(g) OVER w AS x4
           FROM interim WINDOW w AS (PARTITION BY "TRIAL" ORDER BY "TIME" RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)),
features AS (SELECT r.*, k."ACTIVITY", k."SPEED", k."INCLINE" FROM rolled r JOIN last_rows k ON r."TRIAL" = k."TRIAL"
             WHERE r."TIME" > 8)"""


def _least_squares(target: str, name: str) -> str:
    """Errors of the linear model of ``target``: one column after the other is taken out of those behind it and of the
    target, by slopes of the train rows (Gram and Schmidt). What is left of the target is the error."""
    xs = [f"x{i}" for i in range(1, 5)]
    steps = [
        f"""{name}_rows AS (SELECT part, CAST("{target}" AS DOUBLE) AS y, {", ".join(xs)} FROM parted
  WHERE part <> 'gap' AND "{target}" IS NOT NULL)""",
        f"""{name}_m AS (SELECT avg(y) AS my, {", ".join(f"avg({x}) AS m{x}" for x in xs)} FROM {name}_rows WHERE part = 'train')""",
        f"""{name}_0 AS (SELECT part, y AS t, y - my AS y, {", ".join(f"{x} - m{x} AS {x}" for x in xs)} FROM {name}_rows, {name}_m)""",
    ]
    for i, x in enumerate(xs, start=1):
        rest = [*xs[i:], "y"]
        slopes = ", ".join(f"sum({x} * {r}) / sum({x} * {x}) AS slope_{r}" for r in rest)
        left = ", ".join(f"{r} - slope_{r} * {x} AS {r}" for r in rest)
        steps.append(f"{name}_b{i} AS (SELECT {slopes} FROM {name}_{i - 1} WHERE part = 'train')")
        steps.append(f"{name}_{i} AS (SELECT part, t, {left} FROM {name}_{i - 1}, {name}_b{i})")
    steps.append(f"""{name}_scores AS (
  SELECT count(*) AS n, 1 - sum(y * y) / (var_pop(t) * count(*)) AS r2, sqrt(avg(y * y)) AS rmse, avg(abs(y)) AS mae
  FROM {name}_{len(xs)} WHERE part = 'test')""")
    return ",\n".join(steps)


def _scores_of(name: str, first: str = "") -> str:
    return f"SELECT {first}n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM {name}_scores"


SPEED_REGRESSOR = f"""WITH {FEATURES},
{_parted("features", '"ACTIVITY"', "0.8", 5)},
{_least_squares("SPEED", "speed")}
{_scores_of("speed")}"""

REGRESSOR_RUN = f"""WITH {FEATURES},
{_parted("features", STRATUM, "0.8", 0)},
{_least_squares("SPEED", "speed")},
{_least_squares("INCLINE", "incline")}
{_scores_of("speed", "'SPEED' AS target, ")}
UNION ALL {_scores_of("incline", "'INCLINE' AS target, ")}"""

APPLY_MODEL = f"""WITH {FEATURES},
{_parted("features", '"ACTIVITY"', "0.8", 5)},
{_least_squares("SPEED", "speed")}
SELECT 'features' AS val_data, 'run_lr' AS run_id, 'SPEED' AS feature, round(r2, 6) AS score, CAST(NULL AS VARCHAR) AS plot_path,
       round(rmse, 6) AS rmse FROM speed_scores"""


# --- ingest -----------------------------------------------------------------------------------

PARTICIPANTS = f"""WITH {FILES}
SELECT DISTINCT participant, CAST(substr(participant, 2) AS BIGINT) AS participant_no FROM files
WHERE regexp_full_match(participant, 'P\\d{{1,2}}') AND participant NOT IN ('P15', 'P16')"""

FILE_FILTER = f"""WITH {TRIAL_FILES}
SELECT o_orderkey, participant, filename FROM trial_files"""

ACTIVITY_SQL = """CASE WHEN lower(filename) LIKE '%walk%' THEN 'walk' WHEN lower(filename) LIKE '%jog%' THEN 'run'
  WHEN lower(filename) LIKE '%run%' THEN 'run' WHEN lower(filename) LIKE '%jump%' THEN 'jump' END"""
INCLINE_SQL = """CASE WHEN lower(filename) LIKE '%jump%' THEN NULL
  WHEN lower(filename) LIKE '%incline%'
    THEN coalesce(CAST(nullif(regexp_extract(lower(filename), '(\\d+)[\\s_]*incline', 1), '') AS BIGINT), 0)
  WHEN lower(filename) LIKE '%decline%'
    THEN -coalesce(CAST(nullif(regexp_extract(lower(filename), '(\\d+)[\\s_]*decline', 1), '') AS BIGINT), 0)
  ELSE 0 END"""
SPEED_SQL = """CAST(nullif(regexp_extract(filename, '(\\d+)_(\\d+)ms', 1) || '.'
  || regexp_extract(filename, '(\\d+)_(\\d+)ms', 2), '.') AS DOUBLE)"""

METADATA = f"""WITH {FILES}
SELECT o_orderkey, filename, {ACTIVITY_SQL} AS "ACTIVITY", CAST({INCLINE_SQL} AS BIGINT) AS "INCLINE",
       round({SPEED_SQL}, 4) AS "SPEED"
FROM files"""

NUMBERING = f"""WITH {TRIAL_FILES}
SELECT participant, filename, row_number() OVER (ORDER BY no, participant, filename) - 1 AS "TRIAL"
FROM (SELECT DISTINCT participant, filename, no FROM trial_files)"""

TIMES = f"""
SELECT frame, rate, CAST(frame * 1000 // rate AS BIGINT) AS time_exact,
       CAST(trunc(frame / rate::DOUBLE * 1000) AS BIGINT) AS time_compat
FROM (SELECT o_orderkey AS frame, CAST(unnest({_list(views.RATES)}) AS BIGINT) AS rate FROM orders)"""

NORMALISE = f"""WITH {RECORDINGS}
SELECT participant, filename, frame, label, round(value, 6) AS value FROM lowered"""

TIDY = "replace(replace(label, '_l_shank', '_shank_l'), '__', '_')"

SELECT_CHANNELS = f"""WITH {RECORDINGS}
SELECT participant, filename, frame, {TIDY} AS label, round(value, 6) AS value FROM lowered
WHERE (label LIKE '%foot sensor%' OR label LIKE '%shank%' OR label LIKE '%thigh%')
  AND (label LIKE '%accel%' OR label LIKE '%gyro%' OR label LIKE '%sensor%')
  AND (label LIKE '%.y%' OR label LIKE '%.lfs%' OR label LIKE '%.rfs%')"""


def _channel_names() -> list[str]:
    names = []
    for p in range(62):
        raw = views.RAW_MEASURES[p // 21 % 4] + "_" + views.RAW_PLACES[p // 3 % 7] + "." + views.RAW_DIMENSIONS[p % 3]
        names.append(raw.lower().replace("_l_shank", "_shank_l").replace("__", "_"))
    return [*names, "left foot sensor.lfs", "right foot sensor.rfs"]


def _ingest() -> str:
    columns = ", ".join(f"round(max(CASE WHEN tidy = '{c}' THEN value END), 6) AS \"{c}\"" for c in _channel_names())
    return f"""WITH {RECORDINGS},
numbered AS (SELECT filename, dense_rank() OVER (ORDER BY no, filename) - 1 AS "TRIAL", frame, rate, {TIDY} AS tidy, value
             FROM lowered WHERE no <> 4)
SELECT "TRIAL", CAST(frame * 1000 // rate AS BIGINT) AS "TIME", {columns}, {ACTIVITY_SQL} AS "ACTIVITY",
       CAST({INCLINE_SQL} AS BIGINT) AS "INCLINE", round({SPEED_SQL}, 6) AS "SPEED"
FROM numbered GROUP BY "TRIAL", filename, frame, rate"""


INCREMENT = f"""WITH {RECORDINGS},
extents AS (
  SELECT participant, no, filename, CASE WHEN regexp_extract(filename, 'take(\\d+)', 1)::INTEGER % 2 = 0 THEN 1 ELSE 2 END AS batch,
         count(DISTINCT frame) AS frames, max(CAST(frame * 1000 // rate AS BIGINT)) AS last_time
  FROM recordings WHERE no <> 4 GROUP BY participant, no, filename)
SELECT batch, participant, filename, row_number() OVER (ORDER BY batch, no, filename) - 1 AS "TRIAL",
       {ACTIVITY_SQL} AS "ACTIVITY", CAST({INCLINE_SQL} AS BIGINT) AS "INCLINE", round({SPEED_SQL}, 4) AS "SPEED", frames, last_time
FROM extents"""

ALIGNMENT = f"""WITH {RECORDINGS},
takes AS (SELECT *, regexp_extract(filename, 'take(\\d+)', 1)::INTEGER AS take FROM lowered WHERE no <> 4),
altered AS (
  SELECT DISTINCT dense_rank() OVER (ORDER BY no, filename) - 1 AS "TRIAL",
         CASE WHEN take % 5 = 1 AND label = 'accel_foot_l.x' THEN 'mag_foot_l.x' ELSE {TIDY} END AS channel
  FROM takes WHERE NOT (take % 7 = 3 AND label = 'accel_l_shank.z')),
wanted AS (SELECT channel FROM altered WHERE "TRIAL" = 0),
trials AS (SELECT DISTINCT "TRIAL" FROM altered)
SELECT "TRIAL", channel, 'missing' AS difference
FROM (SELECT "TRIAL", channel FROM trials, wanted EXCEPT SELECT "TRIAL", channel FROM altered)
UNION ALL
SELECT "TRIAL", channel, 'extra' AS difference FROM altered WHERE channel NOT IN (SELECT channel FROM wanted)"""

EMPTY_RECORDINGS = f"""WITH {TRIAL_FILES},
listed AS (SELECT DISTINCT participant, filename, no FROM trial_files),
counted AS (
  SELECT participant, filename, count(*) AS n FROM files JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_quantity = 50 GROUP BY participant, filename)
SELECT l.participant, l.filename, coalesce(n, 0) AS samples,
       CASE WHEN n IS NOT NULL THEN row_number() OVER (PARTITION BY n IS NULL ORDER BY no, l.participant, l.filename) - 1 END AS "TRIAL"
FROM listed l LEFT JOIN counted c ON l.participant = c.participant AND l.filename = c.filename"""


# --- scores -----------------------------------------------------------------------------------


def _confusion() -> str:
    kinds = ["click", "error", "purchase", "signup", "view"]
    columns = ", ".join(
        f"round(sum(CASE WHEN prediction = '{k}' THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS \"{k}\"" for k in kinds
    )
    return f"WITH {CLASSES} SELECT label AS labels, {columns} FROM classes GROUP BY label"


CLASS_SCORES = f"""{CLASSES},
per_class AS (
  SELECT c.k, (SELECT count(*) FROM classes WHERE label = c.k) AS support,
         (SELECT count(*) FROM classes WHERE prediction = c.k) AS predicted,
         (SELECT count(*) FROM classes WHERE label = c.k AND prediction = c.k) AS hits
  FROM (SELECT label AS k FROM classes UNION SELECT prediction FROM classes) c),
class_scores AS (
  SELECT CAST(sum(support) AS BIGINT) AS n, sum(hits) / sum(support) AS accuracy,
         sum(support * 2.0::DOUBLE * hits / (support + predicted)) / sum(support) AS weighted_f1
  FROM per_class)"""

VALUE_SCORES = f"""{VALUES_VIEW},
value_scores AS (
  SELECT count(*) AS n,
         1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2,
         sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae
  FROM vals, (SELECT avg(y) AS m FROM vals))"""

CLASSIFICATION = f"""WITH {CLASS_SCORES}
SELECT n, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1 FROM class_scores"""

REGRESSION = f"""WITH {VALUE_SCORES}
SELECT n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM value_scores"""

HISTOGRAM = f"""WITH {VALUES_VIEW},
truth AS (SELECT y AS v, count(*) AS n FROM vals GROUP BY y),
near AS (SELECT v, n, lag(v) OVER (ORDER BY v) AS prev, lead(v) OVER (ORDER BY v) AS next FROM truth),
bins AS (SELECT coalesce((prev + v) / 2, v - (next - v) / 2) AS low, coalesce((v + next) / 2, v + (v - prev) / 2) AS high,
                next IS NULL AS closing FROM near),
span AS (SELECT min(p) AS least, max(p) AS most, (max(p) - min(p)) / 120 AS width FROM vals),
fine AS (SELECT i, least + (i - 1) * width AS low, CASE WHEN i = 120 THEN most ELSE least + i * width END AS high
         FROM span, (SELECT unnest(range(1, 121)) AS i))
SELECT 'actual' AS series, round(v, 6) AS low, round(v, 6) AS high, n AS count FROM truth
UNION ALL
SELECT 'binned', round(low, 6), round(high, 6),
       (SELECT count(*) FROM vals WHERE p >= low AND (p < high OR (closing AND p = high))) FROM bins
UNION ALL
SELECT 'fine', round(low, 6), round(high, 6),
       (SELECT count(*) FROM vals WHERE p >= low AND (p < high OR (i = 120 AND p = high)))
         * (120 // (SELECT count(*) + 1 FROM truth)) FROM fine"""

PARSE = f"""WITH {FEATURE_NAMES}
SELECT p_partkey, feature, statistic, measure, location, dimension FROM parsed"""

ROLLUP = f"""WITH {FEATURE_NAMES}
SELECT component, value, round(sum(importance), 3) AS importance FROM pairs GROUP BY component, value"""

RUN_COMPONENTS = f"WITH {FEATURE_NAMES} SELECT DISTINCT component, value FROM pairs"

LEDGER = f"""WITH {CLASS_SCORES}, {VALUE_SCORES}
SELECT 'events' AS val_data, 'LR_run' AS run_id, 'ACTIVITY' AS feature, round(accuracy, 6) AS score,
       'LR_run_cm' AS plot_path, CAST(NULL AS DOUBLE) AS rmse FROM class_scores
UNION ALL
SELECT 'lineitem', 'LR_run', 'SPEED', round(r2, 6), NULL, round(rmse, 6) FROM value_scores"""


ORACLE: dict[str, str] = {
    "rolling_stats": _rolling(FOUR),
    "rolling_stats_arrow": _rolling(FOUR),
    "rolling_stats_blocked": _rolling(FOUR),
    "rolling_first_last": _rolling(["first", "last"]),
    "rolling_irregular": IRREGULAR,
    "rolling_long_trials": _long_trials(),
    "time_reset_check": TIME_RESET,
    "reattach_labels": REATTACH,
    "feature_extraction": EXTRACTION,
    "schema_check": SCHEMA_CHECK,
    "row_position": ROW_POSITION,
    "stratum_key": f'WITH {LABELLED} SELECT event_id, {STRATUM} AS stratum FROM labelled',
    "train_test_split": SPLIT,
    "train_test_split_strata": SPLIT_STRATA,
    "split_balance": BALANCE,
    "label_order": LABEL_ORDER,
    "activity_counts": COUNTS,
    "class_weights": WEIGHTS,
    "null_target_filter": NULL_TARGETS,
    "label_encode": ENCODE,
    "standard_scaler": SCALER,
    "participant_scan": PARTICIPANTS,
    "trial_file_filter": FILE_FILTER,
    "trial_metadata": METADATA,
    "trial_numbering": NUMBERING,
    "time_column": TIMES,
    "channel_normalise": NORMALISE,
    "channel_select": SELECT_CHANNELS,
    "ingest_trials": _ingest(),
    "ingest_increment": INCREMENT,
    "channel_alignment": ALIGNMENT,
    "empty_recordings": EMPTY_RECORDINGS,
    "confusion_matrix": _confusion(),
    "classification_scores": CLASSIFICATION,
    "regression_scores": REGRESSION,
    "regression_histogram": HISTOGRAM,
    "feature_name_parse": PARSE,
    "importance_rollup": ROLLUP,
    "run_components": RUN_COMPONENTS,
    "validation_ledger": LEDGER,
    "ledger_retry": LEDGER,
    "speed_regressor": SPEED_REGRESSOR,
    "regressor_run": REGRESSOR_RUN,
    "apply_model": APPLY_MODEL,
}
