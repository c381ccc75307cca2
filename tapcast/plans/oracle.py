"""DuckDB SQL for every relational query, written against the raw driver
tables (``events``, ``nation``, ``region``, ``orders``).

The SQL uses the direct formulation where it differs from the
Spark plan: neighbour slots and next-day targets are self-joins, device
counts are COUNT(DISTINCT), the road map is an explicit self-join of
nations. Doubles are rounded to 6 places, as in the Spark queries.
"""

from __future__ import annotations

from tapcast.plans import fixture as fx

TARGET = f"DATE '{fx.TARGET_DATE.isoformat()}'"


# Fixed values, written out so that they check the engine's own.
HOLIDAYS = """'1-1', '2-4', '2-5', '2-6', '2-7', '2-8', '2-9', '2-10', '4-5', '5-1', '6-7', '9-13',
             '10-1', '10-2', '10-3', '10-4', '10-5', '10-6', '10-7'"""
WORKED_WEEKENDS = "'2-2', '2-3', '9-29', '10-12'"


def holiday_sql(d: str) -> str:
    md = f"concat_ws('-', month({d}), day({d}))"
    return (f"CAST(CASE WHEN {md} IN ({HOLIDAYS}) THEN 1 "
            f"WHEN {md} IN ({WORKED_WEEKENDS}) THEN 0 "
            f"WHEN isodow({d}) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER)")


def peak_sql(hol: str = "is_holiday", slot: str = "slot") -> str:
    """Classes of 10-minute slots by clock time, start included, end excluded."""
    clock = f"(TIME '00:00:00' + to_minutes(CAST({slot} * 10 AS BIGINT)))"

    def within(*spans: str) -> str:
        return " OR ".join(f"({clock} >= TIME '{a}:00' AND {clock} < TIME '{b}:00')"
                           for a, b in (s.split("-") for s in spans))

    return f"""CAST(CASE
      WHEN {within('00:00-06:00')} THEN 0
      WHEN {hol} = 0 AND ({within('07:30-08:30', '17:30-18:30')}) THEN 3
      WHEN {hol} = 0 AND ({within('07:00-07:30', '08:30-09:00', '17:00-17:30', '18:30-19:00')}) THEN 2
      WHEN {hol} = 1 AND ({within('09:00-12:00', '15:00-18:00')}) THEN 3
      WHEN {hol} = 1 AND ({within('07:00-09:00', '12:00-15:00', '18:00-20:00')}) THEN 2
      ELSE 1 END AS INTEGER)"""


def peak_hourly_sql() -> str:
    """Classes of whole hours: on workdays 7, 8, 17 and 18 are half peak and
    half special peak, and the higher class wins the tie."""
    return with_ctes(TAPS, SLOTS) + f"""
, hours AS (SELECT DISTINCT station_id, service_date, slot // 6 AS slot, is_holiday FROM slots)
SELECT station_id, service_date, CAST(slot AS INTEGER) AS slot, is_holiday, CAST(CASE
  WHEN slot < 6 THEN 0
  WHEN is_holiday = 0 AND slot IN (7, 8, 17, 18) THEN 3
  WHEN is_holiday = 1 AND slot IN (9, 10, 11, 15, 16, 17) THEN 3
  WHEN is_holiday = 1 AND slot IN (7, 8, 12, 13, 14, 18, 19) THEN 2
  ELSE 1 END AS INTEGER) AS peak_type
FROM hours"""


def _ieee_div(num: str, dem: str) -> str:
    return (f"(CASE WHEN ({dem}) <> 0 THEN ({num}) / ({dem}) "
            f"WHEN isnan({num}) THEN 'nan'::DOUBLE "
            f"WHEN ({num}) > 0 THEN 'inf'::DOUBLE WHEN ({num}) < 0 THEN '-inf'::DOUBLE "
            f"ELSE 'nan'::DOUBLE END)")


def _sqrt(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 OR isnan({x}) THEN 'nan'::DOUBLE ELSE sqrt({x}) END)"


def beta_sql(stat: str, a: str = "a", b: str = "b", p: str = "p") -> str:
    s = f"({a} + {b})"
    if stat == "mean":
        return _ieee_div(a, s)
    if stat == "mode":
        return _ieee_div(f"{a} - 1", f"{s} - 2")
    if stat == "median":
        return _ieee_div(f"{a} - 1.0/3", f"{s} - 2.0/3")
    if stat == "var":
        return _ieee_div(f"{a} * {b}", f"pow({s}, 2) * ({s} + 1)")
    if stat == "skewness":
        return _ieee_div(f"2 * ({b} - {a}) * {_sqrt(f'{s} + 1')}",
                         f"({s} + 2) * {_sqrt(f'{a} * {b}')}")
    if stat == "kurtosis":
        return _ieee_div(f"6 * pow({a} - {b}, 2) * ({s} + 1) - {a} * {b} * ({s} + 2)",
                         f"{a} * {b} * ({s} + 2) * ({s} + 3)")
    return p


# --- CTE chain ---------------------------------------------------------------

TAPS = f"""
taps AS (
  SELECT e.ts AS time, CAST(e.user_id % {fx.N_STATIONS} AS INTEGER) AS station_id, r.r_name AS line_id,
         CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS device_id,
         CASE WHEN e.event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS status
  FROM events e
  LEFT JOIN nation n ON n.n_nationkey = CAST(e.user_id % {fx.N_STATIONS} AS INTEGER)
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  WHERE e.ts IS NOT NULL AND e.user_id IS NOT NULL
),
cells AS (
  SELECT station_id, CAST(time AS DATE) AS service_date,
         CAST((hour(time) * 60 + minute(time)) // 10 AS INTEGER) AS slot, device_id, status
  FROM taps
)"""

SLOTS = f"""
base AS (
  SELECT station_id, service_date, slot, COUNT(status) AS n_taps,
         CAST(COALESCE(SUM(status), 0) AS BIGINT) AS n_in,
         COUNT(DISTINCT device_id) AS nuni_slot
  FROM cells GROUP BY station_id, service_date, slot
),
dev_day AS (
  SELECT station_id, service_date, COUNT(DISTINCT device_id) AS nuni_day
  FROM cells GROUP BY station_id, service_date
),
dev_hour AS (
  SELECT station_id, service_date, slot // 6 AS hour, COUNT(DISTINCT device_id) AS nuni_hour
  FROM cells GROUP BY station_id, service_date, slot // 6
),
slots AS (
  SELECT b.station_id, b.service_date, b.slot,
         CAST(isodow(b.service_date) AS INTEGER) AS weekday,
         {holiday_sql('b.service_date')} AS is_holiday,
         CAST(day(b.service_date) AS INTEGER) AS day,
         CAST(b.slot // 6 AS INTEGER) AS hour, CAST((b.slot % 6) * 10 AS INTEGER) AS minute,
         b.n_in AS in_nums, CAST(b.n_taps - b.n_in AS BIGINT) AS out_nums,
         d.nuni_day AS nuni_device_station, h.nuni_hour AS nuni_device_station_hour,
         b.nuni_slot AS nuni_device_station_slot
  FROM base b
  JOIN dev_day d ON d.station_id = b.station_id AND d.service_date = b.service_date
  JOIN dev_hour h ON h.station_id = b.station_id AND h.service_date = b.service_date
                 AND h.hour = b.slot // 6
)"""


def _nb_join(alias: str, off: int) -> str:
    return (f"LEFT JOIN slots {alias} ON {alias}.station_id = s.station_id "
            f"AND {alias}.service_date = s.service_date AND {alias}.slot = s.slot + ({off})")


NEIGHBORS = f"""
nb AS (
  SELECT s.station_id, s.service_date, s.slot, s.weekday, s.is_holiday, s.day, s.hour, s.minute,
         s.in_nums AS in_now, s.out_nums AS out_now,
         s.nuni_device_station, s.nuni_device_station_hour, s.nuni_device_station_slot,
         COALESCE(b2.in_nums, 0) AS in_before2, COALESCE(b2.out_nums, 0) AS out_before2,
         COALESCE(b1.in_nums, 0) AS in_before1, COALESCE(b1.out_nums, 0) AS out_before1,
         COALESCE(a2.in_nums, 0) AS in_after2, COALESCE(a2.out_nums, 0) AS out_after2,
         COALESCE(a1.in_nums, 0) AS in_after1, COALESCE(a1.out_nums, 0) AS out_after1
  FROM slots s
  {_nb_join('b2', -2)}
  {_nb_join('b1', -1)}
  {_nb_join('a2', 2)}
  {_nb_join('a1', 1)}
)"""

NETWORK = """
station_line AS (SELECT DISTINCT line_id, station_id FROM taps WHERE line_id IS NOT NULL),
per_line AS (SELECT line_id, COUNT(station_id) AS line_size FROM station_line GROUP BY line_id),
line_sizes AS (
  SELECT sl.station_id, max(pl.line_size) AS line_size
  FROM station_line sl JOIN per_line pl ON pl.line_id = sl.line_id GROUP BY sl.station_id
),
degrees AS (
  SELECT a.n_nationkey AS station_id, COUNT(*) AS station_type
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
  GROUP BY a.n_nationkey
)"""

FEAT = f"""
feat AS (
  SELECT nb.*, {peak_sql('nb.is_holiday', 'nb.slot')} AS peak_type,
         max(in_now) OVER whm AS in_whm_max, min(in_now) OVER whm AS in_whm_min,
         avg(in_now) OVER whm AS in_whm_mean,
         max(out_now) OVER whm AS out_whm_max, min(out_now) OVER whm AS out_whm_min,
         avg(out_now) OVER whm AS out_whm_mean,
         max(in_now) OVER wh AS in_wh_max, min(in_now) OVER wh AS in_wh_min,
         avg(in_now) OVER wh AS in_wh_mean, avg(out_now) OVER wh AS out_wh_mean,
         COALESCE(ls.line_size, 0) AS line_size, COALESCE(dg.station_type, 0) AS station_type,
         CAST(CASE WHEN nb.station_id IN ({', '.join(map(str, fx.SPECIAL_IDS))}) THEN 1 ELSE 0 END AS INTEGER)
           AS is_special
  FROM nb
  LEFT JOIN line_sizes ls ON ls.station_id = nb.station_id
  LEFT JOIN degrees dg ON dg.station_id = nb.station_id
  WINDOW whm AS (PARTITION BY nb.station_id, nb.weekday, nb.hour, nb.minute),
         wh AS (PARTITION BY nb.station_id, nb.weekday, nb.hour)
)"""

FEATURE_VALUE_COLS = [
    "in_now", "out_now", "nuni_device_station", "nuni_device_station_hour",
    "nuni_device_station_slot", "in_before2", "out_before2", "in_before1", "out_before1",
    "in_after2", "out_after2", "in_after1", "out_after1", "peak_type",
    "in_whm_max", "in_whm_min", "in_whm_mean", "out_whm_max", "out_whm_min", "out_whm_mean",
    "in_wh_max", "in_wh_min", "in_wh_mean", "out_wh_mean", "line_size", "station_type",
    "is_special",
]
FRAME_COLS = (["station_id", "service_date", "slot", "weekday", "yesterday_is_holiday", "day",
               "hour", "minute"] + FEATURE_VALUE_COLS + ["in_nums", "out_nums", "today_is_holiday"])
STATIC = ["weekday", "yesterday_is_holiday", "nuni_device_station", "line_size",
          "station_type", "is_special"]


def _shifted_select(src: str = "f") -> str:
    d = f"({src}.service_date + 1)"
    vals = ", ".join(f"{src}.{c}" for c in FEATURE_VALUE_COLS)
    return (f"{src}.station_id, {d} AS service_date, {src}.slot, "
            f"CAST(isodow({d}) AS INTEGER) AS weekday, {src}.is_holiday AS yesterday_is_holiday, "
            f"CAST(day({d}) AS INTEGER) AS day, {src}.hour, {src}.minute, {vals}")


FRAMES = f"""
observed AS (SELECT DISTINCT service_date FROM feat),
train AS (
  SELECT {_shifted_select('f')},
         COALESCE(t.in_now, 0) AS in_nums, COALESCE(t.out_now, 0) AS out_nums,
         {holiday_sql('(f.service_date + 1)')} AS today_is_holiday
  FROM feat f
  LEFT JOIN feat t ON t.station_id = f.station_id AND t.slot = f.slot
                  AND t.service_date = f.service_date + 1
  WHERE f.service_date + 1 <> {TARGET}
    AND f.service_date + 1 IN (SELECT service_date FROM observed)
),
sfeat AS (SELECT {_shifted_select('f')} FROM feat f WHERE f.service_date + 1 = {TARGET}),
grid AS (
  SELECT station_id, service_date, CAST(s AS INTEGER) AS slot
  FROM (SELECT n_nationkey AS station_id, {TARGET} AS service_date, unnest(range(0, 144)) AS s
        FROM nation)
),
static AS (
  SELECT station_id, {', '.join(f'max({c}) AS {c}' for c in STATIC)}
  FROM sfeat WHERE {' AND '.join(f'{c} IS NOT NULL' for c in STATIC)}
  GROUP BY station_id
),
sj AS (
  SELECT * EXCLUDE ({', '.join(STATIC + ['hour', 'minute', 'day'])})
  FROM sfeat FULL OUTER JOIN grid USING (station_id, service_date, slot)
),
score AS (
  SELECT sj.station_id, sj.service_date, sj.slot,
         COALESCE(st.weekday, 0) AS weekday,
         COALESCE(st.yesterday_is_holiday, 0) AS yesterday_is_holiday,
         CAST(day(sj.service_date) AS INTEGER) AS day,
         CAST(sj.slot // 6 AS INTEGER) AS hour, CAST((sj.slot % 6) * 10 AS INTEGER) AS minute,
         {', '.join(f'COALESCE(st.{c}, 0) AS {c}' if c in STATIC else f'COALESCE(sj.{c}, 0) AS {c}' for c in FEATURE_VALUE_COLS)},
         CAST(0 AS BIGINT) AS in_nums, CAST(0 AS BIGINT) AS out_nums,
         {holiday_sql('sj.service_date')} AS today_is_holiday
  FROM sj LEFT JOIN static st ON st.station_id = sj.station_id
),
allf AS (
  SELECT {', '.join(FRAME_COLS)} FROM train
  UNION ALL
  SELECT {', '.join(FRAME_COLS)} FROM score
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _r6(x: str) -> str:
    """Round to 6 places; ``+ 0.0`` turns -0.0 into 0.0 (Spark's rounding
    goes through a decimal, which has no negative zero)."""
    return f"(round({x}, 6) + 0.0)"


def _round(cols, doubles) -> str:
    return ", ".join(f"{_r6(c)} AS {c}" if c in doubles else c for c in cols)


FEATURE_DOUBLES = {"in_whm_mean", "out_whm_mean", "in_wh_mean", "out_wh_mean"}


def slot_counts_sql() -> str:
    return with_ctes(TAPS, SLOTS) + """
SELECT station_id, service_date, slot, weekday, is_holiday, day, hour, minute, in_nums, out_nums
FROM slots"""


def device_uniques_sql() -> str:
    return with_ctes(TAPS, SLOTS) + """
SELECT station_id, service_date, slot, nuni_device_station, nuni_device_station_hour,
       nuni_device_station_slot
FROM slots"""


def holiday_flag_sql() -> str:
    d = "CAST(o_orderdate AS DATE)"
    return f"""
SELECT {d} AS service_date, CAST(isodow({d}) AS INTEGER) AS weekday,
       concat_ws('-', month({d}), day({d})) AS month_day, {holiday_sql(d)} AS is_holiday,
       COUNT(*) AS n_orders
FROM orders WHERE o_orderdate IS NOT NULL
GROUP BY {d}"""


def neighbor_slots_sql() -> str:
    return with_ctes(TAPS, SLOTS, NEIGHBORS) + """
SELECT station_id, service_date, slot, in_now, out_now, in_before2, out_before2, in_before1,
       out_before1, in_after2, out_after2, in_after1, out_after1
FROM nb"""


def peak_type_sql() -> str:
    return with_ctes(TAPS, SLOTS) + f"""
SELECT station_id, service_date, slot, is_holiday, {peak_sql()} AS peak_type FROM slots"""


def seasonal_stats_sql() -> str:
    cols = ["station_id", "service_date", "slot", "in_whm_max", "in_whm_min", "in_whm_mean",
            "out_whm_max", "out_whm_min", "out_whm_mean", "in_wh_max", "in_wh_min", "in_wh_mean",
            "out_wh_mean"]
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT) + f"""
SELECT {_round(cols, FEATURE_DOUBLES)} FROM feat"""


def line_size_sql() -> str:
    return with_ctes(TAPS, SLOTS, NETWORK) + """
SELECT s.station_id, s.service_date, s.slot, COALESCE(ls.line_size, 0) AS line_size
FROM slots s LEFT JOIN line_sizes ls ON ls.station_id = s.station_id"""


def station_degree_sql() -> str:
    return with_ctes(TAPS, SLOTS, NETWORK) + """
SELECT s.station_id, s.service_date, s.slot, COALESCE(d.station_type, 0) AS station_type
FROM slots s LEFT JOIN degrees d ON d.station_id = s.station_id"""


def special_flag_sql() -> str:
    ids = ", ".join(map(str, fx.SPECIAL_IDS))
    return with_ctes(TAPS, SLOTS) + f"""
SELECT station_id, service_date, slot,
       CAST(CASE WHEN station_id IN ({ids}) THEN 1 ELSE 0 END AS INTEGER) AS is_special
FROM slots"""


def neighbor_station_flow_sql() -> str:
    pairs = """
pairs AS (
  SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a
  JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
),
nbflow AS (
  SELECT p.a AS station_id, o.service_date, o.slot - k.off AS slot, k.off,
         SUM(o.in_nums) AS fin, SUM(o.out_nums) AS fout
  FROM pairs p JOIN slots o ON o.station_id = p.b
  CROSS JOIN (VALUES (0), (-1), (1)) k(off)
  GROUP BY ALL
)"""
    sel = []
    for off, name in ((0, "now"), (-1, "before1"), (1, "after1")):
        for src, pre in (("fin", "nb_in"), ("fout", "nb_out")):
            sel.append(f"CAST(COALESCE(max(CASE WHEN f.off = {off} THEN f.{src} END), 0) AS BIGINT) "
                       f"AS {pre}_{name}")
    return with_ctes(TAPS, SLOTS, pairs) + f"""
SELECT s.station_id, s.service_date, s.slot, {', '.join(sel)}
FROM slots s LEFT JOIN nbflow f ON f.station_id = s.station_id
  AND f.service_date = s.service_date AND f.slot = s.slot
GROUP BY s.station_id, s.service_date, s.slot"""


def ratio_features_sql() -> str:
    doubles = {"in_share_now", "in_vs_week", "out_vs_week"}
    cols = ["station_id", "service_date", "slot", "net_now", "total_now", "in_share_now",
            "in_trend", "out_trend", "in_vs_week", "out_vs_week"]
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT) + f"""
, r AS (
  SELECT station_id, service_date, slot,
         in_now - out_now AS net_now, in_now + out_now AS total_now,
         in_now / NULLIF(in_now + out_now, 0) AS in_share_now,
         in_after1 - in_before1 AS in_trend, out_after1 - out_before1 AS out_trend,
         CAST(in_now AS DOUBLE) / NULLIF(in_whm_mean, 0) AS in_vs_week,
         CAST(out_now AS DOUBLE) / NULLIF(out_whm_mean, 0) AS out_vs_week
  FROM feat
)
SELECT {_round(cols, doubles)} FROM r"""


def _frame_sql(where: str = "", src: str = "train") -> str:
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES) + f"""
SELECT {_round(FRAME_COLS, FEATURE_DOUBLES)} FROM {src} {where}"""


def train_frame_sql() -> str:
    return _frame_sql()


def score_frame_sql() -> str:
    return _frame_sql(src="score")


def cohort_workday_sql() -> str:
    return _frame_sql("WHERE today_is_holiday = 0")


def encode_sql(stat: str, group: str = "slot", n_min: float = float(fx.N_MIN)) -> str:
    parts = [f"""
train_g AS (SELECT *, {group} AS grp FROM train),
allf_g AS (SELECT *, {group} AS grp FROM allf)"""]
    for tgt, out in (("in_nums", "in_slot_enc"), ("out_nums", "out_slot_enc")):
        parts.append(f"""
st_{out} AS (
  SELECT grp, CAST(SUM(CAST({tgt} AS DOUBLE)) AS DOUBLE) AS n, CAST(COUNT({tgt}) AS DOUBLE) AS cnt
  FROM train_g GROUP BY grp
),
pr_{out} AS (SELECT SUM(n) / SUM(cnt) AS p FROM st_{out}),
nn_{out} AS (
  SELECT a.station_id, a.service_date, a.slot, pr.p,
         CASE WHEN st.n IS NULL THEN pr.p ELSE st.n END AS n,
         CASE WHEN st.n IS NULL THEN 1.0 ELSE st.cnt END AS cnt
  FROM allf_g a LEFT JOIN st_{out} st ON st.grp = a.grp, pr_{out} pr
),
ab_{out} AS (
  SELECT station_id, service_date, slot, p,
         p * greatest({float(n_min)} - cnt, 0.0) + n AS a,
         (1 - p) * greatest({float(n_min)} - cnt, 0.0) + cnt - n AS b
  FROM nn_{out}
),
v_{out} AS (SELECT station_id, service_date, slot, {beta_sql(stat)} AS v FROM ab_{out}),
med_{out} AS (SELECT median(v) AS m FROM v_{out} WHERE NOT isnan(v)),
e_{out} AS (
  SELECT v.station_id, v.service_date, v.slot,
         CASE WHEN isnan(v.v) THEN COALESCE(m.m, 'nan'::DOUBLE) ELSE v.v END AS {out}
  FROM v_{out} v, med_{out} m
)""")
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES, *parts) + f"""
SELECT i.station_id, i.service_date, i.slot, {_r6('i.in_slot_enc')} AS in_slot_enc,
       {_r6('o.out_slot_enc')} AS out_slot_enc
FROM e_in_slot_enc i JOIN e_out_slot_enc o
  ON o.station_id = i.station_id AND o.service_date = i.service_date AND o.slot = i.slot"""


def rolling_folds_sql() -> str:
    excl = ", ".join(f"DATE '{d.isoformat()}'" for d in fx.EXCLUDED_DATES)
    sel = []
    for o in fx.ORIGINS:
        od = f"DATE '{o.isoformat()}'"
        sel.append(f"""
SELECT {od} AS origin,
       COUNT(*) FILTER (WHERE service_date < {od}) AS n_train,
       COUNT(*) FILTER (WHERE service_date = {od}) AS n_valid,
       min(service_date) FILTER (WHERE service_date < {od}) AS first_train_date,
       max(service_date) FILTER (WHERE service_date < {od}) AS last_train_date
FROM mrows""")
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES, f"""
mrows AS (SELECT * FROM allf WHERE service_date <> {TARGET} AND service_date NOT IN ({excl}))""") \
        + "\nUNION ALL".join(sel)


def naive_mae_sql() -> str:
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES) + f"""
, m AS (
  SELECT service_date, avg(abs(CAST(in_nums AS DOUBLE) - in_now)) AS mae_in,
         avg(abs(CAST(out_nums AS DOUBLE) - out_now)) AS mae_out
  FROM train GROUP BY service_date
)
SELECT service_date, {_r6('mae_in')} AS mae_in, {_r6('mae_out')} AS mae_out,
       {_r6('(mae_in + mae_out) / 2')} AS score
FROM m"""


def cohort_holiday_sql() -> str:
    return _frame_sql("WHERE today_is_holiday = 1")


def roadmap_row_sql() -> str:
    cells = ", ".join(f"CAST(COALESCE(max(CASE WHEN b.n_nationkey = {s} THEN 1 END), 0) AS INTEGER) AS adj_{s}"
                      for s in range(fx.N_STATIONS))
    return with_ctes(TAPS, SLOTS) + f"""
SELECT s.station_id, s.service_date, s.slot, {cells}
FROM slots s
LEFT JOIN nation a ON a.n_nationkey = s.station_id
LEFT JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey
GROUP BY s.station_id, s.service_date, s.slot"""


def _model_rows() -> str:
    excl = ", ".join(f"DATE '{d.isoformat()}'" for d in fx.EXCLUDED_DATES)
    return f"mrows AS (SELECT * FROM train WHERE service_date NOT IN ({excl}))"


def _origin_means() -> list:
    return [f"""
m{i} AS (SELECT station_id, slot, avg(in_nums) AS mi, avg(out_nums) AS mo FROM mrows
         WHERE service_date < DATE '{o.isoformat()}' GROUP BY station_id, slot)"""
            for i, o in enumerate(fx.ORIGINS)]


def oof_matrix_sql() -> str:
    parts = [f"""
SELECT r.station_id, r.service_date, r.slot, r.in_nums, r.out_nums,
       {_r6('COALESCE(m.mi, 0.0)')} AS in_mean, {_r6('COALESCE(m.mo, 0.0)')} AS out_mean,
       CAST(r.in_now AS DOUBLE) AS in_last, CAST(r.out_now AS DOUBLE) AS out_last
FROM mrows r LEFT JOIN m{i} m ON m.station_id = r.station_id AND m.slot = r.slot
WHERE r.service_date = DATE '{o.isoformat()}'""" for i, o in enumerate(fx.ORIGINS)]
    return (with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES, _model_rows(), *_origin_means())
            + " UNION ALL ".join(parts))


def blend_submission_sql() -> str:
    n = len(fx.ORIGINS)
    joins = " ".join(f"LEFT JOIN m{i} ON m{i}.station_id = s.station_id AND m{i}.slot = s.slot" for i in range(n))

    def pred(m: str, now: str) -> str:
        mean = " + ".join(f"COALESCE(m{i}.{m}, 0.0)" for i in range(n))
        return _r6(f"0.6 * (({mean}) / {n}) + 0.4 * s.{now}")

    start = "(CAST(s.service_date AS TIMESTAMP) + to_minutes(CAST(s.slot * 10 AS BIGINT)))"
    fmt = "'%Y-%m-%d %H:%M:%S'"
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES, _model_rows(), *_origin_means()) + f"""
SELECT s.station_id AS "stationID", strftime({start}, {fmt}) AS "startTime",
       strftime({start} + INTERVAL 10 MINUTE, {fmt}) AS "endTime",
       {pred('mi', 'in_now')} AS "inNums", {pred('mo', 'out_now')} AS "outNums"
FROM score s {joins}"""


def seasonal_asof_sql() -> str:
    """Each row joined with all rows of earlier days of its group."""
    def stats(alias: str, minute: str) -> str:
        return f"""
SELECT s.station_id, s.service_date, s.slot, max(h.in_now) AS in_max, min(h.in_now) AS in_min, avg(h.in_now) AS in_mean,
       max(h.out_now) AS out_max, min(h.out_now) AS out_min, avg(h.out_now) AS out_mean, count(h.in_now) AS n
FROM nb s LEFT JOIN nb h ON h.station_id = s.station_id AND h.weekday = s.weekday AND h.hour = s.hour {minute}
     AND h.service_date < s.service_date
GROUP BY s.station_id, s.service_date, s.slot"""
    fine = [f"COALESCE(a.{side}_{f}, 0) AS {side}_whm_{f}" for side in ("in", "out") for f in ("max", "min")]
    fine += [f"{_r6(f'COALESCE(a.{side}_mean, 0)')} AS {side}_whm_mean" for side in ("in", "out")]
    return with_ctes(TAPS, SLOTS, NEIGHBORS, f"a AS ({stats('a', 'AND h.minute = s.minute')})", f"b AS ({stats('b', '')})") + f"""
SELECT a.station_id, a.service_date, a.slot, {', '.join(fine)},
       COALESCE(b.in_max, 0) AS in_wh_max, COALESCE(b.in_min, 0) AS in_wh_min,
       {_r6('COALESCE(b.in_mean, 0)')} AS in_wh_mean, {_r6('COALESCE(b.out_mean, 0)')} AS out_wh_mean,
       a.n AS whm_days, b.n AS wh_rows
FROM a JOIN b ON b.station_id = a.station_id AND b.service_date = a.service_date AND b.slot = a.slot"""


def encode_asof_sql() -> str:
    sel, parts = [], ["keys AS (SELECT DISTINCT slot, service_date FROM allf)"]
    for tgt, out in (("in_nums", "in_slot_enc"), ("out_nums", "out_slot_enc")):
        parts.append(f"""
p_{out} AS (
  SELECT k.service_date, COALESCE(avg(CAST(t.{tgt} AS DOUBLE)), 0.0) AS p
  FROM (SELECT DISTINCT service_date FROM keys) k LEFT JOIN train t ON t.service_date < k.service_date
  GROUP BY k.service_date
),
g_{out} AS (
  SELECT k.slot, k.service_date, sum(CAST(t.{tgt} AS DOUBLE)) AS s, CAST(count(t.{tgt}) AS DOUBLE) AS c
  FROM keys k LEFT JOIN train t ON t.slot = k.slot AND t.service_date < k.service_date
  GROUP BY k.slot, k.service_date
),
ab_{out} AS (
  SELECT g.slot, g.service_date, p.p, CASE WHEN g.c > 0 THEN g.s ELSE p.p END AS n,
         CASE WHEN g.c > 0 THEN g.c ELSE 1.0 END AS c
  FROM g_{out} g JOIN p_{out} p ON p.service_date = g.service_date
),
e_{out} AS (
  SELECT slot, service_date, p * greatest({fx.N_MIN} - c, 0) + n AS a,
         (1 - p) * greatest({fx.N_MIN} - c, 0) + c - n AS b FROM ab_{out}
)""")
        sel.append(f"{_r6(f'e_{out}.a / (e_{out}.a + e_{out}.b)')} AS {out}")
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES, *parts) + f"""
SELECT r.station_id, r.service_date, r.slot, {', '.join(sel)}
FROM allf r
JOIN e_in_slot_enc ON e_in_slot_enc.slot = r.slot AND e_in_slot_enc.service_date = r.service_date
JOIN e_out_slot_enc ON e_out_slot_enc.slot = r.slot AND e_out_slot_enc.service_date = r.service_date"""


def device_sketch_sql() -> str:
    return with_ctes(TAPS) + """
SELECT station_id, service_date, CAST(slot // 6 AS INTEGER) AS hour, COUNT(DISTINCT device_id) AS devices, true AS within
FROM cells GROUP BY station_id, service_date, slot // 6
UNION ALL
SELECT station_id, service_date, -1 AS hour, COUNT(DISTINCT device_id) AS devices, true AS within
FROM cells GROUP BY station_id, service_date"""


def slot_grid_history_sql() -> str:
    return with_ctes(TAPS, SLOTS) + """
, span AS (SELECT station_id, min(service_date) AS a, max(service_date) AS b FROM slots GROUP BY station_id),
days AS (SELECT station_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS service_date FROM span),
grid AS (SELECT station_id, service_date, CAST(unnest(range(0, 144)) AS INTEGER) AS slot FROM days)
SELECT g.station_id, g.service_date, g.slot, COALESCE(s.in_nums, 0) AS in_nums, COALESCE(s.out_nums, 0) AS out_nums,
       s.slot IS NOT NULL AS observed
FROM grid g LEFT JOIN slots s ON s.station_id = g.station_id AND s.service_date = g.service_date AND s.slot = g.slot"""


def blend_weights_sql() -> str:
    """The best thousandth of a lattice that narrows around the best so far."""
    parts, sel = [f"oof AS ({oof_matrix_sql()})"], []
    for side in ("in", "out"):
        err = f"avg(abs(o.{side}_nums - (c.w / 1000.0 * o.{side}_mean + (1000 - c.w) / 1000.0 * o.{side}_last)))"
        last = None
        for k, (step, reach) in enumerate(((100, None), (20, 100), (4, 20), (1, 4))):
            name = f"{side}{k}"
            cand = ("SELECT unnest(range(0, 1001, 100)) AS w" if last is None else
                    f"SELECT w + d AS w FROM {last}, (SELECT unnest(range(-{reach}, {reach + 1}, {step})) AS d) "
                    "WHERE w + d BETWEEN 0 AND 1000")
            parts.append(f"""
{name} AS (SELECT c.w, round({err}, 9) AS mae FROM ({cand}) c, oof o GROUP BY c.w ORDER BY mae, c.w LIMIT 1)""")
            last = name
        sel.append(f"SELECT '{side}_nums' AS target, CAST(w AS INTEGER) AS mean_weight, {_r6('mae')} AS mae FROM {last}")
    return with_ctes(*parts) + " UNION ALL ".join(sel)


def feature_screen_sql() -> str:
    cols = ["in_now", "out_now", "in_before1", "out_before1", "in_after1", "out_after1", "in_whm_mean", "out_whm_mean"]
    made = {}
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            made |= {f"{a}+{b}": f"{x} + {y}", f"{a}-{b}": f"{x} - {y}", f"{a}/{b}": f"{x} / nullif({y}, 0)"}
    rows = [f"SELECT '{t}' AS target, '{name}' AS feature, (SELECT round(corr({e}, {t}), 6) + 0.0 FROM train) AS corr"
            for t in ("in_nums", "out_nums") for name, e in made.items()]
    return with_ctes(TAPS, SLOTS, NEIGHBORS, NETWORK, FEAT, FRAMES.replace("train AS (", "train AS MATERIALIZED (", 1),
                     f"c AS ({' UNION ALL '.join(rows)})") + """
SELECT * FROM (
  SELECT target, feature, corr, CAST(row_number() OVER (PARTITION BY target ORDER BY abs(corr) DESC, feature) AS INTEGER) AS rank
  FROM c WHERE corr IS NOT NULL AND NOT isnan(corr))
WHERE rank <= 10"""


def all_sql() -> dict:
    out = {
        "peak_type_hourly": peak_hourly_sql(),
        "cohort_holiday": cohort_holiday_sql(),
        "degree_matrix": station_degree_sql(),
        "neighbor_flow_edges": neighbor_station_flow_sql(),
        "roadmap_row": roadmap_row_sql(),
        "oof_matrix": oof_matrix_sql(),
        "blend_submission": blend_submission_sql(),
        "slot_counts": slot_counts_sql(),
        "device_uniques": device_uniques_sql(),
        "holiday_flag": holiday_flag_sql(),
        "neighbor_slots": neighbor_slots_sql(),
        "peak_type": peak_type_sql(),
        "seasonal_stats": seasonal_stats_sql(),
        "line_size": line_size_sql(),
        "station_degree": station_degree_sql(),
        "special_flag": special_flag_sql(),
        "neighbor_station_flow": neighbor_station_flow_sql(),
        "ratio_features": ratio_features_sql(),
        "cohort_workday": cohort_workday_sql(),
        "train_frame": train_frame_sql(),
        "score_frame": score_frame_sql(),
        "rolling_folds": rolling_folds_sql(),
        "naive_mae": naive_mae_sql(),
    }
    for stat in ("mean", "mode", "median", "var", "skewness", "kurtosis", "prior"):
        out[f"encode_{stat}"] = encode_sql(stat)
    # Fine groups, no pseudo-counts: infinities and NaN repair on real rows.
    out["encode_mode_station_slot"] = out["encode_mode_counted"] = encode_sql("mode", FINE_GROUP_SQL, 1.0)
    out |= {
        "seasonal_asof": seasonal_asof_sql(),
        "encode_asof": encode_asof_sql(),
        "device_sketch": device_sketch_sql(),
        "slot_grid_history": slot_grid_history_sql(),
        "blend_weights": blend_weights_sql(),
        "feature_screen": feature_screen_sql(),
        "slots_by_ledger": slot_counts_sql(),
    }
    return out


FINE_GROUP_SQL = "station_id * 1000 + slot"
