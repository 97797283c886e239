"""The same queries in plain SQL, written independently of the operators, for cross-checking."""

from __future__ import annotations

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (sql, needs)


def _with(body: str, *needs: str, **instead: str) -> str:
    """``body`` after the tables it needs; ``instead`` gives other definitions of some of them."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dependency in CTE[name][1]:
                visit(dependency)
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({instead.get(n, CTE[n][0])})" for n in ordered) + "\n" + body


ACTIVITIES = "smsin, smsout, callin, callout, internet"
EVENTS_OF = {"smsin": "view", "smsout": "click", "callin": "signup", "callout": "purchase", "internet": "error"}
SUMS = ", ".join(
    f"sum(CASE WHEN event_type = '{event}' THEN round(value * 100) END) AS {activity}"
    for activity, event in EVENTS_OF.items()
)
ZEROED = ", ".join(f"coalesce(sum({a}), 0)::DOUBLE AS {a}" for a in EVENTS_OF)
ROUTINE, ANOMALOUS = "'ROUTINE'", "'ANOMALOUS'"


def _lerp(low: str, high: str, part: str) -> str:
    return (
        f"CASE WHEN {part} >= 0.5 THEN {high} - ({high} - {low}) * (1 - {part}) "
        f"ELSE {low} + ({high} - {low}) * {part} END"
    )


def _quantile(source: str, keys: str, value: str, fraction: str) -> str:
    """Interpolated quantile per group by ranking; ``fraction`` may use per-group columns n, mu, mx."""
    return f"""
    SELECT {keys}, {_lerp('v_low', 'v_high', 'part')} AS q FROM (
      SELECT {keys}, max(CASE WHEN rn = floor(pos) THEN v END) AS v_low,
             max(CASE WHEN rn = ceil(pos) THEN v END) AS v_high, max(pos - floor(pos)) AS part
      FROM (SELECT *, ({fraction}) * (n - 1) AS pos FROM (
        SELECT {keys}, {value} AS v,
               row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS rn,
               count(*) OVER (PARTITION BY {keys}) AS n,
               avg({value}) OVER (PARTITION BY {keys}) AS mu,
               max({value}) OVER (PARTITION BY {keys}) AS mx
        FROM {source}))
      GROUP BY {keys})"""


F_STAR = "CASE WHEN mx = 0 OR mu = mx THEN 1.0::DOUBLE ELSE least(greatest(1.0::DOUBLE - mu / mx, 0), 1) END"

_cte("raw", f"""
    SELECT date_trunc('hour', ts) AS datetime, user_id % 25 + 1 AS "CellID",
           CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS countrycode, {SUMS},
           strftime(date_trunc('hour', ts), '%Y-%m-%d') AS _source_file
    FROM events GROUP BY ALL""")
_cte("collapsed", f'SELECT "CellID", datetime, _source_file, {ZEROED} FROM raw GROUP BY ALL', "raw")
_cte("panel", "SELECT *, smsin + smsout + callin + callout + internet AS total_activity FROM collapsed", "collapsed")
_cte("th", _quantile("panel", '"CellID"', "total_activity", "0.9::DOUBLE"), "panel")
_cte("flags", """
    SELECT p.*, q AS congestion_threshold, total_activity > q AS is_congestion_risk
    FROM panel p LEFT JOIN th USING ("CellID")""", "panel", "th")
_cte("offsets", """
    SELECT row_number() OVER (ORDER BY dx, dy) - 1 AS pos, dx, dy
    FROM (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b WHERE dx <> 0 OR dy <> 0""")
_cte("nb", """
    SELECT cell, pos, cell + dx + 5 * dy AS neighbor FROM (SELECT unnest(range(1, 26)) AS cell) c, offsets
    WHERE (cell - 1) % 5 + dx BETWEEN 0 AND 4 AND (cell - 1) // 5 + dy BETWEEN 0 AND 4""", "offsets")
_cte("nb_n", "SELECT cell, count(*) AS total FROM nb GROUP BY cell", "nb")
SERIES = 'OVER (PARTITION BY "CellID" ORDER BY datetime, _source_file)'
_cte("risk", "SELECT *, " + ", ".join(
    f"lag(total_activity, {24 - h}) {SERIES} AS naive_forecast_{h}h, "
    f"datetime + INTERVAL {h} HOUR AS target_datetime_{h}h" for h in (1, 2, 3, 4)
) + " FROM flags", "flags")


def _diagnosis(h: int, holidays: str) -> None:
    _cte(f"risky{h}", f"""
        SELECT *, date_trunc('hour', target_datetime_{h}h) AS target_hour_key FROM risk
        WHERE naive_forecast_{h}h > congestion_threshold""", "risk")
    _cte(f"counted{h}", f"""
        SELECT r.*, total, (
          SELECT count(DISTINCT o."CellID") FROM nb JOIN risky{h} o
            ON o."CellID" = nb.neighbor WHERE nb.cell = r."CellID" AND o.target_hour_key = r.target_hour_key) AS hits,
          CAST(target_datetime_{h}h AS DATE) IN ({holidays}) AS on_target,
          CAST(target_datetime_{h}h - INTERVAL 24 HOUR AS DATE) IN ({holidays}) AS on_source
        FROM risky{h} r JOIN nb_n ON nb_n.cell = r."CellID" """, f"risky{h}", "nb", "nb_n")
    _cte(f"diag{h}", f"""
        SELECT *, CASE WHEN on_target OR hits / total >= 0.3 THEN 'ROUTINE' ELSE 'ANOMALOUS' END AS classification,
          CASE WHEN on_target THEN 'target date is a known holiday'
               WHEN hits / total >= 0.3 THEN hits || '/' || total || ' neighbors also at risk'
               WHEN on_source THEN 'isolated, AND forecast is based on a holiday — basis may be unreliable'
               ELSE 'isolated — only ' || hits || '/' || total || ' neighbors at risk' END AS reason
        FROM counted{h}""", f"counted{h}")


for _h in (1, 2, 3, 4):
    _diagnosis(_h, "DATE '2024-01-01', DATE '2024-01-06'")

_cte("cases", f"""
    SELECT "CellID", target_datetime_1h AS target_datetime,
           greatest(naive_forecast_1h - congestion_threshold, 0) AS deficit
    FROM diag1 WHERE classification = {ROUTINE}""", "diag1")
_cte("capacity", """
    SELECT "CellID", target_datetime_1h AS target_datetime, naive_forecast_1h AS forecast,
           greatest(naive_forecast_1h - congestion_threshold, 0) AS deficit,
           greatest(congestion_threshold - naive_forecast_1h, 0) AS spare
    FROM risk WHERE naive_forecast_1h IS NOT NULL""", "risk")
_cte("edges", """
    SELECT c.target_datetime, c."CellID" AS congested_cell, c.deficit, pos, neighbor AS source_cell, k.spare
    FROM cases c JOIN nb ON nb.cell = c."CellID"
    JOIN capacity k ON k."CellID" = neighbor AND k.target_datetime = c.target_datetime AND k.spare > 0""",
    "cases", "nb", "capacity")
# Largest total of an hour, by the cut theorem: the least, over all sets of cases, of the
# deficits outside the set plus the spare of every source next to the set.
_cte("numbered", """
    SELECT *, row_number() OVER (PARTITION BY target_datetime ORDER BY "CellID") - 1 AS bit,
           count(*) OVER (PARTITION BY target_datetime) AS n_cases FROM cases""", "cases")
_cte("masks", """
    SELECT target_datetime, unnest(range(CAST(pow(2, n) AS BIGINT))) AS mask
    FROM (SELECT target_datetime, count(*) AS n FROM cases GROUP BY 1)""", "cases")
_cte("outside", """
    SELECT m.target_datetime, mask, coalesce(sum(CASE WHEN (mask >> bit) & 1 = 0 THEN deficit END), 0) AS capacity
    FROM masks m JOIN numbered n ON n.target_datetime = m.target_datetime GROUP BY 1, 2""", "masks", "numbered")
_cte("adjacent", """
    SELECT target_datetime, mask, sum(spare) AS capacity FROM (
      SELECT DISTINCT m.target_datetime, mask, source_cell, spare
      FROM masks m JOIN numbered n ON n.target_datetime = m.target_datetime AND (mask >> bit) & 1 = 1
      JOIN edges e ON e.target_datetime = n.target_datetime AND e.congested_cell = n."CellID")
    GROUP BY 1, 2""", "masks", "numbered", "edges")
_cte("optimum", """
    SELECT target_datetime, min(o.capacity + coalesce(a.capacity, 0)) AS covered
    FROM outside o LEFT JOIN adjacent a USING (target_datetime, mask) GROUP BY 1""", "outside", "adjacent")
_cte("hourly", """
    SELECT target_datetime, count(*) AS n_cases, sum(deficit) AS deficit, any_value(covered) AS covered
    FROM cases JOIN optimum USING (target_datetime) GROUP BY 1""", "cases", "optimum")

_cte("moves", """
    SELECT target_datetime, congested_cell, source_cell, pos, least(deficit / 10, spare / 10) AS amount_moved
    FROM edges""", "edges")
_cte("covered", """
    SELECT c."CellID", c.target_datetime, deficit, coalesce(sum(amount_moved), 0) AS covered,
           coalesce(sum(amount_moved), 0) >= deficit - 1e-6 AS fully_resolved
    FROM cases c LEFT JOIN moves m ON m.congested_cell = c."CellID" AND m.target_datetime = c.target_datetime
    GROUP BY 1, 2, 3""", "cases", "moves")
_cte("case_rows", """
    SELECT row_number() OVER (ORDER BY d."CellID", target_datetime_1h) AS id, d."CellID" AS cell_id,
           target_datetime_1h AS target_datetime, naive_forecast_1h AS naive_forecast, congestion_threshold,
           classification, reason, deficit, covered, fully_resolved
    FROM diag1 d LEFT JOIN covered c ON c."CellID" = d."CellID" AND c.target_datetime = target_datetime_1h""",
    "diag1", "covered")
_cte("source_rows", """
    SELECT row_number() OVER (ORDER BY m.target_datetime, congested_cell, pos) AS id, c.id AS case_id,
           source_cell AS source_cell_id, amount_moved, pos
    FROM moves m JOIN case_rows c ON c.cell_id = congested_cell AND c.target_datetime = m.target_datetime""",
    "moves", "case_rows")
_cte("texts", """
    SELECT c.id AS case_id, c.classification, CASE WHEN classification = 'ROUTINE' THEN
      '[MOCK] Cell ' || cell_id || ' is forecasted to exceed its normal traffic threshold at '
      || strftime(target_datetime, '%Y-%m-%d %H:%M:%S') || ' (' || reason || '). Recommended action: '
      || coalesce(listed, 'no reallocation possible — insufficient nearby spare capacity') || '. This covers '
      || printf('%.0f', coalesce(covered / nullif(deficit, 0) * 100, 0)) || '% of the predicted deficit. '
      || 'Classified ROUTINE — safe for automatic handling, logged for audit.'
    ELSE
      '[MOCK] Cell ' || cell_id || ' is forecasted to exceed its normal traffic threshold at '
      || strftime(target_datetime, '%Y-%m-%d %H:%M:%S')
      || ', but this does not match a routine, explainable pattern (' || reason
      || '). No automatic reallocation was attempted. '
      || 'ESCALATED — recommend manual investigation before any action is taken.' END AS report_text
    FROM case_rows c LEFT JOIN (
      SELECT case_id, string_agg(printf('%.1f', amount_moved) || ' units from Cell ' || source_cell_id, ', ' ORDER BY pos) AS listed
      FROM source_rows GROUP BY 1) s ON s.case_id = c.id""", "case_rows", "source_rows")
_cte("reports", """
    SELECT row_number() OVER (ORDER BY case_id) AS id, case_id, report_text,
           TIMESTAMP '2024-02-01 00:00:00' AS generated_at
    FROM texts WHERE classification = 'ROUTINE'""", "texts")
_cte("listing", """
    SELECT c.*, r.id IS NOT NULL AS has_report FROM case_rows c LEFT JOIN reports r ON r.case_id = c.id""",
    "case_rows", "reports")

_cte("averaged", """
    SELECT p.*, (SELECT avg(o.total_activity) FROM nb JOIN panel o ON o."CellID" = nb.neighbor
                 WHERE nb.cell = p."CellID" AND o.datetime = p.datetime) AS neighbor_avg_activity
    FROM panel p""", "panel", "nb")
_FEATURES = [f"lag(total_activity, {k}) {SERIES} AS lag_{k}h" for k in (1, 2, 3, 24)]
_FEATURES += [f"lead(total_activity, {h}) {SERIES} AS target_{h}h" for h in (1, 2, 3, 4)]
_FEATURES += [f"lag(total_activity, {24 - h}) {SERIES} AS baseline_{h}h" for h in (1, 2, 3, 4)]
_cte("features", f"""
    SELECT *, lag(neighbor_avg_activity, 1) {SERIES} AS neighbor_avg_lag1h, {', '.join(_FEATURES)},
           CAST(hour(datetime) AS INTEGER) AS hour_of_day, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
           CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend
    FROM averaged""", "averaged")
_COMPLETE = " AND ".join(
    f"{c} IS NOT NULL" for c in
    [f"lag_{k}h" for k in (1, 2, 3, 24)] + ["neighbor_avg_lag1h"]
    + [f"{p}_{h}h" for p in ("target", "baseline") for h in (1, 2, 3, 4)]
)
_cte("matrix", f"SELECT * FROM features WHERE {_COMPLETE}", "features")
_cte("cut", "SELECT min(datetime) + INTERVAL 5 DAY AS cutoff FROM matrix", "matrix")
_cte("train_mean", 'SELECT "CellID", avg(total_activity) AS m FROM matrix, cut WHERE datetime < cutoff GROUP BY 1', "matrix", "cut")
_cte("parts", """
    SELECT CASE WHEN datetime < cutoff THEN 'train' ELSE 'test' END AS part, x.*,
           coalesce(m, (SELECT avg(total_activity) FROM matrix, cut WHERE datetime < cutoff)) AS cell_historical_mean
    FROM matrix x LEFT JOIN train_mean USING ("CellID"), cut""", "matrix", "train_mean", "cut")
_cte("errors", " UNION ALL ".join(
    f"""SELECT {h} AS horizon, cell_historical_mean, abs(target_{h}h - baseline_{h}h) AS e,
        abs(greatest(target_{h}h, 1) - greatest(baseline_{h}h, 1)) / greatest(target_{h}h, 1) AS r
        FROM parts WHERE part = 'test'""" for h in (1, 2, 3, 4)), "parts")
_cte("hot", "SELECT quantile_cont(cell_historical_mean, 0.98) AS bar FROM parts WHERE part = 'test'", "parts")

_MEANS = """CAST(3 AS BIGINT) AS u, CAST(13 AS BIGINT) AS n, CAST(23 AS BIGINT) AS c"""


def _mean_to_max(keys: str) -> str:
    return f"""
    SELECT "CellID", datetime, total_activity, round(q, 6) AS loubar_threshold, round(f, 9) AS loubar_f_star,
           total_activity > q AS is_congestion_risk
    FROM panel JOIN ({_quantile('panel', keys, 'total_activity', f'({F_STAR}) * 100 / 100')}) USING ({keys})
    JOIN (SELECT {keys}, {F_STAR} AS f FROM (
      SELECT {keys}, avg(total_activity) AS mu, max(total_activity) AS mx FROM panel GROUP BY {keys})) USING ({keys})"""


def _lags(frame: str) -> str:
    return f"""SELECT "CellID", datetime, lag(total_activity, 1) {frame} AS lag_1h, lag(total_activity, 24) {frame} AS lag_24h,
      lead(total_activity, 1) {frame} AS target_1h, lead(total_activity, 4) {frame} AS target_4h,
      lag(total_activity, 23) {frame} AS baseline_1h FROM panel"""


_LISTED = """id, cell_id, target_datetime, classification, naive_forecast, congestion_threshold,
    round(deficit, 3) AS deficit, round(covered, 3) AS covered, fully_resolved, has_report"""
_RISK_COLUMNS = ", ".join(
    f"naive_forecast_{h}h, coalesce(naive_forecast_{h}h > congestion_threshold, false) AS predicted_risk_{h}h, "
    f"target_datetime_{h}h" for h in (1, 2, 3, 4)
)

ORACLES: dict[str, str] = {
    "country_code_collapse": _with("SELECT * FROM collapsed", "collapsed"),
    "daily_union": _with("SELECT * FROM collapsed", "collapsed"),
    "collapse_counts_per_file": _with("""
        SELECT _source_file, count(*) AS raw_rows, count(DISTINCT ("CellID", datetime)) AS collapsed_rows
        FROM raw GROUP BY 1""", "raw"),
    "numeric_coercion": """
        SELECT event_type, count(*) AS n_texts, count(TRY_CAST(trim(piece) AS DOUBLE)) AS n_numbers,
               coalesce(sum(TRY_CAST(trim(piece) AS DOUBLE)), 0) AS total
        FROM (SELECT event_type, unnest(string_split(regexp_extract(props, '[{](.*)[}]', 1), ':')) AS piece FROM events)
        GROUP BY 1""",
    "normalised_times": "SELECT event_id, date_trunc('millisecond', ts) AS from_ms, ts AS from_text FROM events",
    "missing_value_profile": _with(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS missing FROM raw"""
            for c in ["datetime", "CellID", "countrycode", *EVENTS_OF, "_source_file"]
        ), "raw"),
    "load_overview": _with("""
        SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns, min(datetime) AS first_time,
               max(datetime) AS last_time, count(DISTINCT "CellID") AS n_cells FROM collapsed""", "collapsed"),
    "sampling_step": _with("""
        SELECT epoch(t - before)::DOUBLE AS step_seconds, count(*) AS n FROM (
          SELECT t, lag(t) OVER (ORDER BY t) AS before FROM (SELECT DISTINCT datetime AS t FROM collapsed))
        WHERE before IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""", "collapsed"),
    "first_rows": _with('SELECT * FROM collapsed ORDER BY "CellID", datetime, _source_file LIMIT 10', "collapsed"),
    "total_activity": _with('SELECT "CellID", datetime, total_activity FROM panel', "panel"),
    "calendar_parts": _with("""
        SELECT "CellID", datetime, CAST(hour(datetime) AS INTEGER) AS hour_of_day,
               CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week, CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend
        FROM collapsed""", "collapsed"),
    "grid_positions": """
        SELECT p_partkey, x, y, (y - 1) * 100 + x AS again,
               (CASE WHEN x IN (1, 100) THEN 2 ELSE 3 END) * (CASE WHEN y IN (1, 100) THEN 2 ELSE 3 END) - 1::BIGINT AS n_neighbors
        FROM (SELECT p_partkey, p_partkey % 100 + 1 AS x, p_partkey // 100 % 100 + 1 AS y FROM part)""",
    "grid_neighbors": _with("""
        SELECT p_partkey, cell, CAST(pos AS INTEGER) AS pos, CAST(cell + dx + 100 * dy AS BIGINT) AS neighbor
        FROM (SELECT p_partkey, p_partkey % 10000 + 1 AS cell FROM part), offsets
        WHERE (cell - 1) % 100 + dx BETWEEN 0 AND 99 AND (cell - 1) // 100 + dy BETWEEN 0 AND 99""", "offsets"),
    "target_times": _with("""
        SELECT "CellID", datetime, datetime + INTERVAL 3 HOUR AS target, datetime + INTERVAL 3 HOUR AS target_hour,
               strftime(datetime - INTERVAL 21 HOUR, '%Y-%m-%d') AS source_date FROM collapsed""", "collapsed"),
    "hour_band_activity": _with("""
        SELECT "CellID", CASE WHEN hour(datetime) >= 18 THEN 'evening' ELSE 'daytime' END AS band, count(*) AS n,
               sum(internet) AS internet FROM collapsed WHERE hour(datetime) >= 6 GROUP BY 1, 2""", "collapsed"),
    "log_scale_round_trip": _with("""
        SELECT "CellID", datetime, round(ln(1 + total_activity), 9) AS logged, round(total_activity, 3) AS back,
               round(greatest(exp(ln(1 + total_activity) - 8) - 1, 0), 3) AS shifted_back,
               greatest(internet, 1) AS clipped FROM panel""", "panel"),
    "supply_shortfall": """
        SELECT l_orderkey, sum(greatest(l_quantity - 25, 0)) AS shortfall, sum(greatest(l_quantity - 25, 0)) AS pair_shortfall,
               count(*) FILTER (l_tax > 0.04::DOUBLE) AS n_tax_short FROM lineitem GROUP BY 1""",
    "residual_status": _with("""
        SELECT "CellID", CASE WHEN abs(total_activity - naive_forecast_1h) <= congestion_threshold / 10 THEN 'ok'
               ELSE 'deviation' END AS status, count(*) AS n FROM risk WHERE naive_forecast_1h IS NOT NULL GROUP BY 1, 2""",
        "risk"),
    "percentile_thresholds": _with('SELECT "CellID", q AS congestion_threshold FROM th', "th"),
    "percentile_thresholds_as_of": _with(f"""
        SELECT "CellID", q AS congestion_threshold FROM ({_quantile(
            "(SELECT * FROM panel WHERE datetime < TIMESTAMP '2024-01-15 00:00:00')", '"CellID"', "total_activity",
            "0.75::DOUBLE")})""", "panel"),
    "congestion_flags": _with(
        'SELECT "CellID", datetime, total_activity, congestion_threshold, is_congestion_risk FROM flags', "flags"),
    "order_price_quantiles": f"""
        SELECT l_returnflag, l_linestatus, q AS quantile FROM ({_quantile(
            "lineitem", "l_returnflag, l_linestatus", "l_extendedprice", "0.9::DOUBLE")})""",
    "mean_to_max_flags": _with(_mean_to_max('"CellID"'), "panel"),
    "spatial_hotspots": _with(_mean_to_max("datetime"), "panel"),
    "f_star_distribution": _with(f"""
        SELECT count(f) AS count, round(avg(f), 9) AS mean, round(stddev_samp(f), 9) AS std, round(min(f), 9) AS min,
               round(quantile_cont(f, 0.25), 9) AS p25, round(quantile_cont(f, 0.5), 9) AS p50,
               round(quantile_cont(f, 0.75), 9) AS p75, round(max(f), 9) AS max
        FROM (SELECT {F_STAR} AS f FROM (SELECT avg(total_activity) AS mu, max(total_activity) AS mx FROM panel GROUP BY "CellID"))""",
        "panel"),
    "one_row_per_cell": _with('SELECT DISTINCT "CellID", congestion_threshold FROM flags', "flags"),
    "flag_rate": _with("""
        SELECT count(DISTINCT "CellID") AS n_cells, round(avg(CAST(is_congestion_risk AS INTEGER)) * 100, 6) AS flagged_pct
        FROM flags""", "flags"),
    "watched_flag_rates": _with("""
        SELECT "CellID", max(congestion_threshold) AS congestion_threshold,
               round(avg(CAST(is_congestion_risk AS INTEGER)) * 100, 6) AS flagged_pct,
               CASE "CellID" WHEN 3 THEN 'north' WHEN 13 THEN 'centre' ELSE 'south' END AS place
        FROM flags WHERE "CellID" IN (3, 13, 23) GROUP BY "CellID" """, "flags"),
    "known_pattern_report": _with("""
        SELECT 'weekend_lower' AS "check", CAST(3 AS BIGINT) AS cell, round(a, 6) AS a, round(b, 6) AS b,
               CASE WHEN n = 0 THEN 'NO ROWS' WHEN b < a THEN 'PASS' ELSE 'UNEXPECTED' END AS status
        FROM (SELECT count(*) AS n, avg(total_activity) FILTER (isodow(datetime) < 6) AS a,
                     avg(total_activity) FILTER (isodow(datetime) >= 6) AS b FROM panel WHERE "CellID" = 3)
        UNION ALL
        SELECT 'evening_higher', 13, round(a, 6), round(b, 6),
               CASE WHEN n = 0 THEN 'NO ROWS' WHEN b > a THEN 'PASS' ELSE 'UNEXPECTED' END
        FROM (SELECT count(*) AS n, avg(internet) FILTER (hour(datetime) BETWEEN 6 AND 17) AS a,
                     avg(internet) FILTER (hour(datetime) BETWEEN 18 AND 23) AS b FROM panel WHERE "CellID" = 13)
        UNION ALL
        SELECT 'centre_high', 23, round(a, 6), CASE WHEN a IS NOT NULL THEN round(b, 6) END,
               CASE WHEN a IS NULL THEN 'NO ROWS' WHEN b >= 90 THEN 'PASS' ELSE 'WEAKER THAN EXPECTED' END
        FROM (SELECT max(CASE WHEN "CellID" = 23 THEN m END) AS a,
                     avg(CASE WHEN m < (SELECT avg(total_activity) FROM panel WHERE "CellID" = 23) THEN 1 ELSE 0 END) * 100 AS b
              FROM (SELECT "CellID", avg(total_activity) AS m FROM panel GROUP BY 1))""", "panel"),
    "cell_percentile_ranks": _with("""
        SELECT CASE w."CellID" WHEN 3 THEN 'north' WHEN 13 THEN 'centre' ELSE 'south' END AS place, w."CellID" AS cell,
               round(w.m, 6) AS mean_value,
               round((SELECT avg(CASE WHEN o.m < w.m THEN 1 ELSE 0 END) * 100 FROM
                  (SELECT "CellID", avg(total_activity) AS m FROM panel GROUP BY 1) o), 6) AS percentile,
               (SELECT count(DISTINCT "CellID") FROM panel) AS n_cells
        FROM (SELECT "CellID", avg(total_activity) AS m FROM panel GROUP BY 1) w WHERE w."CellID" IN (3, 13, 23)""", "panel"),
    "cell_lags": _with(_lags(SERIES), "panel"),
    "long_series_lags": _with(_lags(SERIES), "panel"),
    "clock_hour_lags": _with("""
        SELECT p."CellID", p.datetime, a.total_activity AS lag_1h, b.total_activity AS lag_24h,
               c.total_activity AS target_1h, d.total_activity AS target_4h, e.total_activity AS baseline_1h
        FROM panel p
        LEFT JOIN panel a ON a."CellID" = p."CellID" AND a.datetime = p.datetime - INTERVAL 1 HOUR
        LEFT JOIN panel b ON b."CellID" = p."CellID" AND b.datetime = p.datetime - INTERVAL 24 HOUR
        LEFT JOIN panel c ON c."CellID" = p."CellID" AND c.datetime = p.datetime + INTERVAL 1 HOUR
        LEFT JOIN panel d ON d."CellID" = p."CellID" AND d.datetime = p.datetime + INTERVAL 4 HOUR
        LEFT JOIN panel e ON e."CellID" = p."CellID" AND e.datetime = p.datetime - INTERVAL 23 HOUR""", "panel"),
    "whole_frame_lags": _with("""
        SELECT "CellID", datetime, CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
               CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend,
               lag(total_activity, 1) OVER w AS total_activity_lag_1, lag(total_activity, 24) OVER w AS total_activity_lag_24,
               lag(total_activity, 168) OVER w AS total_activity_lag_168
        FROM panel WINDOW w AS (ORDER BY datetime, "CellID", _source_file)""", "panel"),
    "supplier_line_lags": """
        SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice,
               CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week, CAST(isodow(l_shipdate) >= 6 AS INTEGER) AS is_weekend,
               lag(l_extendedprice, 1) OVER w AS l_extendedprice_lag_1, lag(l_extendedprice, 7) OVER w AS l_extendedprice_lag_7
        FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)""",
    "one_value_per_cell_time": _with("""
        SELECT "CellID", datetime, arg_min(total_activity, _source_file) AS total_activity FROM panel GROUP BY 1, 2""", "panel"),
    "neighbor_average": _with("""
        SELECT "CellID", datetime, round(neighbor_avg_activity, 6) AS neighbor_avg_activity FROM averaged""", "averaged"),
    "forecast_features": _with("""
        SELECT "CellID", datetime, lag_1h, lag_2h, lag_3h, lag_24h, hour_of_day, day_of_week, is_weekend,
               target_1h, target_2h, target_3h, target_4h, baseline_1h, baseline_2h, baseline_3h, baseline_4h,
               round(neighbor_avg_lag1h, 6) AS neighbor_avg_lag1h FROM matrix""", "matrix"),
    "dropped_feature_rows": _with("""
        SELECT a AS n_rows, a - b AS n_dropped, round((a - b) / a, 9) AS dropped_share
        FROM (SELECT (SELECT count(*) FROM features) AS a, (SELECT count(*) FROM matrix) AS b)""", "matrix"),
    "chronological_split": _with("""
        SELECT part, "CellID", count(*) AS n, min(datetime) AS first_time, max(datetime) AS last_time,
               round(max(cell_historical_mean), 6) AS cell_mean FROM parts GROUP BY 1, 2""", "parts"),
    "baseline_error_metrics": _with("""
        SELECT CAST(horizon AS INTEGER) AS horizon, stratum, count(*) AS n, round(avg(e), 6) AS mae_base, round(avg(r), 6) AS mape_base FROM (
          SELECT horizon, CASE WHEN cell_historical_mean >= bar THEN 'Hotspot cells (top 2%)' ELSE 'Typical cells' END AS stratum, e, r
          FROM errors, hot UNION ALL SELECT horizon, 'All cells', e, r FROM errors) GROUP BY 1, 2""", "errors", "hot"),
    "external_model_scores": _with("""
        SELECT "CellID", datetime, lag_1h, lag_24h, (lag_1h + lag_24h) / 2 AS prediction FROM matrix""", "matrix"),
    "predicted_risk": _with(f'SELECT "CellID", datetime, {_RISK_COLUMNS} FROM risk', "risk"),
    "predicted_risk_by_horizon": _with(" UNION ALL ".join(
        f"""SELECT "CellID", datetime, {h}::INTEGER AS horizon, naive_forecast_{h}h AS forecast,
            naive_forecast_{h}h > congestion_threshold AS predicted_risk, target_datetime_{h}h AS target_datetime
            FROM risk WHERE naive_forecast_{h}h IS NOT NULL""" for h in (1, 2, 3, 4)), "risk"),
    "at_risk_cells_per_hour": _with('SELECT DISTINCT target_hour_key, "CellID" FROM risky1', "risky1"),
    "neighbor_risk_counts": _with(
        'SELECT "CellID", target_hour_key, hits AS neighbors_at_risk, total AS n_neighbors FROM counted1', "counted1"),
    "diagnosis": _with("""
        SELECT "CellID", datetime, naive_forecast_1h, congestion_threshold, target_datetime_1h, target_hour_key,
               classification, reason FROM diag1""", "diag1"),
    "diagnosis_all_horizons": _with(" UNION ALL ".join(
        f"""SELECT "CellID", {h}::INTEGER AS horizon, target_datetime_{h}h AS target_datetime, naive_forecast_{h}h AS naive_forecast,
            congestion_threshold, classification, reason FROM diag{h}""" for h in (1, 2, 3, 4)),
        "diag1", "diag2", "diag3", "diag4"),
    "class_shares": _with("""
        SELECT classification, count(*) AS n, round(count(*) / (SELECT count(*) FROM diag1), 9) AS share,
               round((SELECT count(*) FROM diag1) / (SELECT count(*) FROM risk), 9) AS flagged_share FROM diag1 GROUP BY 1""",
        "diag1"),
    "routine_cases": _with('SELECT "CellID", target_datetime, round(deficit, 6) AS deficit FROM cases', "cases"),
    "capacities": _with("""
        SELECT "CellID", target_datetime, forecast, round(deficit, 6) AS deficit, round(spare, 6) AS spare FROM capacity""", "capacity"),
    "candidate_edges": _with("""
        SELECT target_datetime, congested_cell, round(deficit, 6) AS deficit, CAST(pos AS INTEGER) AS pos, source_cell,
               round(spare, 6) AS spare FROM edges""", "edges"),
    "coverage_per_hour": _with("""
        SELECT target_datetime, n_cases, round(deficit, 3) AS deficit, round(covered, 3) AS covered FROM hourly""", "hourly"),
    "coverage_totals": _with("""
        SELECT CAST(coalesce(sum(n_cases), 0) AS BIGINT) AS n_cases, count(*) AS n_hours,
               round(coalesce(sum(deficit), 0), 3) AS total_deficit, round(coalesce(sum(covered), 0), 3) AS total_covered,
               round(sum(covered) / sum(deficit), 6) AS coverage_rate FROM hourly""", "hourly"),
    "plan_violations": _with("""
        SELECT DISTINCT target_datetime, CAST(0 AS BIGINT) AS cases_overdrawn, CAST(0 AS BIGINT) AS sources_overdrawn,
               CAST(0 AS DOUBLE) AS gap FROM edges""", "edges"),
    "coverage_of_even_plan": _with("""
        SELECT "CellID", target_datetime, round(deficit, 3) AS deficit, round(covered, 3) AS covered, fully_resolved FROM covered""",
        "covered"),
    "hours_with_routine_cases": _with("SELECT DISTINCT target_datetime FROM cases ORDER BY 1", "cases"),
    "assembled_cases": _with("""
        SELECT cell_id AS "CellID", target_datetime, classification, round(deficit, 3) AS deficit, round(covered, 3) AS covered,
               fully_resolved, coalesce(listed, '') AS sources
        FROM case_rows c LEFT JOIN (SELECT case_id, string_agg(source_cell_id || ':' || printf('%.1f', amount_moved), '|' ORDER BY pos) AS listed
                                    FROM source_rows GROUP BY 1) s ON s.case_id = c.id""", "case_rows", "source_rows"),
    "case_reports": _with("""
        SELECT cell_id AS "CellID", target_datetime, c.classification, report_text AS report
        FROM case_rows c JOIN texts t ON t.case_id = c.id""", "case_rows", "texts"),
    "first_cases_per_class": _with("""
        SELECT "CellID", target_datetime_1h AS target_datetime, classification, reason FROM (
          SELECT *, row_number() OVER (PARTITION BY classification ORDER BY "CellID", target_datetime_1h) AS rn FROM diag1)
        WHERE rn <= 3""", "diag1"),
    "case_table": _with("""
        SELECT id, cell_id, target_datetime, naive_forecast, congestion_threshold, classification, reason,
               round(deficit, 3) AS deficit, round(covered, 3) AS covered, fully_resolved FROM case_rows""", "case_rows"),
    "source_table": _with(
        "SELECT id, case_id, source_cell_id, round(amount_moved, 3) AS amount_moved FROM source_rows", "source_rows"),
    "report_upsert": _with("""
        SELECT coalesce(r.id, (SELECT count(*) FROM reports) + row_number() OVER (PARTITION BY r.id IS NULL ORDER BY t.case_id)) AS id,
               t.case_id, t.report_text, coalesce(generated_at, TIMESTAMP '2024-03-01 00:00:00') AS generated_at
        FROM texts t LEFT JOIN reports r ON r.case_id = t.case_id""", "texts", "reports"),
    "listed_cases": _with(f"SELECT {_LISTED} FROM listing ORDER BY listing.target_datetime, listing.id LIMIT 50", "listing"),
    "listed_routine_cases": _with(
        f"SELECT {_LISTED} FROM listing WHERE classification = {ROUTINE} ORDER BY listing.target_datetime, listing.id LIMIT 20", "listing"),
    "displayed_cases": _with("""
        SELECT cell_id AS "Cell", strftime(target_datetime, '%Y-%m-%d %H:%M:%S') AS "Target Time", classification AS "Classification",
               CAST(printf('%.1f', naive_forecast) AS DOUBLE) AS "Forecast", CAST(printf('%.1f', congestion_threshold) AS DOUBLE) AS "Threshold",
               CASE WHEN deficit IS NOT NULL THEN CAST(printf('%.1f', coalesce(deficit, 0)) AS DOUBLE) END AS "Deficit",
               CASE WHEN covered IS NOT NULL THEN CAST(printf('%.1f', coalesce(covered, 0)) AS DOUBLE) END AS "Covered",
               CASE WHEN fully_resolved THEN 'Yes' WHEN NOT fully_resolved THEN 'No' END AS "Fully Resolved?",
               CASE WHEN has_report THEN 'Yes' ELSE 'No' END AS "Report?",
               'Cell ' || cell_id || ' @ ' || strftime(target_datetime, '%Y-%m-%d %H:%M:%S') || ' (id ' || id || ')' AS label
        FROM (SELECT * FROM listing ORDER BY target_datetime, id LIMIT 100)""", "listing"),
    "case_details": _with("""
        SELECT c.id, cell_id, target_datetime, reason, coalesce(listed, '') AS source_cells, report_text, generated_at
        FROM case_rows c LEFT JOIN (SELECT case_id, string_agg(source_cell_id::VARCHAR, ',' ORDER BY id) AS listed
                                    FROM source_rows GROUP BY 1) s ON s.case_id = c.id
        LEFT JOIN reports r ON r.case_id = c.id""", "case_rows", "source_rows", "reports"),
    "single_case": _with("""
        SELECT id, cell_id, target_datetime, classification, reason,
               CAST((SELECT count(*) FROM source_rows s WHERE s.case_id = 1) AS INTEGER) AS n_sources, has_report
        FROM listing WHERE id = 1""", "listing", "source_rows"),
    "listed_reports": _with("""
        SELECT case_id, cell_id, target_datetime, classification, generated_at
        FROM reports JOIN case_rows c ON c.id = case_id""", "reports", "case_rows"),
}

# The calendar of this query comes from the data, so its rule is written out once more.
_BUSY = """(SELECT d FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)
            WHERE n > (SELECT avg(n) FROM (SELECT count(*) AS n FROM events GROUP BY CAST(ts AS DATE))) * 1.02::DOUBLE)"""
ORACLES["calendar_table_diagnosis"] = _with(f"""
    SELECT "CellID", target_datetime_2h,
           CASE WHEN on_t OR hits / total >= 0.3 THEN 'ROUTINE' ELSE 'ANOMALOUS' END AS classification,
           CASE WHEN on_t THEN 'target date is a known holiday'
                WHEN hits / total >= 0.3 THEN hits || '/' || total || ' neighbors also at risk'
                WHEN on_s THEN 'isolated, AND forecast is based on a holiday — basis may be unreliable'
                ELSE 'isolated — only ' || hits || '/' || total || ' neighbors at risk' END AS reason
    FROM (SELECT *, CAST(target_datetime_2h AS DATE) IN {_BUSY} AS on_t,
                 CAST(target_datetime_2h - INTERVAL 24 HOUR AS DATE) IN {_BUSY} AS on_s FROM counted2)""", "counted2")
ORACLES["coverage_per_hour_in_rounds"] = ORACLES["coverage_per_hour"]

# Model errors have no twin in SQL; that they are usable numbers has.
ORACLES["boosted_tree_checks"] = f"SELECT *, TRUE AS model_ok FROM ({ORACLES['baseline_error_metrics']})"
ORACLES["copied_target_importance"] = "SELECT CAST(h AS INTEGER) AS horizon, 'lag_24h' AS feature FROM range(1, 5) t(h)"
ORACLES["reallocation_per_hour"] = f"""
    SELECT target_datetime, covered AS moved, CAST(0 AS BIGINT) AS n_out_of_bounds
    FROM ({ORACLES['coverage_per_hour']}) WHERE covered > 0"""
ORACLES["daily_files_read"] = _with(f"""
    SELECT "CellID", datetime, 'sms-call-internet-mi-' || _source_file || '.csv' AS _source_file, {ACTIVITIES} FROM collapsed""", "collapsed")
ORACLES["daily_files_rejected"] = _with("""
    SELECT _source_file, count(*) AS raw_rows, count(*) FILTER (countrycode % 7 IN (0, 1)) AS without_cell,
           CAST(0 AS BIGINT) AS without_time FROM raw GROUP BY 1""", "raw")
ORACLES["stage_tables_read"] = """
    WITH totals AS (SELECT user_id, count(*) AS n, sum(round(value * 100)) AS cents FROM events GROUP BY 1)
    SELECT *, 'parquet' AS format FROM totals UNION ALL SELECT *, 'csv' FROM totals"""
ORACLES["calendar_read"] = "SELECT strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') AS next_day, count(*) AS n FROM events GROUP BY 1"
ORACLES["serving_store_read"] = ORACLES["case_table"]

# The same queries over order lines on the full grid.
_WIDE = {
    "raw": """
        SELECT TIMESTAMP '2024-01-05' + INTERVAL 1 HOUR * (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 48) AS datetime,
               (l_partkey - 1) % 10000 + 1 AS "CellID", CAST(l_linenumber AS BIGINT) AS countrycode,
               sum(round(l_quantity)) AS smsin, sum(round(l_extendedprice)) AS smsout, sum(round(l_discount * 100)) AS callin,
               sum(round(l_tax * 100)) AS callout, count(*)::DOUBLE AS internet, strftime(datetime, '%Y-%m-%d') AS _source_file
        FROM lineitem GROUP BY 1, 2, 3""",
    "nb": """
        SELECT cell, pos, cell + dx + 100 * dy AS neighbor FROM (SELECT unnest(range(1, 10001)) AS cell) c, offsets
        WHERE (cell - 1) % 100 + dx BETWEEN 0 AND 99 AND (cell - 1) // 100 + dy BETWEEN 0 AND 99""",
}
ORACLES["wide_congestion_flags"] = _with(
    'SELECT "CellID", datetime, total_activity, congestion_threshold, is_congestion_risk FROM flags', "flags", **_WIDE)
ORACLES["wide_neighbor_average"] = _with("""
    SELECT "CellID", datetime, round(neighbor_avg_activity, 6) AS neighbor_avg_activity FROM averaged""", "averaged", **_WIDE)
ORACLES["wide_diagnosis"] = _with("""
    SELECT "CellID", datetime, naive_forecast_1h, congestion_threshold, target_datetime_1h, target_hour_key,
           classification, reason FROM diag1""", "diag1", **_WIDE)
ORACLES["wide_candidate_edges"] = _with("""
    SELECT target_datetime, congested_cell, round(deficit, 6) AS deficit, CAST(pos AS INTEGER) AS pos, source_cell,
           round(spare, 6) AS spare FROM edges""", "edges", **_WIDE)
ORACLES["wide_plan_violations"] = _with("""
    SELECT DISTINCT target_datetime, CAST(0 AS BIGINT) AS cases_overdrawn, CAST(0 AS BIGINT) AS sources_overdrawn,
           0.0::DOUBLE AS gap FROM edges""", "edges", **_WIDE)

# The watermark after an arrival is the latest time so far, in whole milliseconds, less the delay; the next arrival's rows must be after it.
ORACLES["streamed_hourly_cells"] = f"""
WITH b AS (SELECT epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events),
e AS (
  SELECT event_id, ts, user_id % 25 + 1 AS CellID, event_type, value,
    least(5, ((epoch_us(ts) + CASE WHEN event_id % 5 = 0 THEN event_id * 37 % 97 ELSE 0 END * 3600000000 - first) * 6) // (last - first + 1)) AS slot
  FROM events, b
),
delivered AS (SELECT slot, ts FROM e UNION ALL SELECT slot + 1, ts FROM e WHERE event_id % 7 = 0 AND slot < 5),
w AS (
  SELECT k AS slot, (SELECT max(date_trunc('millisecond', ts)) FROM delivered WHERE slot <= k) - INTERVAL 24 HOUR AS mark
  FROM range(6) AS r(k)
)
SELECT CellID, date_trunc('hour', ts) AS datetime, {ZEROED.replace("sum(", "sum(cents_")},
  count(*) AS n_events
FROM (
  SELECT e.*, {", ".join(f"CASE WHEN event_type = '{event}' THEN round(value * 100) END AS cents_{a}" for a, event in EVENTS_OF.items())}
  FROM e LEFT JOIN w ON w.slot = e.slot - 1 WHERE w.mark IS NULL OR e.ts > w.mark
)
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT mark FROM w WHERE slot = 5)
GROUP BY 1, 2"""

# Gradients in units of 2 ** -24; numbers are cut between values, cells ordered by gradient over rows plus 10, with a penalty of 10.
_UNIT = "16777216::DOUBLE"
_LONG = " UNION ALL ".join(
    f"SELECT h, {i} AS f, '{c}' AS feature, CAST({c} AS BIGINT) AS v, g FROM g"
    for i, c in enumerate(("hour_of_day", "day_of_week", "is_weekend", '"CellID"'))
).replace("'\"CellID\"'", "'CellID'")
ORACLES["leafwise_first_split"] = _with(f"""
, t AS ({" UNION ALL ".join(
    f'SELECT {h} AS h, "CellID", hour_of_day, day_of_week, is_weekend, CAST(round(ln(1 + target_{h}h) * {_UNIT}) AS BIGINT) AS y'
    " FROM parts WHERE part = 'train'" for h in (1, 2, 3, 4))}),
start AS (SELECT h, sum(y) / count(*) / {_UNIT} AS mean, count(*) AS total FROM t GROUP BY h),
g AS (SELECT t.*, CAST(round((mean - y / {_UNIT}) * {_UNIT}) AS BIGINT) AS g FROM t JOIN start USING (h)),
hist AS (SELECT h, f, feature, v, sum(g) / {_UNIT} AS g, count(*) AS n FROM ({_LONG}) GROUP BY ALL),
ordered AS (
  SELECT *, CASE WHEN f = 3 THEN 10 ELSE 0 END AS penalty, count(*) OVER (PARTITION BY h, f) AS places, row_number() OVER w AS place,
    sum(g) OVER w AS low_g, sum(n) OVER w AS low_n, sum(g) OVER (PARTITION BY h, f) AS all_g, sum(n) OVER (PARTITION BY h, f) AS all_n
  FROM hist WINDOW w AS (PARTITION BY h, f ORDER BY CASE WHEN f = 3 THEN g / (n + 10) ELSE v END, v ROWS UNBOUNDED PRECEDING)
),
gains AS (
  SELECT *, low_g * low_g / (low_n + penalty) + (all_g - low_g) * (all_g - low_g) / (all_n - low_n + penalty) - all_g * all_g / all_n AS gain
  FROM ordered WHERE low_n >= 50 AND all_n - low_n >= 50 AND (f < 3 OR place <= 32 OR places - place <= 32)
),
best AS (SELECT * FROM gains WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY h ORDER BY gain DESC, f, place) = 1)
SELECT CAST(b.h AS INTEGER) AS horizon, b.feature, CASE WHEN b.f < 3 THEN CAST(b.v AS DOUBLE) END AS bar,
  CASE WHEN b.f = 3 THEN (SELECT string_agg(o.v, ',' ORDER BY o.v) FROM ordered o WHERE o.h = b.h AND o.f = 3 AND o.place <= b.place) END AS low_cells,
  round(gain, 6) AS gain, round(-0.05 * low_g / (low_n + penalty), 9) AS low_value,
  round(-0.05 * (all_g - low_g) / (all_n - low_n + penalty), 9) AS high_value
FROM best b""", "parts")

_WINDOW = "(SELECT * FROM panel WHERE CAST(datetime AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-28')"
ORACLES["merged_threshold_errors"] = _with(f'SELECT "CellID", count(*) AS n, TRUE AS within_bound FROM {_WINDOW} GROUP BY 1', "panel")
ORACLES["window_thresholds"] = _with(
    f"""SELECT "CellID", round(q, 6) AS congestion_threshold FROM ({_quantile(_WINDOW, '"CellID"', 'total_activity', '0.9::DOUBLE')})""", "panel")
ORACLES["all_cell_percentile_ranks"] = _with("""
    SELECT "CellID", round(m, 6) AS mean_value, round((rank() OVER (ORDER BY m) - 1) * 100.0::DOUBLE / count(*) OVER (), 6) AS percentile,
      count(*) OVER () AS n_cells
    FROM (SELECT "CellID", avg(total_activity) AS m FROM panel GROUP BY 1)""", "panel", **_WIDE)
ORACLES["report_store_upsert"] = ORACLES["report_upsert"]
