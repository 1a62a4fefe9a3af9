"""DuckDB SQL that says what a query says, over the same tables.

Written from the definitions, not from the Spark plans: averages fold lists, medians are quantiles, folds are joins.
"""

from __future__ import annotations

from tidemark.operators.features import LAGS, MEANS, STDS, TRENDS, VARIATIONS
from tidemark.operators.indicators import RANGES, WINDOWS
from tidemark.plans.series_queries import SPLIT_DAY

#: Mean order value by status and day, with positions.
POSITIONS = """
    series AS (
        SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
        FROM orders GROUP BY ALL),
    pos AS (SELECT series_id, date, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS INTEGER) AS rn FROM series)
"""

#: Events by type in the order of time, with positions.
EVENTS = "pos AS (SELECT event_type AS series_id, ts AS date, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events)"


def six(expression: str) -> str:
    return f"(floor(({expression}) * 1e6 + 0.5) / 1e6)"


def over(k: int, tail: str = "") -> str:
    return f"OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW){tail}"


BY = "OVER (PARTITION BY series_id ORDER BY rn)"


def lag(k: int, column: str = "value") -> str:
    return f"lag({column}, {k}) {BY}"


def ema(column: str, alpha: float, least: int) -> str:
    """Fold of a list of all values so far; column must not have nulls among them."""
    values = f"list({column}) FILTER ({column} IS NOT NULL) OVER (PARTITION BY series_id ORDER BY rn ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN len({values}) >= {least} THEN list_reduce({values}, lambda a, x: {1 - alpha!r} * a + {alpha!r} * x) END"


def span(column: str, n: int) -> str:
    return ema(column, 2.0 / (n + 1), n)


def q(body: str, extra: str = "") -> str:
    return f"WITH {POSITIONS}{',' + extra if extra else ''} {body}"


def qe(body: str, extra: str = "") -> str:
    """The same over events by type."""
    return f"WITH {EVENTS}{',' + extra if extra else ''} {body}"


RET = f"ret AS (SELECT *, value / {lag(1)} - 1 AS r FROM pos)"
INDICATORS = f"""
    moves AS (SELECT *, value - {lag(1)} AS d, value / {lag(1)} - 1 AS ret_1, value / {lag(3)} - 1 AS ret_3, value / {lag(5)} - 1 AS ret_5,
                     value / {lag(10)} - 1 AS ret_10, value / {lag(20)} - 1 AS ret_20 FROM pos),
    sides AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS loss FROM moves),
    emas AS (SELECT *, {", ".join(f"{span('value', n)} AS ema_{n}" for n in (12, 20, 26, 50))},
                    {ema("gain", 1 / 14, 14)} AS g14, {ema("loss", 1 / 14, 14)} AS l14,
                    {", ".join(f"CASE WHEN rn >= {k - 1} THEN avg(value) {over(k)} END AS ma_{k}" for k in (5, 10, 20, 30))},
                    {", ".join(f"CASE WHEN rn >= {k} THEN stddev_samp(ret_1) {over(k)} END AS vol_{k}" for k in (10, 20, 30))},
                    CASE WHEN rn >= 19 THEN min(value) {over(20)} END AS low_20, CASE WHEN rn >= 19 THEN max(value) {over(20)} END AS high_20 FROM sides),
    lines AS (SELECT *, ema_12 - ema_26 AS macd FROM emas),
    ind AS (SELECT *, {span("macd", 9)} AS macd_signal, macd - ({span("macd", 9)}) AS macd_hist, ema_20 / ema_50 - 1 AS gap,
                   CASE WHEN l14 = 0 AND g14 > 0 THEN 100.0 WHEN g14 = 0 AND l14 > 0 THEN 0.0 ELSE 100 - 100 / (1 + g14 / nullif(l14, 0)) END AS rsi_14,
                   (value - low_20) / nullif(high_20 - low_20, 0) AS range_pos_20 FROM lines)
"""
VOTES = "(CASE WHEN gap > 0 THEN 1 WHEN gap < 0 THEN -1 ELSE 0 END + CASE WHEN ret_10 > 0 THEN 1 WHEN ret_10 < 0 THEN -1 ELSE 0 END + CASE WHEN rsi_14 >= 55 THEN 1 WHEN rsi_14 <= 45 THEN -1 ELSE 0 END + CASE WHEN macd_hist > 0 THEN 1 WHEN macd_hist < 0 THEN -1 ELSE 0 END)"


def rule(up: str, down: str) -> str:
    return q(f'SELECT series_id, rn AS "row", CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END AS signal FROM ind', INDICATORS)


def _rsi(p: int) -> str:
    return f"CASE WHEN l{p} = 0 AND g{p} > 0 THEN 100.0 WHEN g{p} = 0 AND l{p} > 0 THEN 0.0 ELSE 100 - 100 / (1 + g{p} / nullif(l{p}, 0)) END"


def _vote(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


#: All 945 rules on every row: pairs of averages, RSI periods, momentum windows and limits as tables.
GRID = f"""
    folded AS (SELECT *, {", ".join(f"{span('value', n)} AS e{n}" for n in (5, 10, 30, 100))}, {", ".join(f"{ema(side, 1 / p, p)} AS {side[0]}{p}" for p in (7, 21) for side in ("gain", "loss"))} FROM ind),
    gaps AS (SELECT *, f.e / nullif(s.e, 0) - 1 AS g FROM folded, LATERAL (VALUES (e5), (e10), (ema_20)) f(e), LATERAL (VALUES (e30), (ema_50), (e100)) s(e)),
    strengths(rsi_period) AS (VALUES (7), (14), (21)), windows(w) AS (VALUES (5), (10), (20)), bulls(bull) AS (VALUES (55.0), (60.0)), bears(bear) AS (VALUES (45.0), (40.0)),
    bands(band) AS (VALUES (0.001), (0.003)), thresholds(t) AS (VALUES (2), (3)),
    rated AS (SELECT *, CASE rsi_period WHEN 7 THEN {_rsi(7)} WHEN 14 THEN rsi_14 ELSE {_rsi(21)} END AS rsi FROM gaps, strengths),
    said AS (
        SELECT series_id, 'ma' AS strategy, {_vote("g > b", "g < -b")} AS signal FROM gaps, (VALUES (0.001), (0.003), (0.005)) m(b)
        UNION ALL SELECT series_id, 'ma_rsi', {_vote("g > band AND rsi >= bull", "g < -band AND rsi <= bear")} FROM rated, bulls, bears, bands
        UNION ALL SELECT series_id, 'trend_momentum', {_vote("g > band AND m > 0", "g < -band AND m < 0")} FROM (SELECT *, CASE w WHEN 5 THEN ret_5 WHEN 10 THEN ret_10 ELSE ret_20 END AS m FROM gaps, windows), bands
        UNION ALL SELECT series_id, 'combo', CASE WHEN g IS NULL THEN 0 ELSE {_vote("votes >= t", "votes <= -t")} END FROM (
            SELECT *, {_vote("g > 0", "g < 0")} + {_vote("m > 0", "m < 0")} + {_vote("rsi >= bull", "rsi <= bear")} + {_vote("macd_hist > 0", "macd_hist < 0")} AS votes
            FROM (SELECT *, CASE w WHEN 5 THEN ret_5 WHEN 10 THEN ret_10 ELSE ret_20 END AS m FROM rated, windows), bulls, bears), thresholds)
"""


def excursion() -> str:
    at = lambda k: f"lead(value, {k}) {BY}" if k > 0 else f"lag(value, {-k}) {BY}" if k < 0 else "value"
    terms = []
    for length in range(1, 6):
        for place in range(length):
            before = at(-place - 1)
            inside = " AND ".join(f"abs({at(k - place)} / {before} - 1) >= 0.10" for k in range(length))
            terms.append(f"coalesce(abs({at(length - place)} / {before} - 1) <= 0.02 AND {inside}, false)")
    return " OR ".join(terms)


#: Signals of the one trend rule, the last 20 % as holdout, five folds of 120 before it, targets inside each slice.
BACKTEST = f"""
    emas AS (SELECT *, {span("value", 20)} AS ema_20, {span("value", 50)} AS ema_50, lead(value, 5) {BY} / value - 1 AS y FROM pos),
    sig AS (SELECT *, CASE WHEN ema_20 / ema_50 - 1 > 0.003 THEN 1 WHEN ema_20 / ema_50 - 1 < -0.003 THEN -1 ELSE 0 END AS signal FROM emas),
    ends AS (SELECT series_id, CAST(count(*) AS INTEGER) AS n, CAST(round_even(count(*) * 0.8, 0) AS INTEGER) AS dev_end FROM pos GROUP BY 1),
    folds AS (
        SELECT series_id, 0 AS fold, dev_end AS train_end, dev_end AS valid_from, n AS valid_to FROM ends
        UNION ALL
        SELECT series_id, CAST(f AS INTEGER), CAST(dev_end - 5 - 600 + (f - 1) * 120 - 5 AS INTEGER), CAST(dev_end - 5 - 600 + (f - 1) * 120 AS INTEGER), CAST(dev_end - 5 - 600 + f * 120 AS INTEGER)
        FROM ends, range(1, 6) t(f) WHERE dev_end - 5 - 600 > 100),
    train AS (SELECT s.*, fold FROM sig s JOIN folds f ON s.series_id = f.series_id AND rn + 5 < train_end),
    cap AS (SELECT series_id, fold, greatest(quantile_cont(abs(y), 0.9), 1e-6) AS cap FROM train GROUP BY ALL),
    raw AS (SELECT series_id, fold, signal, count(*) AS n_train, CASE WHEN count(*) >= 20 THEN quantile_cont(y, 0.5) ELSE avg(y) END AS e FROM train GROUP BY ALL),
    expected AS (SELECT r.series_id, r.fold, signal, n_train, greatest(-cap, least(cap, e)) AS expected FROM raw r JOIN cap c ON r.series_id = c.series_id AND r.fold = c.fold),
    pred AS (
        SELECT s.*, f.fold, coalesce(e.expected, 0.0) AS p
        FROM sig s JOIN folds f ON s.series_id = f.series_id AND rn >= valid_from AND rn + 5 < valid_to
        LEFT JOIN expected e ON e.series_id = s.series_id AND e.fold = f.fold AND e.signal = s.signal),
    scored AS (
        SELECT series_id, fold, avg(abs(value * (p - y))) AS mae, avg(abs(value * y)) AS mae_naive, sqrt(avg((value * (p - y)) * (value * (p - y)))) AS rmse,
               sqrt(avg((value * y) * (value * y))) AS rmse_naive, avg(CASE WHEN p <> 0 THEN CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END END) AS da,
               avg(CASE WHEN signal <> 0 THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n
        FROM pred GROUP BY ALL)
"""
SCORES = ", ".join(f"{six(e)} AS {n}" for e, n in (("mae", "mae"), ("mae_naive", "mae_naive"), ("mae / mae_naive", "mae_ratio"), ("rmse", "rmse"), ("rmse_naive", "rmse_naive"), ("rmse / rmse_naive", "rmse_ratio"), ("da", "directional_accuracy"), ("coverage", "signal_coverage")))
SUMMARY = """
    s AS (SELECT series_id, avg(mae / mae_naive) AS ratio, quantile_cont(mae / mae_naive, 0.5) AS middle, avg(da) AS da, avg(coverage) AS cov FROM scored WHERE fold > 0 GROUP BY 1)
"""

#: Daily means with the defects that the quality report is to find, by position.
SPOILT = f"""
    spoilt AS (SELECT series_id, date, rn, rn % 71 = 5 AS bad_date, rn % 53 = 1 AS missing, rn % 53 <> 1 AND rn % 59 = 2 AS non_numeric, rn % 53 <> 1 AND rn % 59 <> 2 AND rn % 61 = 3 AS non_positive,
                      floor(value * 100 + 0.5) * (CASE WHEN rn % 67 = 4 THEN 2 ELSE 1 END) / 100 AS value, CASE WHEN series_id = 'P' THEN -rn ELSE rn END AS place, CASE WHEN rn % 73 = 6 THEN 2 ELSE 1 END AS copies FROM pos),
    flags AS (SELECT series_id, CAST(sum(copies) AS BIGINT) AS n_rows, {", ".join(f"CAST(coalesce(sum(copies) FILTER ({c}), 0) AS BIGINT) AS {c}" for c in ("bad_date", "missing", "non_numeric", "non_positive"))}, CAST(0 AS BIGINT) AS non_finite,
                     CAST(coalesce(sum(copies) FILTER (bad_date OR missing OR non_numeric OR non_positive), 0) AS BIGINT) AS invalid,
                     CAST(coalesce(sum(copies - 1) FILTER (NOT (bad_date OR missing OR non_numeric OR non_positive)), 0) AS BIGINT) AS n_duplicate_dates FROM spoilt GROUP BY 1),
    dated AS (SELECT series_id, date, value, place, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn FROM spoilt WHERE NOT (bad_date OR missing OR non_numeric OR non_positive)),
    filed AS (SELECT series_id, NOT coalesce(bool_or(falls), false) AS chronological FROM (SELECT series_id, date < lag(date) OVER (PARTITION BY series_id ORDER BY place) AS falls FROM dated) GROUP BY 1),
    judged AS (SELECT *, CAST(date - {lag(1, "date")} AS INTEGER) AS g, value = {lag(1)} AS same, {excursion()} AS excursion FROM dated),
    spacing AS (SELECT series_id, quantile_cont(g, 0.5) AS median_gap, max(g) AS max_gap, bool_or(isodow(date) >= 6) AS has_weekend, count(*) FILTER (g > 7) AS n_long_gaps, count(*) FILTER (same) AS n_repeated, count(*) FILTER (excursion) AS n_excursions FROM judged GROUP BY 1),
    moved AS (SELECT series_id, date, value, value / lag(value) OVER (PARTITION BY series_id ORDER BY date) - 1 AS r FROM judged WHERE NOT excursion),
    middles AS (SELECT series_id, quantile_cont(r, 0.5) AS m FROM moved GROUP BY 1),
    widths AS (SELECT series_id, any_value(m) AS m, 1.4826 * quantile_cont(abs(r - m), 0.5) AS mad FROM moved JOIN middles USING (series_id) GROUP BY 1),
    stay AS (SELECT series_id, count(*) AS n_rows_clean, min(date) AS date_min, max(date) AS date_max, min(value) AS value_min, max(value) AS value_max, max_by(value, date) AS last_value, max_by(r, date) AS last_change,
                    count(*) FILTER (mad > 0 AND abs(r - m) / mad > 8.0) AS n_extremes FROM moved JOIN widths USING (series_id) GROUP BY 1)
"""

#: Usable rows, the last 15 % as test, development rows with targets before it, five folds of 150.
DATASET = f"""
    f AS (SELECT *, lag(value, 60) {BY} AS v60, CASE WHEN rn >= 20 THEN stddev_samp(r) {over(20)} END AS vol, lead(value, 5) {BY} AS tv, lead(date, 5) {BY} AS td FROM ret),
    use0 AS (SELECT *, row_number() {BY} - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM f WHERE rn >= 30),
    use1 AS (SELECT *, max(CASE WHEN k = CAST(round_even(n * 0.85, 0) AS INTEGER) THEN rn END) OVER (PARTITION BY series_id) AS t0, tv / value - 1 AS y FROM use0),
    ds0 AS (SELECT *, CASE WHEN rn >= t0 THEN 'test' WHEN rn + 5 < t0 THEN 'dev' ELSE 'purged' END AS split FROM use1 WHERE y IS NOT NULL),
    ds AS (SELECT *, row_number() OVER (PARTITION BY series_id, split ORDER BY rn) - 1 AS dev_row, count(*) OVER (PARTITION BY series_id, split) AS n_dev FROM ds0),
    wf AS (SELECT DISTINCT series_id, f AS fold, n_dev - 150 * (6 - f) AS valid_from FROM ds, range(1, 6) t(f) WHERE split = 'dev' AND n_dev >= 955),
    base AS (
        SELECT d.series_id, 'wf' AS split, fold, rn, value AS v, tv AS a, y, pow(value / v60, 5 / 60.0) - 1 AS dr, vol * sqrt(5) AS sigma
        FROM ds d JOIN wf ON d.series_id = wf.series_id AND d.split = 'dev' AND dev_row >= valid_from AND dev_row < valid_from + 150
        UNION ALL
        SELECT series_id, 'holdout', 0, rn, value, tv, y, pow(value / v60, 5 / 60.0) - 1, vol * sqrt(5) FROM ds WHERE split = 'test'),
    long AS (
        SELECT series_id, split, fold, rn, v, a, y, 'naive' AS model, 0.0 AS p, v AS pv FROM base
        UNION ALL SELECT series_id, split, fold, rn, v, a, y, 'drift', dr, v * (1 + dr) FROM base WHERE dr IS NOT NULL),
    met AS (
        SELECT series_id, split, model, count(*) AS n, avg(abs(pv - a)) AS mae, sqrt(avg((pv - a) * (pv - a))) AS rmse, 100 * avg(abs(pv - a) / abs(a)) AS mape,
               100 * avg(2 * abs(pv - a) / (abs(a) + abs(pv))) AS smape, avg(pv - a) AS bias, 1 - sum((pv - a) * (pv - a)) / (count(*) * var_pop(a)) AS r2_level,
               1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)) AS r2_return, 1 - sum((p - y) * (p - y)) / sum(y * y) AS r2_oos,
               avg(CASE WHEN model <> 'naive' AND p <> 0 AND y <> 0 THEN CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END END) AS da
        FROM long GROUP BY ALL)
"""
CALIBRATION = """
    floors AS (SELECT series_id, quantile_cont(sigma, 0.1) AS fl FROM base WHERE split = 'wf' GROUP BY 1),
    res AS (SELECT b.series_id, abs(y) AS r, abs(y) / greatest(sigma, fl) AS z, fl FROM base b JOIN floors f ON b.series_id = f.series_id WHERE split = 'wf'),
    cal AS (SELECT series_id, count(*) AS n, list_sort(list(r))[CAST(least(ceil((count(*) + 1) * 0.9), count(*)) AS INTEGER)] AS q_abs, max(fl) AS fl,
                   list_sort(list(z))[CAST(least(ceil((count(*) + 1) * 0.9), count(*)) AS INTEGER)] AS q_norm FROM res GROUP BY 1)
"""


def dataset(body: str, extra: str = "") -> str:
    return q(body, f"{RET}, {DATASET}{',' + extra if extra else ''}")


def paths(slope: str, name: str) -> str:
    extra = f"steps AS (SELECT *, value - {lag(1)} AS d FROM pos), e AS (SELECT series_id, count(*) AS n, min_by(value, rn) AS a, max_by(value, rn) AS z, coalesce(stddev_samp(d), 1.0) AS s FROM steps GROUP BY 1)"
    v = f"(z + {slope} * h)"
    bands = ", ".join(f"{six(f'{v} + ({sign}{z} * (s * sqrt(h)))')} AS {side}{b}" for b, z in ((80, 1.2815515655), (95, 1.9599639845)) for side, sign in (("lower", "-"), ("upper", "+")))
    return q(f"SELECT series_id, '{name}' AS model, CAST(h AS INTEGER) AS horizon, {six(v)} AS value, {six('s')} AS spread, {bands} FROM e, range(1, 21) t(h)", extra)


RAW = """
    priced AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, o_orderkey % 97 AS m FROM orders),
    raw AS (
        SELECT o_orderstatus AS series_id, o_orderkey AS row_in_file, CASE WHEN o_orderkey % 89 = 1 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_raw,
               CASE m WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'n/a' WHEN 4 THEN '-' || price WHEN 5 THEN replace(price, '.', ',') WHEN 6 THEN '1,' || price ELSE price END AS value_raw
        FROM priced),
    cleaned AS (SELECT *, CASE WHEN contains(value_raw, ',') AND NOT contains(value_raw, '.') THEN replace(value_raw, ',', '.') ELSE value_raw END AS t FROM raw),
    typed AS (SELECT *, TRY_CAST(date_raw AS DATE) AS date, CASE WHEN t IN ('', 'nan', 'None', 'null') THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS value FROM cleaned),
    flagged AS (SELECT *, CASE WHEN date IS NULL THEN 'invalid_date' WHEN value IS NULL THEN 'missing_or_not_numeric' WHEN value <= 0 THEN 'not_positive' END AS reason FROM typed)
"""
UPSERT = f"""
    old AS (SELECT series_id, date, value FROM pos WHERE date < DATE '{SPLIT_DAY}'),
    new AS (SELECT series_id, date, CASE WHEN rn % 7 = 0 THEN value + 1 ELSE value END AS value FROM pos WHERE date >= DATE '{SPLIT_DAY}' - 90),
    m AS (SELECT coalesce(n.series_id, o.series_id) AS series_id, coalesce(n.date, o.date) AS date, coalesce(n.value, o.value) AS value,
                 CASE WHEN o.value IS NULL THEN 'added' WHEN abs(n.value - o.value) > 1e-9 THEN 'corrected' ELSE 'unchanged' END AS status
          FROM old o FULL JOIN new n ON o.series_id = n.series_id AND o.date = n.date)
"""
#: A scraped number's text t with a decimal point: of comma and point the last is the decimal sign.
QUOTED = "CASE WHEN contains(t, ',') AND contains(t, '.') THEN CASE WHEN instr(reverse(t), ',') < instr(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END ELSE replace(t, ',', '.') END"
ROW = 'series_id, rn AS "row"'
PCT = f"p AS (SELECT *, (value - {lag(1)}) / {lag(1)} * 100 AS pct FROM pos)"
LAST20 = "recent AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rn DESC) AS age FROM p)"
LATER = ", ".join(f"CAST(f + CAST({n} + 2 * floor((wd + {n}) / 5) AS INTEGER) AS DATE) AS later_{n}" for n in (1, 5, 8, 20))

#: Correlations of features with the return over 5 rows, on development rows.
ASSOCIATED = [(f"variation_{k}", f"value / {lag(k)} - 1") for k in VARIATIONS] + [(f"rolling_mean_{k}_rel", f"avg(value) {over(k)} / value - 1") for k in MEANS] + [(f"rolling_std_{k}", f"stddev_samp(r) {over(k)}") for k in STDS]
ASSOCIATION = f"""
    feats AS (SELECT series_id, rn, {", ".join(f"{e} AS {n}" for n, e in ASSOCIATED)} FROM ret),
    tied AS (SELECT feats.*, y FROM feats JOIN ds USING (series_id, rn) WHERE split = 'dev'),
    corrs AS ({" UNION ALL ".join(f"SELECT series_id, '{n}' AS feature, corr({n}, y) AS r FROM tied GROUP BY 1" for n, _ in ASSOCIATED)}),
    assoc AS (SELECT series_id, feature, r * r / sum(r * r) OVER (PARTITION BY series_id) AS gain, abs(r) AS rise, CAST(rank() OVER (PARTITION BY series_id ORDER BY abs(r) DESC) AS INTEGER) AS place FROM corrs)
"""
#: 40 orders of each status by md5, others until there are 360.
SAMPLE = """WITH placed AS (SELECT o_orderkey, o_orderstatus, md5('7:' || o_orderkey) AS p FROM orders),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY p) <= 40 AS own FROM placed),
    chosen AS (SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY own DESC, p) AS k FROM ranked) WHERE k <= 360)"""
#: The test of equal accuracy over 5 steps.
DIEBOLD = f"""
    losses AS (SELECT series_id, rn, abs(v * (1 + dr) - a) - abs(v - a) AS d FROM base WHERE split = 'holdout' AND dr IS NOT NULL),
    centred AS (SELECT series_id, rn, d, d - avg(d) OVER (PARTITION BY series_id) AS c FROM losses),
    lagged AS (SELECT *, {", ".join(f"{lag(k, 'c')} AS c{k}" for k in range(1, 5))} FROM centred),
    sums AS (SELECT series_id, count(*) AS n, avg(d) AS mean, (sum(c * c) + {" + ".join(f"2.0 * (1 - {k} / 5.0) * sum(c * c{k})" for k in range(1, 5))}) / count(*) AS variance FROM lagged GROUP BY 1),
    tested AS (SELECT *, mean / sqrt(greatest(variance, 1e-18) / n) * sqrt(greatest((n - 9 + 20 / n) / n, 1e-12)) AS t FROM sums)
"""
#: Student's t of whole degrees of freedom, by its finite sums of powers of a cosine: middle is the probability of [-t, t], signed.
STUDENT = """
    angles AS (SELECT *, n - 1 AS f, atan(t / sqrt(n - 1)) AS angle FROM tested),
    student AS (SELECT *, CASE WHEN f % 2 = 0
        THEN sin(angle) * list_sum(list_transform(range(0, CAST(f // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow(cos(angle), 2 * j)))
        ELSE 2 / pi() * (angle + sin(angle) * coalesce(list_sum(list_transform(range(0, CAST((f - 1) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5) + lgamma(1.5)) * pow(cos(angle), 2 * j + 1))), 0))
        END AS middle FROM angles)
"""
#: 2,000 resamples of blocks of 10 rows, row by row.
BOOTSTRAP = """
    errors AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY rn) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n, abs(v * (1 + dr) - a) AS own, abs(v - a) AS naive
               FROM base WHERE split = 'holdout' AND dr IS NOT NULL),
    places AS (SELECT series_id, n, r, k, CAST('0x' || substr(md5('47:' || r || ':' || (k // 10)), 1, 15) AS BIGINT) % (n - 9) + k % 10 AS taken FROM errors, range(0, 2000) t(r)),
    ratios AS (SELECT p.series_id, p.r, sum(own) / sum(naive) AS ratio FROM places p JOIN errors e ON e.series_id = p.series_id AND e.k = p.taken GROUP BY ALL)
"""

SQL = {
    "series_position": q('SELECT series_id, date, value, rn AS "row" FROM pos'),
    "ship_series_position": """SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value,
        CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY CAST(l_shipdate AS DATE)) - 1 AS INTEGER) AS "row" FROM lineitem GROUP BY l_returnflag, CAST(l_shipdate AS DATE)""",
    "event_series_position": qe('SELECT series_id, date AS ts, value, rn AS "row" FROM pos'),
    "event_lag_features": qe(
        f"SELECT {ROW}, {', '.join(f'{lag(k)} AS lag_{k}' for k in LAGS)}, {', '.join(f'{six(f"value / nullif({lag(k)}, 0) - 1")} AS variation_{k}' for k in VARIATIONS)}, "
        f"{', '.join(f'CASE WHEN rn >= {k - 1} THEN {six(f"sum(value) {over(k)}")} END AS rolling_sum_{k}' for k in MEANS)}, lead(value, 5) {BY} AS target_value FROM pos"
    ),
    "event_rolling_std": qe(f"SELECT {ROW}, {', '.join(f'CASE WHEN rn >= {k - 1} THEN {six(f"stddev_samp(value) {over(k)}")} END AS rolling_std_{k}_level' for k in STDS)} FROM pos"),
    "event_excursions": qe(f"SELECT {ROW}, {excursion()} AS excursion FROM pos"),
    "event_gaps": qe(f"SELECT {ROW}, CAST(floor(epoch(date)) - floor(epoch({lag(1, 'date')})) AS BIGINT) AS gap_seconds FROM pos"),
    "event_averages": qe(
        f"SELECT {ROW}, {', '.join(f'{six(c)} AS {c}' for c in ('ema_20', 'ema_50', 'macd', 'macd_signal', 'macd_hist', 'rsi_14'))}, {six(_rsi(7))} AS rsi_7, {six(_rsi(21))} AS rsi_21 FROM others",
        f"{INDICATORS}, others AS (SELECT *, {', '.join(f'{ema(side, 1 / p, p)} AS {side[0]}{p}' for p in (7, 21) for side in ('gain', 'loss'))} FROM ind)",
    ),
    "event_indicators": qe(
        f"SELECT {ROW}, {six('range_pos_20')} AS range_pos_20, {six('vol_10 / nullif(vol_30, 0)')} AS vol_ratio_10_30, {six('ma_5 / nullif(ma_20, 0) - 1')} AS ma_gap_5_20, "
        f"CASE WHEN rn >= 29 THEN max(value) {over(30)} END AS high_30, CASE WHEN rn >= 29 THEN min(value) {over(30)} END AS low_30 FROM ind",
        INDICATORS,
    ),
    "event_quantiles": f"""SELECT series_id, s AS share, n, {six('v')} AS value FROM (
        SELECT event_type AS series_id, count(*) AS n, unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.999]::DOUBLE[]) AS s, unnest(quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95, 0.999])) AS v FROM events GROUP BY 1)""",
    "event_gap_summary": qe(f"SELECT series_id, quantile_cont(g, 0.5) AS median_gap, max(g) AS max_gap FROM (SELECT series_id, CAST(floor(epoch(date)) - floor(epoch({lag(1, 'date')})) AS DOUBLE) AS g FROM pos) GROUP BY 1"),
    "event_robust_extremes": qe(
        f"SELECT {ROW}, {six('r')} AS ret, {six('abs(r - m) / (1.4826 * mad)')} AS robust_z FROM ret JOIN mads USING (series_id) WHERE abs(r - m) / (1.4826 * mad) > 8.0",
        f"{RET}, meds AS (SELECT series_id, quantile_cont(r, 0.5) AS m FROM ret GROUP BY 1), mads AS (SELECT series_id, any_value(m) AS m, quantile_cont(abs(r - m), 0.5) AS mad FROM ret JOIN meds USING (series_id) GROUP BY 1)",
    ),
    "pct_change": q(f"SELECT {ROW}, {', '.join(f'value / {lag(k)} - 1 AS ret_{k}' for k in (1, 3, 5, 10, 20))} FROM pos"),
    "lag_features": q(f"SELECT {ROW}, {', '.join(f'{lag(k)} AS lag_{k}, {lag(k)} / value - 1 AS lag_{k}_rel' for k in LAGS)}, {', '.join(f'value / {lag(k)} - 1 AS variation_{k}' for k in VARIATIONS)} FROM pos"),
    "rolling_mean": q(f"SELECT {ROW}, {', '.join(f'CASE WHEN rn >= {k - 1} THEN {six(f"avg(value) {over(k)}")} END AS rolling_mean_{k}, CASE WHEN rn >= {k - 1} THEN {six(f"avg(value) {over(k)} / value - 1")} END AS rolling_mean_{k}_rel' for k in MEANS)} FROM pos"),
    "moving_averages": q(f"SELECT {ROW}, {', '.join(f'CASE WHEN rn >= {k - 1} THEN {six(f"avg(value) {over(k)} / value")} END AS ma_{k}' for k in WINDOWS)} FROM pos"),
    "rolling_std": q(f"SELECT {ROW}, {', '.join(f'CASE WHEN rn >= {k} THEN {six(f"stddev_samp(r) {over(k)}")} END AS rolling_std_{k}, CASE WHEN rn >= {k - 1} THEN {six(f"stddev_samp(value) {over(k)}")} END AS rolling_std_{k}_level' for k in STDS)} FROM ret", RET),
    "rolling_slope": q(f"SELECT {ROW}, {', '.join(f'CASE WHEN rn >= {k - 1} THEN {six(f"regr_slope(value, rn) {over(k)} / value")} END AS trend_{k}' for k in TRENDS)} FROM pos"),
    "rolling_minmax": q(f"SELECT {ROW}, {', '.join(f'CASE WHEN rn >= {k - 1} THEN max(value) {over(k)} END AS high_{k}, CASE WHEN rn >= {k - 1} THEN min(value) {over(k)} END AS low_{k}' for k in RANGES)} FROM pos"),
    "range_position": q(f"SELECT {ROW}, {six('range_pos_20')} AS range_pos_20 FROM ind", INDICATORS),
    "ema_20_50": q(f"SELECT {ROW}, {six(span('value', 20))} AS ema_20, {six(span('value', 50))} AS ema_50 FROM pos"),
    "ema_in_sql": q(f"SELECT {ROW}, {six(span('value', 20))} AS ema_20 FROM pos"),
    "macd": q(f"SELECT {ROW}, {six('macd')} AS macd, {six('macd_signal')} AS macd_signal, {six('macd_hist')} AS macd_hist FROM ind", INDICATORS),
    "rsi_14": q(f"SELECT {ROW}, {six('rsi_14')} AS rsi_14 FROM ind", INDICATORS),
    "gap_features": q(f"SELECT {ROW}, {six('ma_5 / ma_20 - 1')} AS ma_gap_5_20, {six('ma_10 / ma_30 - 1')} AS ma_gap_10_30, {six('gap')} AS ema_gap_20_50, {six(f'ema_20 / {lag(5, "ema_20")} - 1')} AS ema_slope_20, {six('vol_10 / nullif(vol_30, 0)')} AS vol_ratio_10_30 FROM ind", INDICATORS),
    "feature_vector": q(
        f"SELECT {ROW}, {six('gap')} AS trend, {six('ret_10')} AS momentum_10, {six('ret_20')} AS momentum_20, {six('rsi_14')} AS rsi, {six('macd / value')} AS macd_norm, {six('macd_hist / value')} AS macd_hist_norm, {six('range_pos_20')} AS range_pos, {six('vol_20')} AS vol FROM ind QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rn DESC) <= 28",
        INDICATORS,
    ),
    "calendar_features": q(f"SELECT {ROW}, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(date - {lag(1, 'date')} AS INTEGER) AS days_since_previous_observation FROM pos"),
    "lead_targets": q(f"SELECT {ROW}, lead(date, 5) {BY} AS target_date, lead(value, 5) {BY} AS target_value, lead(value, 5) {BY} / value - 1 AS return_h FROM pos"),
    "drift_baseline": q(f"SELECT {ROW}, {', '.join(f'{six(f"pow(value / {lag(60)}, {h / 60!r}) - 1")} AS drift_{h}' for h in (5, 10, 20))} FROM pos"),
    "usable_counts": q("SELECT series_id, count(*) AS n_usable, min(rn) AS first_row FROM pos WHERE rn >= 30 GROUP BY 1"),
    "excursion_flags": q(f"SELECT {ROW}, {excursion()} AS excursion FROM pos"),
    "robust_z_extremes": q(
        f"SELECT r.series_id, date, {six('r')} AS ret, {six('abs(r - m) / (1.4826 * mad)')} AS robust_z FROM ret r JOIN mads USING (series_id) WHERE abs(r - m) / (1.4826 * mad) > 2.0",
        f"{RET}, meds AS (SELECT series_id, quantile_cont(r, 0.5) AS m FROM ret GROUP BY 1), mads AS (SELECT series_id, any_value(m) AS m, quantile_cont(abs(r - m), 0.5) AS mad FROM ret JOIN meds USING (series_id) GROUP BY 1)",
    ),
    "gap_histogram": q(f"SELECT series_id, g AS gap_days, count(*) AS n FROM (SELECT series_id, CAST(date - {lag(1, 'date')} AS INTEGER) AS g FROM pos) WHERE g IS NOT NULL GROUP BY ALL"),
    "gap_summary": q(f"SELECT series_id, quantile_cont(g, 0.5) AS median_gap, max(g) AS max_gap, bool_or(isodow(date) >= 6) AS has_weekend FROM (SELECT series_id, date, CAST(date - {lag(1, 'date')} AS INTEGER) AS g FROM pos) GROUP BY 1"),
    "long_gaps": q(f"SELECT * FROM (SELECT series_id, {lag(1, 'date')} AS from_date, date AS to_date, CAST(date - {lag(1, 'date')} AS INTEGER) AS gap_days FROM pos) WHERE gap_days > 1"),
    "customer_long_gaps": """SELECT * FROM (SELECT series_id, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS from_date, date AS to_date, CAST(date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS INTEGER) AS gap_days
        FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS date FROM orders)) WHERE gap_days > 7""",
    "weekday_histogram": q("SELECT series_id, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, count(*) AS n FROM pos GROUP BY ALL"),
    "year_histogram": q("SELECT series_id, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM pos GROUP BY ALL"),
    "repeated_values": q(f"SELECT series_id, count(*) FILTER (same) AS n_repeated FROM (SELECT series_id, value = {lag(1)} AS same FROM pos) GROUP BY 1"),
    "last_observation": q(f"SELECT series_id, date, value, c AS change, abs(c) > 0.05 AS alert FROM (SELECT *, value / {lag(1)} - 1 AS c FROM pos) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1"),
    "audit_flag_counts": f"""WITH {RAW} SELECT series_id, count(*) AS n_rows, count(*) FILTER (date IS NULL) AS bad_date, count(*) FILTER (t IN ('', 'nan', 'None', 'null')) AS missing,
        count(*) FILTER (value IS NULL AND t NOT IN ('', 'nan', 'None', 'null')) AS non_numeric, count(*) FILTER (value <= 0) AS non_positive, CAST(0 AS BIGINT) AS non_finite FROM flagged GROUP BY 1""",
    "quarantine": f"WITH {RAW} SELECT series_id, row_in_file, date_raw, value_raw, reason FROM flagged WHERE reason IS NOT NULL",
    "duplicate_dates": f"WITH {RAW} SELECT series_id, date, count(*) AS n_rows, count(DISTINCT value) AS n_values FROM flagged WHERE reason IS NULL GROUP BY ALL HAVING count(*) > 1",
    "chronological": f"WITH {RAW} SELECT series_id, NOT coalesce(bool_or(falls), false) AS chronological FROM (SELECT series_id, date < lag(date) OVER (PARTITION BY series_id ORDER BY row_in_file) AS falls FROM flagged WHERE reason IS NULL) GROUP BY 1",
    "number_normalisers": f"""WITH priced AS (SELECT o_orderkey AS id, o_orderkey % 10 AS form, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, format('{{:,.2f}}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) AS g FROM orders),
        raw AS (SELECT id, form, CASE form WHEN 0 THEN p WHEN 1 THEN replace(p, '.', ',') WHEN 2 THEN translate(g, ',.', ' ,') WHEN 3 THEN translate(g, ',.', chr(160) || ',') WHEN 4 THEN translate(g, ',.', '.,')
                       WHEN 5 THEN g WHEN 6 THEN '' WHEN 7 THEN 'nan' WHEN 8 THEN '-' || p ELSE ' ' || left(p, 4) END AS raw FROM priced),
        s AS (SELECT id, form, replace(replace(trim(raw), ' ', ''), chr(160), '') AS t FROM raw),
        n AS (SELECT id, form, CASE WHEN t IN ('', 'nan') THEN NULL ELSE TRY_CAST(CASE WHEN contains(t, ',') AND NOT contains(t, '.') THEN replace(t, ',', '.') ELSE t END AS DOUBLE) END AS audited,
            TRY_CAST(nullif(nullif({QUOTED}, 'nan'), '') AS DOUBLE) AS quoted FROM s)
        SELECT id, audited, CASE WHEN form = 7 THEN CAST('nan' AS DOUBLE) ELSE quoted END AS quoted, CASE WHEN quoted BETWEEN 500 AND 10000 THEN quoted END AS believed FROM n""",
    "date_normalisers": """WITH raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
               WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN 'junk' WHEN 5 THEN '' WHEN 6 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 7 THEN upper(strftime(o_orderdate, '%d-%b-%Y')) ELSE strftime(o_orderdate, '%b %-d, %Y') END AS d FROM orders),
        p AS (SELECT id, coalesce(CAST(try_strptime(d, '%Y-%m-%d') AS DATE), CASE WHEN length(d) = 8 THEN CAST(try_strptime(d, '%Y%m%d') AS DATE) END, CAST(try_strptime(d, ['%d %B %Y', '%d-%b-%Y', '%b %d, %Y']) AS DATE)) AS iso,
                     CAST(try_strptime(d, '%m/%d/%Y') AS DATE) AS md, CAST(try_strptime(d, '%d/%m/%Y') AS DATE) AS dm FROM raw)
        SELECT id, coalesce(iso, md) AS month_first, coalesce(iso, dm) AS day_first FROM p""",
    "page_quotes": r"""WITH keyed AS (SELECT page_id AS id, html, page_id % 7 AS form, CAST(400 + page_id * 37 % 9900 AS VARCHAR) AS w, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') AS c FROM pages),
        raw AS (SELECT id, CASE form WHEN 0 THEN '<td>USD (cours moyen)</td><td>' || w || ',' || c || '</td>' WHEN 1 THEN '<b>usd</b> : ' || w || '.' || c || '<br>' WHEN 2 THEN '<p>USD(cours moyen)<i></i>: 1.2' || right(w, 2) || ',5 x 99</p>'
                       WHEN 3 THEN '<p>EUR ' || w || '</p>' WHEN 4 THEN '' WHEN 5 THEN 'USD' || chr(10) || chr(10) || '=' || chr(9) || ' ' || w || ' ' ELSE '<td>usd (Cours  moyen)</td><td>2 ' || right(w, 3) || ',' || c || '</td>' END || html AS html FROM keyed),
        x AS (SELECT id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') AS x FROM raw),
        f AS (SELECT id, replace(coalesce(nullif(regexp_extract(x, '(?i)USD\s*\(cours\s+moyen\)\s*[^0-9]{0,80}([0-9][0-9\s.,]*)', 1), ''),
                                          nullif(regexp_extract(x, '(?i)\bUSD\b\s*[^0-9]{0,120}([0-9][0-9\s.,]*)', 1), '')), ' ', '') AS t FROM x),
        n AS (SELECT id, TRY_CAST(""" + QUOTED + r""" AS DOUBLE) AS v FROM f)
        SELECT id, CASE WHEN v BETWEEN 500 AND 10000 THEN v END AS rate FROM n""",
    "page_text": r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') AS text FROM pages",
    "business_days": q(f"SELECT date, {LATER} FROM (SELECT DISTINCT date, date - CAST(greatest(isodow(date) - 5, 0) AS INTEGER) AS f, least(isodow(date) - 1, 4) AS wd FROM pos)"),
    "collection_calendar": q("SELECT series_id, CAST(d AS DATE) AS date FROM (SELECT series_id, max(date) AS m FROM pos GROUP BY 1), LATERAL (SELECT unnest(range(greatest(DATE '1998-07-01', m - 40), m + 1, INTERVAL 1 DAY)) AS d)"),
    "stratified_orders": f"{SAMPLE} SELECT o_orderkey, o_orderstatus FROM chosen",
    "unsampled_orders": f"{SAMPLE} SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM chosen) GROUP BY 1",
    "date_range_filter": q("SELECT series_id, date, value FROM pos QUALIFY date >= max(date) OVER (PARTITION BY series_id) - 183"),
    "date_search_top80": q(f"SELECT series_id, date, value, {six('pct')} AS pct FROM (SELECT *, coalesce((value - {lag(1)}) / {lag(1)} * 100, 0.0) AS pct FROM pos) WHERE contains(CAST(date AS VARCHAR), '-03-') QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 80"),
    "quartile_picks": q('SELECT series_id, date, value, rn AS "row" FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM pos) WHERE rn IN (0, floor(n * 0.25), floor(n * 0.5), floor(n * 0.75), n - 1)'),
    "new_observations": q(f"SELECT series_id, count(*) FILTER (date > DATE '{SPLIT_DAY}') AS n_new FROM pos GROUP BY 1"),
    "upsert_by_date": q("SELECT * FROM m", UPSERT),
    "upsert_counts": q("SELECT series_id, count(*) AS n, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'corrected') AS corrected FROM m GROUP BY 1", UPSERT),
    "series_overview": q("SELECT series_id, count(*) AS observations, min(date) AS start, max(date) AS last_date, min_by(value, date) AS first_value, max_by(value, date) AS last_value, min(value) AS value_min, max(value) AS value_max FROM pos GROUP BY 1"),
    "pct_summary": q(f"SELECT series_id, {six('avg(pct)')} AS average, {six('stddev_samp(pct)')} AS std FROM p GROUP BY 1", PCT),
    "recent_stats": q(f"SELECT series_id, {six('max_by(pct, rn)')} AS last_pct, {six('avg(value)')} AS average, {six('stddev_samp(pct)')} AS volatility, {six('greatest(0.0, least(100.0, (avg(value) - min(value)) / (max(value) - min(value)) * 100))')} AS marker FROM recent WHERE age <= 20 GROUP BY 1", f"{PCT}, {LAST20}"),
    "technical_snapshot": q(
        f"SELECT series_id, date, value, {six('ema_20')} AS ema_20, {six('ema_50')} AS ema_50, {six('gap')} AS ema_gap_20_50, {six('rsi_14')} AS rsi_14, {six('macd')} AS macd, {six('macd_hist')} AS macd_hist, {six('ret_10 * 100')} AS momentum_10_pct, {six('ret_20 * 100')} AS momentum_20_pct, {six('vol_20 * 100')} AS volatility_20_pct, {six('range_pos_20')} AS range_position_20 FROM ind QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rn DESC) = 1",
        INDICATORS,
    ),
    "data_quality_report": q(
        f"""SELECT series_id, n_rows, bad_date, missing, non_numeric, non_positive, non_finite, n_duplicate_dates, chronological, median_gap, max_gap, has_weekend, n_long_gaps, n_repeated, n_excursions, n_rows_clean, date_min, date_max, value_min, value_max,
            last_value, {six("last_change")} AS last_change, abs(last_change) > 0.05 AS last_alert, n_extremes, invalid + n_excursions AS n_rows_excluded, 0 AS modified_values, 0 AS interpolated_values,
            CAST(gaps AS VARCHAR) AS gaps, CAST(weekdays AS VARCHAR) AS weekdays, coalesce(CAST(distant AS VARCHAR), '[]') AS distant, CAST(extreme_years AS VARCHAR) AS extreme_years
            FROM flags JOIN filed USING (series_id) JOIN spacing USING (series_id) JOIN stay USING (series_id)
            LEFT JOIN (SELECT series_id, to_json(list({{gap_days: g, n: c}} ORDER BY g)) AS gaps FROM (SELECT series_id, g, count(*) AS c FROM judged WHERE g IS NOT NULL GROUP BY ALL) GROUP BY 1) USING (series_id)
            LEFT JOIN (SELECT series_id, to_json(list({{day_of_week: d, n: c}} ORDER BY d)) AS weekdays FROM (SELECT series_id, isodow(date) - 1 AS d, count(*) AS c FROM judged GROUP BY ALL) GROUP BY 1) USING (series_id)
            LEFT JOIN (SELECT series_id, to_json(list({{from_date: f, to_date: date, gap_days: g}} ORDER BY f)) AS distant FROM (SELECT series_id, {lag(1, "date")} AS f, date, g FROM judged) WHERE g > 7 GROUP BY 1) USING (series_id)
            LEFT JOIN (SELECT series_id, to_json(list({{year: y, n: c}} ORDER BY y)) AS extreme_years FROM (SELECT series_id, year(date) AS y, count(*) AS c FROM moved JOIN widths USING (series_id) WHERE mad > 0 AND abs(r - m) / mad > 8.0 GROUP BY ALL) GROUP BY 1) USING (series_id)""",
        SPOILT,
    ),
    "site_snapshot": q(
        f"""SELECT series_id, count(*) AS observations, min(date) AS start, max(date) AS last_date, max_by(value, date) AS last_value, {six("arg_max(rsi_14, date)")} AS rsi_14, CAST(sign(arg_max(gap, date)) AS INTEGER) AS ema_signal,
            CAST(horizon AS INTEGER) AS horizon, max(date) FILTER (date < '{SPLIT_DAY}') AS trained_through, count(*) FILTER (date >= '{SPLIT_DAY}') AS new_observations_since_training
            FROM ind, (VALUES (5), (10), (20)) t(horizon) GROUP BY series_id, horizon""",
        INDICATORS,
    ),
    "published_envelope": q("SELECT series_id, date, value FROM pos"),
    "naive_paths": paths("0.0", "naive"),
    "drift_paths": paths("((z - a) / (n - 1))", "drift"),
    "recent_drift_paths": q(
        f"SELECT series_id, CAST(h AS INTEGER) AS horizon, {six('z + h * s')} AS value, 12.0::DOUBLE AS spread, {', '.join(f'{six(f"z + h * s + ({sign}{z} * (12.0 * sqrt(h)))")} AS {side}{b}' for b, z in ((80, 1.28), (95, 1.96)) for side, sign in (('lower', '-'), ('upper', '+')))} FROM e, range(1, 31) t(h)",
        f"steps AS (SELECT *, value - {lag(1)} AS d, row_number() OVER (PARTITION BY series_id ORDER BY rn DESC) AS age FROM pos), e AS (SELECT series_id, max_by(value, rn) AS z, avg(d) FILTER (age <= 60) AS s FROM steps GROUP BY 1 HAVING count(*) >= 30)",
    ),
    "variation_since_last": q(f"SELECT series_id, date, {six('d')} AS delta FROM (SELECT *, value - {lag(1)} AS d FROM pos) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rn DESC) <= 70"),
    "signal_ma": rule("gap > 0.003", "gap < -0.003"),
    "signal_ma_rsi": rule("gap > 0.003 AND rsi_14 >= 55", "gap < -0.003 AND rsi_14 <= 45"),
    "signal_trend_momentum": rule("gap > 0.003 AND ret_10 > 0", "gap < -0.003 AND ret_10 < 0"),
    "signal_combo": rule(f"gap IS NOT NULL AND {VOTES} >= 2", f"gap IS NOT NULL AND {VOTES} <= -2"),
    "signal_combo_strict": rule(f"gap + ret_10 + rsi_14 + macd_hist IS NOT NULL AND {VOTES} >= 2", f"gap + ret_10 + rsi_14 + macd_hist IS NOT NULL AND {VOTES} <= -2"),
    "candidate_grid": q(
        """SELECT series_id, strategy, CAST(fast AS INTEGER) AS fast, CAST(slow AS INTEGER) AS slow, CAST(n AS BIGINT) AS n, CAST(greatest(rows - slow + 1, 0) AS BIGINT) AS n_rows
           FROM (SELECT series_id, count(*) AS rows FROM pos GROUP BY 1), (VALUES ('ma', 3), ('ma_rsi', 24), ('trend_momentum', 6), ('combo', 72)) s(strategy, n), (VALUES (5), (10), (20)) f(fast), (VALUES (30), (50), (100)) g(slow)"""
    ),
    "unchosen_candidates": "SELECT CAST(945 - 360 AS BIGINT) AS n",
    "fold_range_join": q(
        """SELECT f.series_id, fold, role, count(*) AS n, min(rn) AS first_row, max(rn) AS last_row
           FROM (SELECT s.series_id, fold, rn, CASE WHEN rn + 5 < train_end THEN 'train' WHEN rn >= valid_from AND rn + 5 < valid_to THEN 'valid' END AS role
                 FROM pos s JOIN folds ON s.series_id = folds.series_id WHERE fold > 0) f WHERE role IS NOT NULL GROUP BY ALL""",
        BACKTEST,
    ),
    "signal_expectation": q(f"SELECT series_id, signal, n_train, {six('expected')} AS expected FROM expected WHERE fold = 0", BACKTEST),
    "strategy_holdout_metrics": q(f"SELECT series_id, {SCORES}, n FROM scored WHERE fold = 0", BACKTEST),
    "walk_forward_metrics": q(f"SELECT series_id, fold, {SCORES}, n FROM scored WHERE fold > 0", BACKTEST),
    "fold_summary": q(
        f"SELECT series_id, {six('ratio')} AS mae_ratio_mean, {six('middle')} AS mae_ratio_median, {six('da')} AS directional_accuracy_mean, {six('cov')} AS signal_coverage_mean, {six('least(greatest(ratio - 1, -0.5), 1.0) - 0.5 * greatest(da - 0.5, -0.25) + 0.05 * abs(cov - 0.6)')} AS composite FROM s",
        f"{BACKTEST}, {SUMMARY}",
    ),
    "deploy_rule": q("SELECT s.series_id, CASE WHEN ratio < 1 AND mae / mae_naive < 1 THEN 'ma' ELSE 'naive' END AS selected_model FROM s JOIN scored h ON s.series_id = h.series_id AND h.fold = 0", f"{BACKTEST}, {SUMMARY}"),
    "holdout_predictions": q(f"SELECT series_id, date, value, {six('value * (1 + y)')} AS actual_value, {six('value * (1 + p)')} AS pred_value, {six('y')} AS actual_return, {six('p')} AS pred_return, signal FROM pred WHERE fold = 0", BACKTEST),
    "live_forecast": q(
        f"""SELECT l.series_id, l.date, l.value, l.signal, {six("greatest(-c.cap, least(c.cap, CASE WHEN b.n_same >= 20 THEN b.mid WHEN b.n_same > 0 THEN b.mean ELSE 0 END))")} AS expected_return,
            {six("l.value * (1 + CASE WHEN n_same < 30 THEN lo_all ELSE lo_same END)")} AS lower, {six("l.value * (1 + CASE WHEN n_same < 30 THEN hi_all ELSE hi_same END)")} AS upper
            FROM latest l JOIN bands b ON l.series_id = b.series_id JOIN caps c ON c.series_id = l.series_id""",
        f"""{BACKTEST}, latest AS (SELECT series_id, date, value, signal FROM sig QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rn DESC) = 1),
            caps AS (SELECT series_id, greatest(quantile_cont(abs(y), 0.9), 1e-6) AS cap FROM sig WHERE y IS NOT NULL GROUP BY 1),
            bands AS (SELECT s.series_id, count(*) FILTER (s.signal = l.signal) AS n_same, quantile_cont(y, 0.5) FILTER (s.signal = l.signal) AS mid, avg(y) FILTER (s.signal = l.signal) AS mean,
                quantile_cont(y, 0.1) FILTER (s.signal = l.signal) AS lo_same, quantile_cont(y, 0.9) FILTER (s.signal = l.signal) AS hi_same, quantile_cont(y, 0.1) AS lo_all, quantile_cont(y, 0.9) AS hi_all
                FROM sig s JOIN latest l ON s.series_id = l.series_id WHERE y IS NOT NULL GROUP BY 1)""",
    ),
    "candidate_signal_counts": q("SELECT series_id, strategy, CAST(signal AS INTEGER) AS signal, count(*) AS n FROM said GROUP BY ALL", f"{INDICATORS}, {GRID}"),
    "diebold_mariano_statistic": dataset(f"SELECT series_id, 5 AS horizon, 'holdout' AS split, {six('t')} AS statistic, {six('mean')} AS mean_loss_diff, n FROM tested", DIEBOLD),
    "diebold_mariano_drift": dataset(
        f"SELECT series_id, 5 AS horizon, 'holdout' AS split, {six('t')} AS statistic, {six('1 - abs(middle)')} AS p_two_sided, {six('0.5 + middle / 2')} AS p_better, {six('mean')} AS mean_loss_diff, n FROM student",
        f"{DIEBOLD}, {STUDENT}",
    ),
    "bootstrap_drift": dataset(
        f"SELECT series_id, 5 AS horizon, 'holdout' AS split, {six('quantile_cont(ratio, 0.05)')} AS lower, {six('quantile_cont(ratio, 0.95)')} AS upper, CAST(10 AS INTEGER) AS block_length, CAST(count(*) AS INTEGER) AS n_boot, {six('avg(CASE WHEN ratio < 1 THEN 1.0 ELSE 0.0 END)')} AS prob_below_1 FROM ratios GROUP BY 1",
        BOOTSTRAP,
    ),
    "horizon_split": dataset("SELECT series_id, split, count(*) AS n, min(rn) AS first_row, max(rn) AS last_row FROM ds GROUP BY ALL"),
    "training_folds": dataset("SELECT series_id, CAST(fold AS INTEGER) AS fold, CAST(valid_from - 5 AS INTEGER) AS train_end, CAST(valid_from AS INTEGER) AS valid_from, CAST(valid_from + 150 AS INTEGER) AS valid_to FROM wf"),
    "metric_block_naive_drift": dataset(
        f"""SELECT series_id, 5 AS horizon, split, model, n, {", ".join(f"{six(e)} AS {name}" for e, name in (("mae", "mae"), ("rmse", "rmse"), ("mape", "mape_pct"), ("smape", "smape_pct"), ("bias", "bias"), ("r2_level", "r2_level"), ("r2_return", "r2_return"), ("r2_oos", "r2_oos_vs_naive"), ("da", "directional_accuracy")))},
            {six("mae / max(CASE WHEN model = 'naive' THEN mae END) OVER (PARTITION BY series_id, split)")} AS mae_ratio_vs_naive, {six("rmse / max(CASE WHEN model = 'naive' THEN rmse END) OVER (PARTITION BY series_id, split)")} AS rmse_ratio_vs_naive FROM met"""
    ),
    "fold_metrics": dataset(f"SELECT series_id, CAST(fold AS INTEGER) AS fold, model, count(*) AS n, {six('avg(abs(pv - a))')} AS mae, {six('sqrt(avg((pv - a) * (pv - a)))')} AS rmse FROM long WHERE split = 'wf' GROUP BY ALL"),
    "cumulative_gain": dataset(f"SELECT {ROW}, {six(f'sum(abs(v - a) - abs(v * (1 + dr) - a)) OVER (PARTITION BY series_id ORDER BY rn)')} AS cumulative_gain FROM base WHERE split = 'holdout'"),
    "baseline_search": dataset(
        f"SELECT series_id, CAST(candidate AS INTEGER) AS candidate, {six('m')} AS cv_mean, {six('s')} AS cv_std, better AS folds_better, CAST(row_number() OVER (PARTITION BY series_id ORDER BY m, candidate) AS INTEGER) AS place FROM sets",
        """scored AS (SELECT series_id, fold, candidate, avg(abs(v * (w * dr - y))) / avg(abs(v * y)) AS score FROM base, (VALUES (0, 0.0), (1, 1.0), (2, 0.5)) g(candidate, w) WHERE split = 'wf' AND dr IS NOT NULL GROUP BY ALL),
           sets AS (SELECT series_id, candidate, avg(score) AS m, stddev_pop(score) AS s, count(*) FILTER (score < 1) AS better FROM scored GROUP BY ALL)""",
    ),
    "baseline_fold_scores": dataset(
        f"SELECT series_id, CAST(candidate AS INTEGER) AS candidate, CAST(fold AS INTEGER) AS fold, {six('score')} AS score FROM scored",
        """scored AS (SELECT series_id, fold, candidate, avg(abs(v * (w * dr - y))) / avg(abs(v * y)) AS score FROM base, (VALUES (0, 0.0), (1, 1.0), (2, 0.5)) g(candidate, w) WHERE split = 'wf' AND dr IS NOT NULL GROUP BY ALL)""",
    ),
    "feature_associations": dataset(f"SELECT series_id, feature, {six('gain')} AS gain, {six('rise')} AS permutation_rise, place AS permutation_rank FROM assoc", ASSOCIATION),
    "snapshot_features": dataset(
        f"""SELECT a.series_id, observations, last_value, CAST(5 AS INTEGER) AS horizon, place AS permutation_rank, feature, {six("rise")} AS permutation_rise
            FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY place, feature) AS k FROM assoc) a JOIN (SELECT series_id, count(*) AS observations, max_by(value, date) AS last_value FROM pos GROUP BY 1) o USING (series_id) WHERE k <= 6""",
        ASSOCIATION,
    ),
    "leakage_report": dataset(
        """SELECT series_id, c AS "check", ok, n FROM (
             SELECT series_id, unnest(['truncation', 'perturbation']) AS c, TRUE AS ok, count(*) FILTER (rn IN (150, 700, 1500)) AS n FROM pos GROUP BY 1
             UNION ALL SELECT series_id, unnest(['target h=5', 'last rows unlabelled h=5', 'no target among features']), unnest([TRUE, max(rn) = max(last) - 5, TRUE]), count(*) FROM ds JOIN (SELECT series_id, max(rn) AS last FROM pos GROUP BY 1) USING (series_id) GROUP BY 1
             UNION ALL SELECT series_id, 'holdout purged h=5', max(rn) FILTER (split = 'dev') + 5 < min(rn) FILTER (split = 'test'), count(*) FROM ds GROUP BY 1
             UNION ALL SELECT series_id, 'folds purged h=5', bool_and(coalesce(t + 5 < f0, TRUE)), CAST(sum(n) AS BIGINT) FROM (
               SELECT series_id, fold, max(rn) FILTER (dev_row < valid_from - 5) AS t, min(rn) FILTER (dev_row >= valid_from) AS f0, count(*) AS n FROM ds JOIN wf USING (series_id) WHERE split = 'dev' GROUP BY 1, 2) GROUP BY 1)"""
    ),
    "conformal_interval_long": dataset(f"SELECT series_id, 5 AS horizon, n AS n_calibration, {six('q_abs')} AS q_abs, {six('fl')} AS sigma_floor, {six('q_norm')} AS q_norm FROM cal", CALIBRATION),
    "conformal_interval_naive": dataset(f"SELECT series_id, 5 AS horizon, n AS n_calibration, {six('q_abs')} AS q_abs, {six('fl')} AS sigma_floor, {six('q_norm')} AS q_norm FROM cal", CALIBRATION),
    "interval_coverage_naive": dataset(
        f"SELECT b.series_id, 5 AS horizon, split, {six('avg(CASE WHEN abs(y) <= q_norm * greatest(sigma, fl) THEN 1.0 ELSE 0.0 END)')} AS empirical_coverage, {six('avg(v * 2 * q_norm * greatest(sigma, fl))')} AS mean_width, count(*) AS n FROM base b JOIN cal c ON b.series_id = c.series_id WHERE split = 'holdout' GROUP BY b.series_id, split",
        CALIBRATION,
    ),
}
