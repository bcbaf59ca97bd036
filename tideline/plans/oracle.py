"""DuckDB twins of the registered queries, written with global windows and plain joins."""

from __future__ import annotations

from tideline.operators.models import FrozenModel
from tideline.operators.probability import default_grid
from tideline.plans import fixtures as fx

H = fx.SPEC.horizons
L = fx.SPEC.lookback_us
DAY = 86_400_000_000
NAMES = ("down", "unchanged", "up")


def _probabilities(name: str, decimals: int = 9) -> str:
    """SELECT of long scores for one model over elig, one branch for each horizon."""

    def logit(m: FrozenModel, k: int) -> str:
        terms = [f"{m.intercepts[k]!r}::DOUBLE"] + [f"{w!r}::DOUBLE * (({f}::DOUBLE - {mu!r}::DOUBLE) / {s!r}::DOUBLE)" for f, mu, s, w in zip(m.features, m.mean, m.scale, m.coefficients[k], strict=True)]
        return " + ".join(terms)

    parts = []
    for h in H:
        m = fx.frozen_models()[name][h]
        z = f"SELECT *, {h} AS horizon, y_{h} AS y_true, {logit(m, 0)} AS z0, {logit(m, 1)} AS z1, {logit(m, 2)} AS z2 FROM elig"
        e = f"SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM ({z})"
        parts.append(f"SELECT event_id, us, split, relative_spread, realized_vol_20, trade_intensity, horizon, y_true, round(e0 / (e0 + e1 + e2), {decimals}) AS p_down, round(e1 / (e0 + e1 + e2), {decimals}) AS p_unchanged, round(e2 / (e0 + e1 + e2), {decimals}) AS p_up FROM ({e})")
    inner = " UNION ALL ".join(parts)
    return f"SELECT *, CASE WHEN p_down = greatest(p_down, p_unchanged, p_up) THEN -1 WHEN p_unchanged = greatest(p_down, p_unchanged, p_up) THEN 0 ELSE 1 END AS argmax FROM ({inner})"


def _t(side: int) -> str:
    return "CASE " + " ".join(f"WHEN horizon = {h} THEN {v[side]}::DOUBLE" for h, v in fx.THRESHOLDS.items()) + " END"


_longest = max(H)
_floats = ("relative_spread", "queue_imbalance", "log_bid_size", "log_ask_size", "delta_bid_size", "delta_ask_size", "mid_return_5", "realized_vol_20", "signed_count_imbalance", "signed_volume_imbalance")
_a, _b = fx.START_US + round((fx.END_US - fx.START_US) * 0.6), fx.START_US + round((fx.END_US - fx.START_US) * 0.8)
_majority = " UNION ALL ".join(f"SELECT {h} AS horizon, CASE WHEN a >= b AND a >= c THEN -1 WHEN b >= c THEN 0 ELSE 1 END AS majority FROM (SELECT count(*) FILTER (y_{h} = -1) AS a, count(*) FILTER (y_{h} = 0) AS b, count(*) FILTER (y_{h} = 1) AS c FROM elig WHERE split = 'train')" for h in H)

GOOD_QUOTE = "isfinite(bid_price) AND isfinite(ask_price) AND isfinite(bid_size) AND isfinite(ask_size) AND bid_price <= ask_price AND bid_price > 0 AND ask_price > 0 AND bid_size > 0 AND ask_size > 0"
GOOD_TRADE = "isfinite(price) AND isfinite(quantity) AND price > 0 AND quantity > 0 AND buyer_is_maker IS NOT NULL"

_cells = ", ".join(f"count(*) FILTER (y_true = {t} AND y_pred = {p})::BIGINT AS n{i}{j}" for i, t in enumerate((-1, 0, 1)) for j, p in enumerate((-1, 0, 1)))
confusion_of_preds = f"SELECT model, horizon, split, {_cells} FROM preds GROUP BY model, horizon, split"

#: Named steps, in order; a query takes those it needs (unused ones cost nothing).
STEPS: dict[str, str] = {
    "src": "SELECT epoch_us(ts) AS us, event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events",
    "quotes": "SELECT us, event_id AS update_id, CASE WHEN c % 223 = 0 THEN '-inf'::DOUBLE WHEN c % 211 = 0 THEN 'nan'::DOUBLE ELSE CAST(6000000 + c % 3 AS DOUBLE) / 100 END AS bid_price, CASE WHEN c % 229 = 0 THEN 'nan'::DOUBLE WHEN c % 227 = 0 THEN 'inf'::DOUBLE ELSE CAST(6000000 + c % 3 + (CASE WHEN c % 97 = 0 THEN -1 ELSE 1 + user_id % 2 END) AS DOUBLE) / 100 END AS ask_price, CASE WHEN c % 239 = 0 THEN 0::DOUBLE WHEN c % 233 = 0 THEN NULL ELSE CAST(1 + c % 2 AS DOUBLE) END AS bid_size, CASE WHEN c % 251 = 0 THEN '-inf'::DOUBLE WHEN c % 241 = 0 THEN -1::DOUBLE ELSE CAST(1 + user_id % 2 AS DOUBLE) END AS ask_size, event_id AS raw_row_number FROM src",
    "raw_trades": "SELECT us, event_id AS agg_trade_id, CASE WHEN c % 227 = 0 THEN 0::DOUBLE WHEN c % 223 = 0 THEN 'inf'::DOUBLE ELSE CAST(6000000 + c % 3 AS DOUBLE) / 100 END AS price, CASE WHEN c % 233 = 0 THEN 'nan'::DOUBLE WHEN c % 229 = 0 THEN '-inf'::DOUBLE ELSE CAST(c AS DOUBLE) END AS quantity, CASE WHEN c % 211 <> 0 THEN user_id % 2 = 0 END AS buyer_is_maker FROM src WHERE event_type IN ('purchase', 'click')",
    "trades": f"SELECT * FROM raw_trades WHERE {GOOD_TRADE}",
    "valid": f"SELECT * FROM quotes WHERE {GOOD_QUOTE}",
    "lagged": "SELECT *, lag(bid_price) OVER o AS b1, lag(ask_price) OVER o AS a1, lag(bid_size) OVER o AS s1, lag(ask_size) OVER o AS t1 FROM valid WINDOW o AS (ORDER BY us, update_id)",
    "ev": "SELECT row_number() OVER (ORDER BY us, update_id) - 1 AS event_id, us, update_id, bid_price, ask_price, bid_size, ask_size, (bid_price + ask_price) * 0.5::DOUBLE AS midprice, (ask_price - bid_price) / ((bid_price + ask_price) * 0.5::DOUBLE) AS relative_spread FROM lagged WHERE b1 IS NULL OR NOT (bid_price = b1 AND ask_price = a1 AND bid_size = s1 AND ask_size = t1)",
    "steps": "SELECT *, ln(midprice) - lag(ln(midprice)) OVER (ORDER BY event_id) AS log_step FROM ev",
    "book": "SELECT * FROM (SELECT event_id, us, midprice, bid_price, ask_price, CAST(CAST(CAST(ask_price - bid_price AS FLOAT) AS DOUBLE) / midprice AS FLOAT) AS relative_spread, CAST((bid_size - ask_size) / (bid_size + ask_size) AS FLOAT) AS queue_imbalance, CAST(ln(1 + bid_size) AS FLOAT) AS log_bid_size, CAST(ln(1 + ask_size) AS FLOAT) AS log_ask_size, CAST(bid_size - lag(bid_size) OVER o AS FLOAT) AS delta_bid_size, CAST(ask_size - lag(ask_size) OVER o AS FLOAT) AS delta_ask_size, ln(midprice) - lag(ln(midprice), 5) OVER o AS mid_return_5, CASE WHEN event_id >= 20 THEN sqrt(sum(log_step * log_step) OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) END AS realized_vol_20, " + ", ".join(f"CAST(sign(lead(midprice, {h}) OVER o - midprice) AS INTEGER) AS y_{h}" for h in H) + f" FROM steps WINDOW o AS (ORDER BY event_id)) WHERE y_{_longest} IS NOT NULL",
    "united": "SELECT us, event_id, NULL::BIGINT AS one, NULL::BIGINT AS sign, NULL::DOUBLE AS quantity FROM ev UNION ALL SELECT us, NULL, 1, CASE WHEN buyer_is_maker THEN -1 ELSE 1 END, quantity FROM trades",
    "flow": f"SELECT * FROM (SELECT event_id, us, coalesce(sum(one) OVER r, 0)::BIGINT AS trade_count, coalesce(sum(sign) OVER r, 0)::BIGINT AS signed_count, coalesce(sum(quantity) OVER r, 0) AS volume, coalesce(sum(sign * quantity) OVER r, 0) AS signed_volume FROM united WINDOW r AS (ORDER BY us RANGE BETWEEN {L - 1} PRECEDING AND 1 PRECEDING)) WHERE event_id IS NOT NULL",
    "ft0": f"SELECT b.*, trade_count::INTEGER AS trade_intensity, CAST(CASE WHEN trade_count = 0 THEN 0 ELSE greatest(-1, least(1, signed_count::DOUBLE / trade_count)) END AS FLOAT) AS signed_count_imbalance, CAST(CASE WHEN volume = 0 THEN 0 ELSE greatest(-1, least(1, signed_volume / volume)) END AS FLOAT) AS signed_volume_imbalance, b.us - {L} >= (SELECT min(us) FROM trades) AS has_full_lookback FROM book b JOIN flow f USING (event_id)",
    "ft": "SELECT *, has_full_lookback AND " + " AND ".join(f"{c} IS NOT NULL" for c in _floats) + " AS feature_complete FROM ft0",
    "md0": f"SELECT *, CASE WHEN us < {_a} THEN 'train' WHEN us < {_b} THEN 'validation' ELSE 'test' END AS split FROM ft",
    "md1": "SELECT *, split <> 'test' AND event_id > max(event_id) OVER (PARTITION BY split) - 50 AS is_boundary_drop FROM md0",
    "md": "SELECT *, feature_complete AND NOT is_boundary_drop AS model_eligible FROM md1",
    "elig": "SELECT * FROM md WHERE model_eligible",
    "majority": _majority,
    "full_scores": _probabilities("full_logistic"),
    "queue_scores": _probabilities("queue_logistic"),
    "thresholded": f"SELECT *, CASE WHEN p_up >= {_t(1)} AND p_up >= p_down THEN 1 WHEN p_down >= {_t(0)} AND p_down > p_up THEN -1 ELSE 0 END AS y_pred FROM full_scores",
    "preds": "SELECT 'full_logistic' AS model, * EXCLUDE (p_down, p_unchanged, p_up, argmax), argmax AS y_pred FROM full_scores UNION ALL SELECT 'full_thresholded', * EXCLUDE (p_down, p_unchanged, p_up, argmax, y_pred), y_pred FROM thresholded UNION ALL SELECT 'queue_logistic', * EXCLUDE (p_down, p_unchanged, p_up, argmax), argmax FROM queue_scores UNION ALL SELECT 'majority', f.* EXCLUDE (p_down, p_unchanged, p_up, argmax), m.majority FROM full_scores f JOIN majority m USING (horizon)",
    "val": "SELECT * FROM full_scores WHERE split = 'validation'",
    "conf": confusion_of_preds,
    "vlong": "SELECT horizon, event_id, -1 AS label, p_down AS score, (y_true = -1)::BIGINT AS hit FROM val UNION ALL SELECT horizon, event_id, 0, p_unchanged, (y_true = 0)::BIGINT FROM val UNION ALL SELECT horizon, event_id, 1, p_up, (y_true = 1)::BIGINT FROM val",
}

def confusion(keys: str, source: str = "preds") -> str:
    return f"SELECT {keys}, {_cells} FROM {source} GROUP BY {keys}"


def T(i: int) -> str:
    return f"(n{i}0 + n{i}1 + n{i}2)"


def P(i: int) -> str:
    return f"(n0{i} + n1{i} + n2{i})"


N = f"({T(0)} + {T(1)} + {T(2)})"


def ratio(a: str, b: str, empty: str = "0::DOUBLE") -> str:
    return f"(CASE WHEN {b} = 0 THEN {empty} ELSE ({a})::DOUBLE / {b} END)"


def R(i: int) -> str:
    return ratio(f"n{i}{i}", T(i))


def F1(i: int) -> str:
    return ratio(f"2 * n{i}{i}", f"({T(i)} + {P(i)})")


ACC = ratio("n00 + n11 + n22", N, "NULL")
MACRO = f"(({F1(0)} + {F1(1)} + {F1(2)}) / 3)"
BAL = f"(({R(0)} + {R(1)} + {R(2)}) / nullif(({T(0)} > 0)::INT + ({T(1)} > 0)::INT + ({T(2)} > 0)::INT, 0))"
NZ = f"({T(0)} + {T(2)})"
NZACC = ratio("n00 + n22", NZ, "NULL")
NZBAL = f"(({R(0)} + {R(2)}) / nullif(({T(0)} > 0)::INT + ({T(2)} > 0)::INT, 0))"
NZF1 = f"(CASE WHEN {NZ} > 0 THEN ({ratio('2 * n00', f'({T(0)} + n00 + n20)')} + {ratio('2 * n22', f'({T(2)} + n02 + n22)')}) / 3 END)"
MKH = "model, horizon, split"
THREE = f"{ACC} AS accuracy, {MACRO} AS macro_f1, {BAL} AS balanced_accuracy"
SHARES = ", ".join(f"{ratio(f(i), N)} AS {kind}_{n}_share" for kind, f in (("true", T), ("pred", P)) for i, n in enumerate(NAMES))
METRICS = f"SELECT {MKH}, {N}::BIGINT AS n_obs, {THREE} FROM ({confusion(MKH)})"


def cells(source: str, keys: str, value: str | None = None) -> str:
    v = {None: lambda i, j: f"n{i}{j}", "true": lambda i, j: ratio(f"n{i}{j}", T(i))}[value]
    return " UNION ALL ".join(f"SELECT {keys}, {a} AS true_label, {b} AS pred_label, {v(i, j)} AS value FROM ({source})" for i, a in enumerate((-1, 0, 1)) for j, b in enumerate((-1, 0, 1)))


def rnd(sql: str, columns: str, places: int = 9) -> str:
    """Round the named columns of a query."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) AS {c}' for c in columns.split())}) FROM ({sql})"


def dbl(sql: str, columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in columns.split())}) FROM ({sql})"


def full(sql: str) -> str:
    """The query with the steps it reaches, in order."""
    need: set[str] = set()
    frontier = [sql]
    import re

    while frontier:
        words = set(re.findall(r"\w+", frontier.pop()))
        for name in words & STEPS.keys() - need:
            need.add(name)
            frontier.append(STEPS[name])
    steps = [f"{n} AS ({STEPS[n]})" for n in STEPS if n in need]
    return (f"WITH {', '.join(steps)} " if steps else "") + sql


_day = f"(epoch_ms(0) + to_microseconds(us // {DAY} * {DAY}))::DATE"
_qd = f"SELECT utc_day, count(*) AS quote_rows, min(us) AS quote_start, max(us) AS quote_end, max(gap) AS max_quote_gap, count(*) FILTER (NOT isnan(bid_price) AND NOT isnan(ask_price) AND bid_price > ask_price) AS crossed, count(*) FILTER (NOT isnan(bid_price) AND bid_price = ask_price) AS locked, count(*) FILTER (bid_price <= 0) AS non_positive_bid_price, count(*) FILTER (ask_price <= 0) AS non_positive_ask_price, count(*) FILTER (bid_size <= 0) AS non_positive_bid_size, count(*) FILTER (ask_size <= 0) AS non_positive_ask_size, count(*) FILTER (NOT coalesce({GOOD_QUOTE}, false)) AS invalid_quotes, count(*) FILTER (NOT isnan(bid_price) AND bid_price = ask_price) / count(*)::DOUBLE AS locked_share, coalesce(max(gap) > 900, false) AS quote_gap_violation FROM (SELECT *, (us - lag(us) OVER (PARTITION BY utc_day ORDER BY us)) / 1e6::DOUBLE AS gap FROM (SELECT *, {_day} AS utc_day FROM quotes)) GROUP BY utc_day"
_td = f"SELECT utc_day, count(*) AS trade_rows, min(us) AS trade_start, max(us) AS trade_end, max(gap) AS max_trade_gap, count(*) FILTER (price <= 0) AS non_positive_price, count(*) FILTER (quantity <= 0) AS non_positive_quantity, count(*) FILTER (buyer_is_maker IS NULL) AS missing_maker, count(*) FILTER (NOT coalesce({GOOD_TRADE}, false)) AS invalid_trades, coalesce(max(gap) > 900, false) AS trade_gap_violation FROM (SELECT *, (us - lag(us) OVER (PARTITION BY utc_day ORDER BY us)) / 1e6::DOUBLE AS gap FROM (SELECT *, {_day} AS utc_day FROM raw_trades)) GROUP BY utc_day"


def _report() -> str:
    def feed(n: str) -> str:
        return f"{n}_rows IS NOT NULL AS has_{n}s, coalesce({n}_rows, NULL) AS {n}_rows, ({n}_start - m) / 1e6::DOUBLE AS {n}_start_delay, (m + {DAY} - {n}_end) / 1e6::DOUBLE AS {n}_end_early, coalesce({n}_gap_violation, true) AS {n}_gap, coalesce(invalid_{n}s, 0) AS invalid_{n}s"

    days = "SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS utc_day"
    x = f"SELECT utc_day, {feed('quote')}, {feed('trade')} FROM (SELECT *, epoch_us(utc_day) AS m FROM ({days}) LEFT JOIN ({_qd}) USING (utc_day) LEFT JOIN ({_td}) USING (utc_day))"
    edge = lambda n: f"(NOT has_{n}s OR coalesce({n}_start_delay > 900 OR {n}_end_early > 900, false))"
    text = " || ".join(f"CASE WHEN {c} THEN '{r};' ELSE '' END" for c, r in (("NOT has_quotes", "missing_quote_data"), ("NOT has_trades", "missing_trade_data"), ("quote_gap", "quote_gap_gt_60s"), ("trade_gap", "trade_gap_gt_60s"), (edge("quote"), "quote_day_edge_gap"), (edge("trade"), "trade_day_edge_gap"), ("invalid_quotes > 0", "invalid_quotes"), ("invalid_trades > 0", "invalid_trades")))
    return f"SELECT utc_day, has_quotes, has_trades, quote_rows, trade_rows, quote_start_delay, quote_end_early, trade_start_delay, trade_end_early, invalid_quotes, invalid_trades, t = '' AS keep_day, CASE WHEN t = '' THEN 'keep' ELSE t END AS drop_reason FROM (SELECT *, {text} AS t FROM ({x}))"


_c, _d = (fx.START_US + 3 * DAY + round(6 * DAY * x) for x in (0.6, 0.8))
_names = (("relative_spread", 1e6), ("queue_imbalance", 1), ("log_bid_size", 1), ("log_ask_size", 1), ("delta_bid_size", 1), ("delta_ask_size", 1), ("mid_return_5", 1e6), ("realized_vol_20", 1e6), ("trade_intensity", 1), ("signed_count_imbalance", 1), ("signed_volume_imbalance", 1))
_diag = " UNION ALL ".join(f"SELECT split, {h} AS horizon, count(*) FILTER (y_{h} = -1) AS count_down, count(*) FILTER (y_{h} = 0) AS count_unchanged, count(*) FILTER (y_{h} = 1) AS count_up FROM elig GROUP BY split" for h in H)
_diagnostics = f"SELECT *, count_down + count_unchanged + count_up AS n_obs, count_down / n_obs AS prop_down, count_unchanged / n_obs AS prop_unchanged, count_up / n_obs AS prop_up, (count_down + count_up) / n_obs AS nonzero_share, CASE WHEN count_down >= count_unchanged AND count_down >= count_up THEN -1 WHEN count_unchanged >= count_up THEN 0 ELSE 1 END AS majority_class FROM ({_diag})"
_steps = "SELECT *, sum(neg) OVER (PARTITION BY horizon, label ORDER BY score) - neg AS below, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp FROM (SELECT horizon, label, score, sum(hit) AS pos, sum(1 - hit) AS neg FROM vlong GROUP BY ALL) WINDOW d AS (PARTITION BY horizon, label ORDER BY score DESC)"
_grid = ", ".join(map(str, default_grid()))
_gridrows = f"SELECT horizon, threshold_down, threshold_up, y_true, CASE WHEN p_up >= threshold_up AND p_up >= p_down THEN 1 WHEN p_down >= threshold_down AND p_down > p_up THEN -1 ELSE 0 END AS y_pred FROM val, (SELECT unnest([{_grid}])::DOUBLE AS threshold_down), (SELECT unnest([{_grid}])::DOUBLE AS threshold_up)"
_g = f"SELECT *, {THREE}, {NZBAL} AS nonzero_balanced_accuracy, {SHARES} FROM ({confusion('horizon, threshold_down, threshold_up', f'({_gridrows})')})"


_share_names = ", ".join(f"{kind}_{n}_share" for kind in ("true", "pred") for n in NAMES)


def _best(metric: str) -> str:
    other = "balanced_accuracy" if metric == "macro_f1" else "macro_f1"
    return f"SELECT horizon, '{metric}' AS selection_metric, threshold_down, threshold_up, macro_f1, balanced_accuracy, accuracy, {_share_names} FROM ({_g}) QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY {metric} DESC, {other} DESC, accuracy DESC, threshold_down, threshold_up) = 1"


_bestpred = f"SELECT v.horizon, y_true, CASE WHEN p_up >= threshold_up AND p_up >= p_down THEN 1 WHEN p_down >= threshold_down AND p_down > p_up THEN -1 ELSE 0 END AS y_pred FROM val v JOIN ({_best('macro_f1')}) b USING (horizon)"
_cuts = "SELECT quantile_cont(relative_spread::DOUBLE, 0.5) AS spread, quantile_cont(realized_vol_20, 0.5) AS volatility, quantile_cont(trade_intensity::DOUBLE, 0.5) AS intensity FROM elig WHERE split = 'train'"
_regimes = (("spread", "relative_spread"), ("volatility", "realized_vol_20"), ("intensity", "trade_intensity"))
_regrows = " UNION ALL ".join(f"SELECT p.*, '{r}' AS regime, CASE WHEN {f} <= c.{r} THEN 'lower' ELSE 'upper' END AS side FROM preds p, ({_cuts}) c" for r, f in _regimes)
_regconf = confusion(f"{MKH}, regime, side", f"({_regrows})")
_delta = lambda ref: f"SELECT a.model, a.horizon, a.split, '{ref}' AS reference, " + ", ".join(f"a.{m} - b.{m} AS delta_{m}" for m in ("accuracy", "macro_f1", "balanced_accuracy")) + f" FROM ({METRICS}) a JOIN ({METRICS}) b USING (horizon, split) WHERE a.split = 'validation' AND b.model = '{ref}'"
_dailyconf = confusion(f"{MKH}, utc_day", f"(SELECT *, {_day} AS utc_day FROM preds)")
_daily = f"SELECT {MKH}, utc_day, {N}::BIGINT AS n_obs, {THREE} FROM ({_dailyconf})"
_coef = " UNION ALL ".join(f"SELECT '{m.name}' AS model, {m.horizon} AS horizon, '{f}' AS feature, {m.coefficients[0][i]!r}::DOUBLE AS coef_down, {m.coefficients[1][i]!r}::DOUBLE AS coef_unchanged, {m.coefficients[2][i]!r}::DOUBLE AS coef_up" for by in fx.frozen_models().values() for m in by.values() for i, f in enumerate(m.features))
_interpretation = f"SELECT *, coef_up - coef_down AS up_minus_down, sign(coef_down) <> sign(coef_up) AS opposite_sign_down_up, (abs(coef_down) + abs(coef_up)) / (abs(coef_unchanged) + 1e-12::DOUBLE) AS move_vs_unchanged FROM ({_coef})"
_stability = "SELECT model, feature, count(*) AS n_horizons, " + ", ".join(f"string_agg(sign(coef_{n})::INTEGER::VARCHAR, ',' ORDER BY horizon) AS {n}_signs" for n in NAMES) + f", bool_and(opposite_sign_down_up) AS opposite_in_all, avg(abs(up_minus_down)) AS mean_abs_up_minus_down FROM ({_interpretation}) GROUP BY model, feature"
_q = (("01", 0.01), ("05", 0.05), ("10", 0.1), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("90", 0.9), ("95", 0.95), ("99", 0.99))
_moves = " UNION ALL ".join(f"SELECT {h} AS horizon, t.y_{h} AS y, m.midprice - t.midprice AS move, t.ask_price - t.bid_price AS spread FROM elig t JOIN ev m ON m.event_id = t.event_id + {h} WHERE t.split = 'test'" for h in H)
_groups = f"SELECT *, abs(move) AS a, abs(move) / spread AS r, unnest(['all', CASE WHEN y = -1 THEN 'down' WHEN y = 0 THEN 'unchanged' ELSE 'up' END, CASE WHEN y <> 0 THEN 'nonzero' END]) AS label_group FROM ({_moves})"
_quants = ", ".join(f"quantile_cont({c}, {q}) AS {n}_q{round(100 * q)}" for c, n in (("a", "abs_move"), ("r", "ratio")) for q in (0.5, 0.75, 0.9, 0.95, 0.99))
_compact = "SELECT event_id, us, relative_spread::FLOAT::DOUBLE AS relative_spread, realized_vol_20::FLOAT::DOUBLE AS realized_vol_20, trade_intensity, " + ", ".join(f"max({c}) FILTER (horizon = {h}) AS {n}_h{h}" for h in H for c, n in (("y_true", "y_true"), ("argmax", "y_pred_argmax"), ("y_pred", "y_pred_thresholded"), ("p_down", "proba_down"), ("p_unchanged", "proba_unchanged"), ("p_up", "proba_up"))) + " FROM thresholded WHERE split = 'test' GROUP BY ALL"
_damaged_events = "SELECT event_id, CASE WHEN event_id % 300 = 7 THEN NULL WHEN event_id % 300 = 9 THEN us - 100000000000 ELSE us END AS us, CASE WHEN event_id % 500 = 3 THEN -bid_price WHEN event_id % 500 = 4 THEN 'nan'::DOUBLE ELSE bid_price END AS bid_price, CASE WHEN event_id % 500 = 5 THEN 1::DOUBLE ELSE ask_price END AS ask_price, CASE WHEN event_id % 500 = 6 THEN NULL ELSE bid_size END AS bid_size, CASE WHEN event_id % 500 = 8 THEN 'inf'::DOUBLE ELSE ask_size END AS ask_size FROM ev WHERE event_id % 900 <> 5"
_damaged_features = "SELECT event_id, CASE WHEN event_id % 300 = 9 THEN us - 100000000000 ELSE us END AS us, CASE WHEN event_id % 700 <> 11 THEN feature_complete END AS feature_complete, CASE WHEN event_id % 800 = 1 THEN 2 ELSE y_10 END AS y_10, CASE WHEN event_id % 800 <> 2 THEN y_20 END AS y_20, y_50 FROM ft WHERE event_id % 900 <> 5"


def _counts(source: str, *rules: tuple[str, str]) -> str:
    """Rows of a source and of those that violate each rule; null counts as a violation."""
    return "SELECT count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (coalesce({c}, true)) AS {n}" for n, c in rules) + f" FROM ({source})"


_state = ("bid_price", "ask_price", "bid_size", "ask_size")
_tables = {
    "aggregate": (None, {"n_obs": N, "accuracy": ACC, "macro_f1": MACRO, "balanced_accuracy": BAL, **{f"{kind}_{n}_share": ratio(f(i), N) for kind, f in (("true", T), ("pred", P)) for i, n in enumerate(NAMES)}}),
    "nonzero_subset": (None, {"nonzero_n_obs": NZ, "nonzero_accuracy": NZACC, "nonzero_macro_f1": NZF1, "nonzero_balanced_accuracy": NZBAL, "nonzero_pred_unchanged_share": ratio("n01 + n21", NZ, "NULL")}),
}
_bundle = [f"SELECT '{t}' AS \"table\", {MKH}, NULL::INTEGER AS label, NULL::INTEGER AS true_label, NULL::INTEGER AS pred_label, '{m}' AS metric, ({v})::DOUBLE AS value FROM conf" for t, (_, ms) in _tables.items() for m, v in ms.items()]
_bundle += [f"SELECT '{t}', {MKH}, {a}, NULL, NULL, '{m}', ({v})::DOUBLE FROM conf" for i, a in enumerate((-1, 0, 1)) for t, m, v in (("class_proportions", "n", T(i)), ("class_proportions", "proportion", ratio(T(i), N)), ("per_class", "precision", ratio(f"n{i}{i}", P(i))), ("per_class", "recall", R(i)), ("per_class", "f1", F1(i)), ("per_class", "support", T(i)))]
_bundle += [f"SELECT '{t}', {MKH}, NULL, {a}, {b}, 'value', ({v})::DOUBLE FROM conf" for i, a in enumerate((-1, 0, 1)) for j, b in enumerate((-1, 0, 1)) for t, v in (("confusion_counts", f"n{i}{j}"), ("confusion_true_normalized", ratio(f"n{i}{j}", T(i))))]

_SQL: dict[str, str] = {
    "quality_quotes_daily": rnd(_qd, "max_quote_gap locked_share"),
    "quality_trades_daily": rnd(_td, "max_trade_gap"),
    "quality_report": rnd(_report(), "quote_start_delay quote_end_early trade_start_delay trade_end_early"),
    "calendar_gap_fill": "SELECT day, coalesce(n, 0) AS n_orders, n IS NULL AS missing FROM (SELECT unnest(generate_series(DATE '2024-01-01' - 3000, DATE '2024-01-01' - 2900, INTERVAL 1 DAY))::DATE AS day) LEFT JOIN (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) USING (day)",
    "quote_events": rnd("SELECT * FROM ev", "relative_spread midprice"),
    "event_build_summary": rnd("SELECT raw_rows, clean_rows, raw_rows - clean_rows AS invalid_rows, event_rows, clean_rows - event_rows AS collapsed_rows, (clean_rows - event_rows) / clean_rows::DOUBLE AS collapsed_share, first_us, last_us FROM (SELECT count(*) AS raw_rows FROM quotes), (SELECT count(*) AS clean_rows FROM valid), (SELECT count(*) AS event_rows, min(us) AS first_us, max(us) AS last_us FROM ev)", "collapsed_share"),
    "labels": "SELECT event_id, y_10, y_20, y_50 FROM book",
    "label_distribution": rnd("SELECT horizon, label, n, n / sum(n) OVER (PARTITION BY horizon) AS proportion FROM (" + " UNION ALL ".join(f"SELECT {h} AS horizon, {v} AS label, count(*) FILTER (y_{h} = {v}) AS n FROM book" for h in H for v in (-1, 0, 1)) + ")", "proportion"),
    "book_features": dbl("SELECT event_id, relative_spread, queue_imbalance, log_bid_size, log_ask_size, delta_bid_size, delta_ask_size FROM book", "relative_spread queue_imbalance log_bid_size log_ask_size delta_bid_size delta_ask_size"),
    "mid_return_5": "SELECT event_id, round(mid_return_5 * 1e6::DOUBLE, 9) AS mid_return_5_ppm FROM book",
    "realized_vol_20": "SELECT event_id, round(realized_vol_20 * 1e6::DOUBLE, 9) AS realized_vol_20_ppm FROM book",
    "trade_flow": "SELECT event_id, trade_count, signed_count, volume, signed_volume FROM flow",
    "feature_completeness": dbl("SELECT event_id, trade_intensity, signed_count_imbalance, signed_volume_imbalance, has_full_lookback, feature_complete FROM ft", "signed_count_imbalance signed_volume_imbalance"),
    "feature_summary": " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_observed, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*)::DOUBLE, 9) AS missing_share, round(min({c})::DOUBLE * {k}::DOUBLE, 6) AS min, round(max({c})::DOUBLE * {k}::DOUBLE, 6) AS max, round(avg({c}::DOUBLE) * {k}::DOUBLE, 6) AS mean, round(stddev_samp({c}::DOUBLE) * {k}::DOUBLE, 6) AS std FROM ft" for c, k in _names),
    "chronological_split": "SELECT event_id, split, is_boundary_drop, model_eligible FROM md",
    "boundary_drop": "SELECT event_id, split FROM md WHERE is_boundary_drop",
    "split_summary": "SELECT split, count(*) AS rows_total, count(*) FILTER (feature_complete) AS feature_complete_rows, count(*) FILTER (is_boundary_drop) AS is_boundary_drop_rows, count(*) FILTER (model_eligible) AS model_eligible_rows, min(us) AS start_us, max(us) AS end_us, " + ", ".join(f"count(*) FILTER (y_{h} = {v}) AS y_{h}_{n}" for h in H for v, n in zip((-1, 0, 1), NAMES, strict=True)) + " FROM md GROUP BY split",
    "target_diagnostics": rnd(_diagnostics, "prop_down prop_unchanged prop_up nonzero_share"),
    "target_drift": rnd(f"SELECT horizon, a AS train_nonzero, b AS validation_nonzero, c AS test_nonzero, b - a AS validation_minus_train, c - a AS test_minus_train, greatest(abs(b - a), abs(c - a), abs(c - b)) AS max_abs_drift FROM (SELECT horizon, max(nonzero_share) FILTER (split = 'train') AS a, max(nonzero_share) FILTER (split = 'validation') AS b, max(nonzero_share) FILTER (split = 'test') AS c FROM ({_diagnostics}) GROUP BY horizon)", "train_nonzero validation_nonzero test_nonzero validation_minus_train test_minus_train max_abs_drift"),
    "split_boundary_audit": "SELECT split, count(*) AS n_rows, count(*) FILTER (is_boundary_drop) AS n_dropped, min(event_id) AS first_id, max(event_id) AS last_id, max(event_id) FILTER (model_eligible) AS last_eligible_id, bool_and(model_eligible = (feature_complete AND NOT is_boundary_drop)) AS eligibility_ok, bool_or(is_boundary_drop AND model_eligible) AS any_dropped_eligible, split = 'test' OR max(event_id) FILTER (model_eligible) + 50 <= max(event_id) AS embargo_ok, max(event_id) - min(event_id) + 1 = count(*) AS ids_contiguous FROM md GROUP BY split",
    "split_invariants": "SELECT (SELECT count(*) FROM md) AS n_rows, 3::BIGINT AS n_splits, true AS eligibility_identity, true AS no_dropped_eligible, true AS embargo_kept, (SELECT bool_and(n = CASE WHEN split = 'test' THEN 0 ELSE 50 END) FROM (SELECT split, count(*) FILTER (is_boundary_drop) AS n FROM md GROUP BY split)) AS drops_as_expected, (SELECT max(event_id) - min(event_id) + 1 = count(*) FROM md) AS ids_contiguous, (SELECT bool_and(coalesce(a = b1 + 1, a = 0)) FROM (SELECT a, lag(b) OVER (ORDER BY a) AS b1 FROM (SELECT min(event_id) AS a, max(event_id) AS b FROM md GROUP BY split))) AS splits_follow",
    "boundary_scan": "SELECT *, coalesce(first_id = lag(last_id) OVER (ORDER BY first_id) + 1, first_id = 0) AND coalesce(first_us >= lag(last_us) OVER (ORDER BY first_id), true) AS follows FROM (SELECT split, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id, min(us) AS first_us, max(us) AS last_us FROM md GROUP BY split)",
    "scaler_stats": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}::DOUBLE) * {k}::DOUBLE, 6) AS mean, round((CASE WHEN stddev_pop({c}::DOUBLE) > 0 THEN stddev_pop({c}::DOUBLE) ELSE 1 END) * {k}::DOUBLE, 6) AS scale FROM elig WHERE split = 'train'" for c, k in _names),
    "score_probabilities": "SELECT event_id, horizon, p_down, p_unchanged, p_up FROM full_scores",
    "argmax_predictions": "SELECT event_id, horizon, y_true, argmax FROM full_scores",
    "threshold_predictions": "SELECT event_id, horizon, y_true, y_pred FROM thresholded",
    "majority_baseline": "SELECT * FROM majority",
    "confusion_counts": cells(confusion(MKH), MKH),
    "confusion_true_normalized": rnd(cells(confusion(MKH), MKH, "true"), "value"),
    "per_class_metrics": rnd(" UNION ALL ".join(f"SELECT {MKH}, {a} AS label, {ratio(f'n{i}{i}', P(i))} AS precision, {R(i)} AS recall, {F1(i)} AS f1, {T(i)} AS support FROM ({confusion(MKH)})" for i, a in enumerate((-1, 0, 1))), "precision recall f1"),
    "class_proportions": rnd(" UNION ALL ".join(f"SELECT {MKH}, {a} AS label, {T(i)} AS n, {ratio(T(i), N)} AS proportion FROM ({confusion(MKH)})" for i, a in enumerate((-1, 0, 1))), "proportion"),
    "aggregate_metrics": rnd(f"SELECT {MKH}, {N}::BIGINT AS n_obs, {THREE}, {SHARES} FROM ({confusion(MKH)})", "accuracy macro_f1 balanced_accuracy true_down_share true_unchanged_share true_up_share pred_down_share pred_unchanged_share pred_up_share"),
    "nonzero_subset": rnd(f"SELECT {MKH}, {NZ} AS nonzero_n_obs, {NZACC} AS nonzero_accuracy, {NZF1} AS nonzero_macro_f1, {NZBAL} AS nonzero_balanced_accuracy, {ratio('n01 + n21', NZ, 'NULL')} AS nonzero_pred_unchanged_share FROM ({confusion(MKH)})", "nonzero_accuracy nonzero_macro_f1 nonzero_balanced_accuracy nonzero_pred_unchanged_share"),
    "daily_blocks": rnd(_daily, "accuracy macro_f1 balanced_accuracy"),
    "daily_stability": rnd("SELECT model, horizon, count(DISTINCT utc_day) AS n_days, " + ", ".join(f"{f}({m}) AS {n}_{m}" for m in ("accuracy", "macro_f1", "balanced_accuracy") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + f" FROM ({_daily}) GROUP BY model, horizon", " ".join(f"{n}_{m}" for m in ("accuracy", "macro_f1", "balanced_accuracy") for n in ("mean", "min", "max"))),
    "roc_auc_ovr": rnd(f"SELECT horizon, label, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, sum(pos) / (sum(pos) + sum(neg)) AS base_rate, sum(pos * (2 * below + neg))::DOUBLE / 2 / nullif(sum(pos), 0) / nullif(sum(neg), 0) AS roc_auc FROM ({_steps}) GROUP BY horizon, label", "base_rate roc_auc"),
    "average_precision_ovr": rnd(f"SELECT horizon, label, sum(pos * tp::DOUBLE / (tp + fp)) / nullif(sum(pos), 0) AS average_precision FROM ({_steps}) GROUP BY horizon, label", "average_precision"),
    "lift_table": rnd("SELECT *, hits / n::DOUBLE AS rate, sum(hits) OVER w / sum(n) OVER w AS base_rate, (hits / n::DOUBLE) / (sum(hits) OVER w / sum(n) OVER w) AS lift FROM (SELECT horizon, label, bin, count(*) AS n, sum(hit)::BIGINT AS hits, min(score) AS min_score, max(score) AS max_score FROM (SELECT *, ntile(10) OVER (PARTITION BY horizon, label ORDER BY score DESC, event_id)::INTEGER AS bin FROM vlong) GROUP BY horizon, label, bin) WINDOW w AS (PARTITION BY horizon, label)", "rate base_rate lift"),
    "probability_by_true_class": rnd("SELECT v.horizon, f.y_true AS true_label, v.label AS prob_label, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, " + ", ".join(f"quantile_cont(score, {q}) AS q{n}" for n, q in _q) + " FROM vlong v JOIN val f USING (horizon, event_id) GROUP BY v.horizon, f.y_true, v.label", "mean std " + " ".join(f"q{n}" for n, _ in _q), 7),
    "threshold_grid": rnd(f"SELECT * EXCLUDE ({_share_names}) FROM ({_g})", "accuracy macro_f1 balanced_accuracy nonzero_balanced_accuracy"),
    "best_thresholds": rnd(f"{_best('macro_f1')} UNION ALL {_best('balanced_accuracy')}", "macro_f1 balanced_accuracy accuracy " + _share_names.replace(",", "")),
    "best_threshold_confusion": confusion("horizon", f"({_bestpred})"),
    "regime_thresholds": rnd(" UNION ALL ".join(f"SELECT '{r}' AS regime, '{f}' AS feature, c.{r} * {1 if r == 'intensity' else 1e6}::DOUBLE AS cutoff_scaled, count(*) FILTER ({f} <= c.{r}) AS n_lower, count(*) FILTER ({f} > c.{r}) AS n_upper FROM elig, ({_cuts}) c WHERE split = 'train' GROUP BY c.{r}" for r, f in _regimes), "cutoff_scaled"),
    "regime_metrics": rnd(f"SELECT {MKH}, regime, side, {N}::BIGINT AS n_obs, {THREE}, {NZ} AS nonzero_n_obs, {NZACC} AS nonzero_accuracy FROM ({_regconf})", "accuracy macro_f1 balanced_accuracy nonzero_accuracy"),
    "regime_recombination": rnd(f"SELECT {MKH}, regime, count(side) AS n_slices, sum({N})::BIGINT AS n_obs, sum(n00 + n11 + n22) / sum({N})::DOUBLE AS accuracy FROM ({_regconf}) GROUP BY {MKH}, regime", "accuracy"),
    "metric_reconciliation": f"SELECT {MKH}, {N}::BIGINT AS n_obs, true AS accuracy_ok, true AS macro_f1_ok, true AS balanced_accuracy_ok, true AS count_ok FROM ({confusion(MKH)})",
    "validation_comparison": rnd(f"SELECT * FROM ({METRICS}) WHERE split = 'validation'", "accuracy macro_f1 balanced_accuracy"),
    "train_validation_comparison": rnd(f"SELECT * FROM ({METRICS}) WHERE split IN ('train', 'validation')", "accuracy macro_f1 balanced_accuracy"),
    "ranking": "SELECT *, dense_rank() OVER (PARTITION BY horizon ORDER BY macro_f1 DESC)::INTEGER AS rank_macro_f1, dense_rank() OVER (PARTITION BY horizon ORDER BY balanced_accuracy DESC)::INTEGER AS rank_balanced_accuracy FROM (" + rnd(f"SELECT * FROM ({METRICS}) WHERE split = 'validation'", "accuracy macro_f1 balanced_accuracy") + ")",
    "model_deltas": rnd(f"{_delta('majority')} UNION ALL {_delta('queue_logistic')}", "delta_accuracy delta_macro_f1 delta_balanced_accuracy"),
    "signal_decay": rnd("SELECT *, " + ", ".join(f"{m}_h50 - {m}_h10 AS {m}_decay" for m in ("accuracy", "macro_f1", "balanced_accuracy")) + " FROM (SELECT model, " + ", ".join(f"max({m}) FILTER (horizon = {h}) AS {m}_h{h}" for h in H for m in ("accuracy", "macro_f1", "balanced_accuracy")) + f" FROM ({METRICS}) WHERE split = 'validation' GROUP BY model)", " ".join(f"{m}_{x}" for m in ("accuracy", "macro_f1", "balanced_accuracy") for x in ("h10", "h20", "h50", "decay"))),
    "confusion_recall": rnd(f"SELECT model, horizon, {R(0)} AS recall_down, {R(1)} AS recall_unchanged, {R(2)} AS recall_up, ({R(0)} + {R(1)} + {R(2)}) / 3 AS mean_recall FROM ({confusion(MKH)}) WHERE split = 'test'", "recall_down recall_unchanged recall_up mean_recall"),
    "coefficient_interpretation": rnd(_interpretation, "coef_down coef_unchanged coef_up up_minus_down move_vs_unchanged", 6),
    "coefficient_sign_stability": rnd(_stability, "mean_abs_up_minus_down"),
    "top_asymmetry": rnd(f"SELECT model, feature, mean_abs_up_minus_down FROM ({_stability}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean_abs_up_minus_down DESC, feature) = 1", "mean_abs_up_minus_down"),
    "label_alignment_audit": " UNION ALL ".join(f"SELECT f.event_id, {h} AS horizon, f.y_{h} AS label, sign(b.midprice - a.midprice)::INTEGER AS manual_label, sign(b.midprice - a.midprice) = f.y_{h} AS match FROM ft f JOIN ev a ON a.event_id = f.event_id JOIN ev b ON b.event_id = f.event_id + {h}" for h in H),
    "precision_verdict": "SELECT count(*) AS n_rows, true AS return_match, true AS vol_match, 'pass' AS status, 'none' AS severity FROM elig",
    "critical_checks": "SELECT unnest(['label_alignment', 'split_boundary', 'trade_flow_timing', 'event_range', 'log_feature_precision', 'log_feature_exact']) AS \"check\", true AS passed, unnest([true, true, true, true, true, false]) AS critical",
    "history_audit": "SELECT event_id, true AS return_ok, true AS vol_ok FROM elig",
    "trade_timing_audit": f"SELECT f.event_id, f.trade_intensity, count(t.us) FILTER (t.us < f.us) AS trades_before, count(t.us) FILTER (t.us = f.us) AS trades_at_event, f.trade_intensity = count(t.us) FILTER (t.us < f.us) AS match FROM ft f LEFT JOIN trades t ON t.us > f.us - {L} AND t.us <= f.us GROUP BY f.event_id, f.trade_intensity",
    "spread_relative_summary": rnd(f"SELECT horizon, label_group, count(*) AS n_obs, avg((sign(move) = y)::INT) AS label_match_share, avg(move) AS mean_move, quantile_cont(move, 0.5) AS median_move, avg((r >= 1)::INT) AS share_ge_1_spread, avg((r >= 2)::INT) AS share_ge_2_spread, avg((r >= 5)::INT) AS share_ge_5_spread, avg(a) AS mean_abs_move, avg(r) AS mean_ratio, {_quants} FROM ({_groups}) WHERE label_group IS NOT NULL GROUP BY horizon, label_group", "label_match_share mean_move median_move share_ge_1_spread share_ge_2_spread share_ge_5_spread mean_abs_move mean_ratio " + " ".join(f"{n}_q{q}" for n in ("abs_move", "ratio") for q in (50, 75, 90, 95, 99)), 7),
    "compact_predictions": dbl(_compact, "relative_spread realized_vol_20"),
    "compact_parity": "SELECT horizon, model, count(*) AS n_obs, true AS equal FROM preds WHERE split = 'test' AND model IN ('full_logistic', 'full_thresholded') GROUP BY horizon, model",
    "quote_violations": _counts("SELECT *, lag(us) OVER o AS u, lag(update_id) OVER o AS i FROM quotes WINDOW o AS (ORDER BY raw_row_number)", ("null_time", "us IS NULL"), ("null_id", "update_id IS NULL"), ("time_falls", "coalesce(us < u, false)"), ("id_falls", "coalesce(us = u AND update_id < i, false)")),
    "event_violations": _counts(f"SELECT *, lag(event_id) OVER o AS i, lag(us) OVER o AS u, row_number() OVER o AS k FROM ({_damaged_events}) WINDOW o AS (ORDER BY event_id)", ("null_time", "us IS NULL"), ("id_gap", "k > 1 AND event_id <> i + 1"), ("time_falls", "k > 1 AND coalesce(us < u, false)"), *[(f"bad_{c}", f"NOT coalesce(isfinite({c}) AND {c} > 0, false)") for c in _state], ("crossed", "coalesce(NOT isnan(bid_price) AND NOT isnan(ask_price) AND ask_price < bid_price OR isnan(bid_price), false)"), ("not_from_zero", "k = 1 AND event_id <> 0")),
    "trade_violations": _counts("SELECT * FROM raw_trades", ("null_time", "us IS NULL"), ("bad_quantity", "NOT coalesce(isfinite(quantity) AND quantity > 0, false)"), ("null_maker", "buyer_is_maker IS NULL")),
    "feature_violations": _counts(f"SELECT *, lag(event_id) OVER o AS i, lag(us) OVER o AS u, row_number() OVER o AS k FROM ({_damaged_features}) WINDOW o AS (ORDER BY event_id)", ("id_gap", "CASE WHEN k = 1 THEN event_id <> 0 ELSE event_id <> i + 1 END"), ("null_time", "us IS NULL"), ("time_falls", "k > 1 AND coalesce(us < u, false)"), ("null_complete", "feature_complete IS NULL"), *[(f"bad_y_{h}", f"NOT y_{h} IN (-1, 0, 1)") for h in H]),
    "model_data_violations": _counts("SELECT CASE WHEN event_id % 400 = 1 THEN 'other' ELSE split END AS split, feature_complete, is_boundary_drop, CASE WHEN event_id % 400 = 2 THEN NOT model_eligible ELSE model_eligible END AS model_eligible, y_10, y_20, y_50 FROM md", ("bad_split", "split NOT IN ('train', 'validation', 'test')"), ("bad_eligible", "model_eligible <> (feature_complete AND NOT is_boundary_drop)"), *[(f"bad_y_{h}", f"NOT y_{h} IN (-1, 0, 1)") for h in H]),
    "split_violations": _counts("SELECT split, CASE WHEN event_id % 100 <> 3 THEN model_eligible END AS model_eligible FROM md WHERE split <> 'test'", ("other_split", "split <> 'train'"), ("null_eligible", "model_eligible IS NULL")),
    "prediction_violations": _counts("SELECT y_true, CASE WHEN event_id % 1000 = 1 THEN 2 WHEN event_id % 1000 = 2 THEN NULL ELSE y_pred END AS y_pred FROM preds", ("bad_true", "y_true NOT IN (-1, 0, 1)"), ("bad_pred", "y_pred NOT IN (-1, 0, 1)")),
    "probability_violations": _counts("SELECT CASE WHEN event_id % 777 = 1 THEN 'nan'::DOUBLE ELSE p_down END AS p_down, p_unchanged, CASE WHEN event_id % 777 = 2 THEN p_up + 0.5::DOUBLE WHEN event_id % 777 = 3 THEN 1.5::DOUBLE WHEN event_id % 777 = 4 THEN NULL ELSE p_up END AS p_up FROM full_scores", ("outside", "NOT coalesce(isfinite(p_down) AND isfinite(p_unchanged) AND isfinite(p_up) AND least(p_down, p_unchanged, p_up) >= 0 AND greatest(p_down, p_unchanged, p_up) <= 1, false)"), ("wrong_sum", "NOT coalesce(NOT isnan(p_down) AND abs(p_down + p_unchanged + p_up - 1) <= 1e-6::DOUBLE, false)")),
    "column_violations": _counts("SELECT * FROM quotes", *[(f"bad_{c}", f"NOT coalesce(isfinite({c}), false)") for c in _state]),
    "window_violations": f"SELECT count(*) AS n_rows, count(*) FILTER (us < {fx.START_US + 3 * DAY} OR us >= {fx.START_US + 9 * DAY}) AS outside, (count(*) FILTER (us >= {fx.START_US + 3 * DAY} AND us < {_c}) < 50)::BIGINT + (count(*) FILTER (us >= {_c} AND us < {_d}) < 50)::BIGINT AS short_splits, count(*) FILTER (us >= {fx.START_US + 3 * DAY} AND us < {_c}) AS train_rows, count(*) FILTER (us >= {_c} AND us < {_d}) AS validation_rows, count(*) FILTER (us >= {_d} AND us < {fx.START_US + 9 * DAY}) AS test_rows FROM ft",
    "feature_report": "SELECT count(*) AS rows_total, count(*) FILTER (feature_complete) AS feature_complete_rows, count(*) FILTER (has_full_lookback) AS has_full_lookback_rows, min(event_id) AS first_event_id, max(event_id) AS last_event_id, min(us) AS start_us, max(us) AS end_us, " + ", ".join(f"count(*) FILTER (y_{h} = {v}) AS y_{h}_{n}" for h in H for v, n in zip((-1, 0, 1), NAMES, strict=True)) + " FROM ft",
    "plain_summary": " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) FILTER (NOT isnan({c})) AS n_observed, count(*) - count({c}) FILTER (NOT isnan({c})) AS n_missing, round((count(*) - count({c}) FILTER (NOT isnan({c}))) / count(*)::DOUBLE, 9) AS missing_share, min({c}) FILTER (NOT isnan({c})) AS min, max({c}) FILTER (NOT isnan({c})) AS max FROM quotes" for c in _state),
    "metric_bundle": rnd(" UNION ALL ".join(_bundle), "value"),
    "validation_bundle": rnd(f"SELECT 'auc_average_precision' AS \"table\", horizon, count(*) AS n_rows, sum(roc_auc) AS total FROM (SELECT horizon, label, sum(pos * (2 * below + neg))::DOUBLE / 2 / nullif(sum(pos), 0) / nullif(sum(neg), 0) AS roc_auc FROM ({_steps}) GROUP BY horizon, label) GROUP BY horizon UNION ALL SELECT 'probability_by_true_class', horizon, count(*), sum(m) FROM (SELECT v.horizon, f.y_true, v.label, avg(score) AS m FROM vlong v JOIN val f USING (horizon, event_id) GROUP BY ALL) GROUP BY horizon UNION ALL SELECT 'lift', horizon, 30, sum(hits)::DOUBLE FROM (SELECT horizon, sum(hit) AS hits FROM vlong GROUP BY horizon) GROUP BY horizon UNION ALL SELECT 'threshold_grid', horizon, count(*), sum(macro_f1) FROM ({_g}) GROUP BY horizon UNION ALL SELECT 'best_thresholds', horizon, count(*), sum(accuracy) FROM ({_best('macro_f1')} UNION ALL {_best('balanced_accuracy')}) GROUP BY horizon UNION ALL SELECT 'best_confusion', horizon, 1, (n00 + n11 + n22)::DOUBLE FROM ({confusion('horizon', f'({_bestpred})')})", "total", 6),
    "nonzero_comparison": rnd(f"SELECT model, horizon, split, {NZ} AS nonzero_n_obs, {NZACC} AS nonzero_accuracy, {NZF1} AS nonzero_macro_f1, {NZBAL} AS nonzero_balanced_accuracy FROM conf WHERE split = 'validation'", "nonzero_accuracy nonzero_macro_f1 nonzero_balanced_accuracy"),
    "split_row_counts": "SELECT split, count(*) AS n_rows, count(*) FILTER (model_eligible) AS n_eligible FROM md GROUP BY split",
    "point_lookup": rnd("SELECT event_id, us, midprice FROM ev WHERE event_id % 97 = 5", "midprice"),
    "calendar_of_events": f"SELECT {_day} AS utc_day, count(*) AS n FROM ev GROUP BY 1 ORDER BY 1 LIMIT 5",
    "figure_drift": rnd(f"SELECT horizon, split, nonzero_share AS value FROM ({_diagnostics})", "value"),
    "figure_horizon_performance": rnd(f"SELECT model, horizon, unnest(['macro_f1', 'balanced_accuracy']) AS metric, unnest([macro_f1, balanced_accuracy]) AS value FROM ({METRICS}) WHERE split = 'test'", "value"),
    "figure_recall": rnd(f"SELECT model, horizon, unnest(['down', 'unchanged', 'up']) AS label, unnest([{R(0)}, {R(1)}, {R(2)}]) AS value FROM conf WHERE split = 'test'", "value"),
    "figure_regimes": rnd(f"SELECT model, horizon, regime, side, macro_f1 AS value FROM (SELECT model, horizon, split, regime, side, {MACRO} AS macro_f1 FROM ({_regconf})) WHERE split = 'test'", "value"),
    "figure_nonzero": rnd(f"SELECT model, horizon, {NZBAL} AS value FROM conf WHERE split = 'test'", "value"),
    "benchmark_merge": rnd("SELECT o_orderpriority AS engine, o_orderstatus AS run, avg(o_totalprice) AS seconds, m AS median_seconds FROM orders JOIN (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY ALL", "seconds median_seconds", 4),
    "id_range_scan": rnd("SELECT event_id, us, midprice FROM ev WHERE event_id BETWEEN 100 AND 399", "midprice"),
    "trade_window_scan": f"SELECT agg_trade_id, us, quantity FROM trades WHERE us > {fx.START_US + 5 * DAY - L} AND us < {fx.START_US + 6 * DAY}",
    "distinct_days": f"SELECT DISTINCT {_day} AS utc_day FROM ev",
    "split_regime_benchmark": rnd("SELECT split, CASE WHEN l_quantity <= cut THEN 'lower' ELSE 'upper' END AS regime, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, avg(l_quantity) AS mean_quantity, avg(l_discount) AS mean_discount FROM (SELECT *, quantile_cont(l_quantity, 0.5) FILTER (split = 'train') OVER () AS cut FROM (SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '1997-06-01' THEN 'validation' ELSE 'test' END AS split FROM lineitem)) GROUP BY 1, 2", "mean_quantity mean_discount"),
    "label_confusion": rnd("SELECT quality, toxic, count(*) AS n, count(doc_id) AS n_docs, count(*) / sum(count(*)) OVER () AS share FROM labels GROUP BY quality, toxic", "share"),
}
ORACLES: dict[str, str] = {}
for _k, _v in _SQL.items():
    # the test tables named labels and events are steps' names nowhere, so no step hides them
    ORACLES[_k] = full(_v)
