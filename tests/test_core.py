"""Cases from the operators' definitions, and small differential checks."""

import math
import random
import re
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.functions.scalar import dates_between, parse_date, parse_horizons, parse_splits, threshold_label, window_us
from tideline.operators import audit, events, features, metrics, probability, quality, ranks, regimes, splits, timerange, validate
from tideline.operators.models import FrozenModel, logits_by_horizon, score
from tideline.operators.ordering import bucket_width
from tideline.plans import catalog
from tideline.plans import fixtures as fx
from tideline.plans.spec import BOOK_STATE, FEATURES, SPLITS, Spec
from tideline.sources import staging

QUOTES = "us long, update_id long, bid_price double, ask_price double, bid_size double, ask_size double"
DAY = 86_400_000_000
SMOKE_DIR = "/root/testdata/sf0.001"


def plain_events(rows):
    """Collapse by a loop: the valid rows whose state differs from the valid row before."""
    out, last = [], None
    for us, i, *state in sorted(rows, key=lambda r: r[:2]):
        if all(x is not None and math.isfinite(x) and x > 0 for x in state) and state[0] <= state[1]:
            if state != last:
                out.append(i)
            last = state
    return out


def test_collapse_equals_a_loop(spark):
    rng = random.Random(51)
    odd = [None, math.nan, math.inf, -1.0, 0.0]
    rows = [(rng.randrange(400), i, *[rng.choice([7.0, 8.0, 9.0]) if rng.random() < 0.93 else rng.choice(odd) for _ in BOOK_STATE]) for i in range(500)]
    q = spark.createDataFrame(rows, QUOTES)
    want = plain_events(rows)
    for width in (None, 13):  # one bucket, and states carried from bucket to bucket
        got = events.build_events(q, width).orderBy("event_id").collect()
        assert [r.update_id for r in got] == want and [r.event_id for r in got] == list(range(len(want)))
    s = events.build_summary(q, events.build_events(q)).first()
    valid = sum(all(x is not None and math.isfinite(x) and x > 0 for x in r[2:]) and r[2] <= r[3] for r in rows)
    assert (s.raw_rows, s.clean_rows, s.event_rows, s.collapsed_rows) == (500, valid, len(want), valid - len(want))


def test_composites_check_their_input(spark):
    ordered = [(10 * i, i, 5.0, 6.0, 1.0 + i, 1.0, i) for i in range(4)]
    schema = QUOTES + ", raw_row_number long"
    assert events.build_events(spark.createDataFrame(ordered, schema), check=True).count() == 4
    for at, change in ((2, (5, 2)), (2, (10, 0)), (1, (None, 1)), (3, (30, None))):
        bad = list(ordered)
        bad[at] = (*change, *ordered[at][2:])
        with pytest.raises(ValueError, match="quotes"):
            events.build_events(spark.createDataFrame(bad, schema), check=True)
    with pytest.raises(ValueError, match="no valid quote"):
        events.build_events(spark.createDataFrame([(1, 1, 9.0, 8.0, 1.0, 1.0, 0)], schema), check=True)
    with pytest.raises(ValueError, match="missing"):
        events.build_events(spark.createDataFrame(ordered, schema).drop("update_id"), check=True)
    e = events.build_events(spark.createDataFrame(ordered, schema))
    t = spark.createDataFrame([(1, 2.0, True)], "us long, quantity double, buyer_is_maker boolean")
    for bad_events, bad_trades in ((e.where("event_id != 1"), t), (e, t.withColumn("quantity", F.lit(math.inf))), (e, t.withColumn("buyer_is_maker", F.lit(None).cast("boolean"))), (e, t.limit(0)), (e.withColumn("us", -F.col("us")), t)):
        with pytest.raises(ValueError):
            features.build_features(bad_events, bad_trades, Spec())
    with pytest.raises(TypeError):
        validate.check_trades(t.withColumn("buyer_is_maker", F.lit("yes")))


def test_trades_of_the_open_interval(spark):
    rng = random.Random(52)
    times = sorted(rng.sample(range(3000), 40))
    trades = [(rng.randrange(-200, 3000), float(rng.randrange(1, 9)), rng.random() < 0.5) for _ in range(300)]
    e = spark.createDataFrame(list(enumerate(times)), "event_id long, us long")
    t = spark.createDataFrame(trades, "us long, quantity double, buyer_is_maker boolean")
    for bucket in (None, 250):
        for r in timerange.trade_flow(e, t, 200, bucket).collect():
            near = [x for x in trades if r.us - 200 < x[0] < r.us]
            sign = [-1 if m else 1 for _, _, m in near]
            assert (r.trade_count, r.signed_count, r.volume, r.signed_volume) == (len(near), sum(sign), sum(x[1] for x in near), sum(s * x[1] for s, x in zip(sign, near, strict=True)))


@pytest.mark.parametrize("lookback", [1, 7, 900])
def test_trade_flow_takes_running_sums(spark, lookback):
    """Ties, negative times, many trades in an interval; no frame is summed anew for each event."""
    rng = random.Random(lookback)
    times = sorted(rng.choices(range(-500, 1500), k=120))
    trades = [(rng.randrange(-900, 1500), float(rng.randrange(1, 9)), rng.random() < 0.5) for _ in range(600)]
    e = spark.createDataFrame(list(enumerate(times)), "event_id long, us long")
    t = spark.createDataFrame(trades, "us long, quantity double, buyer_is_maker boolean")
    for bucket in (None, 1000):
        flow = timerange.trade_flow(e, t, lookback, bucket)
        frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", flow._jdf.queryExecution().executedPlan().toString())
        assert frames and all(f.startswith("unboundedpreceding") for f in frames)
        got = flow.orderBy("event_id").collect()
        assert [(r.event_id, r.us) for r in got] == list(enumerate(times))
        for r in got:
            near = [x for x in trades if r.us - lookback < x[0] < r.us]
            sign = [-1 if m else 1 for _, _, m in near]
            assert (r.trade_count, r.signed_count, r.volume, r.signed_volume) == (len(near), sum(sign), sum(x[1] for x in near), sum(s * x[1] for s, x in zip(sign, near, strict=True)))


#: Bytes of a method beyond which HotSpot does not compile it.
JIT_BYTES = 8000


def method_sizes(df):
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]


def test_projected_rows_are_computed_once(spark):
    """Filters hold no rule of a projected column again, and their code can be compiled."""
    for rows in (fx.quotes(spark, SMOKE_DIR).where(events.valid_quote()), fx.trades(spark, SMOKE_DIR)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("round(") == 1
        assert max(method_sizes(rows)) < JIT_BYTES


def test_scores_by_horizon(spark):
    """The same bits as the logits of each horizon's model, in code that can be compiled."""
    features_of = {f: (F.rand(i) - 0.5).cast("float" if i % 2 else "double") for i, f in enumerate(FEATURES)}
    data = spark.range(200).select(F.col("id").alias("event_id"), F.lit(0).alias("us"), F.lit("test").alias("split"), *[c.alias(f) for f, c in features_of.items()], *[(F.col("id") % (2 + i) - 1).cast("int").alias(f"y_{h}") for i, h in enumerate(fx.SPEC.horizons)]).localCheckpoint()
    for name, of in fx.frozen_models().items():
        got = {(r.event_id, r.horizon): r[2:] for r in logits_by_horizon(data, of, ["event_id"]).collect()}
        assert len(got) == 600
        for h, m in of.items():
            for r in data.select("event_id", f"y_{h}", *m.logits()).collect():
                assert got[r.event_id, h] == r[1:]
        assert max(method_sizes(fx.score_rows(data.withColumn("trade_intensity", F.col("trade_intensity").cast("int")), name))) < JIT_BYTES
    two = {10: fx.frozen_models()["full_logistic"][10], 20: fx.frozen_models()["queue_logistic"][20]}
    with pytest.raises(ValueError, match="same features"):
        logits_by_horizon(data, two, ["event_id"])


def test_confusion_without_written_predictions(spark, monkeypatch):
    monkeypatch.setattr(staging, "_kept", {})
    got = {(r.model, r.horizon, r.split): [r[c] for c in metrics.CELLS] for r in fx.prediction_confusion(spark, SMOKE_DIR).collect()}
    assert "predictions" not in {name for _, name, _ in staging._kept}
    want = {}
    for r in fx.predictions(spark, SMOKE_DIR).collect():
        want.setdefault((r.model, r.horizon, r.split), [0] * 9)[3 * (r.y_true + 1) + r.y_pred + 1] += 1
    assert got == want


def test_threshold_predictions_score_one_model(spark, monkeypatch):
    monkeypatch.setattr(staging, "_kept", {})
    got = catalog.QUERIES["threshold_predictions"](spark, SMOKE_DIR)
    assert {name for _, name, _ in staging._kept} == {"events", "features", "model-data", "scores-full_logistic"}
    scores = {(r.event_id, r.horizon): r for r in fx.scored(spark, SMOKE_DIR).collect()}
    rows = got.collect()
    assert len(rows) == len(scores) > 0
    for r in rows:
        s, (t_down, t_up) = scores[r.event_id, r.horizon], fx.THRESHOLDS[r.horizon]
        want = 1 if s.p_up >= t_up and s.p_up >= s.p_down else -1 if s.p_down >= t_down and s.p_down > s.p_up else 0
        assert (r.y_true, r.y_pred) == (s.y_true, want)


def test_bucketed_features_equal_one_bucket(spark):
    rows = [(i, i * 1000, 100 + (i * 7 % 5) * 0.5, 101 + (i * 7 % 5) * 0.5, 1.0 + i % 3, 2.0, 100.5 + (i * 7 % 5) * 0.5) for i in range(200)]
    e = spark.createDataFrame(rows, "event_id long, us long, bid_price double, ask_price double, bid_size double, ask_size double, midprice double")
    one, many = (features.book_and_labels(e, Spec(), b).orderBy("event_id").collect() for b in (1 << 20, 37))
    assert one == many and len(one) == 150
    mids = [r[6] for r in rows]
    steps = [math.log(b) - math.log(a) for a, b in zip(mids, mids[1:], strict=False)]
    assert one[20].realized_vol_20 == pytest.approx(math.sqrt(sum(x * x for x in steps[:20])), abs=1e-15)
    assert one[19].realized_vol_20 is None
    table = features.book_and_labels(e, Spec())
    again = audit.history_features(table, e, bucket=31).collect()
    assert len(again) == 130 and all(r.return_ok and r.vol_ok and r.return_error < 1e-12 and r.return_error_float < 1e-5 for r in again)
    assert audit.precision_verdict(audit.history_features(table, e)).first().status == "pass"
    wrong = table.withColumn("mid_return_5", F.col("mid_return_5") + 1e-7)
    assert audit.precision_verdict(audit.history_features(wrong, e)).first().status == "pass_with_precision_warning"
    assert audit.precision_verdict(audit.history_features(wrong.withColumn("realized_vol_20", F.lit(1.0)), e)).first().severity == "critical"
    assert bucket_width(e, rows=50) == math.ceil(199_001 / 4) and bucket_width(e.limit(0)) == DAY


def test_daily_quality(spark):
    rows = [(s * 1_000_000, i, 3.0, 4.0, 1.0, 1.0) for i, s in enumerate((5, 9, 200, 86_399, 86_401, 86_500))] + [(86_450_000_000, 9, math.inf, 4.0, -math.inf, 1.0), (86_460_000_000, 10, math.nan, 4.0, None, 0.0), (86_470_000_000, 11, 4.0, 4.0, 1.0, 1.0)]
    q = spark.createDataFrame(rows, QUOTES)
    t = spark.createDataFrame([(7_000_000, math.inf, 1.0, True), (8_000_000, 0.0, -math.inf, None)], "us long, price double, quantity double, buyer_is_maker boolean")
    by = {r.utc_day.day: r for r in quality.quotes_by_day(q, Spec()).collect()}
    assert by[1].max_quote_gap == 86_199.0 and by[2].max_quote_gap == 49.0  # the gap over midnight is of no day
    assert (by[2].crossed, by[2].locked, by[2].non_positive_bid_size, by[2].non_positive_ask_size, by[2].invalid_quotes) == (1, 1, 1, 1, 2)
    trades = quality.trades_by_day(t, Spec()).first()
    assert (trades.non_positive_price, trades.non_positive_quantity, trades.missing_maker, trades.invalid_trades) == (1, 1, 1, 2)
    report = quality.combine_reports(quality.quotes_by_day(q, Spec()), quality.trades_by_day(t, Spec()), Spec(), date(1970, 1, 1), date(1970, 1, 3)).orderBy("utc_day").collect()
    assert [r.keep_day for r in report] == [False] * 3 and "quote_gap_gt_60s;" in report[0].drop_reason and "missing_trade_data;" in report[1].drop_reason and not report[2].has_quotes
    with pytest.raises(ValueError):
        quality.require_kept(quality.combine_reports(quality.quotes_by_day(q, Spec()), quality.trades_by_day(t, Spec()), Spec()))
    twice = quality.quotes_by_day(q, Spec()).union(quality.quotes_by_day(q, Spec()))
    with pytest.raises(Exception, match="not unique"):
        quality.combine_reports(twice, quality.trades_by_day(t, Spec()), Spec()).collect()


def plain_metrics(pairs):
    n = len(pairs)
    recall, f1 = [], []
    for c in (-1, 0, 1):
        hit, true, pred = sum(t == p == c for t, p in pairs), sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
        f1.append(2 * hit / (true + pred) if true + pred else 0.0)
        if true:
            recall.append(hit / true)
    return sum(t == p for t, p in pairs) / n, sum(f1) / 3, sum(recall) / len(recall)


def test_metrics_against_plain_counts(spark):
    rng = random.Random(53)
    groups = {k: [(rng.choice(c), rng.choice((-1, 0, 1))) for _ in range(40)] for k, c in (("all", (-1, 0, 1)), ("no up", (-1, 0)), ("flat", (0,)))}
    p = spark.createDataFrame([(k, t, y) for k, g in groups.items() for t, y in g], "k string, y_true int, y_pred int")
    wide = metrics.confusion(p, ["k"])
    for r in metrics.nonzero_metrics(metrics.aggregate_metrics(wide)).collect():
        assert (r.accuracy, r.macro_f1, r.balanced_accuracy) == pytest.approx(plain_metrics(groups[r.k]))
        moved = [x for x in groups[r.k] if x[0]]
        assert r.nonzero_n_obs == len(moved) and r.nonzero_accuracy == (pytest.approx(sum(a == b for a, b in moved) / len(moved)) if moved else None)
    assert all(r.accuracy_ok and r.macro_f1_ok and r.balanced_accuracy_ok and r.count_ok for r in metrics.reconcile(wide, ["k"]).collect())
    rows = {m: {(r.k, r.true_label, r.pred_label): r.value for r in metrics.confusion_rows(wide, ["k"], m).collect()} for m in (None, "true", "pred", "all")}
    for (k, t, y), n in rows[None].items():
        assert n == groups[k].count((t, y)) and rows["all"][k, t, y] == pytest.approx(n / 40)
        assert rows["pred"][k, t, y] == pytest.approx(n / max(1, sum(b == y for _, b in groups[k])))
    both = metrics.merge(metrics.confusion(p.where("y_true = 0"), ["k"]).union(metrics.confusion(p.where("y_true != 0"), ["k"])), ["k"])
    assert sorted(both.collect()) == sorted(wide.collect())
    stacked = metrics.stacked(metrics.evaluation_tables(wide, ["k"]), ["k"])
    assert stacked.where("table = 'aggregate' and metric = 'n_obs'").agg(F.sum("value")).first()[0] == 120


def scores(spark, n, seed, ties=False):
    rng, rows = random.Random(seed), []
    for i in range(n):
        p = [rng.expovariate(1) for _ in range(3)]
        p = [round(x / sum(p), 1 if ties else 9) for x in p]
        rows.append((i, rng.choice((10, 20)), rng.choice((-1, 0, 1)), *p))
    return rows, spark.createDataFrame(rows, "event_id long, horizon int, y_true int, p_down double, p_unchanged double, p_up double")


def test_grid_equals_every_pair_counted(spark):
    _, s = scores(spark, 250, 54, ties=True)
    grid = (0.0, 0.2, 0.3, 0.55, 1.0)
    found = {(r.horizon, r.threshold_down, r.threshold_up): r for r in probability.threshold_grid(s, ["horizon"], grid).collect()}
    assert len(found) == 50
    for d in grid:
        for u in grid:
            for want in metrics.confusion(s.withColumn("y_pred", threshold_label(F.col("p_down"), F.col("p_up"), d, u)), ["horizon"]).collect():
                assert all(found[want.horizon, d, u][c] == want[c] for c in metrics.CELLS)
    with pytest.raises(ValueError):
        probability.check_grid((0.1, 1.5))


@pytest.mark.parametrize("ties", [False, True])
def test_ranges_change_nothing(spark, ties):
    """AUC, precision, lift and quantiles with one range and with many, against plain loops."""
    rows, s = scores(spark, 300, 55, ties)
    for n in (1, 64):
        for r in probability.auc_and_precision(s, ["horizon"], n).collect():
            column = {-1: 3, 0: 4, 1: 5}[r.label]
            x = [(row[column], row[2] == r.label) for row in rows if row[1] == r.horizon]
            pos, neg = [v for v, h in x if h], [v for v, h in x if not h]
            assert r.roc_auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
            assert r.average_precision == pytest.approx(sum(sum(v >= a for v in pos) / sum(v >= a for v, _ in x) for a in pos) / len(pos))
        got = {(r.horizon, r.label, r.bin): r for r in probability.lift_table(s, ["horizon"], 7, ranges=n).collect()}
        for h in (10, 20):
            for label, column in ((-1, 3), (0, 4), (1, 5)):
                x = sorted((-row[column], row[0], row[2] == label) for row in rows if row[1] == h)
                size, extra, at = len(x) // 7, len(x) % 7, 0
                for b in range(7):
                    part = x[at : at + size + (b < extra)]
                    at += len(part)
                    r = got[h, label, b + 1]
                    assert (r.n, r.hits, r.min_score, r.max_score) == (len(part), sum(p[2] for p in part), -part[-1][0], -part[0][0])
        for r in ranks.quantiles(s, ["horizon"], "p_up", (0.0, 0.25, 0.5, 0.99, 1.0), n).collect():
            x = sorted(row[5] for row in rows if row[1] == r.horizon)
            for i, q in enumerate((0.0, 0.25, 0.5, 0.99, 1.0)):
                at = q * (len(x) - 1)
                assert r[f"q{i}"] == pytest.approx(x[math.floor(at)] + (x[math.ceil(at)] - x[math.floor(at)]) * (at - math.floor(at)), abs=1e-12)


def test_no_range_holds_many_rows(spark):
    values = spark.range(20_000).select(F.lit(1).alias("k"), F.rand(3).alias("v"), F.lit(1).alias("n"))
    edges = values.groupBy("k").agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 6400).alias("e"))
    sizes = values.join(edges, "k").select(F.size(F.filter("e", lambda e: e < F.col("v"))).alias("r")).groupBy("r").count().collect()
    assert max(r["count"] for r in sizes) <= 2 / 64 * 20_000


def test_regime_cutoffs(spark):
    rng = random.Random(56)
    rows = [(rng.choice((0.1, 0.2, 0.3)), rng.random(), rng.randrange(6)) for _ in range(101)]
    d = spark.createDataFrame(rows, "relative_spread double, realized_vol_20 double, trade_intensity int")
    for n in (1, 16):
        got = {r.regime: r for r in regimes.train_medians(d, ranges=n).collect()}
        for i, name in enumerate(("spread", "volatility", "intensity")):
            x = sorted(r[i] for r in rows)
            assert got[name].cutoff == x[50] and got[name].n_lower == sum(v <= x[50] for v in x) and got[name].n_upper == sum(v > x[50] for v in x)
    regimes.check_cutoffs(regimes.train_medians(d))
    with pytest.raises(ValueError):
        regimes.check_cutoffs(regimes.train_medians(d).where("regime != 'spread'"))
    with pytest.raises(ValueError):
        regimes.check_regimes(d.withColumn("realized_vol_20", F.lit(math.nan)))
    p = d.withColumns({"y_true": F.when(F.col("realized_vol_20") < 0.4, -1).otherwise(1), "y_pred": F.when(F.col("realized_vol_20") < 0.6, -1).otherwise(0), "m": F.lit("m")})
    medians = regimes.train_medians(d)
    want = metrics.confusion(regimes.slice_rows(p, medians), ["m", "regime", "side"]).collect()
    assert sorted(map(str, regimes.regime_confusion(p, medians, ["m"]).select(*metrics.confusion(regimes.slice_rows(p, medians), ["m", "regime", "side"]).columns).collect())) == sorted(map(str, want))


def feature_rows(spark, n):
    rows = [(i, i * 1000, True, 1, 0, -1) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, us long, feature_complete boolean, y_10 int, y_20 int, y_50 int")


def test_splits(spark):
    f = feature_rows(spark, 1000)
    got = splits.assign_splits(f, 0, 1_000_000, Spec())
    assert {r.split: (r.n_rows, r.n_eligible) for r in splits.row_counts(got).collect()} == {"train": (600, 550), "validation": (200, 150), "test": (200, 200)}
    flags = splits.invariants(got, Spec()).first()
    assert flags.n_splits == 3 and all(flags[c] for c in flags.asDict() if c not in ("n_rows", "n_splits"))
    manifest = splits.dataset_manifest(got, Spec(), 0, 1_000_000)
    assert list(manifest["splits"]) == list(SPLITS) and manifest["rows_total"] == 1000 and manifest["boundaries"]["train_end_us"] == 600_000
    with pytest.raises(ValueError, match="outside"):
        splits.assign_splits(f, 0, 999_000, Spec())
    with pytest.raises(ValueError, match="fewer than the embargo"):
        splits.assign_splits(feature_rows(spark, 60), 0, 60_000, Spec())
    with pytest.raises(ValueError, match="fewer than the embargo"):
        splits.assign_splits(f, 0, 10**10, Spec())  # all rows are in train
    for bad in (f.where("event_id != 4"), f.withColumn("y_20", F.lit(2)), f.withColumn("us", -F.col("us")), f.withColumn("feature_complete", F.lit(None).cast("boolean")), f.limit(0)):
        with pytest.raises(ValueError, match="features"):
            splits.assign_splits(bad, 0, 1_000_000, Spec())


def test_summaries_with_infinite_values(spark):
    d = spark.createDataFrame([(1.0,), (3.0,), (math.inf,), (math.nan,), (None,)], "x double")
    finite, plain = (features.feature_summary(d, ("x",), k).first() for k in (False, True))
    assert (finite.n_observed, finite.n_missing, finite["max"], finite["mean"]) == (2, 3, 3.0, 2.0)
    assert (plain.n_observed, plain.n_missing, plain.missing_share, plain["max"], plain["mean"]) == (3, 2, 0.4, math.inf, math.inf) and math.isnan(plain["std"])


def test_frozen_model_round_trip_and_scores(spark):
    m = FrozenModel("m", 10, ("a",), (1.0,), (2.0,), ((1.0,), (0.0,), (-1.0,)), (0.0, 0.1, 0.0))
    assert FrozenModel.from_json(m.to_json()) == m
    with pytest.raises(ValueError):
        FrozenModel.from_json(m.to_json().replace("2.0", "3.0"))
    m.require(name="m", horizon=10, features=("a",))
    for wrong in ({"name": "other"}, {"horizon": 20}, {"features": ("b",)}, {"dataset_sha256": "x"}):
        with pytest.raises(ValueError):
            m.require(**{"name": "m", "horizon": 10, "features": ("a",), **wrong})
    for wrong in ({"scale": (0.0,)}, {"mean": (math.nan,)}, {"horizon": 0}, {"classes": (0, 1)}):
        with pytest.raises(ValueError):
            FrozenModel(**{**m.__dict__, **wrong})
    r = score(spark.createDataFrame([(3.0,)], "a double"), m).first()
    z = [math.exp(x) for x in (1.0, 0.1, -1.0)]
    assert r.p_down == pytest.approx(z[0] / sum(z), abs=1e-12) and r.argmax == -1


def test_checks_raise(spark):
    with pytest.raises(ValueError, match="missing"):
        validate.require_columns(spark.range(1), ["x"], "t")
    with pytest.raises(ValueError):
        validate.check_predictions(spark.createDataFrame([(2, 0)], "y_true int, y_pred int"))
    p = spark.createDataFrame([(0.2, 0.3, 0.5)], "p_down double, p_unchanged double, p_up double")
    validate.check_probabilities(p)
    for bad in (0.6, math.nan, 1.5, None):
        with pytest.raises(ValueError):
            validate.check_probabilities(p.withColumn("p_up", F.lit(bad).cast("double")))
    with pytest.raises(ValueError, match="unique"):
        validate.check_numeric(p, ("p_up", "p_up"))
    with pytest.raises(TypeError):
        validate.check_numeric(p.withColumn("x", F.lit("a")), ("x",))
    with pytest.raises(ValueError):
        validate.check_unique(p.union(p), ["p_up"])
    data = spark.createDataFrame([("train", True), ("test", True)], "split string, model_eligible boolean")
    with pytest.raises(ValueError, match="other_split"):
        validate.check_split(data, "train")
    with pytest.raises(ValueError):
        Spec(embargo=10)


def test_sample_is_the_same_every_time(spark):
    d = spark.range(500).withColumnRenamed("id", "event_id")
    a, b = (sorted(r.event_id for r in audit.sample_ids(x, 40, low=100, high=299).collect()) for x in (d, d.repartition(7)))
    assert a == b and len(set(a)) == 40 and a[0] >= 100 and a[-1] <= 299


def test_dates_and_lists():
    assert {parse_date(x) for x in ("2024-03-01", "2024/03/01", "01-03-2024", "01/03/2024", " 20240301 ")} == {date(2024, 3, 1)}
    assert len(dates_between("2024-03-01", "2024-03-07")) == 7 and window_us("1970-01-02", "1970-01-02") == (DAY, 2 * DAY)
    for bad in ("03/31/2024", "01.03.2024", "2024-3"):
        with pytest.raises(ValueError):
            parse_date(bad)
    with pytest.raises(TypeError):
        parse_date(20240301)
    assert parse_horizons("50, 10") == (10, 50) and parse_splits("test,train", SPLITS) == ("test", "train")
    for f, text in ((parse_horizons, "10,10"), (parse_horizons, "0"), (lambda t: parse_splits(t, SPLITS), "train,other")):
        with pytest.raises(ValueError):
            f(text)
    assert Counter(dates_between("2024-02-28", "2024-03-01")) == Counter([date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)])
