"""Hand-computed cases of the tape operators."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import tapeworks
from tapeworks.functions import columns
from tapeworks.operators import audit, bars, execution, history, signal, skill, vectors
from tapeworks.sources import cleaning
from tapeworks.sources import tape as archive

TAPE = "market_id long, wallet long, ts long, side int, size double, yes_price double, token_price double, seq long"
LABELS = "market_id long, payout_yes double, event_at long, label_available_at long"


def tape(spark, rows):
    return spark.createDataFrame(rows, TAPE)


def rule(spark, **over):
    base = {"rule": "r", "min_notional": 1e6, "rolling": False, "min_prints": 1, "warmup_hours": 1, "min_conviction": 0.8, "max_days": None} | over
    return spark.createDataFrame([tuple(base.values())], "rule string, min_notional double, rolling boolean, min_prints int, warmup_hours int, min_conviction double, max_days double")


def test_volume_admission_takes_whole_seconds(spark):
    t = tape(spark, [(1, 1, s, 0, z, 0.5, 0.5, i) for i, (s, z) in enumerate([(10, 800e3), (10, 800e3), (10, 800e3), (11, 1.0)])])
    row = bars.volume_admission(t, 1e6).first()
    assert (row.admitted_at, row.cumulative) == (11, 1_200_000.0)
    assert bars.volume_admission(t, 2e6).isEmpty()


def test_activation_waits_for_a_completed_hour(spark):
    t = tape(spark, [(1, 1, 10, 0, 1e6, 0.95, 0.95, 1), (1, 1, 3700, 0, 1e6, 0.95, 0.95, 2)])
    markets = spark.createDataFrame([(1, None)], "market_id long, close_at long")

    def run(until):
        return bars.activation(bars.rolling_bars(bars.dense_hours(bars.hourly_bars(t), until), 24), markets, rule(spark, warmup_hours=0)).collect()

    assert run(7199) == []
    (row,) = run(7200)
    assert (row.time, round(row.cumulative_notional, 6)) == (7200, 1_900_000.0)
    assert row.observed_hours == 7190 / 3600


def test_warm_up_counts_from_the_first_print(spark):
    t = tape(spark, [(1, 1, 10, 0, 2e6, 0.95, 0.95, 1)])
    markets = spark.createDataFrame([(1, None)], "market_id long, close_at long")

    def run(until):
        return bars.activation(bars.rolling_bars(bars.dense_hours(bars.hourly_bars(t), until), 24), markets, rule(spark, warmup_hours=2)).collect()

    assert run(7200) == [] and run(10799) == []
    assert run(10800)[0].time == 10800


def test_activation_in_a_silent_hour(spark):
    t = tape(spark, [(1, 1, 10, 0, 2e6, 0.95, 0.95, 1)])
    markets = spark.createDataFrame([(1, None)], "market_id long, close_at long")
    rolled = bars.rolling_bars(bars.dense_hours(bars.hourly_bars(t), 10 * 3600), 24)
    assert bars.activation(rolled, markets, rule(spark, warmup_hours=5)).first().time == 6 * 3600  # five hours after second 10 are over in the sixth
    assert bars.activation(rolled, markets, rule(spark, max_days=1.0)).isEmpty()  # no close, no horizon


def test_stakes_share_what_is_left_and_the_next_candidate_is_tried(spark):
    made = [("c", 1, 1, 10, "YES", 0.9, 0.5, 0.9, "stable", 10.0, "q"), ("c", 1, 5, 20, "YES", 0.9, 0.5, 0.9, "stable", 10.0, "q"), ("c", 2, 1, 10, "YES", 0.5, 0.1, 0.9, "lottery", 10.0, "q")]
    candidates = spark.createDataFrame(made, "case string, market_id long, seq long, ts long, direction string, confidence double, price double, allowed_price double, bucket string, wait_days double, question string")
    observed = spark.createDataFrame([(1, 1, 20.0), (1, 5, 1000.0), (2, 1, 5.0)], "market_id long, seq long, observed_notional double")
    settings = {"case": "c", "edge_multiplier": 1.0, "min_fraction": 0.1, "max_fraction": 0.1, "target_fraction": 0.6, "buffer_fraction": 0.0, "max_position_fraction": None, "max_competitive_fraction": None, "max_market_fraction": 0.25, "max_balance_fraction": None, "max_loss_fraction": None, "lottery_lot": 100.0, "lottery_max_fraction": 0.02, "min_ticket": 10.0}
    case = spark.createDataFrame([tuple(settings.values())], ", ".join(f"`{k}` " + ("string" if k == "case" else "double") for k in settings))

    def stakes(deployed, lottery_open):
        account = spark.createDataFrame([("c", 1000.0, 1000.0, deployed, lottery_open)], "case string, equity double, cash double, deployed double, lottery_open double")
        return execution.order_stakes(candidates, account, observed, case)

    rows = {(r.market_id, r.seq): (round(r.stake, 9), r.quantity) for r in stakes(200.0, 0.0).collect()}
    assert rows == {(1, 1): (0.0, None), (1, 5): (40.0, None), (2, 1): (10.0, 100.0)}  # a quarter of 20 dollars is no ticket; 0.1 of 600 - 200
    first = {r.market_id: r.seq for r in signal.first_entries(stakes(200.0, 0.0).where("stake > 0")).collect()}
    assert first == {1: 5, 2: 1}
    assert {r.market_id: r.stake for r in stakes(600.0, 11.0).where("seq = 1 or seq = 5").collect()} == {1: 0.0, 2: 0.0}  # the target is reached, 11 + 10 is over 0.02 of cash


def test_settlement_of_a_fractional_payout(spark):
    t = tape(spark, [(1, 7, 1, 0, 10.0, 0.2, 0.2, 1), (1, 7, 2, 2, 4.0, 0.8, 0.8, 2), (1, 7, 3, 1, 5.0, 0.3, 0.7, 3)])
    row = history.settlements(t, spark.createDataFrame([(1, 0.5, 9, 10)], LABELS)).first()
    assert (round(row.notional, 9), round(row.score, 9), row.settled_at) == (8.7, round(3.2 / 8.7, 9), 10)


def test_risk_class_and_kernel(spark):
    q = spark.createDataFrame([("Ravens vs. Bills",), ("Will they win the 2026 NBA Finals?",), ("2 Trump vs. Harris debates before election?",)], "q string")
    assert [r[0] for r in q.select(columns.risk_class(F.col("q"))).collect()] == ["competitive_event", "competitive_event", "standard"]
    c = spark.createDataFrame([(x,) for x in (0.4, 0.5, 0.6, 0.8, 1.0)], "c double")
    assert [round(r[0], 6) for r in c.select(columns.similarity_kernel(F.col("c"), 0.5, 2)).collect()] == [0, 0, 0.04, 0.36, 1]


def test_skill_is_as_of_and_leaves_out_the_own_market(spark):
    s = spark.createDataFrame([(1, 10, 0.3, 5.0, 100), (1, 11, 0.5, 5.0, 100), (1, 1, -1.0, 5.0, 100)], "wallet long, market_id long, score double, notional double, settled_at long")
    t = tape(spark, [(1, 1, 99, 0, 1.0, 0.5, 0.5, 1), (1, 1, 100, 0, 1.0, 0.5, 0.5, 2)])
    a, b = skill.skill(t, s).orderBy("seq").collect()
    assert (a.weighted_score, a.supporting_markets) == (0.0, 0)
    assert (round(b.weighted_score, 9), b.supporting_markets) == (0.4, 2)
    pairs = spark.createDataFrame([(1, 10, 0.5)], "target long, other long, weight double")
    k = skill.skill(t, s, "kernel", pairs=pairs).orderBy("seq").collect()[1]
    assert (round(k.weighted_score, 9), k.weighted_history_notional, round(k.mean_similarity, 9)) == (0.3, 2.5, 0.25)


def test_dense_skill_equals_the_naive_join(spark, monkeypatch):
    tapeworks.distribute(spark)
    monkeypatch.setattr(skill, "TARGETS", 3)
    monkeypatch.setattr(skill, "HISTORY", 4)
    monkeypatch.setattr(skill, "TRADES_LOG2", 2)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 5)).astype(np.float32)
    facts = [(f"w{w}", m, float(rng.uniform(-1, 1)), float(rng.uniform(1, 9)), int(rng.integers(0, 60))) for w in range(3) for m in range(30 if w == 0 else 4) if rng.random() < 0.8]
    trades = [(int(rng.integers(0, 32)), f"w{rng.integers(0, 4)}", int(rng.integers(0, 70)), i) for i in range(150)]
    s = spark.createDataFrame(facts, "wallet string, market_id long, score double, notional double, settled_at long")
    t = spark.createDataFrame(trades, "market_id long, wallet string, ts long, seq long")
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v) if i != 7], "market_id long, vector array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for threshold in (0.0, 0.3):
        got = {r.seq: r for r in skill.dense_skill(t, s, vec, threshold=threshold, power=2.0 if threshold else 1.0).collect()}
        assert len(got) == len(trades)
        for market, wallet, ts, seq in trades:
            known = market < 30 and market != 7
            rows = [(max(0.0, float(unit[market] @ unit[m])), score, n) for w, m, score, n, at in facts if w == wallet and at <= ts and m != market and m != 7] if known else []
            rows = [(((max(c - threshold, 0) / (1 - threshold)) ** 2 if threshold else c) * n, score, n) for c, score, n in rows]
            w = sum(x for x, _, _ in rows)
            want = (sum(x * sc for x, sc, _ in rows) / w, w, sum(x > 0 for x, _, _ in rows), w * w / sum(x * x for x, _, _ in rows), w / sum(n for _, _, n in rows)) if w > 0 else (0, 0, 0, 0, 0)
            r = got[seq]
            assert np.allclose((r.weighted_score, r.weighted_history_notional, r.supporting_markets, r.effective_history_markets, r.mean_similarity), want, atol=1e-5)


def observations(spark, rows):
    """rows: wallet, direction, volume, skill."""
    data = [(1, i, i, w, 0.5, d, v, s, 1.0, 1.0, 1.0, 1.0, 0.0) for i, (w, d, v, s) in enumerate(rows)]
    return spark.createDataFrame(data, "market_id long, seq long, ts long, wallet long, yes_price double, direction string, volume double, skill double, weighted_history_notional double, effective_history_markets double, mean_similarity double, positive_history_weight_fraction double, skill_score_std double")


def test_consensus_forms_agree(spark):
    obs = observations(spark, [(1, "YES", 100.0, 0.6), (2, "YES", 30.0, 0.6), (3, "NO", 20.0, 0.5), (4, "NO", 900.0, 0.2)])
    cfg = signal.ConsensusConfig(skill_threshold=0.3, consensus_threshold=0.7)
    last = signal.consensus(obs, cfg).orderBy("seq").collect()[-1]
    batch = signal.batch_consensus(obs, cfg).first()
    rolling = signal.rolling_consensus(obs, cfg, 1000).orderBy("seq").collect()[-1]
    assert last.direction == batch.direction == rolling.direction == "YES"
    assert round(last.confidence, 9) == round(batch.confidence, 9) == round(rolling.confidence, 9) == round(78 / 88, 9)
    assert last.skilled_wallets == batch.skilled_wallets == rolling.skilled_wallets == 3
    tight = signal.ConsensusConfig(skill_threshold=0.3, consensus_threshold=0.7, max_wallet_share=0.6)
    assert signal.consensus(obs, tight).orderBy("seq").collect()[-1].direction is None


def test_lookback_drops_old_rows(spark):
    obs = observations(spark, [(1, "YES", 100.0, 0.6), (2, "NO", 30.0, 0.6), (3, "NO", 20.0, 0.5)])
    cfg = signal.ConsensusConfig(skill_threshold=0.3)
    short = signal.rolling_consensus(obs, cfg, 1).orderBy("seq").collect()[-1]
    assert (short.direction, short.skilled_wallets) == ("NO", 2)


def test_lookback_by_blocks_equals_a_rescan(spark):
    rnd = random.Random(6)
    rows = [(m, i, ts, f"w{rnd.randrange(5)}", 0.5, rnd.choice(["YES", "NO"]), float(rnd.randrange(1, 9)), rnd.choice([0.1, 0.4, 0.7]), 1.0, rnd.uniform(1, 3), 1.0, 1.0, 0.0) for m in (1, 2) for i, ts in enumerate(sorted(rnd.choice([rnd.randrange(400_000), 7200 * rnd.randrange(50)]) for _ in range(150)))]
    obs = spark.createDataFrame(rows, "market_id long, seq long, ts long, wallet string, yes_price double, direction string, volume double, skill double, weighted_history_notional double, effective_history_markets double, mean_similarity double, positive_history_weight_fraction double, skill_score_std double")
    cfg = signal.ConsensusConfig(skill_threshold=0.3, consensus_threshold=0.55, min_wallets=2)
    assert [signal._block_seconds(x) for x in (86400, 7200, 3601, 0)] == [3600, 3600, 3601, 1]
    for lookback in (86400, 7200, 3601, 0):
        got = {(r.market_id, r.seq): r for r in signal.rolling_consensus(obs, cfg, lookback).collect()}
        assert len(got) == len(rows)
        for m, seq, ts, *_ in rows:
            live = [r for r in rows if r[0] == m and r[1] <= seq and r[2] >= ts - lookback and r[7] >= 0.3]
            by = {}
            for r in live:
                by[r[3]] = by.get(r[3], 0.0) + r[6] * r[7]
            total, r = sum(by.values()), got[m, seq]
            assert r.skilled_wallets == len(by)
            if len(by) >= 2:
                yes = sum(x[6] * x[7] for x in live if x[5] == "YES")
                want = "YES" if yes / total >= 0.55 else "NO" if 1 - yes / total >= 0.55 else None
                assert abs(r.total_weight - total) < 1e-6 and abs(r.wallet_share - max(by.values()) / total) < 1e-6 and (r.direction == want or abs(yes / total - 0.55) < 1e-9 or abs(yes / total - 0.45) < 1e-9)
                if r.direction:
                    mine = [x for x in live if x[5] == r.direction]
                    assert r.directional_wallets == len({x[3] for x in mine})
                    assert abs(r.mean_history_markets - sum(x[6] * x[7] * x[9] for x in mine) / sum(x[6] * x[7] for x in mine)) < 1e-6


def orders(spark, **over):
    base = {"case": "c", "market_id": 1, "direction": "YES", "seq": 0, "ts": 0, "price": 0.5, "allowed_price": 0.9, "stake": 100.0, "quantity": None, "bucket": "stable"} | over
    return spark.createDataFrame([tuple(base.values())], "case string, market_id long, direction string, seq long, ts long, price double, allowed_price double, stake double, quantity double, bucket string")


def cases(spark, **over):
    base = {"case": "c", "delay": 10, "trade_filter": "any", "expiry": 1000, "slippage_bps": 0.0, "min_price": 0.0, "max_price": 1.0, "stable_floor": 0.1, "lottery_high": 0.05, "max_drift_bps": None, "wait": True, "confirmations": 1, "participation": 0.1, "max_children": 2, "slices": 2, "min_ticket": 0.01, "fee_bps": 0.0} | over
    schema = ", ".join(f"`{k}` " + {bool: "boolean", str: "string", int: "int"}.get(type(v), "double") for k, v in base.items())
    return spark.createDataFrame([tuple(base.values())], schema)


def test_participation_and_delay(spark):
    t = tape(spark, [(1, 1, s, 0, 10.0, 0.5, 0.5, i) for i, s in enumerate((0, 5, 10, 20, 30))])
    fills = execution.participation_fills(orders(spark), t, cases(spark)).orderBy("child").collect()
    assert [(f.filled_at, round(f.quantity, 9)) for f in fills] == [(10, 1.0), (20, 1.0)]
    assert execution.delayed_fills(orders(spark), t, cases(spark, confirmations=2)).first().filled_at == 20


def test_a_high_price_kills_or_waits(spark):
    t = tape(spark, [(1, 1, 10, 0, 10.0, 0.95, 0.95, 1), (1, 1, 20, 0, 10.0, 0.5, 0.5, 2)])
    assert execution.delayed_fills(orders(spark), t, cases(spark)).first().filled_at == 20
    assert execution.delayed_fills(orders(spark), t, cases(spark, wait=False)).isEmpty()


def lottery(spark, **over):
    return orders(spark, price=0.10, stake=10.0, quantity=100.0, bucket="lottery", **over)


def test_a_lot_keeps_its_shares(spark):
    t = tape(spark, [(1, 1, 10 * i, 0, 50.0, 0.12, 0.12, i) for i in range(1, 7)])
    c = cases(spark, lottery_high=0.2, participation=0.25, max_children=5, slices=4, min_ticket=1.0)
    for fills in (execution.delayed_fills, execution.participation_fills):
        (f,) = fills(lottery(spark), t, c).collect()
        assert (round(f.quantity, 9), round(f.notional, 9), f.filled_at) == (100.0, 12.0, 10)
    slices = execution.sliced_fills(lottery(spark), t, c).orderBy("child").collect()
    assert [round(f.quantity, 9) for f in slices] == [25.0] * 4 and [round(f.notional, 9) for f in slices] == [3.0] * 4
    # after three slices a dollar is left of the ten, which is no ticket of two
    assert execution.sliced_fills(lottery(spark), t, cases(spark, lottery_high=0.2, slices=4, min_ticket=2.0)).count() == 3


def test_no_participation_is_no_limit(spark):
    t = tape(spark, [(1, 1, 10 * i, 0, 5.0, 0.5, 0.5, i) for i in range(1, 7)])
    c = cases(spark, participation=None, max_children=6).withColumn("participation", F.lit(None).cast("double"))
    (f,) = execution.participation_fills(orders(spark, stake=10.0), t, c).collect()
    assert (f.notional, f.child) == (10.0, 1)


def test_slices_end_below_the_least_ticket(spark):
    t = tape(spark, [(1, 1, 10 * i, 0, 50.0, 0.5, 0.5, i) for i in range(1, 9)])
    fills = execution.sliced_fills(orders(spark, stake=10.0), t, cases(spark, slices=4, min_ticket=5.0)).orderBy("child").collect()
    assert [(f.child, round(f.notional, 9)) for f in fills] == [(1, 2.5), (2, 2.5), (3, 2.5)]
    assert [f.filled_at for f in execution.sliced_fills(orders(spark, stake=10.0), t, cases(spark, slices=2, confirmations=3, min_ticket=1.0)).orderBy("child").collect()] == [30, 60]


def test_drift_counts_from_the_price_with_slippage(spark):
    t = tape(spark, [(1, 1, 10, 0, 9.0, 0.505, 0.505, 1)])
    assert execution.delayed_fills(orders(spark), t, cases(spark, slippage_bps=100.0, max_drift_bps=100.0)).count() == 1  # 0.51005 of at most 0.505 x 1.01
    assert execution.delayed_fills(orders(spark), t, cases(spark, slippage_bps=100.0, max_drift_bps=99.0)).isEmpty()


def naive_fills(order, prints, case, kind):
    """The orders' loop over all later prints, one by one."""
    out, seen, left, lot, children = [], 0, order["stake"], order["quantity"], 0
    slices = case["slices"] if kind == "sliced" else 1
    limit = {"delayed": 1, "participation": case["max_children"], "sliced": slices}[kind]
    paid = round(min(1.0, order["price"] * (1 + case["slippage_bps"] / 1e4)), 9)
    for seq, ts, side, size, yes in sorted(prints):
        if seq <= order["seq"] or ts < order["ts"] + case["delay"]:
            continue
        if case["expiry"] is not None and ts > order["ts"] + case["delay"] + case["expiry"]:
            break
        yes_side, buy = side in (0, 2), side < 2
        token = yes_side == (order["direction"] == "YES")
        same = (side in (0, 3)) == (order["direction"] == "YES")
        if not {"any": True, "signal_direction": same, "target_token": token, "target_token_buy": token and buy, "target_token_sell": token and not buy}[case["trade_filter"]]:
            continue
        p = round(min(1.0, max(0.0, (yes if order["direction"] == "YES" else round(1 - yes, 4)) * (1 + case["slippage_bps"] / 1e4))), 9)
        if p <= 0 or p < case["min_price"]:
            break
        if p > case["max_price"] or p > order["allowed_price"] or (case["max_drift_bps"] is not None and p > round(paid * (1 + case["max_drift_bps"] / 1e4), 9)):
            if case["wait"]:
                continue
            break
        if (order["bucket"] == "stable" and p <= case["stable_floor"]) or (order["bucket"] == "lottery" and p >= case["lottery_high"]):
            break
        seen += 1
        if seen < case["confirmations"]:
            continue
        if lot is not None:
            n = lot / slices * p
        else:
            n = order["stake"] / slices if kind == "sliced" else left
            n = min(n, size * p * case["participation"]) if kind == "participation" and case["participation"] is not None else n
        children += 1
        out.append((order["case"], order["market_id"], children, seq, round(n, 6)))
        left = max(0.0, left - n)
        seen = 0 if kind == "sliced" else seen
        if round(left, 9) < case["min_ticket"] or left <= 0 or children >= limit or (lot is not None and kind != "sliced"):
            break
    return out


def test_the_forward_search_finds_what_the_loop_finds(spark):
    rnd = random.Random(11)
    prints = [(m, 1, ts, rnd.randrange(4), rnd.choice([1.0, 5.0, 40.0]), round(min(0.99, max(0.01, 0.1 + 0.2 * m + rnd.gauss(0, 0.06))), 4), 0.5, i) for m in range(1, 5) for i, ts in enumerate(sorted(rnd.randrange(200_000) for _ in range(400)))]
    settings, made = [], []
    for k in range(40):
        settings.append({"case": f"c{k}", "delay": rnd.choice([0, 100, 5000]), "trade_filter": rnd.choice(["any", "signal_direction", "target_token", "target_token_buy", "target_token_sell"]), "expiry": rnd.choice([None, 20_000]), "slippage_bps": rnd.choice([0.0, 25.0]), "min_price": rnd.choice([0.0, 0.02]), "max_price": 0.97, "stable_floor": 0.3, "lottery_high": 0.25, "max_drift_bps": rnd.choice([None, 300.0]), "wait": rnd.random() < 0.6, "confirmations": rnd.choice([1, 1, 3]), "participation": rnd.choice([None, 0.1, 0.5]), "max_children": rnd.choice([1, 3, 8]), "slices": rnd.choice([1, 2, 4]), "min_ticket": rnd.choice([0.5, 4.0]), "fee_bps": 5.0})
        for m in range(1, 5):
            direction, seq = rnd.choice(["YES", "NO"]), rnd.randrange(0, 300)
            row = next(p for p in prints if p[0] == m and p[7] == seq)
            price = row[5] if direction == "YES" else round(1 - row[5], 4)
            bucket = "lottery" if price <= 0.2 else "stable"
            lot = 30.0 if bucket == "lottery" else None
            made.append({"case": f"c{k}", "market_id": m, "direction": direction, "seq": seq, "ts": row[2], "price": price, "allowed_price": rnd.choice([0.97, price + 0.02]), "stake": lot * price if lot else 20.0, "quantity": lot, "bucket": bucket})
    t = tape(spark, prints)
    o = spark.createDataFrame([tuple(x.values()) for x in made], orders(spark).schema)
    types = {"case": "string", "trade_filter": "string", "wait": "boolean", "delay": "long", "expiry": "long", "confirmations": "int", "max_children": "int", "slices": "int"}
    c = spark.createDataFrame([tuple(x.values()) for x in settings], ", ".join(f"`{n}` {types.get(n, 'double')}" for n in settings[0]))
    zones = execution.price_zones(t)
    for kind, fills in (("delayed", execution.delayed_fills), ("participation", execution.participation_fills), ("sliced", execution.sliced_fills)):
        want = [f for x in made for f in naive_fills(x, [(p[7], p[2], p[3], p[4], p[5]) for p in prints if p[0] == x["market_id"]], next(s for s in settings if s["case"] == x["case"]), kind)]
        got = [(f["case"], f.market_id, f.child, f.seq, round(f.notional, 6)) for f in fills(o, t, c, zones).collect()]
        assert sorted(got) == sorted(want) and want


def test_an_order_visits_no_more_of_a_longer_tape(spark):
    def visited(days):
        rows = [(1, 1, ts, 0, 10.0, 0.5 if ts >= 39_600 else 0.95, 0.5, i) for i, ts in enumerate(range(0, days * 86400, 600))]
        c = cases(spark, expiry=None, delay=0, participation=0.5).withColumn("expiry", F.lit(None).cast("long"))
        return sorted(r.hour for r in execution.visited_hours(orders(spark), execution.price_zones(tape(spark, rows)), c, F.lit(2)).collect())

    assert visited(2) == visited(20) == [11]  # the hours before are too high, the first that fits is enough


def test_cash_counts_payouts_first(spark):
    fills = spark.createDataFrame([("c", 1, 1, 5, 15.0, 0.0)], "case string, market_id long, child int, filled_at long, notional double, fee double")
    positions = spark.createDataFrame([("c", 2, 5, 10.0)], "case string, market_id long, resolved_at long, payout double")
    row = audit.audit_cash(fills, positions, 10.0).first()
    assert (row.final_cash, row.min_cash, row.negative) == (5.0, 5.0, False)
    assert audit.audit_cash(fills, positions.where("payout < 0"), 10.0).first().negative


def test_normalising_trades(spark):
    raw = spark.createDataFrame([("m", "down", "?", 999, "BUY", 0.2, 1.0, 1, "w", "h"), ("m", "x", "?", 999, "BUY", 0.2, 1.0, 1, "w", "h"), ("m", "x", "up", 999, "SELL", 0.0, 1.0, 1, "w", "h")], "conditionId string, asset string, outcome string, outcomeIndex int, side string, price double, size double, timestamp long, proxyWallet string, transactionHash string")
    markets = spark.createDataFrame([("m", ["Up", "Down"], ["up_", "down"])], "market_id string, outcome_labels array<string>, clob_token_ids array<string>")
    assert sorted([(r.side, r.yes_price) for r in cleaning.normalize_trades(raw, markets).collect()], key=str) == [(1, 0.8), (2, 0.0), (None, None)]
    strict = cleaning.corrected_trades(raw, markets).collect()
    assert [(r.side, r.yes_price, r.corrected) for r in strict] == [(1, 0.8, True)]


def test_future_rows_change_nothing(spark):
    rows = [(1, i % 3, i * 900, i % 4, 10.0, 0.5 + 0.01 * (i % 9), 0.5, i) for i in range(200)]
    old = bars.volume_admission(tape(spark, rows[:150]), 500).collect()
    assert old == bars.volume_admission(tape(spark, rows).repartition(7), 500).collect()


def test_tape_quality_sees_each_fault(spark):
    good = (1, 5, 100, 0, 10.0, 0.5, 0.5)
    manifest = spark.createDataFrame([(1, 2, 100, 200)], "market_id long, rows long, start long, end long")

    def found(**change):
        row = dict(zip("market_id wallet ts side size yes_price token_price".split(), good, strict=True)) | {"ts": 150} | change
        t = tape(spark, [(*good, 1), (*row.values(), 2)])
        return {r.check: r.violations for r in cleaning.tape_quality(t, manifest).collect()}

    assert found() == {}
    for size in (0.0, -1.0, None, float("nan"), float("inf")):
        assert found(size=size) == {"size": 1}
    assert found(ts=99) == {"order": 1, "bounds": 1} and found(ts=201) == {"bounds": 1}
    for price in (1.5, -0.1):
        assert found(yes_price=price) == {"price_range": 1, "price_mapping": 1}
    assert found(yes_price=None) == {"price_range": 1} and found(side=7, yes_price=0.5) == {"side": 1} and found(wallet=None) == {"wallet": 1}
    assert found(token_price=0.5 + 1e-9) == {"price_mapping": 1} and found(token_price=0.5 + 1e-13) == {}
    short = cleaning.tape_quality(tape(spark, [(*good, 1)]), manifest.unionByName(manifest.withColumn("market_id", F.lit(2).cast("long"))))
    assert sorted((r.market_id, r.check) for r in short.collect()) == [(1, "count"), (2, "count")]


def test_inventory_of_an_archive(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([("a", "q", 1.0), ("b", None, None), ("c", "x", 2.0)], "market_id string, question string, volume double").write.option("compression", "gzip").json(f"{at}/markets")
    spark.createDataFrame([("a", "w", 1)], "market_id string, wallet string, ts long").write.parquet(f"{at}/tape")
    spark.createDataFrame([("a", 0.5, 1, 2), ("b", 1.5, 1, 2), ("c", None, 5, 5)], "market_id string, payout_yes double, event_at long, label_available_at long").write.parquet(f"{at}/labels")
    spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, float("inf")]), ("b", [0.0, 1.0]), ("z", [1.0])], "market_id string, vector array<float>").write.parquet(f"{at}/vectors")
    inputs = archive.load_inputs(spark, at)
    assert inputs["markets"].count() == 3 and inputs["tape"].first().size is None
    want = {("b", "vector_repeated"), ("b", "vector_not_finite"), ("c", "vector_missing"), ("z", "vector_of_no_market"), ("z", "vector_width"), ("b", "label_payout"), ("c", "label_time")}
    assert {(r.market_id, r.problem) for r in archive.inventory(inputs).collect()} == want


def test_question_vectors(spark):
    tapeworks.distribute(spark)
    from pyspark.ml.feature import HashingTF

    texts = ["Will it rain, will it?", None, "a b c", "Rain rain RAIN go away"]
    df = spark.createDataFrame(list(enumerate(texts)), "market_id long, question string")
    place = HashingTF(numFeatures=4096).indexOf
    for r in vectors.hashing_vectors(df).collect():
        v = np.zeros(4096)
        for w in re.findall(r"\b\w\w+\b", (texts[r.market_id] or "").lower()):
            v[place(w)] += 1
        assert np.allclose(r.vector, v / max(np.linalg.norm(v), 1e-12), atol=1e-6)
    got = {r.market_id: r.vector for r in vectors.encoded_vectors(df, lambda q: [[len(t), 1.0] for t in q]).collect()}
    assert all(np.allclose(got[i], np.array([len(t or ""), 1.0]) / np.hypot(len(t or ""), 1), atol=1e-6) for i, t in enumerate(texts))


def test_pairs_over_blocks_and_shuffled_vectors(spark):
    tapeworks.distribute(spark)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "market_id long, vector array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j): float(unit[i] @ unit[j]) for i in range(40) for j in range(40) if i != j and unit[i] @ unit[j] > 0.3}
    for block in (7, 100):
        rows = vectors.market_pairs(df, 0.3, block=block).collect()
        assert len(rows) == len(want) and all(abs(want[r.target, r.other] - r.cosine) < 1e-5 for r in rows)
    # eight tight clusters: blocks of different ones never meet, and no pair is lost
    tight = np.concatenate([c + 0.02 * rng.normal(size=(40, 16)) for c in rng.normal(size=(8, 16))]).astype(np.float32)
    far = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(tight)], "market_id long, vector array<float>")
    unit = tight / np.linalg.norm(tight, axis=1, keepdims=True)
    close = {(int(i), int(j)) for i, j in zip(*np.nonzero(unit.astype(float) @ unit.T.astype(float) > 0.9), strict=True) if i != j}
    assert {(r.target, r.other) for r in vectors.market_pairs(far, 0.9, block=20).collect()} == close
    work, blocks = vectors.pair_work(far, 0.9, block=20).collect(), len({r.b for r in vectors._dealt(far, 0.9, 20).select("b").distinct().collect()})
    assert len(work) < 0.4 * blocks * (blocks + 1) / 2
    shuffled = {r.market_id: tuple(r.vector) for r in vectors.shuffle_vectors(df, 3).collect()}
    assert sorted(shuffled.values()) == sorted(map(tuple, v.tolist())) and shuffled.keys() == set(range(40))
    assert shuffled != {r.market_id: tuple(r.vector) for r in vectors.shuffle_vectors(df, 4).collect()}


def test_running_flow_equals_sums_over_all_wallets():
    cfg = {"skill_threshold": -1.0, "min_history_notional": 0.0, "min_effective_markets": 0.0, "min_similarity": 0.0, "min_positive_fraction": 0.0, "max_score_std": 9.0, "weighting": "skill_volume"}
    rnd, flow, held = random.Random(2), signal.Flow(cfg), []
    for _ in range(600):
        row = {"wallet": rnd.randrange(12), "direction": rnd.choice(["YES", "NO"]), "skill": rnd.uniform(0.01, 1), "volume": rnd.uniform(1, 9), "weighted_history_notional": 1.0, "skill_score_std": 0.0} | dict.fromkeys(("effective_history_markets", "mean_similarity", "positive_history_weight_fraction"), 1.0)
        flow.apply(row, 1)
        held.append(row)
        while len(held) > rnd.choice([0, 5, 40]):
            flow.apply(held.pop(rnd.randrange(len(held))), -1)
        by = {}
        for r in held:
            by.setdefault(r["wallet"], {}).setdefault(r["direction"], []).append(r["skill"] * r["volume"])
        side = {d: [sum(x[d]) for x in by.values() if d in x] for d in ("YES", "NO")}
        want = [sum(side["YES"]), sum(side["NO"]), len(by), max((sum(map(sum, x.values())) for x in by.values()), default=0.0)]
        got = flow.decide()
        for i, d in enumerate(("YES", "NO")):
            assert np.allclose(got[4 + 7 * i : 7 + 7 * i], [len(side[d]), sum(w * w for w in side[d]), max(side[d], default=0.0)], atol=1e-6)
        assert np.allclose(got[:4], want, atol=1e-6)


def test_daily_marks_end_with_the_position(spark):
    d = 86400
    t = tape(spark, [(1, 1, 5, 0, 1.0, 0.4, 0.4, 1), (1, 1, 2 * d + 5, 0, 1.0, 0.6, 0.6, 2), (2, 1, 5, 0, 1.0, 0.5, 0.5, 1)])
    fills = spark.createDataFrame([("c", 1, "YES", 10, 10.0, 4.0, 0.1), ("c", 2, "NO", 3 * d, 2.0, 1.0, 0.0), ("c", 2, "NO", 9 * d, 4.0, 2.0, 0.0)], "case string, market_id long, direction string, filled_at long, quantity double, notional double, fee double")
    positions = spark.createDataFrame([("c", 1, "YES", 10.0, 4.0, 5 * d, 10.0), ("c", 2, "NO", 2.0, 1.0, 7 * d, 0.0)], "case string, market_id long, direction string, quantity double, notional double, resolved_at long, payout double")
    rows = {r.day: r for r in execution.daily_marks(fills, positions, t, 100.0).collect()}
    assert sorted(rows) == [0, 3, 5, 7, 9]
    assert [round(rows[k].cash, 6) for k in sorted(rows)] == [95.9, 94.9, 104.9, 104.9, 102.9]
    assert [round(rows[k].open_value, 6) for k in sorted(rows)] == [4.0, 7.0, 1.0, 0.0, 2.0]  # a fill after the settlement opens again
    assert [round(rows[k].open_notional, 6) for k in sorted(rows)] == [4.0, 5.0, 1.0, 0.0, 2.0]


def test_running_sums_over_days_equal_one_window(spark):
    from pyspark.sql import Window

    from tapeworks.operators.running import running

    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 400000).alias("ts"), F.col("id").alias("seq"), (F.col("id") * 31 % 17).cast("double").alias("x"))
    w = Window.partitionBy("g").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    got = running(df, ["g"], "ts", ["ts", "seq"], {"s": F.col("x"), "n": F.lit(1)}, {"m": F.col("x")}).select("seq", "s", "n", "m")
    want = df.select("seq", F.sum("x").over(w).alias("s"), F.count("*").over(w).alias("n"), F.max("x").over(w).alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_missing_lower_gate_fails(spark):
    rules = spark.createDataFrame([("lo", "f", 1.0, False), ("hi", "f", 2.0, False), ("roll", "f", 2.0, True)], "rule string, family string, min_notional double, rolling boolean")
    gates = spark.createDataFrame([(1, "lo", 10, 5.0, 5.0), (1, "hi", 20, 5.0, 4.0), (2, "hi", 20, 3.0, 4.0), (3, "lo", 30, 1.0, 1.0), (3, "hi", 20, 1.0, 1.0), (3, "roll", 20, 1.0, 1.0), (4, "roll", 9, 1.0, 1.0)], "market_id long, rule string, time long, cumulative_notional double, recent_notional double")
    out = {(r.check, r.market_id, r.rule): r.ok for r in audit.gate_monotonicity(gates, rules).collect()}
    assert {k: v for k, v in out.items() if k[0] != "dollars"} == {("threshold", 1, "hi"): True, ("threshold", 2, "hi"): False, ("threshold", 3, "hi"): False, ("mode", 3, "roll"): True, ("mode", 4, "roll"): False}
    assert [k for k, v in out.items() if k[0] == "dollars" and not v] == [("dollars", 2, "hi")]


def test_the_timeline_has_one_order(spark):
    t = tape(spark, [(m, 1, 30 * i // 7 * 50, 0, 1.0, 0.5, 0.5, i) for m in (1, 2) for i in range(300)])
    labels = spark.createDataFrame([(1, 1.0, 99, 100), (2, None, 9, 9)], LABELS)
    rows = sorted((r.position, r.ts, r.kind != "resolution", r.market_id, r.seq) for r in cleaning.timeline(t, labels).collect())
    assert [r[0] for r in rows] == list(range(1, 602)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_order_of_prints_is_checked_over_runs(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "RUN_LOG2", 2)
    t = tape(spark, [(1, 1, ts, 0, 1.0, 0.5, 0.5, seq) for seq, ts in zip([1, 2, 3, 4, 5, 17, 18], [10, 11, 12, 11, 13, 12, 12], strict=True)])
    manifest = spark.createDataFrame([(1, 7, 0, 99)], "market_id long, rows long, start long, end long")
    assert [(r.check, r.violations) for r in cleaning.tape_quality(t, manifest).collect()] == [("order", 2)]


def test_exposure_counts_waiting_orders(spark):
    made = [("c", 1, 10, 50.0, "stable"), ("c", 2, 20, 30.0, "stable"), ("c", 3, 40, 10.0, "stable"), ("c", 4, 60, 10.0, "stable"), ("d", 3, 40, 10.0, "stable")]
    o = spark.createDataFrame(made, "case string, market_id long, ts long, stake double, bucket string")
    pairs = spark.createDataFrame([(a, b, 0.9 if abs(a - b) < 4 else 0.1) for a in range(1, 5) for b in range(1, 5) if a != b], "target long, other long, cosine double")
    positions = spark.createDataFrame([("c", 1, 20.0, 15, 50)], "case string, market_id long, notional double, opened_at long, resolved_at long")
    ends = spark.createDataFrame([("c", 1, 20.0, 30), ("c", 2, 0.0, 35), ("c", 3, 0.0, None), ("c", 4, 0.0, None)], "case string, market_id long, filled double, done_at long")
    got = {(r["case"], r.market_id): r.exposure for r in execution.semantic_cluster_exposure(o, positions, pairs, 0.5, ends).collect()}
    # 2 sees the 50 of 1; 3 the 20 that were filled, 2 having expired; 4 what 3 waits for, 1 being settled
    assert got == {("c", 1): 0.0, ("c", 2): 50.0, ("c", 3): 20.0, ("c", 4): 10.0, ("d", 3): 0.0}
    held = {(r["case"], r.market_id): r.exposure for r in execution.semantic_cluster_exposure(o, positions, pairs, 0.5).collect()}
    assert held["c", 2] == 20.0 and held["c", 4] == 0.0


def test_order_statistics_equal_sorting(spark):
    from tapeworks.operators.quantiles import exact_percentiles, ranked_values

    rnd = random.Random(9)
    groups = {"a": [rnd.gauss(0, 1e-7) for _ in range(301)], "b": [rnd.choice([-1.5, 0.0, 0.0, 3.25]) for _ in range(200)], "c": [7.0], "d": [10.0 ** rnd.uniform(-9, 12) * rnd.choice([1, -1]) for _ in range(400)]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in [*v, None]], "g string, v double")
    got = {r.g: r for r in ranked_values(df, ["g"], "v", {"first": lambda n: F.lit(0), "tail": lambda n: F.ceil(n * 0.05) - 1, "last": lambda n: n - 1}).collect()}
    shares = {r.g: r for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    for g, v in groups.items():
        o = sorted(v)
        assert (got[g].n, got[g].first, got[g].tail, got[g].last) == (len(o), o[0], o[-(-len(o) // 20) - 1], o[-1])
        assert np.allclose([shares[g].p50, shares[g].p90], np.quantile(o, [0.5, 0.9]), rtol=1e-12, atol=0)


def test_a_bucketed_tape_is_not_shuffled(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS buckets_of_a_test")
    t = tape(spark, [(m, 1, 10 * i, 0, 1.0, 0.5, 0.5, i) for m in range(20) for i in range(30)])
    manifest = archive.write_bucketed(t, "buckets_of_a_test", str(tmp_path), 4)
    assert {(r.market_id, r.rows, r.last_seq) for r in manifest.collect()} == {(m, 30, 29) for m in range(20)}
    stored = archive.bucketed(spark, "buckets_of_a_test")
    gates = spark.createDataFrame([(m, "r", 100) for m in range(0, 20, 2)], "market_id long, rule string, time long")
    labels = spark.createDataFrame([(m, 1.0, 199, 200) for m in range(20)], LABELS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        gated = bars.gate_tape(stored, gates, labels)
        fills = gates.select("market_id", F.lit(100).cast("long").alias("filled_at"))
        audited = fills.join(stored.withColumnRenamed("ts", "filled_at"), ["market_id", "filled_at"])
        for df in (gated, audited):
            plan = df._jdf.queryExecution().executedPlan().toString()
            tape_side = plan[: plan.index("buckets_of_a_test")].splitlines()
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            above, level = [], depth(tape_side[-1]) + 1
            for line in reversed(tape_side):  # the operators that stand over the scan
                if depth(line) < level:
                    level = depth(line)
                    above.append(line)
            assert not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "Join" in x)])
        assert gated.count() == 10 * 10
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
        spark.sql("DROP TABLE buckets_of_a_test")


def test_admission_by_a_rule_is_never_earlier_than_by_volume(spark):
    admissions = spark.createDataFrame([(1, 50, 1.0), (2, 50, 1.0), (3, 50, 1.0)], "market_id long, admitted_at long, cumulative double")
    gates = spark.createDataFrame([(1, "r", 40), (2, "r", 60), (4, "r", 60)], "market_id long, rule string, time long")
    assert {(r.market_id, r.admitted_at) for r in history.gated_admissions(admissions, gates).collect()} == {(1, 50), (2, 60)}


def test_shuffled_vectors_of_many_ranges_are_all_there(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(i)]) for i in rng.permutation(20_000)]
    vec = spark.createDataFrame(rows, "market_id long, vector array<float>").repartition(13).where("vector[0] >= 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.market_id: int(r.vector[0]) for r in vectors.shuffle_vectors(vec, 7).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    dealt = sorted(range(20_000), key=lambda i: (hashlib.md5(f"{i}:7".encode()).hexdigest(), i))
    assert got == dict(enumerate(dealt))


@pytest.mark.parametrize("most", [1, 20, 200_000])
def test_blocks_of_any_length_give_the_same_flow(spark, monkeypatch, most):
    monkeypatch.setattr(signal, "BLOCK_ROWS", most)
    rnd = random.Random(8)
    rows = [(1, i, ts, f"w{rnd.randrange(4)}", 0.5, rnd.choice(["YES", "NO"]), 1.0, rnd.choice([0.1, 0.5]), 1.0, 1.0, 1.0, 1.0, 0.0) for i, ts in enumerate(sorted(rnd.randrange(400_000) for _ in range(120)))]
    obs = spark.createDataFrame(rows, "market_id long, seq long, ts long, wallet string, yes_price double, direction string, volume double, skill double, weighted_history_notional double, effective_history_markets double, mean_similarity double, positive_history_weight_fraction double, skill_score_std double")
    width = signal._blocks(obs, 86400)
    assert {1: width == 3600, 20: 3600 < width < 86400, 200_000: width == 86400}[most]
    got = {r.seq: (r.total_weight, r.skilled_wallets) for r in signal.rolling_consensus(obs, signal.ConsensusConfig(skill_threshold=0.3, min_wallets=1), 86400).collect()}
    for _, seq, ts, *_ in rows:
        live = [r for r in rows if r[1] <= seq and r[2] >= ts - 86400 and r[7] >= 0.3]
        assert got[seq] == (0.5 * len(live), len({r[3] for r in live}))


def test_dense_skill_by_pieces_of_blocks(spark, monkeypatch):
    """A block is more than its product holds at once: the same sums, in few rows of shuffle."""
    tapeworks.distribute(spark)
    rng = np.random.default_rng(7)
    facts = [("w", m, float(rng.uniform(-1, 1)), float(rng.uniform(1, 9)), int(rng.integers(0, 60))) for m in range(40)]
    s = spark.createDataFrame(facts, "wallet string, market_id long, score double, notional double, settled_at long")
    t = spark.createDataFrame([(int(rng.integers(0, 40)), "w", int(rng.integers(0, 70)), i) for i in range(80)], "market_id long, wallet string, ts long, seq long")
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 5)))], "market_id long, vector array<float>")
    whole = [tuple(r) for r in skill.dense_skill(t, s, vec).orderBy("seq").collect()]
    monkeypatch.setattr(skill, "CELLS", 7)
    pieces = [tuple(r) for r in skill.dense_skill(t, s, vec).orderBy("seq").collect()]
    assert len(whole) == 80 and all(a[:3] == b[:3] and np.allclose(a[3:], b[3:]) for a, b in zip(whole, pieces, strict=True))
    assert skill.TARGETS * skill.HISTORY >= 32 * 512 * 2048
