"""Streams against their batch forms: wallets of any type, resumed gates, state that forgets."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import tapeworks
from tapeworks.operators import bars, signal
from tapeworks.plans.registry import _drained
from tapeworks.plans.testtape import END, START
from tapeworks.streaming import streams

RULE = {"width": 40, "min_notional": 20.0, "rolling": True, "min_prints": 3, "warmup_hours": 30, "min_conviction": 0.55, "max_days": None}


def prints(spark):
    """Three markets over the clock of `_drained`: dense, thin, and one that falls silent before its warm-up ends."""
    rows = [(f"m{m}", START + 40 + i * step, 10.0 + i % 4, 0.7, 0.7, i) for m, (n, step) in enumerate([(900, 7000), (40, 130_000), (3, 1000)]) for i in range(n)]
    df = spark.createDataFrame(rows, "market_id string, ts long, size double, yes_price double, token_price double, seq long")
    return df.withColumns({"close_at": F.lit(None).cast("long"), "event_time": F.timestamp_seconds("ts")})


@pytest.mark.parametrize("rolling", [True, False])
def test_gates_of_a_stream_equal_the_batch(spark, rolling):
    tapeworks.distribute(spark)
    rule = RULE | {"rolling": rolling}
    tape, v = prints(spark), SimpleNamespace(spark=spark)
    rolled = bars.rolling_bars(bars.dense_hours(bars.hourly_bars(tape), END), rule["width"])
    rules = spark.createDataFrame([("r", *[rule[k] for k in ("min_notional", "rolling", "min_prints", "warmup_hours", "min_conviction", "max_days")])], "rule string, min_notional double, rolling boolean, min_prints int, warmup_hours int, min_conviction double, max_days double")
    want = {r.market_id: (r.time, r.recent_prints, round(r.recent_notional, 6), r.observed_hours) for r in bars.activation(rolled, tape.select("market_id", "close_at").distinct(), rules).collect()}
    assert {"m0", "m2"} <= set(want)
    cut = START + 90_000
    whole = _drained(v, tape, lambda s: streams.stream_activation(s, rule))
    resumed = _drained(v, tape.where(F.col("ts") >= cut), lambda s: streams.stream_activation(s, rule, start=tape.where(F.col("ts") < cut)), late=False)
    for out in (whole, resumed):
        assert {r.market_id: (r.time, r.recent_prints, round(r.recent_notional, 6), r.observed_hours) for r in out.collect()} == want


def test_consensus_of_a_stream_with_string_wallets(spark):
    tapeworks.distribute(spark)
    rows = [(f"m{i % 2}", i, START + i * 30_000, f"0x{i * i % 7}", 0.5, "YES" if i * 7 % 5 < 3 else "NO", 1.0 + i % 3, 0.1 * (i % 6), 1.0, 2.0, 1.0, 1.0, 0.0) for i in range(250)]
    obs = spark.createDataFrame(rows, "market_id string, seq long, ts long, wallet string, yes_price double, direction string, volume double, skill double, weighted_history_notional double, effective_history_markets double, mean_similarity double, positive_history_weight_fraction double, skill_score_std double")
    cfg = signal.ConsensusConfig(skill_threshold=0.15, consensus_threshold=0.5, min_wallets=2)

    def rounded(df):
        return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()], key=repr)

    got = _drained(SimpleNamespace(spark=spark), obs, lambda s: streams.stream_consensus(s, cfg), late=False)
    assert rounded(got) == rounded(signal.consensus(obs, cfg).select(*got.columns))
    with pytest.raises(ValueError):
        streams.stream_consensus(obs, signal.ConsensusConfig(skill_threshold=-1.0))


def test_rolling_bars_of_a_stream_equal_the_batch_and_multiply_nothing(spark):
    tapeworks.distribute(spark)
    tape = prints(spark)
    complete = tape.agg(F.floor(F.max("ts") / 3600)).first()[0]
    rolled = bars.rolling_bars(bars.dense_hours(bars.hourly_bars(tape), complete * 3600), 40).where("recent_prints > 0")
    want = {(r.market_id, r.hour): (r.recent_quantity, round(r.recent_pq, 6), round(r.recent_notional, 6), r.recent_prints) for r in rolled.collect()}
    plans = []

    def build(stream):
        out = streams.stream_rolling_bars(stream, "40 hours")
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out

    got = _drained(SimpleNamespace(spark=spark), tape, build).collect()
    assert len(got) == len(want) and {(r.market_id, r.hour): (r.quantity, round(r.price_quantity, 6), round(r.dollars, 6), r.prints) for r in got} == want
    assert "Expand" not in plans[0]  # a print is in one hourly window, not in 40
