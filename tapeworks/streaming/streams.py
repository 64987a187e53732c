"""Structured Streaming forms: bars, rolling bars, activation gates and running consensus.

All take a stream of prints (market_id, wallet, event_time timestamp, side, size, yes_price,
token_price, ...). Only completed hours are emitted; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeworks.operators.signal import DIAGNOSTICS, FLOW_COLUMNS, ConsensusConfig, Flow, decision

HOUR = 3600


def _sums() -> list:
    return [F.sum("size").alias("quantity"), F.sum(F.col("size") * F.col("yes_price")).alias("price_quantity"), F.sum(F.col("size") * F.col("token_price")).alias("dollars"), F.count("*").alias("prints")]


def stream_hourly_bars(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(market_id, hour, quantity, price_quantity, dollars, prints) of each completed hour with a print."""
    bars = stream.withWatermark("event_time", delay).groupBy("market_id", F.window("event_time", "1 hour")).agg(*_sums())
    return bars.select("market_id", F.floor(F.unix_seconds("window.start") / HOUR).alias("hour"), "quantity", "price_quantity", "dollars", "prints")


class _Rolling(StatefulProcessor):
    """State of a market: the bars of its last width - 1 judged hours, the last judged hour, and the timer at the end of the next one with a bar in its window."""

    columns = ["market_id", "hour", "quantity", "price_quantity", "dollars", "prints"]

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.market = handle.getValueState("market", "judged long, timer long, hours array<long>, quantity array<double>, price_quantity array<double>, dollars array<double>, prints array<long>")

    def _judge(self, key: Any, new: pd.DataFrame | None, until: int, fired: bool) -> pd.DataFrame:
        """The windows that end with a completed hour up to until, silent hours included; new: completed bars."""
        names = self.columns[2:]
        if self.market.exists():
            judged, timer, hours, *held = self.market.get()
            bars = [np.asarray(x, np.int64 if n == "prints" else np.float64) for n, x in zip(names, held, strict=True)]
            hours = np.asarray(hours, np.int64)
        else:
            judged, timer, hours, bars = None, None, np.zeros(0, np.int64), [np.zeros(0, np.int64 if n == "prints" else np.float64) for n in names]
        if new is not None and len(new):
            hours = np.concatenate((hours, new["hour"].to_numpy(np.int64)))
            bars = [np.concatenate((x, new[n].to_numpy(x.dtype))) for n, x in zip(names, bars, strict=True)]
        first = int(hours.min()) if judged is None else judged + 1
        until = max(until, int(hours.max()), first - 1)
        # bars by hour from width - 1 before the first hour to judge, and their sums over each window
        start, size = first - self.width + 1, until - first + self.width
        dense = [np.bincount(hours - start, x, size) for x in bars]
        windows = [np.lib.stride_tricks.sliding_window_view(x, self.width).sum(axis=1) for x in dense] if until >= first else [np.zeros(0)] * len(names)
        some = windows[-1] > 0.5
        out = pd.DataFrame({"market_id": [key[0]] * int(some.sum()), "hour": np.arange(first, until + 1)[some], **{n: x[some] for n, x in zip(names, windows, strict=True)}}).astype({"prints": "int64"})
        left = hours > until - self.width + 1
        hours, bars = hours[left], [x[left] for x in bars]
        wanted = (until + 2) * HOUR * 1000 if len(hours) else None
        if timer is not None and not fired and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and (fired or timer != wanted):
            self.handle.registerTimer(wanted)
        self.market.update((until, wanted, hours.tolist(), *(x.tolist() for x in bars)))
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield self._judge(key, pd.concat(list(rows)), timerValues.getCurrentWatermarkInMs() // 1000 // HOUR - 1, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._judge(key, None, timerValues.getCurrentWatermarkInMs() // 1000 // HOUR - 1, True)

    def close(self) -> None:
        pass


def stream_rolling_bars(stream: DataFrame, width: str = "24 hours", delay: str = "0 seconds") -> DataFrame:
    """The same sums over a trailing window that ends at each full hour; hour is its last. width: whole hours, as `24 hours` or `2 days`.

    Prints become hourly bars first; a market's completed bars then meet those of its last hours in its
    state, so that no print or bar is multiplied by the hours of a window. Needs the RocksDB state store.
    """
    number, unit = width.split()
    hours = int(number) * {"hour": 1, "day": 24, "week": 168}[unit.removesuffix("s")]
    bars = stream.withWatermark("event_time", delay).groupBy("market_id", F.window("event_time", "1 hour")).agg(*_sums())
    bars = bars.select("market_id", F.window_time("window").alias("event_time"), F.floor(F.unix_seconds("window.start") / HOUR).alias("hour"), "quantity", "price_quantity", "dollars", "prints")
    kind = stream.schema["market_id"].dataType.simpleString()
    schema = f"market_id {kind}, hour long, quantity double, price_quantity double, dollars double, prints long"
    return bars.groupBy("market_id").transformWithStateInPandas(_Rolling(hours), schema, "append", "EventTime")


class _Gate(StatefulProcessor):
    """State of a market: its first print, the window's sums and all dollars up to the last judged hour, and the hours of that window and after it.

    Hours that left the window are deleted. One event-time timer, at the end of the next hour to
    judge, stands for silent hours; it is replaced when that hour changes.
    """

    columns = ["market_id", "time", "cumulative_notional", "recent_notional", "recent_prints", "recent_yes_vwap", "observed_hours"]

    def __init__(self, rule: dict):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "q double, pq double, d double, n long")
        self.market = handle.getValueState("market", "first long, close long, judged long, timer long, done boolean, q double, pq double, d double, n long, total double")

    def _load(self) -> dict:
        names = ("first", "close", "judged", "timer", "done", "q", "pq", "d", "n", "total")
        return dict(zip(names, self.market.get() if self.market.exists() else (None, None, None, None, False, 0.0, 0.0, 0.0, 0, 0.0), strict=True))

    def _save(self, m: dict) -> None:
        """Writes the state, with the timer at the end of the hour after the last judged one."""
        wanted = None if m["done"] or m["judged"] is None else (m["judged"] + 2) * HOUR * 1000
        if wanted != m["timer"]:
            if m["timer"] is not None:
                self.handle.deleteTimer(m["timer"])
            if wanted is not None:
                self.handle.registerTimer(wanted)
            m["timer"] = wanted
        self.market.update(tuple(m.values()))

    def _take(self, hours: pd.DataFrame) -> None:
        """hours: hour, q, pq, d, n, first (second of its first print), close."""
        m = self._load()
        if m["done"] or not len(hours):
            return
        for row in hours.itertuples():
            hour = int(row.hour)
            old = self.hours.getValue((hour,)) if self.hours.containsKey((hour,)) else (0.0, 0.0, 0.0, 0)
            self.hours.updateValue((hour,), (old[0] + float(row.q), old[1] + float(row.pq), old[2] + float(row.d), old[3] + int(row.n)))
            first = int(row.first)
            if m["first"] is None or first < m["first"]:
                m["first"] = first
                if not m["n"] and not m["total"]:  # nothing was judged yet
                    m["judged"] = first // HOUR - 1
            if m["close"] is None and pd.notna(row.close):
                m["close"] = int(row.close)
        self._save(m)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._take(initialState)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = []
        for pdf in rows:
            pdf = pdf.assign(pq=pdf["size"] * pdf["yes_price"], d=pdf["size"] * pdf["token_price"])
            parts.append(pdf.groupby("hour").agg(q=("size", "sum"), pq=("pq", "sum"), d=("d", "sum"), n=("size", "size"), first=("second", "min"), close=("close_at", "first")).reset_index())
        if parts:
            self._take(pd.concat(parts))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        m, r = self._load(), self.rule
        m["timer"] = None  # it has fired
        until = max(m["judged"], timerValues.getCurrentWatermarkInMs() // 1000 // HOUR - 1)
        rows = {k[0]: v for k, v in self.hours.iterator()}
        zero, found = (0.0, 0.0, 0.0, 0), None
        for hour in range(m["judged"] + 1, until + 1):
            new, old = rows.get(hour, zero), rows.get(hour - r["width"], zero)
            m["n"] += new[3] - old[3]
            for name, x, y in zip(("q", "pq", "d"), new, old, strict=False):
                m[name] = m[name] + x - y if m["n"] else 0.0
            m["total"] += new[2]
            vwap = m["pq"] / m["q"] if m["n"] and m["q"] > 1e-9 else 0.5
            time = (hour + 1) * HOUR
            wait = None if m["close"] is None else m["close"] - time
            horizon = r["max_days"] is None or (wait is not None and 0 < wait < r["max_days"] * 86400)
            dollars, seen = m["d"] if r["rolling"] else m["total"], time - m["first"]
            if horizon and seen >= r["warmup_hours"] * HOUR and round(dollars, 4) >= r["min_notional"] and m["n"] >= r["min_prints"] and round(max(vwap, 1 - vwap), 9) >= r["min_conviction"]:
                found = (key[0], time, m["total"], m["d"], int(m["n"]), vwap, seen / HOUR)
                break
        m["judged"], m["done"] = until, found is not None
        if m["done"]:
            self.hours.clear()
        else:
            for hour in rows:
                if hour <= until - r["width"]:
                    self.hours.removeKey((hour,))
        self._save(m)
        yield pd.DataFrame([found] if found else [], columns=self.columns)

    def close(self) -> None:
        pass


def stream_activation(stream: DataFrame, rule: dict, delay: str = "0 seconds", start: DataFrame | None = None) -> DataFrame:
    """One row a market: the first completed hour that meets the rule, silent hours included.

    rule: width, min_notional, rolling, min_prints, warmup_hours (from the first print), min_conviction,
    max_days (None: no horizon). start: prints of a batch tape (the stream's columns) before the
    stream's first, which give each market its state; a market judges them once the stream's clock
    passes their hours, or when its first row comes.
    """
    kind = stream.schema["market_id"].dataType.simpleString()

    def rows(df: DataFrame) -> DataFrame:
        second = F.unix_seconds("event_time")
        return df.select("market_id", "event_time", second.alias("second"), F.floor(second / HOUR).alias("hour"), "size", "yes_price", "token_price", F.col("close_at").cast("double").alias("close_at"))

    before = None
    if start is not None:
        sums = [F.sum("size").alias("q"), F.sum(F.col("size") * F.col("yes_price")).alias("pq"), F.sum(F.col("size") * F.col("token_price")).alias("d"), F.count("*").alias("n"), F.min("second").alias("first"), F.first("close_at", True).alias("close")]
        before = rows(start).groupBy("market_id", "hour").agg(*sums).groupBy("market_id")
    schema = f"market_id {kind}, time long, cumulative_notional double, recent_notional double, recent_prints long, recent_yes_vwap double, observed_hours double"
    return rows(stream.withWatermark("event_time", delay)).groupBy("market_id").transformWithStateInPandas(_Gate(rule), schema, "append", "EventTime", before)


class _Consensus(StatefulProcessor):
    """State of a market: its sums, squares, counts and largest wallets, and by wallet what it has in each direction.

    Weights never fall, so the largest wallet is a running maximum, and a batch reads the wallets that it touches and no others.
    """

    def __init__(self, cfg: dict, wallet: str):
        self.cfg, self.wallet = cfg, wallet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.by = handle.getMapState("by", f"wallet {self.wallet}", "yes double, no double, n_yes long, n_no long")
        self.market = handle.getValueState("market", "flow array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at = {c: i for i, c in enumerate(FLOW_COLUMNS)}
        flow = list(self.market.get()[0]) if self.market.exists() else [0.0] * len(FLOW_COLUMNS)
        weigh, held, out = Flow(self.cfg).weigh, {}, []
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"]).to_dict("records"):
            w = weigh(row)
            if w is not None:
                wallet, d = row["wallet"], row["direction"]
                if wallet not in held:
                    held[wallet] = list(self.by.getValue((wallet,))) if self.by.containsKey((wallet,)) else [0.0, 0.0, 0, 0]
                own, side = held[wallet], 0 if d == "YES" else 1
                flow[at["wallets"]] += not own[2] + own[3]
                flow[at[f"wallets_{d}"]] += not own[2 + side]
                flow[at[f"squares_{d}"]] += (own[side] + w) ** 2 - own[side] ** 2
                own[side] += w
                own[2 + side] += 1
                flow[at["yes" if d == "YES" else "no"]] += w
                flow[at["largest"]] = max(flow[at["largest"]], own[0] + own[1])
                flow[at[f"largest_{d}"]] = max(flow[at[f"largest_{d}"]], own[side])
                for name, column in DIAGNOSTICS.items():
                    flow[at[f"{name}_{d}"]] += w * row[column]
            out.append((row["market_id"], row["seq"], row["ts"], row["yes_price"], *flow))
        for wallet, own in held.items():
            self.by.updateValue((wallet,), (float(own[0]), float(own[1]), int(own[2]), int(own[3])))
        self.market.update(([float(x) for x in flow],))
        pdf = pd.DataFrame(out, columns=["market_id", "seq", "ts", "yes_price", *FLOW_COLUMNS])
        yield pdf.astype({c: "int32" for c in FLOW_COLUMNS if c.startswith("wallets")})

    def close(self) -> None:
        pass


def stream_consensus(stream: DataFrame, cfg: ConsensusConfig) -> DataFrame:
    """The running decision for each observation of a stream, in the order in which micro-batches bring them (by ts and seq inside one)."""
    if cfg.skill_threshold < 0 and cfg.weighting in ("skill", "skill_volume"):
        raise ValueError("a negative skill_threshold lets weights fall; a running maximum needs weights that do not")
    kind = {c: stream.schema[c].dataType.simpleString() for c in ("market_id", "wallet")}
    types = ["int" if c.startswith("wallets") else "double" for c in FLOW_COLUMNS]
    schema = f"market_id {kind['market_id']}, seq long, ts long, yes_price double, " + ", ".join(f"{c} {t}" for c, t in zip(FLOW_COLUMNS, types, strict=True))
    columns = ["market_id", "seq", "ts", "yes_price", "wallet", "direction", "volume", "skill", "weighted_history_notional", *DIAGNOSTICS.values()]
    out = stream.select(*columns).groupBy("market_id").transformWithStateInPandas(_Consensus(asdict(cfg), kind["wallet"]), schema, "append", "None")
    return decision(out, cfg, ["market_id", "seq", "ts", "yes_price"])
