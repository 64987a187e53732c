"""Every registered query over the tape has a form, and a sample of them equals DuckDB's."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["O04_normalize_trades", "O17_tape_quality", "O35_activation", "O38_thin_tape", "O48_wallet_skill_uniform", "O50_consensus", "O41_participation_fills", "O01_read_tape", "O30_bootstrap_ci", "O44_daily_marks", "O45_embed_text_encoder", "O46_market_pairs", "O49_shuffle_vectors", "O51_rolling_consensus", "O74_equity_daily", "O67_stream_hourly_bars", "O69_stream_activation", "O69_stream_activation_resumed", "O70_stream_consensus", "O48_wallet_skill_semantic", "O40_delayed_fills", "O42_sliced_fills"]


def rows(cols, data):
    def norm(v):
        return None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(norm(r[c]) for c in cols) for r in data), key=repr)


def test_entry_and_names():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("O")]
    assert len(names) >= 80
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_duckdb(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    r = con.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(df.columns, [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_plans_of_the_chain_start_at_files(spark):
    """A late table of the chain is read from a written one, so its plan does not hold those before."""
    import __spark_entry__ as entry

    df = entry.queries()["O29_case_summary"](spark, DATA)
    assert len(df._jdf.queryExecution().executedPlan().toString().splitlines()) < 1000


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Tables of sf0.001 twice, the second time with shifted keys, so that there are markets far above 1,000."""
    at = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    shifts = {"supplier": {"s_suppkey": 4500000}, "orders": {"o_orderkey": 150001, "o_custkey": 15000}, "lineitem": {"l_orderkey": 150001, "l_partkey": 20000, "l_suppkey": 4500000}, "embeddings": {"vec_id": 4500000}}
    for t, keys in shifts.items():
        con.sql(f"COPY (SELECT * EXCLUDE (i) REPLACE ({', '.join(f'{k} + {by} * i AS {k}' for k, by in keys.items())}) FROM '{DATA}/{t}.parquet', (SELECT unnest([0, 1]) AS i)) TO '{at}/{t}.parquet'")
    return str(at)


def same_as_duckdb(spark, name, folder):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("supplier", "orders", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    r = con.sql(entry.oracle_sql()[name])
    return rows(df.columns, df.collect()) == rows(df.columns, [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_daily_equity_of_markets_over_a_thousand(spark, copies):
    assert same_as_duckdb(spark, "O74_equity_daily", copies)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_the_chain_leaves_no_shuffle_files(spark, copies):
    """A kept table's shuffle files go when it is written, and what only its making needed goes too."""
    from tapeworks.plans.testtape import View

    local = [x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def shuffled():
        return sum(len([f for f in files if f.startswith("shuffle_")]) for d in local for _, _, files in os.walk(d))

    v, before = View(spark, copies), shuffled()
    v.staked
    assert shuffled() <= before
    assert not {"prints", "flow"} & set(os.listdir(v.folder.removeprefix("file:")))
