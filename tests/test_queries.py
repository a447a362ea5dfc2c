"""Every registered query against its SQL twin, at the smallest size, and the streaming operators."""

from datetime import date, datetime

import duckdb
import pytest

from siltstone.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return str(x) if isinstance(x, (date, datetime)) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    a = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    b = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_twin_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    from siltstone.streaming.snapshots import daily_snapshots, update_counts

    rows = [(1, datetime(2026, 10, 1, 2), 5), (1, datetime(2026, 10, 1, 9), 6), (2, datetime(2026, 10, 1, 3), None), (1, datetime(2026, 10, 2, 2), 7)]
    kind = "pair int, captured_at timestamp, position int"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    for name, df, mode in (("daily", daily_snapshots(stream, ["pair"]), "append"), ("counts", update_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("daily").count() == 3
    assert {(str(r.start)[:10], r.n, r.unranked) for r in spark.table("counts").collect()} == {("2026-10-01", 3, 1), ("2026-10-02", 1, 0)}
