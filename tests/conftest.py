import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.fixture(scope="session")
def same_rows(duck):
    def plain(v):
        if v is None or isinstance(v, (str, bool)):
            return v
        return round(float(v), 9) if isinstance(v, float) else int(v)

    def check(df, sql):
        names = sorted(df.columns)
        mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
        rel = duck.execute(sql)
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == names
        order = [cols.index(n) for n in names]
        theirs = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
        assert mine == theirs

    return check
