import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from strandmill.session import session

    s = session("tests", "local[8]", **{"spark__sql__shuffle__partitions": "2", "spark__ui__enabled": "false", "spark__driver__memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def agrees(spark):
    """A function that runs a query and its SQL over the smallest test tables and compares rows, whatever their order."""
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, list | tuple) else v

    def run(query, sql):
        df = query(spark, str(DATA))
        rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
        if sql is not None:
            rel = con.sql(sql)
            names = list(rel.columns)
            assert sorted(names) == sorted(df.columns)
            want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall()]
            assert sorted(rows, key=repr) == sorted(want, key=repr)
        return rows

    return run
