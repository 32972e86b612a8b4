"""Every registered query of the library against its SQL form."""

import math
import os

import duckdb
import pytest
from pulsegrid.jobs import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("n", float(v))
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)):
        return ("n", "nan" if math.isnan(v) else float(f"{v:.9g}"))
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    got = rows_of(frame.columns, frame.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    assert sorted(columns) == sorted(frame.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or x[0] == y[0] == "n" and abs(x[1] - y[1]) <= 1e-9 + 1e-6 * abs(y[1]) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """Their results are held against plain loops in the other tests; here they are to run over whole tables."""
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


ODD = {
    # Three rest beats of which two are close: a difference above 2**31 ms.
    "gap": "VALUES (900000, TIMESTAMP '2024-01-01 00:00:00', 99, 'view'), (900001, '2024-01-01 00:00:01', 99, 'view'), (900002, '2024-01-30 23:59:00', 99, 'view'), (900003, '2024-01-09 00:00:00', 99, 'click')",
    # A rest phase whose intervals are all below 10 ms: milliseconds nevertheless.
    "near": "VALUES (900000, TIMESTAMP '2024-01-05 00:00:00', 99, 'view'), (900001, '2024-01-05 00:00:00.0053', 99, 'view'), (900002, '2024-01-05 00:00:00.0091', 99, 'view'), (900003, '2024-01-05 00:01:30', 99, 'click')",
    # Beats at the same time, of some recordings in the rest phase too: infinite rates.
    "tie": "SELECT event_id + 100000, ts, user_id, event_type FROM old WHERE user_id % 3 = 0 AND (user_id % 2 = 0 OR event_type <> 'view')",
}


@pytest.mark.parametrize("odd", sorted(ODD))
def test_rest_ratios_of_odd_beats(spark, tmp_path, odd):
    con = duckdb.connect()
    con.execute("CREATE VIEW old AS SELECT * FROM read_parquet('/root/testdata/sf0.001/events.parquet')")
    con.execute(f"CREATE TABLE events AS SELECT * FROM old UNION ALL SELECT event_id, ts, user_id, event_type, 1.5, '' FROM ({ODD[odd]}) t(event_id, ts, user_id, event_type)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("j10_hrv_rest_ratio", "a4_a7_hrv_summary"):
        frame = registry.queries()[name](spark, str(tmp_path))
        got = rows_of(frame.columns, frame.collect())
        sql = registry.oracle_sql()[name]
        if odd == "gap" and name == "j10_hrv_rest_ratio":
            with pytest.raises(duckdb.ConversionException):
                con.execute(sql).fetchall()
            sql = sql.replace("::INTEGER", "::BIGINT")  # the SQL itself stops at 2**31 ms
        cursor = con.execute(sql)
        want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
        assert len(got) == len(want) and len(got) >= 15
        for a, b in zip(got, want, strict=True):
            assert a == b or all(x == y or x[0] == y[0] == "n" and "nan" not in (x[1], y[1]) and abs(x[1] - y[1]) <= 1e-9 + 1e-6 * abs(y[1]) for x, y in zip(a, b, strict=True)), (a, b)
        if odd == "tie":
            assert {("n", math.inf), ("n", "nan")} <= {v for row in got for v in row}
