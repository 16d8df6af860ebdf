import math
import zlib
from datetime import datetime, timedelta

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkvane.llm import asof

CLICKS = "click_id long, ts timestamp_ntz, client_id long, at string, PART string"
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, key string"
HOUR = 3_600_000_000


def at(us):
    return None if us is None else datetime(1970, 1, 1) + timedelta(microseconds=us)


def crc(n):
    return zlib.crc32(str(n).encode())


def brute(clicks, sales):
    """Rows as the contract says, from (click_id, us, client) and (sale_id, client, total, us, priority)."""

    def floor(n, us):
        return us - us % HOUR if us is not None and n is not None and crc(n) % 2 else us

    orders = []
    for sale, client, total, us, priority in sales:
        cents, us = None if total is None else math.floor(100 * total + 0.5), floor(sale, us)
        orders.append((sale, client, cents, us, priority))
        if sale is not None and crc(sale) % 3:
            orders.append((-1 - sale, client, cents, us, None if priority is None else 6 - priority))
    out = {}
    for click, us, client in clicks:
        us = floor(click, us)
        mine = [o for o in orders if o[3] is not None and client is not None and us is not None and o[1] == client and 0 <= us - o[3] <= 240 * HOUR]
        row = (click, client, us, None, None, None, 0)
        if mine:
            tied = [o for o in mine if o[3] == max(o[3] for o in mine)]
            best = min(tied, key=lambda o: (o[4] is None, o[4] or 0, o[0] is None, -(o[0] or 0), o[2] is None, -(o[2] or 0)))
            row = (click, client, us, best[0], us - best[3], best[2], len(tied))
        out[click] = row
    return sorted(out.values(), key=str)


def run(spark, folder, clicks, sales):
    c = spark.createDataFrame([(i, at(us), k, "x", "y") for i, us, k in clicks], CLICKS)
    s = spark.createDataFrame([(i, k, t, at(us), p, "x") for i, k, t, us, p in sales], SALES)
    sf = folder(clicks=c, sales=s)
    return sorted(map(tuple, asof.op11_asof(spark, sf).collect()), key=str), sf


def test_ties_nulls_copies_and_tolerance(spark, folder):
    t = 1_704_067_200_000_000
    sales = [(n, 1, n + 0.25, t + n * HOUR // 2, n % 6) for n in range(40)]  # a client of most rows
    sales += [(100, 2, 1.0, t, None), (101, 2, 2.0, t, 3), (102, 2, 2.005, t, 3), (102, 2, 2.005, t, 3), (103, 2, None, t, 3)]
    sales += [(None, 3, 5.0, t + 1, 1), (105, None, 1.0, t, 1), (106, 4, 1.0, None, 1)]
    clicks = [(n, t + n * HOUR // 3, 1) for n in range(80)] + [(7, t + 7 * HOUR // 3, 1)] * 3
    clicks += [(200 + d, t + 240 * HOUR + d, 2) for d in (-1, 0, 1)] + [(300, t, 2), (301, t - 1, 2), (302, t, None), (303, None, 1), (304, t + 2, 3), (305, t, 4), (306, t, 99)]
    found, sf = run(spark, folder, clicks, sales)
    assert found == brute(clicks, sales)
    con = duckdb.connect()
    for name in ("clicks", "sales"):
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet/*.parquet')")
    order = "click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied"
    assert sorted(con.execute(f"select {order} from ({asof.OP11_SQL})").fetchall(), key=str) == found


def test_a_session_zone_changes_nothing(spark, folder):
    t = 1_711_846_800_000_000  # clocks change in Berlin
    clicks, sales = [(n, t + n * HOUR // 2, 1) for n in range(8)], [(n, 1, 1.0, t + n * HOUR, 1) for n in range(4)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        found, _ = run(spark, folder, clicks, sales)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == brute(clicks, sales)


def test_empty_tables(spark, tmp_path, folder):
    found, _ = run(spark, folder, [], [(1, 1, 1.0, 5, 1)])
    assert found == []


def test_no_orders(spark, folder):
    found, _ = run(spark, folder, [(1, 5, 1), (None, 7, 1)], [])
    assert found == sorted([(1, 1, 5, None, None, None, 0) if crc(1) % 2 == 0 else (1, 1, 0, None, None, None, 0), (None, 1, 7, None, None, None, 0)], key=str)


ROWS = st.tuples(st.integers(0, 3), st.integers(0, 30))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROWS, min_size=1, max_size=40), st.lists(ROWS, min_size=1, max_size=40))
def test_ranges_carry_the_last_group(spark, left, right):
    """Many ranges and few keys, against a plain search."""
    clicks = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "id long, key long, at long")
    groups = spark.createDataFrame([(k, t, 100 * k + t) for k, t in sorted(set(right))], "key long, at long, value long")
    got = {r.id: (r.value, r.order_at) for r in asof.as_of(clicks, groups, 9).collect()}
    for i, (k, t) in enumerate(left):
        near = [x for key, x in right if key == k and 0 <= t - x]
        best = max(near) if near and t - max(near) <= 9 else None
        assert got[i] == ((None, None) if best is None else (100 * k + best, best))


@pytest.mark.parametrize("text", ["0", "-17", "9223372036854775807"])
def test_crc_in_sql(text):
    assert duckdb.connect().execute(f"select {asof.crc_sql(f'({text})::bigint')}").fetchone()[0] == zlib.crc32(text.encode())
