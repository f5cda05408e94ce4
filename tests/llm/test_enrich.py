"""Sales enriched through the stream, against a loop over batches, clients and versions."""

from __future__ import annotations

import datetime as dt
import random
import zlib
from math import floor

import pytest

from peakforge.llm import enrich

EPOCH, HOURS = dt.datetime(1970, 1, 1), dt.timedelta(hours=36)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, kind string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, balance double, seg long"


def brute(sales: list[dict], changes: list[dict]) -> list[tuple]:
    number = lambda day: 9 if day is None else max(0, min(9, (day - 19723) * 10 // 152))
    key = lambda v: (v["valid_at"], v["seq"] is not None, v["seq"] or 0, v["change_id"] is not None, v["change_id"] or 0)
    distinct = [dict(t) for t in dict.fromkeys(tuple(c.items()) for c in changes) if dict(t)["valid_at"] is not None]
    arrivals = [(number(None if c["change_id"] is None else (c["valid_at"] - EPOCH).days + zlib.crc32(str(c["change_id"]).encode()) % 4), c) for c in distinct]
    sold = [(number(s["arrived_at"] and (s["arrived_at"] - EPOCH).days), s) for s in sales]
    held, waiting, out, low = {}, [], [], dt.datetime.min + HOURS
    tops = [low, low]
    for b in range(11):
        ws, wc = (t - HOURS for t in tops)
        h = min(ws, wc)
        for _, c in (x for x in arrivals if x[0] == b):
            if c["valid_at"] < wc:
                out.append(("late", c["change_id"], b, None, None, None, None))
            elif c["client_id"] is not None:
                held.setdefault(c["client_id"], []).append(c)
        waiting += [s for n, s in sold if n == b]
        due = [s for s in waiting if s["sold_at"] is None or s["sold_at"] < h or b == 10]
        waiting = [s for s in waiting if not (s["sold_at"] is None or s["sold_at"] < h or b == 10)]
        for s in due:
            mine = held.get(s["client_id"], []) if s["client_id"] is not None else []
            v = max((c for c in mine if s["sold_at"] is not None and c["valid_at"] <= s["sold_at"]), key=key, default=None)
            cents = None if v is None or v["balance"] is None else floor(100 * v["balance"] + 0.5)
            out.append(("sale", s["sale_id"], b, len(mine), v and v["change_id"], cents, v and v["op"]))
        for c, mine in held.items():
            below = sorted((v for v in mine if v["valid_at"] <= h), key=key)
            held[c] = below[-1:] + [v for v in mine if v["valid_at"] > h]
        tops = [max([t, *(x[f] for n, x in rows if n == b and x[f] is not None)]) for t, rows, f in zip(tops, (sold, arrivals), ("sold_at", "valid_at"), strict=True)]
    return sorted(out, key=repr)


def tables(seed: int, n: int, clients: int) -> tuple[list[dict], list[dict]]:
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    time = lambda: start + dt.timedelta(hours=r.choice([r.randrange(2900), r.randrange(40) * 72]), minutes=r.choice([0, 0, 7]), microseconds=r.choice([0, 1]))
    who = lambda: r.choice([None, 1, 1, 1, r.randrange(clients)])
    sales, changes = [], []
    for i in range(n):
        t = time() if r.random() > 0.05 else None
        came = (t or time()) + dt.timedelta(hours=r.choice([0, 1, 30, 900]))
        sales.append({"sale_id": i // 2 if r.random() < 0.1 else i, "client_id": who(), "status": None, "total": 1.0, "sold_at": t, "arrived_at": came if r.random() > 0.02 else None, "kind": "x"})
        changes.append({"change_id": i if r.random() > 0.02 else None, "client_id": who(), "seq": r.choice([None, 0, 1]), "op": r.choice(["U", "D", None]), "valid_at": time() if r.random() > 0.03 else None, "source": None, "balance": r.choice([None, -0.005, 1.005, r.random() * 1000]), "seg": 7})
    return sales + sales[:5], changes + changes[:20]


@pytest.fixture
def few_stores(spark):
    """Each start opens and saves a state store per shuffle partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_enriched_sales_equal_a_loop(spark, few_stores):
    """Clients with over 20 rows are split by time, the others are not."""
    sales, changes = tables(3, 400, 40)
    got = enrich.enrich_sales(spark.createDataFrame([tuple(s.values()) for s in sales], SALES), spark.createDataFrame([tuple(c.values()) for c in changes], CHANGES), 20, 16, 64)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(sales, changes)
    assert got.columns == ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]


def test_empty_tables(spark, few_stores):
    none = lambda schema: spark.createDataFrame([], schema)
    assert enrich.enrich_sales(none(SALES), none(CHANGES)).collect() == []
