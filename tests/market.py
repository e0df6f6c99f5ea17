"""A small hand-written marketplace that holds the awkward cases."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from mercato.sources.schemas import RAW_SCHEMAS

DAY = dt.timedelta(days=1)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def order(key, customer, placed, status="delivered", arrived=None, due=None):
    placed = at(placed) if placed else None
    return (
        key, customer, status, placed, placed, placed,
        at(arrived) if arrived else None,
        at(due) if due else (placed + 20 * DAY if placed else None),
    )


def item(key, number, product="p1", seller="s1", price="100.00", freight="10.00"):
    return (key, number, product, seller, D(price), D(freight))


BASE = {
    "orders": [
        order("o1", "c1", "2018-01-10 10:00:00", arrived="2018-01-20 10:00:00"),
        # Same person, 23 h 59 min later, across midnight.
        order("o2", "c2", "2018-01-11 09:59:00", arrived="2018-02-15 00:00:00"),
        # Arrives exactly when due, and one second late.
        order("o3", "c3", "2018-02-01 08:00:00", arrived="2018-02-21 08:00:00"),
        order("o4", "c4", "2018-02-01 08:00:00", arrived="2018-02-21 08:00:01"),
        order("o5", "c5", "2018-03-05 00:00:00", status="canceled"),
        order("o6", "c6", "2018-03-06 00:00:00", status="shipped"),
        # An order without items.
        order("o7", "c7", "2018-03-07 00:00:00", arrived="2018-03-08 00:00:00"),
    ],
    "customers": [
        ("c1", "u1", "santos", "SP"),
        ("c2", "u1", "campinas", "XX"),
        ("c3", "u2", "natal", "RN"),
        ("c4", "u3", "belem", None),
        ("c5", "u4", "recife", "PE"),
        ("c6", "u5", "olinda", "PE"),
        ("c7", "u6", "manaus", "AM"),
    ],
    "items": [
        item("o1", 1),
        item("o1", 2, "p2", "s2", "50.00", "25.00"),
        item("o2", 1, "p3", "s1", "0.00", "5.00"),
        item("o3", 1, "p4", "s3"),
        item("o4", 1),
        item("o5", 1, "p1", "s9", "30.00", "3.00"),
        item("o6", 1, "p9", "s1", "20.00", "2.00"),
        # No such order.
        item("o0", 1, "p1", "s1", "70.00", "7.00"),
    ],
    "payments": [
        ("o1", "voucher", 1, D("60.00")),
        ("o1", "credit_card", 11, D("125.00")),
        ("o2", "boleto", 0, D("5.00")),
        ("o3", "credit_card", 10, D("110.00")),
        ("o4", "credit_card", 5, D("110.00")),
    ],
    "reviews": [
        ("o1", 1),
        ("o1", 2),
        ("o2", None),
        ("o3", 5),
        ("o4", None),
        ("o4", 4),
    ],
    "products": [
        ("p1", "brinquedos", 100, 10, 10, 50),
        ("p2", "", 100, 20, 25, 40),
        ("p3", None, 100, None, 25, 40),
        ("p4", "moveis", 100, 50, 10, 100),
    ],
    "translation": [("brinquedos", "toys"), ("moveis", "")],
    "sellers": [
        ("s1", "santos", "SP"),
        ("s1", "abc", "RJ"),
        ("s2", "natal", "RN"),
        ("s3", "nowhere", "ZZ"),
    ],
}


def raw(spark, **changes):
    """The eight raw tables, with some replaced."""
    rows = {**BASE, **changes}
    return {
        name: spark.createDataFrame(rows[name], schema) for name, schema in RAW_SCHEMAS.items()
    }
