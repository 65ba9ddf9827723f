import datetime as dt
import random

from colorway.operators import carts as CR

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, session_id long, item_key long, op string, delta int"


def replay(events):
    """Row-by-row replay of the cart store rules (the reference behaviour)."""
    carts = {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        _, _, s, k, op, d = e
        lines = carts.setdefault(s, {})
        if op == "add":
            lines[k] = 1 if k not in lines else min(20, lines[k] + 1)
        elif op == "change":
            if k in lines:
                lines[k] = max(1, min(20, lines[k] + (d or 0)))
        elif op == "remove":
            lines.pop(k, None)
        elif op == "clear":
            lines.clear()
    return {(s, k): q for s, ls in carts.items() for k, q in ls.items()}


def ev(i, op, k=1, d=1, s=1, sec=None):
    return (i, T0 + dt.timedelta(seconds=i if sec is None else sec), s, k, op, d)


def fold(spark, events, partitions=None, prior=None, **kw):
    df = spark.createDataFrame(events, SCHEMA)
    return {(r["session_id"], r["item_key"]): r["qty"] for r in CR.cart_state(df, prior, partitions, **kw).collect()}


def test_hand_cases(spark):
    events = (
        [ev(1, "change", k=1, d=5)]                      # change before add: ignored
        + [ev(2 + i, "add", k=1) for i in range(25)]     # add past 20 stays 20
        + [ev(30, "change", k=1, d=-100)]                # clamp at 1
        + [ev(31, "add", k=2), ev(32, "clear", k=9), ev(33, "add", k=2)]  # re-add after clear
        + [ev(34, "add", k=3), ev(35, "remove", k=3)]    # removed
        + [ev(36, "add", k=4, s=2), ev(37, "clear", s=3)]  # clear of another session
    )
    got = fold(spark, events)
    assert got == replay(events) == {(1, 2): 1, (2, 4): 1}
    # Equal timestamps: event id decides the order.
    tie = [ev(2, "add", sec=0), ev(1, "remove", sec=0)]
    assert fold(spark, tie) == replay(tie) == {(1, 1): 1}


def test_random_against_replay(spark):
    rnd = random.Random(7)
    ops = ["add"] * 5 + ["change"] * 4 + ["remove", "clear"]
    events = []
    for i in range(3000):
        # one hot session/key holds a large share of the events
        s, k = (1, 1) if rnd.random() < 0.35 else (rnd.randint(1, 20), rnd.randint(1, 5))
        events.append((i, T0 + dt.timedelta(seconds=rnd.randint(0, 5000)), s, k, rnd.choice(ops),
                       rnd.randint(-25, 25)))
    want = replay(events)
    # Many ordered chunks: the hot key is split over partitions.
    assert fold(spark, events, partitions=37) == want
    assert fold(spark, events, partitions=1) == want
    # Tiny tree levels: runs of 4, 16, 64 steps, then whole keys.
    assert fold(spark, events, partitions=5, shifts=(2, 4, 6)) == want


def test_prior_state_continues(spark):
    events = [ev(1, "add", k=1), ev(2, "add", k=1), ev(3, "add", k=2), ev(4, "change", k=2, d=3),
              ev(5, "remove", k=1), ev(6, "add", k=1), ev(7, "add", k=5, s=2), ev(8, "clear", s=2),
              ev(9, "change", k=9, d=2)]
    for cut in range(len(events) + 1):
        first = spark.createDataFrame(events[:cut], SCHEMA)
        prior = CR.cart_state(first)
        got = fold(spark, events[cut:], prior=prior)
        assert got == replay(events), cut


def test_cart_sessions(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    existing = spark.createDataFrame([("s9", 1), ("s1", 1), ("s2", 2)], "id string, user_id long")
    got = {r["user_id"]: (r["session_id"], r["created"]) for r in CR.cart_sessions(users, existing).collect()}
    assert got[1] == ("s1", False) and got[2] == ("s2", False)
    assert got[3][1] is True and len(got[3][0]) == 64


def replay_attrs(events):
    """Row-by-row replay that also keeps the price fixed by the creating add."""
    carts = {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        _, _, s, k, op, d, price = e
        lines = carts.setdefault(s, {})
        if op == "add":
            if k not in lines:
                lines[k] = [1, price]
            else:
                lines[k][0] = min(20, lines[k][0] + 1)
        elif op == "change":
            if k in lines:
                lines[k][0] = max(1, min(20, lines[k][0] + (d or 0)))
        elif op == "remove":
            lines.pop(k, None)
        elif op == "clear":
            lines.clear()
    return {(s, k): tuple(v) for s, ls in carts.items() for k, v in ls.items()}


def test_first_add_fixes_price(spark):
    rnd = random.Random(11)
    ops = ["add"] * 5 + ["change"] * 3 + ["remove", "clear"]
    events = [(i, T0 + dt.timedelta(seconds=rnd.randint(0, 3000)), rnd.randint(1, 5), rnd.randint(1, 3),
               rnd.choice(ops), rnd.randint(-9, 9), rnd.randint(100, 999)) for i in range(1500)]
    schema = SCHEMA + ", price long"
    want = replay_attrs(events)
    df = spark.createDataFrame(events, schema)
    got = {(r["session_id"], r["item_key"]): (r["qty"], r["price"])
           for r in CR.cart_state(df, partitions=7, shifts=(3, 6), attrs=["price"]).collect()}
    assert got == want
    # Cut in two batches, the second folded onto the first's lines.
    cut = sorted(events, key=lambda e: (e[1], e[0]))[700]
    first = [e for e in events if (e[1], e[0]) < (cut[1], cut[0])]
    second = [e for e in events if (e[1], e[0]) >= (cut[1], cut[0])]
    prior = CR.cart_state(spark.createDataFrame(first, schema), attrs=["price"])
    got2 = {(r["session_id"], r["item_key"]): (r["qty"], r["price"])
            for r in CR.cart_state(spark.createDataFrame(second, schema), prior, attrs=["price"]).collect()}
    assert got2 == want
