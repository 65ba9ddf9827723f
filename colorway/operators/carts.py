"""Cart state folded from cart events, for all sessions at once.

Rules of the cart store: add -> 1 if absent, else min(20, q + 1); change d ->
clamp(q + d, 1, 20), ignored if absent; remove -> absent; clear -> the whole
session empty. Events apply in (ts, event_id) order.

How it scales: each event is a step function on the line state q (0 =
absent, else 1..20), of one closed form: f(0) = z, and for q >= 1 either a
constant c or a clamp min(h, max(l, q + d)). add is (z=1, clamp(q+1, 1, 20)),
change is (z=0, clamp(q+d, 1, 20)), remove is (z=0, constant 0). These forms
compose into the same form, so the ordered fold is associative and runs as a
tree: events are range-sorted by (session, key, ts, id), which splits a hot
key over many partitions in order, and contiguous runs of at most 2**17 steps
are composed level by level (``compose_ordered``). A clear empties the whole
session, so only events after the session's last clear count, starting
absent. No key's events are ever gathered in one place; the events are read
twice (last clears, then the steps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colorway.session import range_partitions

# Quantity bounds of a cart line.
MIN_QTY, MAX_QTY = 1, 20

_INF = 1 << 40  # stands in for +/- infinity in a clamp; far from overflow
FIELDS = ["z", "k", "c", "d", "l", "h"]


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def _present(f: Column, q: Column) -> Column:
    """f on a present quantity q >= 1."""
    return F.when(f["k"], f["c"]).otherwise(_clamp(q + f["d"], f["l"], f["h"]))


def apply_step(f: Column, q: Column) -> Column:
    """f(q) for q in {0 (absent), 1..20}."""
    return F.when(q == 0, f["z"]).otherwise(_present(f, q))


def _step(z, k, c, d, l, h, fa=None, ar=None) -> Column:
    fields = [z.cast("long").alias("z"), k.alias("k"), c.cast("long").alias("c"),
              d.cast("long").alias("d"), l.cast("long").alias("l"), h.cast("long").alias("h")]
    if fa is not None:
        # Line attributes (name, price ...): those of the segment's first add,
        # and of its first add after its last remove.
        fields += [fa.alias("fa"), ar.alias("ar")]
    return F.struct(*fields)


def _compose(f: Column, g: Column, attrs: bool) -> Column:
    """g after f, in the same form."""
    k = f["k"] | g["k"]
    c = F.when(f["k"], apply_step(g, f["c"])).otherwise(g["c"])
    extra = {}
    if attrs:
        extra = {"fa": F.coalesce(f["fa"], g["fa"]),
                 "ar": F.when(g["k"], g["ar"]).when(f["k"], F.coalesce(f["ar"], g["fa"]))}
    return _step(apply_step(g, f["z"]), k, c, f["d"] + g["d"], _clamp(f["l"] + g["d"], g["l"], g["h"]),
                 _clamp(f["h"] + g["d"], g["l"], g["h"]), **extra)


def _identity(attr_type: str | None) -> Column:
    extra = {}
    if attr_type:
        extra = {"fa": F.lit(None).cast(attr_type), "ar": F.lit(None).cast(attr_type)}
    return _step(F.lit(0), F.lit(False), F.lit(0), F.lit(0), F.lit(-_INF), F.lit(_INF), **extra)


def _fields(attr_type: str | None) -> list[str]:
    return FIELDS + (["fa", "ar"] if attr_type else [])


def _fold(arr: Column, attr_type: str | None = None) -> Column:
    """Compose an ordered array of steps."""
    names = _fields(attr_type)
    return F.aggregate(arr, _identity(attr_type),
                       lambda acc, e: _compose(acc, _step(*[e[x] for x in names]), bool(attr_type)))


def event_step(op: Column, delta: Column, attrs: Column | None = None, attr_type: str | None = None) -> Column:
    """The step of one add / change / remove event (with the event's line
    attributes when tracked: an add may create the line)."""
    lo, hi = F.lit(MIN_QTY), F.lit(MAX_QTY)
    d = F.when(op == "add", F.lit(1)).otherwise(F.coalesce(delta, F.lit(0)))
    extra = {}
    if attrs is not None:
        extra = {"fa": F.when(op == "add", attrs), "ar": F.lit(None).cast(attr_type)}
    return _step(F.when(op == "add", F.lit(1)).otherwise(F.lit(0)), op == "remove", F.lit(0), d, lo, hi, **extra)


# Group sizes of the tree fold: each level gathers at most 2**17 items.
_LEVEL_SHIFTS = (17, 34, 51)


def compose_ordered(steps: DataFrame, keys: list[str], order: list[str], partitions: int,
                    shifts: tuple[int, ...] = _LEVEL_SHIFTS, attr_type: str | None = None) -> DataFrame:
    """Per ``keys`` group, the composition of its steps (column ``step``) in
    ``order``.

    One range sort puts every key's steps in order across partitions (a hot
    key spans many); ``monotonically_increasing_id`` then grows with that
    order inside a key (partition id in the high bits, row in the low bits).
    Grouping by (key, id >> 17), then >> 34, then >> 51, then the key alone
    folds contiguous runs, so no group ever holds more than 2**17 items, at
    any data size.
    """
    names = _fields(attr_type)
    ranged = (steps.repartitionByRange(partitions, *keys, *order)
              .sortWithinPartitions(*keys, *order)
              .select(*keys, F.monotonically_increasing_id().alias("_m"), "step"))
    level = ranged
    for shift in shifts:
        grouped = level.groupBy(*keys, F.shiftright("_m", shift).alias("_g")).agg(
            F.min("_m").alias("_first"),
            F.array_sort(F.collect_list(F.struct("_m", *[F.col("step")[x].alias(x) for x in names]))).alias("_s"))
        level = grouped.select(*keys, F.col("_first").alias("_m"), _fold(F.col("_s"), attr_type).alias("step"))
    final = level.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("_m", *[F.col("step")[x].alias(x) for x in names]))).alias("_s"))
    return final.select(*keys, _fold(F.col("_s"), attr_type).alias("step"))


def cart_state(events: DataFrame, prior: DataFrame | None = None, partitions: int | None = None,
               session: str = "session_id", key: str = "item_key",
               shifts: tuple[int, ...] = _LEVEL_SHIFTS, attrs: list[str] | None = None) -> DataFrame:
    """D1 (and one X5 batch): the cart lines (session, key, qty) after
    ``events``, starting from ``prior`` lines (session, key, qty) if given.

    Events carry session, key, ts, event_id, op (add/change/remove/clear) and
    delta; they apply in (ts, event_id) order. ``attrs`` names event columns
    (e.g. name, price) that the add creating a line fixes on it; later adds
    of the same line do not change them. Prior lines then carry them too.
    """
    spark = events.sparkSession
    n = partitions or range_partitions(events)
    attrs = list(attrs or [])
    at = F.struct("ts", "event_id")
    ev = events.select(session, key, "ts", "event_id", "op", "delta", *attrs)
    attr_col = F.struct(*attrs) if attrs else None
    attr_type = ev.select(attr_col.alias("a")).schema["a"].dataType.simpleString() if attrs else None
    clears = ev.where(F.col("op") == "clear").groupBy(session).agg(F.max(at).alias("_clr"))
    live = ev.where(F.col("op") != "clear").join(clears, session, "left")
    live = live.where(F.col("_clr").isNull() | (at > F.col("_clr")))
    steps = live.select(session, key, "ts", "event_id", F.col("_clr").isNotNull().alias("_cut"),
                        event_step(F.col("op"), F.col("delta"), attr_col, attr_type).alias("step"))
    folded = compose_ordered(steps, [session, key, "_cut"], ["ts", "event_id"], n, shifts, attr_type)

    def line(start: Column, prior_attrs: list[Column]) -> list[Column]:
        qty = apply_step(F.col("step"), start).alias("qty")
        # After a remove: the add after the last one; from absent: the first
        # add; from a present line without a remove: the line's own values.
        made = F.when(F.col("step.k"), F.col("step.ar")).when(start == 0, F.col("step.fa"))
        return [qty] + [F.when(F.col("step.k") | (start == 0), made[a]).otherwise(p).alias(a)
                        for a, p in zip(attrs, prior_attrs)]

    # A cleared session starts absent; otherwise a line continues from before.
    if prior is None:
        zero = F.lit(0).cast("long")
        return folded.select(session, key, *line(zero, [F.lit(None)] * len(attrs))).where(F.col("qty") > 0)
    p = prior.select(session, key, F.col("qty").cast("long").alias("_q0"),
                     *[F.col(a).alias(f"_p_{a}") for a in attrs])
    # One join meets both sides: lines with events continue from their prior
    # quantity; prior lines without events stay, unless their session was
    # cleared (which re-reads only the batch's clear events).
    wiped = clears.select(session, F.lit(True).alias("_wiped"))
    both = folded.join(p, [session, key], "full_outer").join(wiped, session, "left")
    start = F.when(F.col("_cut"), F.lit(0)).otherwise(F.coalesce("_q0", F.lit(0))).cast("long")
    still = F.col("step").isNull()
    after = line(start, [F.col(f"_p_{a}") for a in attrs])
    stays = [F.when(F.col("_wiped"), F.lit(0)).otherwise(F.col("_q0")).cast("long"), *[F.col(f"_p_{a}") for a in attrs]]
    out = [F.when(still, s).otherwise(n).alias(c) for c, n, s in zip(["qty", *attrs], after, stays, strict=True)]
    return both.select(session, key, *out).where(F.col("qty") > 0)


def cart_sessions(users: DataFrame, existing: DataFrame) -> DataFrame:
    """One session per user: keep the existing one (smallest id if
    several), create one for the rest (id from the user id, so reruns agree)."""
    keep = existing.groupBy("user_id").agg(F.min("id").alias("session_id")).withColumn("created", F.lit(False))
    new = (users.select(F.col("id").alias("user_id")).join(keep.select("user_id"), "user_id", "left_anti")
           .select("user_id", F.sha2(F.concat(F.lit("cart:"), F.col("user_id").cast("string")), 256).alias("session_id"),
                   F.lit(True).alias("created")))
    return keep.unionByName(new)
