"""Metadata queries: permissions, paging, updates, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.scratch import written

#: What a role may do; a higher level includes the lower ones, an unknown role has none.
LEVELS = {"owner": 100, "admin": 80, "write": 50, "read": 20}


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_deleted"))


def level(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, role), F.lit(0))


def allowed(role: Column, required: Column) -> Column:
    """Whether a role (NULL: none) reaches the required one; an unknown requirement allows nobody."""
    return (level(required) > 0) & (level(F.coalesce(role, F.lit(""))) >= level(required))


def paginate(rows: DataFrame, order: list[Column], page: int = 1, size: int = 20, by: list[str] | None = None, total: bool = True) -> DataFrame:
    """One page of each group of ``by`` (or of all rows) with position, total and total_pages; size 0 has no pages.

    With groups the pages are found by a row number, of which Spark keeps the first ``page`` * ``size`` of a group below the
    exchange; without, by a global sort with such a limit. Totals are aggregates of their own, left out without ``total``.
    """
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        out = rows.withColumn("_place", place).filter(F.col("_place") <= page * size).filter(F.col("_place") > (page - 1) * size)
        out = out.withColumn("position", F.col("_place").cast("bigint")).drop("_place")
        if not total:
            return out
        out = out.join(rows.groupBy(*by).agg(F.count("*").alias("total")), by)
    else:
        total = rows.agg(F.count("*").alias("total"))
        out = rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))
    pages = F.floor((F.col("total") + size - 1) / size) if size > 0 else F.lit(0)
    return out.withColumn("total_pages", pages.cast("bigint"))


def kbs_for_user(kbs: DataFrame, members: DataFrame, like: str | None = None, strict: bool = False) -> DataFrame:
    """Live knowledge bases with each member's role; ``strict`` also wants the membership live."""
    rows = live(members) if strict else members
    out = live(kbs).join(rows.select("kb_id", "user_id", F.col("role").alias("my_role")), "kb_id")
    return out.filter(F.col("name").contains(like)) if like else out


def permission_audit(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (id, kb_id, user_id, op, required) with role, allow, and the action an audit row would have on denial."""
    roles = live(members).select("kb_id", "user_id", "role")
    out = requests.join(roles, ["kb_id", "user_id"], "left").withColumn("allow", allowed(F.col("role"), F.col("required")))
    return out.withColumn("audit", F.when(~F.col("allow"), F.concat_ws(" ", F.lit("permission_denied"), "op", F.coalesce("role", F.lit("none")), "required")))


def apply_member_changes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after one change each (kb_id, user_id, change add/update/remove, new_role).

    Owners never change; only admin, write and read can be given; add on an existing row updates
    its role and revives it; remove is a soft delete.
    """
    rows = members.select("kb_id", "user_id", F.col("role").alias("old"), F.col("is_deleted").alias("gone"), F.lit(True).alias("known"))
    both = rows.join(changes, ["kb_id", "user_id"], "full_outer")
    fits = F.col("new_role").isin("admin", "write", "read") & (F.coalesce("old", F.lit("")) != "owner")
    gives = fits & (F.col("change").isin("add") | ((F.col("change") == "update") & F.col("known") & ~F.col("gone")))
    removes = (F.col("change") == "remove") & (F.coalesce("old", F.lit("owner")) != "owner")
    gives, removes = F.coalesce(gives, F.lit(False)), F.coalesce(removes, F.lit(False))
    out = both.withColumns({
        "role": F.when(gives, F.col("new_role")).otherwise(F.col("old")),
        "is_deleted": F.when(gives, False).when(removes, True).otherwise(F.col("gone")),
    })
    return out.filter(F.col("role").isNotNull()).select("kb_id", "user_id", "role", "is_deleted")


def partial_update(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields overwritten where the change has a value."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(new, key, "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def _composed(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, shift, floor) of the maps x -> max(x + shift, floor) of each group, applied in the order of ``_b``."""
    ordered = F.array_sort(F.collect_list(F.struct("_b", "shift", "floor")))
    none = F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(0).cast("bigint").alias("floor"))
    then = lambda s, x: F.struct(
        (s["shift"] + x["shift"]).alias("shift"), F.greatest(s["floor"] + x["shift"], x["floor"]).alias("floor")
    )
    return parts.groupBy(*by).agg(F.aggregate(ordered, none, then).alias("m")).select(*by, "m.shift", "m.floor")


def floored_counter(deltas: DataFrame, key: str, order: list[str], block: int = 4_096, fan: int = 256) -> DataFrame:
    """(key, value): running sum of ``delta`` in order, never below 0 after any step.

    Steps in a row are one map x -> max(x + shift, floor), and such maps compose. Each key's rows are cut into blocks
    of ``block`` values of the first order column (whole numbers); blocks become maps on their own, and ``fan``
    maps at a time are composed until one is left, so no task ever holds a key's rows.
    """
    rows = deltas.withColumn("_b", F.floor(F.col(order[0]) / block))
    in_block = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r", F.sum("delta").over(in_block))
    # The largest sum behind any step of the block, that behind the last one being 0.
    parts = rows.groupBy(key, "_b").agg(F.sum("delta").alias("shift"), (F.sum("delta") - F.min("_r")).alias("floor"))
    parts = written(parts, "counter-blocks")
    low, high = parts.agg(F.min("_b"), F.max("_b")).first()
    while low is not None and high - low >= fan:
        parts = _composed(parts.withColumn("_up", F.floor(F.col("_b") / fan)), [key, "_up"]).withColumnRenamed("_up", "_b")
        low, high = low // fan, high // fan
    return _composed(parts, [key]).select(key, F.greatest("shift", "floor").alias("value"))


def latest_fields(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last non-NULL value of each field."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def messages_before(messages: DataFrame, before: int | None, limit: int) -> DataFrame:
    """The newest ``limit`` messages of each conversation with an id below ``before``."""
    rows = messages if before is None else messages.filter(F.col("id") < before)
    order = Window.partitionBy("conv_id").orderBy(F.desc("id"))
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit).drop("_k")


def audit_query(rows: DataFrame, start=None, end=None, **equal) -> DataFrame:
    """Audit rows of an inclusive time range and given values; NULL filters are left out.

    Where the rows lie in folders of a ``day``, those outside the range are not read.
    """
    for bound, fits in ((start, F.col("day") >= F.to_date(F.lit(start))), (end, F.col("day") <= F.to_date(F.lit(end)))) if "day" in rows.columns else ():
        rows = rows if bound is None else rows.filter(fits)
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    if start is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(start))
    return rows if end is None else rows.filter(F.col("created_at") <= F.lit(end))


def _next_after(nodes: DataFrame, ttl: int, rows: int) -> DataFrame:
    """(key, at, to): for each time of a key the key's first time later than ``at`` + ``ttl``, NULL if there is none.

    Times are cut into spans of equal width, about ``rows`` of them in each over all keys. The wanted time is in the span
    that holds ``at`` + ``ttl`` or is the first of the key's next span that has any.
    """
    low, high, n = nodes.agg(F.min("at"), F.max("at"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0)) * rows // max(1, n))
    span = lambda c: F.floor(c / width)
    asked = nodes.select("key", "at", (F.col("at") + ttl).alias("place"), F.lit(False).alias("there"))
    there = nodes.select("key", F.lit(None).cast("bigint").alias("at"), F.col("at").alias("place"), F.lit(True).alias("there"))
    later = Window.partitionBy("key", "span").orderBy("place", F.desc("there")).rowsBetween(1, Window.unboundedFollowing)
    both = asked.unionByName(there).withColumn("span", span(F.col("place")))
    found = both.withColumn("to", F.first(F.when(F.col("there"), F.col("place")), ignorenulls=True).over(later)).filter("not there")
    # Where the span has nothing later, one row for the span asks the key's spans for the next first time.
    firsts = nodes.groupBy("key", span(F.col("at")).alias("span")).agg(F.min("at").alias("first"))
    open_ = found.filter("to is null").select("key", "at", "span")
    marks = firsts.unionByName(open_.select("key", "span").distinct().withColumn("first", F.lit(None).cast("bigint")))
    ahead = Window.partitionBy("key").orderBy("span", F.asc_nulls_last("first")).rowsBetween(1, Window.unboundedFollowing)
    told = marks.withColumn("to", F.first("first", ignorenulls=True).over(ahead)).filter("first is null").select("key", "span", "to")
    return found.filter("to is not null").select("key", "at", "to").unionByName(open_.join(told, ["key", "span"]).select("key", "at", "to"))


def query_cache(requests: DataFrame, ttl: int, rows: int = 10_000) -> DataFrame:
    """(key, event_id, hit): a hit is at most ``ttl`` seconds after the key's last miss; hits do not refresh.

    From a miss the next one is the key's first request later than ``ttl``. These pointers are found by a join of time spans
    and doubled: in each round every known miss marks the one 1, 2, 4, ... misses on. So a key with very many
    requests takes a few joins and no fold. Of requests at the same time the smallest event_id comes first; requests
    without a time are misses.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = written(requests.select("key", "event_id", at.alias("at")), "cache-requests")
    nodes = written(timed.filter("at is not null").groupBy("key", "at").agg(F.min("event_id").alias("first_id")), "cache-times")
    jump = written(_next_after(nodes.select("key", "at"), ttl * 1_000_000, rows).filter("to is not null"), "cache-jumps")
    misses = written(nodes.groupBy("key").agg(F.min("at").alias("at")), "cache-misses")
    while not jump.isEmpty():
        reached = misses.join(jump, ["key", "at"]).select("key", F.col("to").alias("at"))
        misses = written(misses.unionByName(reached).distinct(), "cache-misses")
        again = jump.select("key", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(again, ["key", "to"]).select("key", "at", F.col("far").alias("to")), "cache-jumps")
    first = misses.join(nodes, ["key", "at"]).select("key", F.col("first_id").alias("event_id"), F.lit(False).alias("hit"))
    out = timed.join(first, ["key", "event_id"], "left")
    return out.select("key", "event_id", F.coalesce("hit", F.col("at").isNotNull()).alias("hit"))
