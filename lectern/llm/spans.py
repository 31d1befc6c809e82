"""Regex matches with code-point offsets, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose offsets are summed in one go, spans that meet others in one go, characters of a text's piece.
BLOCK, APART, PIECE = 256, 64, 512
SPAN = "array<struct<start:int,end:int,match:string>>"


def with_spans(df: DataFrame, name: str, text: str, pattern: str, needs: Column | None = None) -> DataFrame:
    """Adds ``name``: leftmost non-overlapping matches of ``pattern`` in ``text`` (not null), in order.

    Matches and the gaps between them come from the same regex engine; offsets are running sums of
    their lengths, so the cost grows with the text and the number of matches. ``needs`` is a cheap condition without which nothing can match. Patterns must
    not match the empty string.
    """
    found, gaps = f"_{name}_found", f"_{name}_gaps"
    none = F.array().cast("array<string>")
    all_of = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(found, all_of if needs is None else F.when(needs, all_of).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none))
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + F.length(x["match"])).cast("int").alias("at"),
        F.concat(s["out"], F.array(F.struct(
            (s["at"] + x["gap"]).cast("int").alias("start"),
            (s["at"] + x["gap"] + F.length(x["match"])).cast("int").alias("end"), x["match"].alias("match"),
        ))).cast(SPAN).alias("out"),
    )
    pairs, totals = f"_{name}_pairs", f"_{name}_totals"
    df = df.withColumn(pairs, F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match"))))
    # Offsets run on inside blocks of matches, which start where the blocks before end: no step copies more than a block.
    blocks = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    block = lambda c, b: F.slice(c, b * BLOCK + 1, BLOCK)
    df = df.withColumn(totals, F.transform(blocks(pairs), lambda b: F.aggregate(block(pairs, b), F.lit(0), lambda s, x: s + x["gap"] + F.length(x["match"]))))
    start = lambda b: F.aggregate(F.slice(totals, F.lit(1), b), F.lit(0), lambda s, x: s + x)
    walk = lambda b: F.aggregate(block(pairs, b), F.struct(start(b).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])
    return df.withColumn(name, F.flatten(F.transform(blocks(pairs), walk)).cast(SPAN)).drop(found, gaps, pairs, totals)


def by_start(spans: Column, order: int, kind: str) -> Column:
    """Spans as structs that sort by start, then by ``order``."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def apart(df: DataFrame, name: str, spans: Column, others: Column) -> DataFrame:
    """Adds ``name``: those of ``spans`` that overlap none of ``others``, in their order.

    Both are cut into blocks; a span meets the blocks of ``others`` that reach into its own block's range. Where both are in
    the order of their starts those are few, so the cost grows with the number of spans; in any order the result is the same.
    """
    mine, theirs = f"_{name}_mine", f"_{name}_theirs"
    cut = lambda c, n: F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / n).cast("int")), lambda b: F.slice(c, b * n + 1, n)))
    ranged = lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("items"))
    df = df.withColumns({f"{mine}_all": spans, f"{theirs}_all": others})
    df = df.withColumns({mine: cut(F.col(f"{mine}_all"), APART), theirs: cut(F.col(f"{theirs}_all"), APART)})
    df = df.withColumns({mine: F.transform(mine, ranged), theirs: F.transform(theirs, ranged)})

    def free(block: Column) -> Column:
        near = F.flatten(F.transform(F.filter(theirs, lambda o: (o["low"] < block["high"]) & (block["low"] < o["high"])), lambda o: o["items"]))
        # The blocks in reach are put together once for the block, not once for each of its spans.
        return F.element_at(F.transform(F.array(near), lambda n: F.filter(block["items"], lambda s: ~F.exists(n, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))), 1)

    out = F.when(F.col(theirs).isNull() | F.col(mine).isNull(), F.col(f"{mine}_all")).otherwise(F.flatten(F.transform(mine, free)))
    return df.withColumn(name, out).drop(mine, theirs, f"{mine}_all", f"{theirs}_all")


def piecewise(text: str) -> Column:
    """A text in pieces of ``PIECE`` characters, for ``near``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def near(pieces: Column, start: Column, length: Column) -> Column:
    """At most ``PIECE`` characters of a text from ``start`` (from 0) on, read from its pieces and not from its beginning."""
    k = F.floor(start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return two.substr(start - k * PIECE + 1, length)
