"""Exact Jaccard joins in metric space, shared by the document and the line operators.

Items meet in cells; any two items that may link share a cell. The result is links that connect all
linked items, not all pairs. Cells of up to ``BLOCK`` items are joined in place on odd sketches, which
discard only pairs that cannot link; whole sets move for what is left, to be compared exactly.

Larger cells are divided first. The item with the smallest id is compared with all others, and what
links join already is one. Then pivots create Voronoi regions: each member is compared with its
nearest pivot. If y links with pivot q, whatever links with y is within twice the threshold of q
(triangle inequality), so members of other components in that window of q are copied to q's
region; members that do not link with their pivot form a region of their own. Regions of one
component are done, those that shrank by half divide again, and the others are dealt out in blocks,
each of which meets every block of items outside the region's largest component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import lean, looked_up, materialise, small_enough
from lectern.llm.components import components
from lectern.llm.sketches import Sketches, differing, may_link

#: Cells of at most so many items are joined in place.
BLOCK = 4096
#: Pivots that a large cell elects in one round, rounds, and members that meet the pivots in one group.
PIVOTS, ROUNDS, SALT = 8, 3, 4096


def shared_cells(postings: DataFrame, name: str) -> DataFrame:
    """(cell, id, size) for cells with two members at least, of (cell, id) rows; cells with the same members become one.

    The new cell is a hash of the members; should two groups collide, their union is one larger cell. Members are
    counted by partial aggregates, so a cell that holds a large share of all rows is not gathered in one task.
    """
    rows = materialise(postings.distinct(), name)
    of = F.xxhash64(F.count("*"), F.expr("bit_xor(xxhash64(id))"), F.expr("bit_xor(xxhash64(1, id))"))
    groups = rows.groupBy("cell").agg(F.count("*").alias("size"), of.alias("group")).filter("size > 1")
    one = groups.groupBy("group").agg(F.min("cell").alias("cell"), F.max("size").alias("size"))
    return rows.join(small_enough(materialise(one.select("cell", "size"), name)), "cell").select("cell", "id", "size")


def _verifier(to_set: Callable[[bytes], np.ndarray], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for k, (y, s, t) in enumerate(zip(b, batch.column(2), batch.column(3), strict=True)):
                if y not in held:
                    held = {y: to_set(t.as_buffer())}
                left, right = to_set(s.as_buffer()), held[y]
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both * 100 >= (len(left) + len(right) - both) * percent:
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in kept], pa.binary()) for x in (a, b)], ["a", "b"])

    return run


def verified(pairs: DataFrame, bodies: Callable[[DataFrame], DataFrame], to_set: Callable, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches ``percent``; ``bodies`` gives (id, body) for a table of ids."""
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    whole = materialise(bodies(wanted), "pair-bodies")
    left = whole.select(F.col("id").alias("a"), F.col("body").alias("s"))
    right = whole.select(F.col("id").alias("b"), F.col("body").alias("t"))
    joined = looked_up(left.join(small_enough(pairs), "a"), right, "b", counted=pairs).select("a", "b", "s", "t")
    return materialise(joined.mapInArrow(lean(_verifier(to_set, percent)), "a binary, b binary"), "links")


def _sketch_filter(percent: int):
    """(a, b, na, nb, sa, sb) to the pairs (a, b) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            keep = may_link(differing(Sketches(batch.column(4)), at, Sketches(batch.column(5)), at), na, nb, percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _stars(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    pairs = written = materialise(pairs.distinct(), "stars")
    for side in "ab":  # a pivot is one side of very many pairs
        named = info.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        pairs = looked_up(pairs, named, side, counted=written)
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(_sketch_filter(percent)), "a binary, b binary")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a cell (column 0, sorted) ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy()
        start = int(np.searchsorted(cells, cells[-1]))
        if held and (start or held[-1].column(0)[-1].as_py() != cells[0]):
            held.append(batch.slice(0, start))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
            batch = batch.slice(start)
        elif start:
            yield pa.Table.from_batches([batch.slice(0, start)]).combine_chunks()
            batch = batch.slice(start)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near(cells: np.ndarray, n: np.ndarray, sketches: Sketches, roots: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with i < j of the pairs in one cell, of two roots, that sizes and sketches do not rule out."""
    left, right = [], []
    k, alive = 1, np.arange(len(cells) - 1)
    while len(alive := alive[cells[alive] == cells[alive + k]]):
        i, j = alive, alive + k
        keep = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (roots[i] != roots[j])
        i, j = i[keep], j[keep]
        keep = may_link(differing(sketches, i, sketches, j), n[i], n[j], percent)
        left.append(i[keep])
        right.append(j[keep])
        k += 1
        alive = alive[alive + k < len(cells)]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _join_regions(percent: int, every: bool):
    """(cell, id, n, sketch, root) sorted by cell and id to candidates (a, b, more).

    ``every`` gives all pairs of different roots; otherwise each item comes with its first candidate
    only. Where a cell has more candidates, rows with ``more`` tie the items that they connect to
    the first of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cells, n = table["cell"].to_numpy(), table["n"].to_numpy()
            ids, roots = (table[c].combine_chunks().cast(pa.binary()) for c in ("id", "root"))
            codes = roots.dictionary_encode().indices.to_numpy()
            i, j = _near(cells, n, Sketches(table["sketch"].combine_chunks()), codes, percent)
            tied = np.empty(0, np.int64)
            top = np.arange(len(cells))
            if not every and len(j):
                order = np.lexsort((i, j))
                i, j = i[order], j[order]
                first = np.append(True, j[1:] != j[:-1])
                while True:  # least label of each connected group, by hooking and jumping
                    low = top.copy()
                    np.minimum.at(low, j, top[i])
                    np.minimum.at(low, i, top[j])
                    low = low[low]
                    if (low == top).all():
                        break
                    top = low
                tied = np.flatnonzero(np.isin(top, top[j[~first]]) & (top != np.arange(len(top))))
                i, j = i[first], j[first]
            left, right = pa.array(np.concatenate((i, top[tied]))), pa.array(np.concatenate((j, tied)))
            yield pa.RecordBatch.from_arrays([ids.take(left), ids.take(right), pa.array(np.arange(len(left)) >= len(i))], ["a", "b", "more"])

    return run


def _regions(members: DataFrame, info: DataFrame, percent: int, every: bool) -> DataFrame:
    rows = members.join(info, "id").select("cell", "id", "n", "sketch", "root").repartition("cell").sortWithinPartitions("cell", "id")
    return materialise(rows.mapInArrow(lean(_join_regions(percent, every)), "a binary, b binary, more boolean"), "candidates")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(small_enough(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (cell, id, ...) with root and size, of the cells that are not one component."""
    members = materialise(_rooted(members, roots), "members")
    cells = members.groupBy("cell").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return materialise(members.join(small_enough(materialise(cells.select("cell", "size"), "open")), "cell"), "members")


def _windows(percent: int):
    """(cell, salt, member, id, n, sketch), pivots of a group first, to (cell, id, pivot, nearest, close).

    One row for the nearest pivot (``close`` if they may link), one for each other pivot whose window holds the member.
    """
    reach = 2 * (100 - percent) / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            cell, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(salt) != 0)) + 1
            for start, end in zip(chain([0], cuts.tolist()), chain(cuts.tolist(), [batch.num_rows]), strict=True):
                if start == end:
                    continue
                part, key = batch.slice(start, end - start), (int(cell[start]), int(salt[start]))
                flags = part.column(2).to_numpy(zero_copy_only=False)
                heads = pa.Table.from_batches([part.filter(pa.array(~flags))])
                if key in pivots:
                    heads = pa.concat_tables([pivots[key], heads])
                pivots = {key: heads}
                members = part.filter(pa.array(flags))
                if not members.num_rows:
                    continue
                rows, of = members.num_rows, heads.num_rows
                i, j = np.repeat(np.arange(rows), of), np.tile(np.arange(of), rows)
                sizes = (members.column(4).to_numpy()[i] + heads["n"].to_numpy()[j]).astype(np.int64)
                differ = differing(Sketches(members.column(5)), i, Sketches(heads["sketch"].combine_chunks()), j)
                least = (2 * differ / (sizes + differ)).reshape(rows, of)
                nearest = least.argmin(1)
                take = least <= reach
                take[np.arange(rows), nearest] = True
                x, p = np.nonzero(take)
                close = (differ * (100 + percent) <= (100 - percent) * sizes).reshape(rows, of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), key[0])), members.column(3).cast(pa.binary()).take(pa.array(x)), heads["id"].combine_chunks().cast(pa.binary()).take(pa.array(p)),
                     pa.array(nearest[x] == p), pa.array(close[x, p]), pa.array(least[x, p] <= reach)],
                    ["cell", "id", "pivot", "nearest", "close", "inside"],
                )

    return run


def _voronoi(state: DataFrame, info: DataFrame, depth: int, percent: int) -> DataFrame:
    """(cell, id, pivot, nearest, close, inside) for the members of ``state`` (cell, id, root, size) and their pivots."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(depth), "id"), "id")
    elected = state.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
    salts = F.ceil(F.col("size") / SALT)
    heads = elected.join(info, "id").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"), F.lit(False).alias("member"), "id", "n", "sketch"
    )
    rows = state.join(info, "id").select("cell", F.pmod(F.xxhash64("id"), salts).alias("salt"), F.lit(True).alias("member"), "id", "n", "sketch")
    rows = rows.unionByName(heads).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "member")
    return materialise(rows.mapInArrow(lean(_windows(percent)), "cell bigint, id binary, pivot binary, nearest boolean, close boolean, inside boolean"), "voronoi")


def _blocks(state: DataFrame) -> DataFrame:
    """(cell, id): every block of a cell with every block of what is outside its largest component."""
    half = max(1, BLOCK // 2)
    counts = state.groupBy("cell", "root", "size").count()
    largest = counts.groupBy("cell").agg(F.max(F.struct("count", "root")).alias("top"), F.max("size").alias("every"))
    largest = largest.select("cell", F.col("top.root").alias("top"), F.ceil((F.col("every") - F.col("top.count")) / half).alias("outer"), F.ceil(F.col("every") / half).alias("inner"))
    rows = state.select("cell", "id", "root").join(small_enough(materialise(largest, "largest")), "cell")
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), n)
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    inner = rows.select("cell", "id", many(F.col("outer")).alias("i"), deal(1, F.col("inner")).alias("j"))
    outer = rows.filter("root <> top").select("cell", "id", deal(2, F.col("outer")).alias("i"), many(F.col("inner")).alias("j"))
    return inner.unionByName(outer).select(F.xxhash64("cell", "i", "j").alias("cell"), "id").distinct()


def _divide(big: DataFrame, info: DataFrame, bodies: Callable, to_set: Callable, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """Regions (cell, id) that remain of large cells, and the links found on the way."""
    big = big.select("cell", "id")
    pivots = materialise(big.groupBy("cell").agg(F.min("id").alias("pivot")), "pivots")
    stars = big.join(small_enough(pivots), "cell").filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    found = verified(_stars(stars, info, percent), bodies, to_set, percent)
    roots, regions, big = components(found), None, big.withColumn("was", F.lit(1 << 62))
    for depth in range(ROUNDS + 1):
        state = _open(big, roots)
        wide = F.col("size") > BLOCK
        stuck = wide & (F.lit(depth == ROUNDS) | (F.col("size") * 2 > F.col("was")))
        ready = state.filter(~wide).select("cell", "id").unionByName(_blocks(state.filter(stuck)))
        regions = ready if regions is None else regions.unionByName(ready)
        state = state.filter(wide & ~stuck)
        if state.isEmpty():
            return regions, found
        near = _voronoi(state, info, depth, percent)
        own = near.filter("nearest and close and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        linked = verified(own, bodies, to_set, percent)
        found = materialise(found.unionByName(linked).distinct(), "links")
        roots = components(found)
        known = linked.select(F.col("a").alias("id"), F.col("b").alias("pivot"), F.lit(True).alias("linked")).distinct()
        tops = roots.select(F.col("id").alias("pivot"), F.col("root").alias("top"))
        near = _rooted(near, roots).join(small_enough(tops), "pivot", "left").join(small_enough(materialise(known, "known")), ["id", "pivot"], "left")
        home = F.col("nearest") & (F.coalesce("linked", F.lit(False)) | (F.col("id") == F.col("pivot")))
        region = F.when(home | (F.col("inside") & (F.col("root") != F.coalesce("top", "pivot"))), F.xxhash64(F.lit(depth), "cell", "pivot"))
        alone = F.when(F.col("nearest") & ~home, F.xxhash64(F.lit(depth), "cell"))
        sizes = materialise(state.select("cell", F.col("size").alias("was")).distinct(), "sizes")
        near = near.join(small_enough(sizes), "cell").select("id", "was", F.explode(F.array_compact(F.array(region, alone))).alias("cell"))
        big = materialise(near.select("cell", "id", "was"), "regions")
    raise AssertionError


def links(cells: DataFrame, info: DataFrame, bodies: Callable[[DataFrame], DataFrame], to_set: Callable, percent: int) -> DataFrame:
    """(a, b) links with 100 * |A n B| >= percent * |A u B| that connect all linked items of ``cells`` (cell, id, size).

    ``info`` (id, n, sketch) has sizes and sketches of the items, ``bodies`` turns a table of ids
    into (id, body) with each set in a form that ``to_set`` reads. Ids are binary.
    """
    big = cells.filter(F.col("size") > BLOCK)
    regions, found = cells.filter(F.col("size") <= BLOCK).select("cell", "id"), None
    roots = None
    if not big.isEmpty():
        divided, found = _divide(big, info, bodies, to_set, percent)
        regions = materialise(regions.unionByName(divided), "regions")
        roots = components(found)
    members = _rooted(regions, roots) if roots is not None else regions.withColumn("root", F.col("id"))
    first = _regions(members, info, percent, every=False)
    near = verified(first.filter("not more").select("a", "b"), bodies, to_set, percent)
    found = near if found is None else found.unionByName(near)
    groups = components(first.filter("more").select("a", "b"))
    if groups.isEmpty():
        return found
    # Each item is in one group only, whatever its number of cells. Groups past BLOCK keep their cells.
    groups = groups.withColumnRenamed("root", "group")
    sizes = materialise(groups.groupBy("group").count(), "groups")
    groups = groups.join(small_enough(sizes), "group")
    wide = materialise(groups.filter(F.col("count") > BLOCK).select("id"), "wide")
    rest = groups.filter(F.col("count") <= BLOCK).select(F.xxhash64("group").alias("cell"), "id")
    rest = rest.unionByName(regions.join(small_enough(wide), "id", "left_semi").select("cell", "id"))
    rest = _regions(_open(rest, components(found)), info, percent, every=True)
    return found.unionByName(verified(rest.select("a", "b"), bodies, to_set, percent))
