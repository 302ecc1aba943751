"""N-gram Jaccard self-join in size-banded tiles with hashed bitmap signatures; exact.

A document is the set of hashes of its word shingles; equal sets are one node.
Sets that link have sizes in the same or adjacent bands, and differ in at most
d elements, d known per band. Cutting the hash space into d + 1 + E parts leaves
at least E + 1 parts equal in both, so every linked pair shares a tile (band,
part, content of the part). Parts of one element or none, which unrelated sets
share easily, are tiles only for sets with more than E + 1 - ``SHARED`` of them,
empty ones only for sets with more than that many empty ones, so linked sets share
``SHARED`` tiles or more. Sets in fewer shared tiles are left out. Tiles tie their members to the smallest one;
of these pairs the one of each set with the most common tiles is checked first by
bitmaps, whose bit counts bound the overlap from above, and by intersection of the
sorted arrays. Pairs with ``SHARED`` common tiles make families (their components), and so do a
set and a family that has most members in as many of its tiles:
groups of near copies lie in one each. A family is cut into slices of bounded size,
and each pair of slices is a cell that tests pairs between components, bitmaps
first, and joins components as it finds links; so a member is placed once for each
slice of its family, however many tiles it shares. Tiles that hold several families
are left: where they have few pairs between families, the pairs that occur in
``SHARED`` tiles are named and checked like the first ones. Larger tiles are keyed
anew by each second such tile of their members, which parts sets that share a
passage only. Of those that stay large, members of the largest family are placed
once for each block of others. So no link between components is lost and none
within one is looked for.
Components come from label propagation with pointer jumping over written tables.
The bit counts of a family grow with the square of its members, its rows with the
square over the size of a slice.

Null, empty and white-space texts have the empty set and link with nothing. A
text with fewer words than a shingle is one shingle. Repeated rows share a
node. Rows with a null id link with nothing, unless their set is also another
row's. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.store import release, small_batches, stash, tidy
from helixframe.llm.textops import Hasher, chunks, mix, sequence_hash, signed, windows, words


#: Tiles with so many pairs of components name them (a pair is tested once, whatever tiles it shares); others are keyed by two.
FEW = 2048
#: Tiles that linked sets share at least: of the parts equal in both, as many are left when small ones don't count.
SHARED = 3
#: Sets and shingles of a slice of a family, about.
SLICE, SLICE_ITEMS = 1024, 1 << 19
#: Sets that a task remembers to have named tiles for.
_SEEN = 1 << 20


@dataclass(frozen=True)
class Spec:
    """Shingle length, and the threshold as a fraction: links need den * intersection >= num * union."""

    size: int = 5
    num: int = 80
    den: int = 100
    block: int = 256


class Bands:
    """Size bands and, for each level, the number of parts and the empties allowed."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.low = [1]
        self.parts: list[tuple[int, int]] = []

    def levels(self, n: int) -> list[int]:
        """The set's own band, and the one below."""
        num, den = self.spec.num, self.spec.den
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * den // num)))
            small = self.low[-1] - 1
            differ = (small + small * den // num) * (den - num) // (den + num)
            spare = SHARED + 2 + differ // 3 if differ else 0
            self.parts.append((differ + 1 + spare, spare))
        own = int(np.searchsorted(self.low, n, "right")) - 1
        return [own, own - 1] if own else [own]

    def keys(self, u: np.ndarray) -> np.ndarray:
        """Tile keys of a sorted set of hashes."""
        out = []
        content = mix(u + np.uint64(0x632BE59BD9B4E019))
        for level in self.levels(len(u)):
            k, spare = self.parts[level]
            index = (u >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
            sums, at = np.add.reduceat(content, first), index[first]
            rich, most = np.diff(np.append(first, len(u))) > 1, max(0, spare + 1 - SHARED)
            if k - int(rich.sum()) <= most:
                at, sums = at[rich], sums[rich]
            elif k - len(first) > most:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), at)
                at, sums = np.concatenate((at, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64)))
            out.append(mix(sums + mix(at + np.uint64(level << 32) + np.uint64(1))))
        return np.concatenate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk (A to Z lower-cased)."""
    start, end, at = words(data, offsets)
    h = Hasher(data, lower=True).of(start, end)
    w = windows(h, size)
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= size:
            yield np.unique(w[a : b - size + 1])
        elif b > a:
            yield np.array([sequence_hash(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_id(u: np.ndarray) -> int:
    return int(signed(mix(mix(u).sum(keepdims=True) + np.uint64(len(u))))[0])


def sets(df: DataFrame, spec: Spec, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set (null for the empty set), row (hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                found = [(len(u), set_id(u) if len(u) else None) for u in shingle_sets(data, offsets, spec.size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64()), batch.column(2).slice(lo, hi - lo)], ["id", "n_shingles", "set", "row"])

    return df.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_shingles long, set long, row long")


def tile_rows(df: DataFrame, spec: Spec, text_col: str) -> DataFrame:
    """(tile, set), each set once a task: copies don't make a tile hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(spec), set()
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                tiles, owners, counts = [], [], []
                for u in shingle_sets(data, offsets, spec.size):
                    if len(u) and (s := set_id(u)) not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()  # a set may be named again
                        seen.add(s)
                        tiles.append(bands.keys(u))
                        owners.append(s)
                        counts.append(len(tiles[-1]))
                if tiles:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tiles))), pa.array(np.repeat(np.array(owners, np.int64), counts))], ["tile", "set"])

    return df.select(text_col).mapInArrow(run, "tile long, set long")


def features(df: DataFrame, spec: Spec, text_col: str = "text") -> DataFrame:
    """(set, size, bitmap, items: the sorted hashes) of rows (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                wanted = batch.column(0).slice(lo, hi - lo).to_pylist()
                us = [(s, u) for s, u in zip(wanted, shingle_sets(data, offsets, spec.size), strict=True) if len(u) and set_id(u) == s]  # an id's other texts are left out
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in us], pa.int64()), pa.array([len(u) for _, u in us], pa.int32()), pa.array([bitmap(u).tobytes() for _, u in us], pa.binary()), pa.array([u.tobytes() for _, u in us], pa.binary())],
                    ["set", "size", "bitmap", "items"],
                )

    return df.select("set", text_col).mapInArrow(run, "set long, size int, bitmap binary, items binary")


def bitmap(u: np.ndarray) -> np.ndarray:
    size = 1 << max(6, (4 * len(u) - 1).bit_length() if len(u) else 6)
    bits = np.zeros(size, np.uint8)
    bits[(u & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """Most elements two sets can share, from their bitmaps: a set bit that the other lacks is a foreign element."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def linked(u: np.ndarray, v: np.ndarray, spec: Spec) -> bool:
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    both = int((v[at] == u).sum())
    return spec.den * both >= spec.num * (len(u) + len(v) - both)


def verified(pairs: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """The pairs (a, b) that link, written: bitmaps are joined first, sorted sets only to pairs that they let through."""

    def run(test):
        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(k) for k in range(2, batch.num_columns)]
                keep = [test(*(c[i] for c in columns)) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

        return filtered

    def bounded(bits_a: pa.Scalar, n_a: pa.Scalar, bits_b: pa.Scalar, n_b: pa.Scalar) -> bool:
        n, m = n_a.as_py(), n_b.as_py()
        need = lambda both: spec.den * both >= spec.num * (n + m - both)
        return need(min(n, m)) and need(overlap_bound(np.frombuffer(bits_a.as_buffer(), np.uint8), n, np.frombuffer(bits_b.as_buffer(), np.uint8), m))

    def exact(a: pa.Scalar, b: pa.Scalar) -> bool:
        return linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), spec)

    def joined(rows: DataFrame, *columns: str) -> DataFrame:
        side = lambda s: found.select(F.col("set").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
        return rows.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{s}" for s in "ab" for c in columns])

    near = stash(joined(pairs.select("a", "b"), "bitmap", "size").mapInArrow(run(bounded), "a long, b long"), "join-near", narrow=True)
    tidy(pairs.sparkSession)
    out = stash(joined(near, "items").mapInArrow(run(exact), "a long, b long"), "join-edges", narrow=True)
    release(near)
    tidy(pairs.sparkSession)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(set, comp) of every node of ``edges`` (a, b): smallest reachable node, by hooking to the least neighbour label and jumping."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = stash(both, "links", narrow=True)
    labels = links.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))

    def step(labels: DataFrame) -> DataFrame:
        near = links.join(labels.select(F.col("set").alias("b"), "comp"), "b").groupBy(F.col("a").alias("set")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "set").select("set", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("set").alias("comp"), F.col("comp").alias("up"))
        return hooked.join(up, "comp", "left").select("set", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))

    last = None
    while True:  # two steps a written table; at rest when the second changes nothing
        moved = stash(step(step(labels).select("set", "comp")), "labels", narrow=True)
        if last is not None:
            release(last)
        last, labels = moved, moved.select("set", "comp")
        labels._stashed_at = moved._stashed_at
        if not moved.where("old != comp").limit(1).count():
            release(links)
            return labels


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds comp_a and comp_b, a set without a label being a component of its own."""
    side = lambda s: labels.select(F.col("set").alias(s), F.col("comp").alias(f"comp_{s}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({f"comp_{s}": F.coalesce(f"comp_{s}", s) for s in "ab"})


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels once components with a link between them are one; ``labels`` and its table go."""
    joined = stash(between(links, labels).where("comp_a != comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "join-between", narrow=True)
    if joined.isEmpty():
        release(joined)
        return labels
    whole = components(joined).select(F.col("set").alias("comp"), F.col("comp").alias("whole"))
    rows = labels.join(whole, "comp", "full").select(F.coalesce("set", "comp").alias("set"), F.coalesce("whole", "comp").alias("comp"))
    out = stash(rows, "join-labels", narrow=True)
    release(joined, labels)
    return out


def join(df: DataFrame, spec: Spec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, set of every row."""
    spec = spec or Spec()
    small_batches(df.sparkSession)
    members = stash(sets(df, spec, id_col, text_col), "join-sets")
    nodes = members.where(F.col("set").isNotNull() & F.col("id").isNotNull()).groupBy("set").agg(F.min(F.struct("id", "row")).alias("_rep"))
    least, most = (f("set").over(Window.partitionBy("tile")) for f in (F.min, F.max))
    shared = stash(tile_rows(df, spec, text_col).withColumn("least", least).withColumn("most", most).where("least != most").select("tile", "set").distinct(), "join-shared")
    tidy(df.sparkSession)
    able = shared.groupBy("set").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("set")
    left = shared.join(able, "set").withColumn("least", least).withColumn("most", most).where("least != most")
    tiles = stash(left.select("tile", "set", "least"), "join-tiles")
    release(shared)
    shared_tiles = tiles.where("set != least").groupBy(F.col("least").alias("a"), F.col("set").alias("b")).agg(F.count("*").alias("n"))
    pairs = stash(shared_tiles, "join-pairs", narrow=True)
    named = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    wanted = nodes.join(named, "set").select("set", "_rep.id", "_rep.row")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row")).join(wanted, ["id", "row"])
    turn = F.row_number().over(Window.partitionBy("set").orderBy("id"))  # one of repeated rows
    found = stash(features(texts.withColumn("turn", turn).where("turn = 1"), spec), "join-features")
    tidy(df.sparkSession)
    labels = linked_sets(tiles, pairs, found, spec)
    release(pairs, tiles, found)
    tidy(df.sparkSession)
    grouped = nodes.join(labels, "set", "left").select("set", "_rep", F.coalesce("comp", "set").alias("comp"))
    smallest = grouped.groupBy("comp").agg(F.min("_rep.id").alias("component"))
    classes = grouped.join(smallest, "comp").select("set", "component")
    out = members.join(classes, "set", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), "set")


def linked_sets(tiles: DataFrame, pairs: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """(set, comp) of the sets with links; steps without pairs are left out."""
    # each set first meets the one it shares most tiles with
    edges = verified(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), found, spec)
    labels, families = labels_of(edges), labels_of(pairs.where(F.col("n") >= SHARED).select("a", "b"))
    families = widened(families, tiles)
    links = family_links(families, labels, found, spec)
    if not links.isEmpty():
        labels = merge(labels, links)
    release(links)
    # linked sets of different families share tiles that hold both
    opened = open_tiles(tiles, families, found)
    if not opened.isEmpty():
        twice = tiles_of_two(opened)
        fresh = few_pairs(opened, spec, SHARED).union(few_pairs(twice, spec)).distinct().join(pairs.where(F.col("n") >= SHARED), ["a", "b"], "left_anti")
        labels = checked(labels, fresh, found, spec)
        if not twice.where(_crossing() > FEW).isEmpty():
            labels = merge(labels, block_links(twice, found, spec))
        release(twice)
    release(edges, opened, families)
    return labels


def labels_of(edges: DataFrame) -> DataFrame:
    """``components`` of edges that may be none."""
    return stash(edges.select(F.col("a").alias("set"), F.col("b").alias("comp")), "labels", narrow=True) if edges.isEmpty() else components(edges)


def widened(families: DataFrame, tiles: DataFrame) -> DataFrame:
    """Families joined with those that share ``SHARED`` tiles with them in which they have the most members: sets that no one set draws in."""
    sizes = tiles.join(families, "set", "left").groupBy("tile", F.coalesce("comp", "set").alias("comp")).agg(F.count("*").alias("c"))
    tops = sizes.groupBy("tile").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("n")).where("n > 1").select("tile", F.col("top.comp").alias("a"))
    near = sizes.join(tops, "tile").where("comp != a").groupBy("a", F.col("comp").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    return merge(families, near.select("a", "b"))


def family_links(families: DataFrame, labels: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """Pairs (a, b) of components of one family with a link between them, from cells of two of its slices (or one with itself)."""
    told = families.select("set", F.col("comp").alias("family")).join(labels, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    told = told.join(found.select("set", "size"), "set")
    several = told.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("items"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most")
    slices = F.greatest(F.ceil(F.col("n") / SLICE), F.ceil(F.col("items") / SLICE_ITEMS)).cast("int")
    placed = told.drop("size").join(several.select("family", slices.alias("g")), "family").withColumn("own", F.pmod(F.xxhash64("set"), F.col("g")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    placed = placed.select("family", "set", "comp", "own", F.explode(cells).alias("m")).select("family", "set", "comp", "own", "m.x", "m.y")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        x, y, place = key[1].as_py(), key[2].as_py(), np.arange(len(own))
        return _links_within(table, spec, np.flatnonzero(own == x).tolist(), lambda i: place > i if x == y else own == y)

    return stash(placed.join(found, "set").groupBy("family", "x", "y").applyInArrow(run, "a long, b long"), "join-family-links", narrow=True)


def checked(labels: DataFrame, pairs: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """Labels once those of the pairs (a, b) that link are merged."""
    named = stash(pairs, "join-pairs", narrow=True)
    if not named.isEmpty():
        links = verified(named, found, spec)
        labels = merge(labels, links)
        release(links)
    release(named)
    return labels


def open_tiles(tiles: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """``_opened`` members of the tiles that hold several components."""
    told = found.select("set", "size").join(labels, "set", "left").select("set", "size", F.coalesce("comp", "set").alias("comp"))
    return _opened(tiles.select("tile", "set").join(told, "set"))


def _opened(labelled: DataFrame) -> DataFrame:
    """(tile, set, size, comp, most, mine, others, times): members of tiles with several components.

    ``most`` marks members of the tile's largest component; ``others`` counts the rest, ``mine`` the largest. Of
    tiles with the same members one stays, ``times`` counts them.
    """
    who = F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("who")
    sizes = labelled.groupBy("tile", "comp").agg(F.count("*").alias("c"), who)
    largest = F.max(F.struct("c", "comp")).alias("top")
    several = sizes.groupBy("tile").agg(F.count("*").alias("comps"), F.sum("c").alias("n"), F.sum("who").alias("who"), largest).where("comps > 1")
    chosen = several.groupBy("who", "n").agg(F.min(F.struct("tile", "top")).alias("t"), F.count("*").alias("times")).select("t.tile", "t.top", "n", "times")
    rows = labelled.join(chosen, "tile")
    return stash(rows.select("tile", "set", "size", "comp", (F.col("comp") == F.col("top.comp")).alias("most"), F.col("top.c").alias("mine"), (F.col("n") - F.col("top.c")).alias("others"), "times"), "join-open")


def tiles_of_two(opened: DataFrame) -> DataFrame:
    """``_opened`` members of pairs of open tiles, the first with more than ``FEW`` pairs: linked sets share several tiles, other sets rarely two."""
    large = opened.where(_crossing() > FEW).select("set", "size", "comp", F.col("tile").alias("t"))
    other = opened.select("set", F.col("tile").alias("u"), "times", (_crossing() > FEW).alias("large"))
    both = large.join(other, "set").where("(t != u OR times > 1) AND (NOT large OR t <= u)")
    return _opened(both.select(F.xxhash64("t", "u").alias("tile"), "set", "size", "comp"))


def few_pairs(opened: DataFrame, spec: Spec, least: int = 1) -> DataFrame:
    """Distinct pairs (a, b) of different components in at least ``least`` of the open tiles with ``FEW`` such pairs or less.

    Sets in fewer such tiles, and pairs whose sizes alone rule a link out, are never formed.
    """
    few = opened.where(_crossing() <= FEW)
    if least > 1:
        few = few.withColumn("held", F.sum("times").over(Window.partitionBy("set"))).where(F.col("held") >= least)
    other = few.select("tile", *[F.col(c).alias("other" if c == "set" else f"other_{c}") for c in ("set", "size", "comp", "most")])
    sized = F.least("size", "other_size").cast("long") * spec.den >= F.greatest("size", "other_size").cast("long") * spec.num
    met = few.where("NOT most").join(other, "tile").where("comp != other_comp AND (other_most OR set < other)").where(sized)
    counted = met.groupBy(F.least("set", "other").alias("a"), F.greatest("set", "other").alias("b")).agg(F.sum("times").alias("times"))
    return counted.where(F.col("times") >= least).select("a", "b")


def _crossing() -> F.Column:
    return F.col("others") * F.col("mine") + F.col("others") * (F.col("others") - 1) / 2


def block_links(opened: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """Pairs (a, b) of components with a link between them, from blocks of open tiles.

    Block (x, y): slice x of a tile's other members with slice y of its largest
    component, or, for y above those, with a later slice of the others.
    """
    slices = lambda c: F.ceil(F.col(c) / F.lit(spec.block)).cast("int")
    cut = opened.where(_crossing() > FEW).withColumn("g", slices("mine")).withColumn("r", slices("others"))
    own = F.when(F.col("most"), F.pmod(F.xxhash64("set"), F.col("g"))).otherwise(F.pmod(F.xxhash64("set"), F.col("r"))).cast("int")
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    for_most = F.transform(upto("r"), lambda x: at(x, F.col("own")))
    with_most = F.transform(upto("g"), lambda y: at(F.col("own"), y))
    with_others = F.transform(F.filter(upto("r"), lambda o: o != F.col("own")), lambda o: at(F.least(o, F.col("own")), F.col("g") + F.greatest(o, F.col("own"))))
    meet = F.when(F.col("most"), for_most).otherwise(F.concat(with_most, with_others))
    placed = cut.withColumn("own", own).select("tile", "set", "comp", "most", "own", F.explode(meet).alias("m")).select("tile", "set", "comp", "most", "own", "m.x", "m.y")
    ready = placed.join(found, "set")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, most = table.column("own").to_numpy(), table.column("most").to_numpy()
        x, first, place = key[1].as_py(), key[2].as_py() == 0, np.arange(len(own))
        # members of one slice meet each other in its first block only
        return _links_within(table, spec, np.flatnonzero(~most & (own == x)).tolist(), lambda i: most | (own != x) | (first & (place > i)))

    return ready.groupBy("tile", "x", "y").applyInArrow(run, "a long, b long")


def _links_within(table: pa.Table, spec: Spec, rows: list[int], meets: Callable[[int], np.ndarray]) -> pa.Table:
    """Pairs (a, b) of components of a cell (comp, size, bitmap, items) with a link between one of ``rows`` and one that it ``meets``."""
    names, label = np.unique(table.column("comp").to_numpy(), return_inverse=True)
    size = table.column("size").to_numpy().astype(np.int64)
    maps = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bitmap")]
    items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
    width = min(map(len, maps))
    folded = np.stack([_fold(m, width) for m in maps]).view(np.uint64)
    a, b = [], []
    for i in rows:
        j = np.flatnonzero(meets(i) & (label != label[i]) & (size[i] * spec.num <= size * spec.den) & (size * spec.num <= size[i] * spec.den))
        if not len(j):
            continue
        both = np.bitwise_count(folded[i] & folded[j]).sum(1, dtype=np.int64)
        own, other = int(np.bitwise_count(folded[i]).sum()), np.bitwise_count(folded[j]).sum(1, dtype=np.int64)
        bound = np.minimum(size[i] - own + both, size[j] - other + both)
        for k in j[spec.den * bound >= spec.num * (size[i] + size[j] - bound)].tolist():
            if label[k] != label[i] and linked(items[i], items[k], spec):
                a.append(names[min(label[i], label[k])])
                b.append(names[max(label[i], label[k])])
                label[label == label[k]] = label[i]
    return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits
