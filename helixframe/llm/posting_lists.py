"""Approximate nearest neighbours by balanced posting lists; distances are exact.

The index: a sample of at most about ``SAMPLE`` rows is halved again and again
along the line between two means, each time by its median, so all lists get
equal shares of it; their means, moved to the mean of what is nearest to them
twice, are the centroids, at most ``MOST_LISTS``. Every row goes into the list
of its nearest centroid, and, if it lies near a border, into those of up to
``COPIES`` centroids within ``EDGE`` times the nearest one's distance. Lists are
written as matrices of at most ``PART_ROWS`` rows; a long one (copies of one
vector above all) has many, dealt over salted keys.

Centroids are found through a graph held in memory: each is tied to its nearest
ones and to a few far ones, and a search goes on from the nearest known one
that it has not left yet until it has seen nothing nearer for its whole list of
best ones. A query first reads the lists whose centroids lie within ``RATIO``
times its nearest one's distance (``LEAST`` at least); the search widens until it
has all of these. The k-th distance found there bounds the second reading: a list
holds nothing nearer if its centroid lies farther than that distance and the
list's own radius together, so all others are read, without the border copies.
Nothing is missed by this, however rows and lists lie; a query in a dense place reads
few lists, and one whose rows are all about as far reads most. Lists meet the blocks of queries
that chose them, and each query's nearest rows are kept, once each, by distance
in double precision and id.

Memory: the graph is bounded by ``MOST_LISTS``, the sample by ``SAMPLE``; both
may be broadcast. Every row is indexed and may be found.

Rows with a null id, and vectors null, zero, empty or with a null or non-finite
component, take no part. Missing components of shorter vectors count as zero.
Ties go to the smaller id. Repeated ids are rows of their own. An empty table,
or one without queries, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.store import release, small_batches, stash
from helixframe.llm.vectors import array_of, bytes_of, finite, matrix, numbered, squares

#: Rows of a list that the number of lists aims at, and their bound; rows that centroids are fitted to, about, at most.
LIST_ROWS, MOST_LISTS, SAMPLE = 128, 4096, 1 << 16
#: Lists that a row may lie in, and how far the others may be.
COPIES, EDGE = 3, 1.05
#: Lists that a query reads for its bound: how far they may be, and how many at least.
RATIO, LEAST = 1.05, 4
#: What rounding may add to a distance, as a share of both lengths.
_SLACK = 1e-7
PART_ROWS, QUERY_ROWS = 2048, 512
_NEAR, _FAR, _BEAM = 16, 4, 32
#: Rows that a task holds of its queries before it passes them on.
_HELD = 1 << 17


def halved(points: np.ndarray, parts: int) -> list[np.ndarray]:
    """Rows of ``points`` in as many groups of equal sizes (one apart), each cut along the line between two means."""
    if parts == 1 or len(points) < 2:
        return [points] if len(points) else []
    first = points[0]
    a, b = first, points[int(np.argmax(((points - first) ** 2).sum(1)))]
    for _ in range(4):
        side = points @ (a - b)
        low = np.argsort(side, kind="stable")[: len(points) // 2]
        mask = np.zeros(len(points), bool)
        mask[low] = True
        a, b = points[~mask].mean(0), points[mask].mean(0)
    order = np.argsort(points @ (a - b), kind="stable")
    half = parts // 2
    cut = len(points) * half // parts
    return halved(points[order[:cut]], half) + halved(points[order[cut:]], parts - half)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, to within rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def fitted(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of balanced lists of a sample."""
    centroids = np.stack([x.mean(0) for x in halved(points, lists)])
    for _ in range(2):
        near = np.concatenate([distances(points[k : k + 4096], centroids).argmin(1) for k in range(0, len(points), 4096)])
        count = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        centroids[some] = np.add.reduceat(points[order], (np.cumsum(count) - count)[some]) / count[some, None]
    return centroids


class Graph:
    """Centroids, each tied to its nearest ones and some far ones; searches go through it for many points at a time."""

    def __init__(self, centroids: np.ndarray):
        self.at, n = centroids, len(centroids)
        near = min(_NEAR, n - 1)
        rng = np.random.default_rng(7)
        ties = []
        for k in range(0, n, 1024):
            d = distances(centroids[k : k + 1024], centroids)
            d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
            ties.append(np.argpartition(d, near - 1, 1)[:, :near] if near else np.zeros((len(d), 0), np.int64))
        self.ties = np.concatenate((np.concatenate(ties), (np.arange(n)[:, None] + rng.integers(1, max(n, 2), (n, _FAR))) % n), 1)
        self.square = (centroids * centroids).sum(1)

    def _to(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance of each row of ``x`` to its own nodes."""
        return np.maximum((x * x).sum(1)[:, None] + self.square[nodes] - 2 * np.einsum("ij,ikj->ik", x, self.at[nodes]), 0)

    def nearest(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the ``wanted`` nearest that a search from fixed entries finds, nearest first."""
        n, m = len(self.at), len(x)
        wanted = min(wanted, n)
        seen = np.zeros((m, n), bool)
        entry = np.unique(np.linspace(0, n - 1, 8).astype(np.int64))
        nodes = np.full((m, wanted), -1)
        dist, left = np.full((m, wanted), np.inf), np.ones((m, wanted), bool)  # left: the search has gone on from it

        def put(rows: np.ndarray, new: np.ndarray) -> None:
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            order = np.argsort(new, 1, kind="stable")  # a node may come twice
            twice = np.zeros(new.shape, bool)
            held = np.take_along_axis(new, order, 1)
            np.put_along_axis(twice, order[:, 1:], held[:, 1:] == held[:, :-1], 1)
            d = np.where(fresh & ~twice, self._to(x[rows], new), np.inf)
            all_d = np.concatenate((dist[rows], d), 1)
            best = np.argsort(all_d, 1, kind="stable")[:, :wanted]
            dist[rows] = np.take_along_axis(all_d, best, 1)
            nodes[rows] = np.take_along_axis(np.concatenate((nodes[rows], new), 1), best, 1)
            left[rows] = np.take_along_axis(np.concatenate((left[rows], ~(fresh & ~twice)), 1), best, 1)

        put(np.arange(m), np.broadcast_to(entry, (m, len(entry))))
        rows = np.arange(m)
        while len(rows):
            at = np.argmin(left[rows], 1)
            rows, at = (v[~left[rows, at]] for v in (rows, at))
            if len(rows):
                left[rows, at] = True
                put(rows, self.ties[nodes[rows, at]])
        return nodes, dist

    def within(self, x: np.ndarray, ratio: float, least: int) -> list[np.ndarray]:
        """Of each row the centroids within ``ratio`` times the nearest one's distance, ``least`` at least."""
        out: list = [None] * len(x)
        rows, wanted = np.arange(len(x)), max(_BEAM, least)
        while len(rows):
            nodes, dist = self.nearest(x[rows], wanted)
            inside = dist <= dist[:, :1] * ratio**2
            inside[:, :least] = True
            inside &= np.isfinite(dist)
            whole = ~inside[:, -1] | (wanted >= len(self.at))
            for k in np.flatnonzero(whole).tolist():
                out[rows[k]] = nodes[k, inside[k]]
            rows, wanted = rows[~whole], 4 * wanted
        return out


@dataclass(frozen=True)
class Index:
    """What ``build`` makes: the centroids' graph, the lists' radii, and their parts (list, salt, ids, rows, vectors): each row once, and border copies."""

    graph: Graph
    reach: np.ndarray
    parts: DataFrame
    copies: DataFrame
    salts: dict[int, int]
    width: int
    kind: str


def prepared(df: DataFrame, query: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, vector, query and _row of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(query, F.lit(False)).alias("query"))
    kept = rows.where(F.col("id").isNotNull() & finite(F.col("vector"))).where(F.exists("vector", lambda x: x != 0))
    return stash(numbered(kept), "lists-rows")


def _kind(rows: DataFrame) -> str:
    """Type that holds the components as they are."""
    return "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"


def sampled(rows: DataFrame, n: int, size: int, width: int, kind: str) -> np.ndarray:
    """About ``size`` rows, all if there are fewer, taken by a hash of their number."""
    rows = rows if n <= size else rows.where(F.pmod(F.xxhash64("_row"), F.lit(n)) < size)
    table = rows.orderBy(F.xxhash64("_row")).select("vector").toArrow()
    return matrix(table.column(0).combine_chunks(), width, kind).astype(np.float64)


def assigned(rows: DataFrame, graph: Graph, width: int, kind: str, ratio: float, least: int, most: int | None) -> DataFrame:
    """(list, id, _row, vector binary, own, gap) for each list that a row goes to: ``own`` is the first one, ``gap`` the distance to its centroid."""
    held = rows.sparkSession.sparkContext.broadcast(graph)  # bounded by MOST_LISTS

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = matrix(part.column(2), width, kind)
                if most == 1 or len(held.value.at) == 1:
                    chosen = list(held.value.nearest(x.astype(np.float64), _BEAM)[0][:, :1])
                else:
                    chosen = held.value.within(x.astype(np.float64), ratio, least)
                if most:
                    chosen = [c[:most] for c in chosen]
                times = np.fromiter(map(len, chosen), np.int64, len(chosen))
                at, lists = np.repeat(np.arange(len(x)), times), np.concatenate(chosen)
                with np.errstate(over="ignore"):
                    gap = np.concatenate([np.sqrt(((x[at[k : k + 4096]] - held.value.at[lists[k : k + 4096]]) ** 2).sum(1)) for k in range(0, len(at), 4096)])
                row, raw = pa.array(at), pa.array([v.tobytes() for v in x], pa.binary())
                own = np.diff(at, prepend=-1) != 0
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column(0).take(row), part.column(1).take(row), raw.take(row), pa.array(own), pa.array(gap)], ["list", "id", "_row", "vector", "own", "gap"])

    return rows.select("id", "_row", "vector").mapInArrow(run, "list int, id long, _row long, vector binary, own boolean, gap double")


def reaching(queries: DataFrame, index: Index) -> DataFrame:
    """(list, id, _row, vector binary) for each list that may hold a row within ``bound`` of a query (null: no bound)."""
    width, kind = index.width, index.kind
    held = queries.sparkSession.sparkContext.broadcast((index.graph.at, index.reach))  # bounded by MOST_LISTS

    def run(batches):
        at, reach = held.value
        length = np.sqrt((at * at).sum(1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = matrix(part.column(2), width, kind)
                bound = np.nan_to_num(part.column(3).to_numpy(zero_copy_only=False), nan=np.inf)
                with np.errstate(over="ignore", invalid="ignore"):
                    y = x.astype(np.float64)
                    slack = _SLACK * (np.sqrt((y * y).sum(1))[:, None] + length)
                    beyond = np.sqrt(distances(y, at)) - reach - slack > bound[:, None]
                query, lists = np.nonzero(~beyond & (reach >= 0))
                raw, row = pa.array([v.tobytes() for v in x], pa.binary()), pa.array(query)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column(0).take(row), part.column(1).take(row), raw.take(row)], ["list", "id", "_row", "vector"])

    return queries.select("id", "_row", "vector", "bound").mapInArrow(run, "list int, id long, _row long, vector binary")


def parts_of(placed: DataFrame, salts: dict[int, int], per: int, n: int) -> DataFrame:
    """(list, salt, ids, rows, vectors): rows of a list and salt in parts of at most ``per``."""
    several = {k: v for k, v in salts.items() if v > 1}
    salt = F.pmod(F.xxhash64("_row"), F.coalesce(F.try_element_at(_map(several), F.col("list")), F.lit(1))).cast("int")

    def run(batches):
        key, held, size = None, [], 0

        def flush():
            nonlocal size
            ids, rows = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (2, 3))
            raw = b"".join(v for x in held for v in x.column(4).to_pylist())
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), bytes_of(ids), bytes_of(rows), pa.array([raw], pa.binary())], ["list", "salt", "ids", "rows", "vectors"])

        for batch in batches:
            lists, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(lists) != 0) | (np.diff(at) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(lists)], strict=True):
                if lo == hi:
                    continue
                if held and key != (lists[lo], at[lo]):
                    yield flush()
                key = (lists[lo], at[lo])
                while lo < hi:
                    held.append(batch.slice(lo, min(hi - lo, per - size)))
                    lo, size = lo + held[-1].num_rows, size + held[-1].num_rows
                    if size == per:
                        yield flush()
        if held:
            yield flush()

    spark = placed.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (1 << 17)))
    dealt = placed.withColumn("salt", salt).select("list", "salt", "id", "_row", "vector").repartition(count, "list", "salt").sortWithinPartitions("list", "salt", "_row")
    return dealt.mapInArrow(run, "list int, salt int, ids binary, rows binary, vectors binary")


def _map(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]) if values else F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))


def build(rows: DataFrame) -> Index:
    """Index of all of ``rows`` (id, _row, vector)."""
    extent = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width, kind = extent["n"], max(extent["width"] or 1, 1), _kind(rows)
    lists = int(np.clip(-(-n // LIST_ROWS), 1, MOST_LISTS))
    points = sampled(rows, n, SAMPLE, width, kind)
    graph = Graph(fitted(points, min(lists, max(1, len(points)))) if len(points) else np.zeros((1, width)))
    placed = stash(assigned(rows, graph, width, kind, EDGE, 1, COPIES), "lists-placed")
    sizes = placed.groupBy("list").agg(F.count("*").alias("count"), F.max(F.when(F.col("own"), F.col("gap"))).alias("reach")).collect()  # at most MOST_LISTS
    salts = {r["list"]: -(-r["count"] // (4 * PART_ROWS)) for r in sizes}
    reach = np.full(len(graph.at), -1.0)  # lists that are nobody's own are not read
    for r in sizes:
        reach[r["list"]] = -1.0 if r["reach"] is None else np.inf if np.isnan(r["reach"]) else r["reach"]
    parts = stash(parts_of(placed.where("own"), salts, PART_ROWS, n), "lists-parts")
    copies = stash(parts_of(placed.where("NOT own"), salts, PART_ROWS, sum(r["count"] for r in sizes) - n), "lists-copies")
    release(placed)
    return Index(graph, reach, parts, copies, salts, width, kind)


def nearest_rows(q: np.ndarray, own: np.ndarray, c: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query's place, distance, id, row) of each query's ``k`` nearest rows of a part, by distance and id; ``own`` are the queries' rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = (q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * (q @ c.T)
        slack = 1e-11 * ((q * q).sum(1)[:, None] + (c * c).sum(1).max())
    rough[np.isnan(rough)] = -np.inf
    rough[own[:, None] == rows] = np.inf
    if rough.shape[1] > k:
        least = np.partition(rough, k - 1, 1)[:, k - 1 : k]
        near = rough <= least + slack
    else:
        near = np.ones(rough.shape, bool)
    near &= own[:, None] != rows
    out = []
    some = max(1, (1 << 19) // max(1, near.sum(1).max(initial=1)))
    for lo in range(0, len(q), some):  # rounding may tie many rows, so a few queries at a time
        a, b = np.nonzero(near[lo : lo + some])
        score = np.concatenate([np.sqrt(((q[lo + a[s : s + 8192]] - c[b[s : s + 8192]]) ** 2).sum(1)) for s in range(0, len(a), 8192)] or [np.zeros(0)])
        order = np.lexsort((rows[b], ids[b], score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.searchsorted(a, np.arange(some))
        keep = np.arange(len(a)) - first[a] < k if len(a) else np.zeros(0, bool)
        out.append((lo + a[keep], score[keep], ids[b[keep]], rows[b[keep]]))
    return tuple(np.concatenate([x[j] for x in out]) for j in range(4))


def first_of_each(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest, once each, of every query among (query's row, its id, row, id, distance)."""
    query, q_id, row, ids, score = (np.concatenate([x[j] for x in found]) for j in range(5))
    order = np.lexsort((row, ids, score, query))
    query, row = query[order], row[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
    order, query = order[fresh], query[fresh]
    keep = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return tuple(np.concatenate([x[j] for x in found])[keep] for j in range(5))


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score, query_row of the ``k`` nearest rows to each of ``queries`` (id, _row, vector), but for the row itself."""
    asked = stash(assigned(queries, index.graph, index.width, index.kind, RATIO, LEAST, None), "lists-asked")
    first = found(index, index.parts.unionByName(index.copies), asked, k)
    bounds = first.groupBy("query_row").agg(F.when(F.count("*") == k, F.max("score")).alias("bound"))
    bounded = stash(queries.join(bounds, F.col("_row") == F.col("query_row"), "left").select("id", "_row", "vector", "bound"), "lists-bounds")
    release(asked, index.copies)
    reached = stash(reaching(bounded, index), "lists-reached")
    release(bounded)
    return found(index, index.parts, reached, k)


def found(index: Index, parts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score, query_row of the ``k`` nearest rows in the ``parts`` of the lists that each query asks for (list, id, _row, vector)."""
    width, kind = index.width, index.kind
    sizes = asked.groupBy("list").count().collect()  # at most MOST_LISTS
    wide = parts_of(asked, {r["list"]: -(-r["count"] // (4 * QUERY_ROWS)) for r in sizes}, QUERY_ROWS, sum(r["count"] for r in sizes))
    times = F.coalesce(F.try_element_at(_map({a: b for a, b in index.salts.items() if b > 1}), F.col("list")), F.lit(1))
    blocks = wide.select("list", F.explode(F.sequence(F.lit(0), times - 1)).alias("salt"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"))
    met = parts.join(blocks.hint("merge"), ["list", "salt"]).select("ids", "rows", "vectors", "q_ids", "q_rows", "q_vectors")

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["query_row", "query_id", "row", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, q_ids, q_rows = (array_of(batch.column(j), i, "<i8") for j in (0, 1, 3, 4))
                c, q = (array_of(batch.column(j), i, kind).reshape(-1, width).astype(np.float64) for j in (2, 5))
                at, score, found, row = nearest_rows(q, q_rows, c, ids, rows, k)
                held.append((q_rows[at], q_ids[at], row, found, score))
                size += len(at)
                if size >= 2 * _HELD:
                    held[:] = [first_of_each(held, k)]
                    size = len(held[0][0])
                    if size >= _HELD:
                        yield out()
                        size = 0
        if size:
            held[:] = [first_of_each(held, k)]
            yield out()

    hits = met.mapInArrow(run, "query_row long, query_id long, row long, id long, score double")
    once = hits.groupBy("query_row", "query_id", "row", "id").agg(F.min("score").alias("score"))  # a row may lie in several lists
    order = Window.partitionBy("query_row").orderBy("score", "id", "row")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score", "query_row")


def neighbours(df: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score, query_row: the ``k`` nearest rows found to each row that ``query`` tells, itself excepted; see the module's head."""
    small_batches(df.sparkSession)
    rows = prepared(df, query, id_col, vector_col)
    index = build(rows)
    return search(index, rows.where("query"), k)
