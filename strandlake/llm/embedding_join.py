"""Embedding near-dedup: exact metric range join over pivot cells.

On unit vectors a cosine of at least c is a distance of at most e = sqrt(2 - 2c). Pivots
cut the space into cells, each vector at home in the cell of its nearest pivot. A vector
whose partner may be at home in another cell is copied there; the triangle inequality says
when that can be: only if the other pivot is at most 2e farther than the own one. As the
metric is Euclidean, the partner must also reach over the bisecting plane, which is tighter.
Cells are in order, and vectors are copied only to cells before their own; so each pair that
may link meets once, in the first of its two home cells, and cells join independently.

Cells split by their counts into units of bounded bytes: slices of a cell's home vectors meet
each other, and each slice of the vectors that were copied to the cell. A vector thus travels
to as many units as its cell has slices, which is the root of the number of units. Within a
unit the first coordinates of the vectors, turned to the directions in which a sample varies
most, and the lengths of the rest bound each cosine from above; only pairs that pass are
multiplied out in double precision. Equal vectors become one before. Where distances
concentrate (independent directions in many dimensions) no metric bound separates cells, and
the join bounds as many pairs as a nested loop would; see the README.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import checkpointed, components, table, tidy
from strandlake.llm.simhash import forest

COSINE = 0.95
#: Distinct vectors for each pivot, and most pivots, the bounded sample that goes to the driver.
PER_PIVOT, PIVOTS = 8192, 1024
#: Bytes of either side of a unit, in double precision, the fewest vectors of one, and pairs that are bounded at a time.
SIDE_BYTES, LEAST, AT_ONCE = 16 << 20, 256, 1 << 21
#: Sides at least that all vectors make, so that small inputs spread as well.
SIDES = 6
#: Coordinates that bound a cosine, and what single precision may have lost of the bound.
LEADING, SLACK = 16, 1e-5
#: What rounding may have taken from a distance (the root of a difference from 1) and from a square.
LOST, LOST_SQUARE = 1e-7, 1e-9
#: Vectors that may be so frequent that their classes are broadcast: of n those of more than n / HOT.
HOT = 10_000


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros, and their dimensions. Components are scaled before they are squared, so that no square leaves the range."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((len(size), int(size.max(initial=1))))
    m[np.arange(m.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    # by a power of two, which loses nothing
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0))[1][:, None])
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True)), size


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def cells(m: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and whether each cell gets it."""
    width = max(m.shape[1], pivots.shape[1])
    m, pivots = _padded(m, width), _padded(pivots, width)
    square = np.maximum(2 - 2 * (m @ pivots.T), 0)
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0)) + LOST
    home = square.argmin(axis=1)
    nearest = square[np.arange(len(m)), home][:, None]
    triangle = np.sqrt(square) - np.sqrt(nearest) <= 2 * reach + 2 * LOST
    plane = square - nearest <= 2 * reach * between[home] + LOST_SQUARE
    member = triangle & plane
    member[np.arange(len(m)), home] = True
    return home, member


def apart(pivots: np.ndarray) -> np.ndarray:
    """Pivots without those of (nearly) the direction of one before, which would part no vectors."""
    kept: list[int] = []
    for k, near in enumerate(pivots @ pivots.T > 1 - 1e-6):
        if not near[kept].any():
            kept.append(k)
    return pivots[kept]


def copied(home: np.ndarray, member: np.ndarray) -> np.ndarray:
    """To which cells a vector goes beside its own: those before it."""
    return member & (np.arange(member.shape[1]) < home[:, None])


def _counts(pivots: np.ndarray, reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home, guests = np.zeros((2, len(pivots)), np.int64)
        for b in batches:
            if b.num_rows:
                home, member = cells(_matrix(b.column("embedding"))[0], pivots, reach)
                at_home += np.bincount(home, minlength=len(pivots))
                guests += copied(home, member).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(at_home), pa.array(guests)], names=["cell", "home", "guests"])

    return counts


#: A message to a unit: vectors of its left (role 0) or right (role 1) side, or of a slice that meets itself (role 2).
MESSAGE = "unit long, role int, dim int, reps binary, weights binary, dims binary, vectors binary"


def _deal(pivots: np.ndarray, reach: float, homes: np.ndarray, guests: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """homes, guests: slices of each cell. Units are numbered cell by cell: pairs of home slices, of which half occur, then a home slice with a guest slice."""
    base = np.r_[0, np.cumsum(homes * (homes + guests))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, dims = _matrix(b.column("embedding"))
            rep, weight = b.column("rep").to_numpy(), b.column("weight").to_numpy()
            home, member = cells(m, pivots, reach)
            member = copied(home, member)
            mixed = (rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            rows = []

            def add(unit: int, role: int, i: np.ndarray) -> None:
                rows.append({"unit": unit, "role": role, "dim": m.shape[1], "reps": rep[i].tobytes(), "weights": weight[i].tobytes(), "dims": dims[i].tobytes(), "vectors": m[i].tobytes()})  # noqa: B023

            for c in range(len(pivots)):
                n, g = int(homes[c]), int(guests[c])
                own, others = np.flatnonzero(home == c), np.flatnonzero(member[:, c])
                for s in range(n):
                    i = own[mixed[own] % np.uint64(n) == s]
                    if len(i):
                        add(int(base[c] + s * n + s), 2, i)
                        for t in range(n):
                            if t != s:
                                add(int(base[c] + min(s, t) * n + max(s, t)), int(t < s), i)
                        for t in range(g):
                            add(int(base[c] + n * n + s * g + t), 0, i)
                for t in range(g):
                    i = others[mixed[others] % np.uint64(g) == t]
                    for s in range(n) if len(i) else ():
                        add(int(base[c] + n * n + s * g + t), 1, i)
            yield from pa.Table.from_pylist(rows, schema=_SCHEMA).to_batches()

    return deal


_SCHEMA = pa.schema([("unit", pa.int64()), ("role", pa.int32()), ("dim", pa.int32()), ("reps", pa.binary()), ("weights", pa.binary()), ("dims", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def directions(pivots: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose first columns are the directions in which the pivots vary most."""
    return np.linalg.eigh(pivots.T @ pivots)[1][:, ::-1]


def leading(m: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """First coordinates of the turned vectors and the length of the rest: products of two such rows bound the vectors' product from above."""
    width = len(turned)
    x = m @ turned[:, :LEADING] if m.shape[1] == width else m[:, :LEADING]
    return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))]).astype(np.float32)


def close_pairs(left: np.ndarray, right: np.ndarray, turned: np.ndarray, cosine: float, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, k) of pairs with left[i] . right[k] >= cosine, some at a time; if the sides are the same slice, with i < k."""
    a, b = leading(left, turned), leading(right, turned).T
    some = max(1, AT_ONCE // max(len(right), 1))
    for at in range(0, len(left), some):
        first = at if itself else 0
        i, k = np.nonzero(a[at : at + some] @ b[:, first:] >= cosine - SLACK)
        i, k = i + at, k + first
        if itself:
            i, k = i[i < k], k[i < k]
        for part in range(0, len(i), 1 << 17):
            x, y = i[part : part + (1 << 17)], k[part : part + (1 << 17)]
            good = np.einsum("ij,ij->i", left[x], right[y]) >= cosine
            if good.any():
                yield x[good], y[good]


def _join(turned: np.ndarray, cosine: float) -> Callable[[pa.Table], pa.Table]:
    """Of a unit: the weighted links of each vector, and the smallest vector that it reaches here."""

    def join(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        width = max(r["dim"] for r in rows)
        itself = rows[0]["role"] == 2
        sides = []
        for role in (2,) if itself else (0, 1):
            side = [r for r in rows if r["role"] == role]
            if not side:
                return pa.Table.from_pylist([], schema=_FOUND)
            whole = [np.concatenate([np.frombuffer(r[c], np.int64) for r in side]) for c in ("reps", "weights", "dims")]
            sides.append((*whole, np.concatenate([_padded(np.frombuffer(r["vectors"]).reshape(-1, r["dim"]), width) for r in side])))
        (rep, weight, dims, left), (others, others_weight, others_dims, right) = sides[0], sides[-1]
        every = rep if itself else np.r_[rep, others]
        shift = 0 if itself else len(rep)
        order = np.argsort(every)  # nodes are numbered by rep, so that the smallest number is the smallest rep
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        links, root = np.zeros(len(every), np.int64), np.arange(len(every))
        for i, k in close_pairs(left, right, turned, cosine, itself):
            same = dims[i] == others_dims[k]
            i, k = i[same], k[same]
            links += np.bincount(i, others_weight[k], len(every)).astype(np.int64)
            links += np.bincount(k + shift, weight[i], len(every)).astype(np.int64)
            u, v = root[number[i]], root[number[k + shift]]
            apart = u != v
            if apart.any():
                root = forest(np.r_[u[apart], np.arange(len(root))], np.r_[v[apart], root], len(root))
        has = np.flatnonzero(links)
        moved = np.flatnonzero(root != np.arange(len(root)))
        found = pa.Table.from_arrays([pa.array(every[has]), pa.array(links[has]), pa.nulls(len(has), pa.int64())], schema=_FOUND)
        return pa.concat_tables([found, pa.Table.from_arrays([pa.array(every[order[moved]]), pa.array(np.zeros(len(moved), np.int64)), pa.array(every[order[root[moved]]])], schema=_FOUND)])

    return join


def range_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id long, embedding array<float or double>).

    n_links counts the other rows with a cosine of at least `cosine`; component_id is the
    smallest vec_id reachable by links, and kept says whether it is the row's own. Vectors
    that are null, empty or zero, or hold null or non-finite components, link with nothing,
    as do vectors of different dimensions with each other. Equal vectors link. An empty
    table gives an empty one; other columns are left out, whatever their names. Repeated rows
    count each. Rows without a vec_id link with nothing: no links, a null component, kept.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(finite & F.exists(e, lambda x: x != 0), e.cast("array<double>")).alias("embedding"))
    rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))
    distinct = checkpointed(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    n = distinct.count()
    some = distinct.orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(PIVOTS, -(-n // PER_PIVOT)))).select("embedding").toArrow()["embedding"]
    if n:
        pivots = apart(_matrix(some)[0])
        most = max(LEAST, min(SIDE_BYTES // (8 * pivots.shape[1]), n // SIDES))
        count = distinct.mapInArrow(_counts(pivots, reach), "cell long, home long, guests long").groupBy("cell").agg(F.sum("home"), F.sum("guests")).collect()
        # a slice at least for each: rounding may put a vector on a border elsewhere when they are dealt
        homes, guests = np.ones((2, len(pivots)), np.int64)
        for cell, home, met in count:
            homes[cell], guests[cell] = max(1, -(-home // most)), max(1, -(-met // most))
        units = int((homes * (homes + 1) // 2 + homes * guests).sum())
        dealt = distinct.mapInArrow(_deal(pivots, reach, homes, guests), MESSAGE).repartition(max(1, units), "unit")
        found = checkpointed(dealt.groupBy("unit").applyInArrow(tidy(_join(directions(pivots), cosine)), "rep long, links long, to long"))
        links = found.where("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
        roots = components(found.where("to is not null").select(F.col("rep").alias("u"), F.col("to").alias("v")))
        classes = distinct.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("embedding", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    else:
        classes = distinct.select("embedding", "weight", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    # a vector of very many rows would gather them in one task, as would null ones: neither is shuffled
    often = F.col("weight") > vectors.count() // HOT
    hot, cold = F.broadcast(classes.where(often)), classes.where(~often)
    found = rows.where("embedding is not null")
    linked = found.join(hot, "embedding").unionByName(found.join(hot.select("embedding"), "embedding", "left_anti").join(cold, "embedding"))
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))
