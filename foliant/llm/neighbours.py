"""The k most similar vectors of every vector, over shifted Hilbert curves.

The different vectors are projected on a few principal axes, turned anew for each curve, and put on a grid of equal counts, shifted
anew as well; their places along a Hilbert curve through the grid are range-partitioned, and every vector is compared with all
vectors up to a window before and behind it on each curve. Neighbouring ranges share the rows of a window at their border. The lists of
all curves are merged.

How many curves and how wide a window are needed is measured, not set: the true neighbours of some hundred sampled vectors are found by
comparing them with all vectors, their distances along each curve counted over all vectors, and the cheapest plan taken
that reaches the wanted share of them. Dense clusters widen the window that way, up to comparing all with all where nothing less will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.runtime import materialise

DIM, K = 64, 5
AXES, BITS, PRINCIPAL = 12, 5, 24
#: Most curves a plan may use; share of the sampled neighbours that its windows must hold.
CURVES, WANTED = 10, 0.999
#: Bounded samples: vectors that place axes, grid and range borders, and those of them whose neighbours are searched among all.
SAMPLE, QUERIES = 20_000, 512
LEAST_WINDOW, ROWS, BLOCK = 1_024, 65_536, 512
#: Vectors travel in 16 bits a value where that tells neighbours apart: where the k-th and the next but SPARE differ by GAP or more in the cosine.
SPARE, GAP = 3, 2e-4


def hilbert_keys(q: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of grid cells (rows of `q`, `bits` bits an axis); axes * bits <= 63."""
    x = q.astype(np.uint32).T.copy()
    d = len(x)
    m = np.uint32(1 << (bits - 1))
    step = m
    while step > 1:
        low = np.uint32(step - 1)
        for i in range(d):
            hit = (x[i] & step) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        step = np.uint32(step >> 1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.uint32)
    step = m
    while step > 1:
        t ^= np.where((x[d - 1] & step) != 0, np.uint32(step - 1), np.uint32(0))
        step = np.uint32(step >> 1)
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] >> np.uint32(b)) & 1)
    return key


def usable(vectors: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(id, v): one row for each key whose vector has `dim` finite values, not all zero."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.where(F.coalesce(_ok("v", dim), F.lit(False))).dropDuplicates(["id"])


def _ok(v: str, dim: int) -> Column:
    c = F.col(v)
    return (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)


@dataclass
class Curves:
    """Projections and grids of all curves."""

    centre: np.ndarray
    axes: np.ndarray  # curve x dim x axis
    edges: np.ndarray  # curve x axis x border

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        x = (unit - self.centre) @ self.axes[curve]
        cells = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges[curve])], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
        return hilbert_keys(cells, BITS)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)


def draw_curves(sample: np.ndarray, seed: int = 5) -> Curves:
    """Axes and grids from a sample of unit vectors: the principal axes, turned for each curve, cut where the counts are equal, shifted for each curve."""
    r = np.random.default_rng(seed)
    centre = sample.mean(0)
    _, turn = np.linalg.eigh(np.cov((sample - centre).T))
    main = turn[:, ::-1][:, : min(PRINCIPAL, sample.shape[1])]
    axes, edges = [], []
    for _ in range(CURVES):
        q, _ = np.linalg.qr(r.standard_normal((main.shape[1], main.shape[1])))
        a = main @ q[:, : min(AXES, main.shape[1])]
        levels = (np.arange(1, 1 << BITS) - r.random()) / (1 << BITS)
        axes.append(a)
        edges.append(np.quantile((sample - centre) @ a, levels, axis=0).T)
    return Curves(centre, np.array(axes), np.array(edges))


def _truth(reps: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, dim: int, least: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """(query, vector) of the k nearest of each query among all vectors, at `least` or more, and whether some lie too close together to be told apart in 16 bits.

    k + SPARE rows for each query and task leave the tasks.
    """
    wide = k + SPARE


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, far, raw = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim), np.float32)
        for b in batches:
            if not len(b):
                continue
            own, v = b.column(0).to_numpy(), _vectors(b, 1, dim)
            s = queries @ _unit(v).T
            s[ids[:, None] == own[None, :]] = -2.0
            m = min(wide, s.shape[1])
            at = np.argpartition(-s, m - 1, axis=1)[:, :m]
            who, far, raw = np.r_[who, np.repeat(np.arange(len(queries)), m)], np.r_[far, -np.take_along_axis(s, at, 1).ravel()], np.r_[raw, v[at.ravel()]]
            order = np.lexsort((far, who))
            place = np.arange(len(who)) - np.searchsorted(who[order], who[order])
            order = order[place < wide]
            who, far, raw = who[order], far[order], raw[order]
        keep = far <= min(-least, 1.5)
        yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(far[keep]), pa.array(list(raw[keep]), type=pa.list_(pa.float32()))], names=["q", "far", "v"])

    rows = reps.mapInArrow(run, "q long, far double, v array<float>").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("far"))).where(F.col("r") <= wide)
    got = rows.toPandas()
    edge = got[got["r"] == k].merge(got[got["r"] == wide], on="q")
    tight = bool(len(edge)) and float(np.mean(edge["far_y"] - edge["far_x"] < GAP)) > 0.001
    got = got[got["r"] <= k]
    return got["q"].to_numpy(dtype=np.int64), np.array(got["v"].tolist(), dtype=np.float32).reshape(len(got), dim), tight


def _ranks(reps: DataFrame, curves: Curves, marks: np.ndarray, dim: int) -> np.ndarray:
    """curve x mark: how many vectors lie before each mark on each curve; one row for each mark and curve reaches the driver."""
    keys = np.stack([curves.keys(marks, c) for c in range(CURVES)])
    order = np.sort(keys, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((CURVES, order.shape[1] + 1), dtype=np.int64)
        for b in batches:
            if len(b):
                u = _unit(_vectors(b, 1, dim))
                for c in range(CURVES):
                    n[c] += np.bincount(np.searchsorted(order[c], curves.keys(u, c), side="right"), minlength=n.shape[1])
        c, i = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(n[c, i])], names=["c", "i", "n"])

    got = reps.mapInArrow(run, "c long, i long, n long").groupBy("c", "i").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((CURVES, order.shape[1] + 1), dtype=np.int64)
    n[got["c"].to_numpy(), got["i"].to_numpy()] = got["n"].to_numpy()
    before = np.cumsum(n, axis=1)
    return np.stack([before[c][np.searchsorted(order[c], keys[c])] for c in range(CURVES)])


def choose_plan(apart: np.ndarray, n: int, wanted: float) -> tuple[int, int]:
    """(curves, window): the cheapest that hold the wanted share of the pairs. apart: curve x pair, places between the two."""
    best = (np.inf, 1, n)
    for c in range(1, len(apart) + 1):
        nearest = np.sort(apart[:c].min(0))
        window = int(nearest[min(len(nearest) - 1, int(np.ceil(wanted * len(nearest))))]) if len(nearest) else 0
        window = min(n, max(LEAST_WINDOW, window + window // 8 + 64))
        best = min(best, (c * (2 * window + 4 * BLOCK), c, window))
    return best[1], best[2]


def _windows(ids: np.ndarray, raw: np.ndarray, own: np.ndarray, window: int, k: int, least: float, digits: int | None) -> Iterator[pa.RecordBatch]:
    """(head, nb, far): the k best of each own row within the window around it; rows are in the order of the curve."""
    exact = _unit(raw)
    for at in range(0, len(ids), BLOCK):
        rows = np.arange(at, min(at + BLOCK, len(ids)))
        rows = rows[own[rows]]
        if not len(rows):
            continue
        lo, hi = max(0, at - window), min(len(ids), at + BLOCK + window)
        # products in single precision around the middle of the block, so that they tell apart what lies close together
        middle = exact[rows].mean(0)
        side = exact[lo:hi] @ middle
        level = float(side[rows - lo].mean())
        s = (exact[rows] - middle).astype(np.float32) @ (exact[lo:hi] - middle).astype(np.float32).T
        s += (side - level).astype(np.float32)
        shift = exact[rows] @ middle - middle @ middle + level  # what the products lack of the cosine, for each row
        s[np.arange(len(rows)), rows - lo] = -10.0
        m = k + 4  # a few more than wanted, since these products are in single precision
        some = s[:, :: max(1, s.shape[1] // 512)]
        bound = (least - 1e-3 - shift).astype(np.float32)
        if some.shape[1] >= m:
            bound = np.maximum(bound, np.partition(some, some.shape[1] - m, axis=1)[:, some.shape[1] - m])
        i, j = np.nonzero(s >= bound[:, None])
        x = s[i, j]
        order = np.lexsort((-x, i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < m
        i, j = i[keep], j[keep]
        j = j + lo
        real = j != rows[i]
        i, j = i[real], j[real]
        far = -np.einsum("nd,nd->n", exact[rows[i]], exact[j])
        far = far if digits is None else np.round(far, digits)
        order = np.lexsort((ids[j], far, i))
        i, j, far = i[order], j[order], far[order]
        keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (far <= -least)
        i, j, far = i[keep], j[keep], far[keep]
        who, first = np.unique(i, return_index=True)
        ends = pa.array(np.r_[first, len(i)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[who]]), pa.ListArray.from_arrays(ends, pa.array(far)), pa.ListArray.from_arrays(ends, pa.array(ids[j]))], names=["head", "far", "nb"])


def _search(reps: DataFrame, n: int, k: int, dim: int, least: float, wanted: float, digits: int | None) -> DataFrame:
    """(head, nb, far): the k best others of every vector."""
    spark = reps.sparkSession
    drawn = reps.orderBy(F.xxhash64(F.lit(17), "head")).limit(SAMPLE).toPandas()
    ids, sample = drawn["head"].to_numpy(dtype=np.int64), _unit(np.array(drawn["v"].tolist(), dtype=np.float32).reshape(len(drawn), dim))
    curves = draw_curves(sample)
    if n <= 2 * LEAST_WINDOW:
        count, window, single = 1, n, True
    else:
        who, near, single = _truth(reps, sample[:QUERIES], ids[:QUERIES], k, dim, least)
        rank = _ranks(reps, curves, np.concatenate([sample[:QUERIES], _unit(near)]), dim)
        asked = min(QUERIES, len(sample))
        count, window = choose_plan(np.abs(rank[:, :asked][:, who] - rank[:, asked:]), n, wanted)
    single = single or least < 0
    # ranges of each curve by the sample; a range is several windows and several steps of the sample long
    slots = spark.sparkContext.defaultParallelism
    size = max(8 * n // len(sample), min(ROWS, -(-n * count // (2 * slots))))
    size = max(size, min(2 * window, -(-n * count // slots)))
    ranges = max(1, n // size)
    spare = int(np.ceil(window * len(sample) / n * 1.2)) + 2  # a window in steps of the sample
    ends = np.iinfo(np.int64)
    inner, low, high = [], [], []  # borders, and the first and last key that each range takes part of
    for c in range(count):
        keys = np.sort(curves.keys(sample, c))
        at = (np.arange(1, ranges) * len(keys) // ranges).astype(np.int64)
        inner.append(keys[at])
        low.append(np.r_[ends.min, np.where(at > spare, keys[np.maximum(at - spare, 0)], ends.min)])
        high.append(np.r_[np.where(at + spare < len(keys), keys[np.minimum(at + spare, len(keys) - 1)], ends.max), ends.max])
    reach = min(ranges - 1, -(-spare * ranges // len(sample)) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v = _vectors(b, 1, dim)
            u = _unit(v)
            packed = v.astype(np.float32) if single else np.rint(u * 32_767).astype(np.int16)
            raw = pa.array([x.tobytes() for x in packed], type=pa.binary())
            for c in range(count):
                key = curves.keys(u, c)
                own = np.searchsorted(inner[c], key, side="right")
                rows, part = [np.arange(len(key))], [own]
                for to in (own + d for k in range(1, reach + 1) for d in (k, -k)):
                    inside = np.clip(to, 0, ranges - 1)
                    guest = np.flatnonzero((to == inside) & (key >= low[c][inside]) & (key <= high[c][inside]))
                    rows.append(guest)
                    part.append(to[guest])
                at = np.concatenate(rows)
                mine = np.arange(len(at)) < len(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part) + c * ranges, type=pa.int32()), pa.array(key[at]), pa.array(mine), b.column(0).take(pa.array(at)), raw.take(pa.array(at))], names=["p", "key", "own", "head", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.float32 if single else np.int16).reshape(len(b), dim)) for b in batches if len(b)]
        if held:
            p, own, ids, raw = (np.concatenate(x) for x in zip(*held))
            for part in np.unique(p):
                at = p == part
                yield from _windows(ids[at], raw[at], own[at], window, keep, least if single else least - GAP, digits if single else None)

    keep = k if single else k + SPARE
    placed = reps.mapInArrow(place, "p int, key long, own boolean, head long, v binary")
    placed = placed.repartitionById(count * ranges, "p").sortWithinPartitions("p", "key", F.xxhash64("p", "head")).select("p", "own", "head", "v")  # equal keys in another order on each curve
    lists = placed.mapInArrow(meet, "head long, far array<double>, nb array<long>")
    if count == 1:
        best = lists.select("head", F.arrays_zip("far", "nb").alias("best"))
    else:
        each = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("far", "nb")))))  # k for each curve
        best = lists.groupBy("head").agg(F.slice(each, 1, keep).alias("best"))
    found = best.select("head", F.explode("best").alias("x")).select("head", "x.nb", "x.far")
    return found if single else _exact(found, reps, k, dim, least)


def _exact(found: DataFrame, reps: DataFrame, k: int, dim: int, least: float) -> DataFrame:
    """The k best by the vectors as they are of those found by shortened ones."""
    v = reps.select("head", "v")
    both = found.select("head", "nb").join(v, "head").join(v.select(F.col("head").alias("nb"), F.col("v").alias("w")), "nb").select("head", "nb", "v", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                far = -np.einsum("nd,nd->n", _unit(_vectors(b, 2, dim)), _unit(_vectors(b, 3, dim)))
                ok = pa.array(far <= -least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(far).filter(ok)], names=["head", "nb", "far"])

    far = both.mapInArrow(run, "head long, nb long, far double")
    return far.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("far", "nb"))).where(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, key: str, vector: str, k: int = K, dim: int = DIM, least: float = -1.5, wanted: float = WANTED, digits: int | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for every usable vector its k most similar others, best first, ties by smaller key.

    Left out: null keys, vectors that are null, of another length, all zero or with a null, NaN or infinite value. Each key takes
    part once. Copies of one vector are compared once, however many there are, and become each other's neighbours
    afterwards (the first k + 1 of a class serve the rest). A cosine is computed in double precision and given in
    single; with `digits`, those that agree in so many digits are ties. With `least`, neighbours of a lower cosine may be missing. Neighbours may be missed: the windows are planned to hold the share `wanted` of
    those at `least` or more, as measured on QUERIES sampled vectors. Vectors without structure in their many dimensions have no order that keeps
    neighbours together; for those the plan comes near to comparing all with all.
    """
    pts = usable(vectors, key, vector, dim)
    tagged = pts.withColumn("c", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))  # 128 bits
    ranked = tagged.select("id", "c").withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = ranked.groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("first")).withColumn("head", F.col("first")[0])  # at most k + 1 a class
    reps = materialise(tagged.groupBy("c").agg(F.min("id").alias("head"), F.first("v").alias("v")).select("head", "v"), "vectors")
    n = reps.count()
    if not n:
        return tagged.select("id", F.col("id").alias("neighbour"), F.lit(0.0).cast("float").alias("cosine"), F.lit(1).alias("rank")).where("false")
    top = _search(reps, n, k, dim, least, wanted, digits)
    # classes to keys: own copies come first, then the members of the neighbouring classes
    other = top.join(heads.select(F.col("head").alias("nb"), "first"), "nb").select("head", F.explode("first").alias("neighbour"), "far")
    other = other.withColumn("p", F.row_number().over(Window.partitionBy("head").orderBy("far", "neighbour"))).where(F.col("p") <= k)
    lists = other.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("far", F.col("neighbour").alias("nb")))).alias("others"))  # at most k
    both = heads.join(lists, "head", "left")
    own = F.transform(F.filter("first", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("nb")))
    empty = F.array().cast("array<struct<far:double,nb:bigint>>")
    best = F.slice(F.concat(F.slice(own, 1, k), F.coalesce("others", empty)), 1, k)
    out = tagged.select("id", "c").join(both, "c").select("id", F.posexplode(best).alias("rank", "x"))
    return out.select("id", F.col("x.nb").alias("neighbour"), (-F.col("x.far")).cast("float").alias("cosine"), (F.col("rank") + 1).alias("rank"))
