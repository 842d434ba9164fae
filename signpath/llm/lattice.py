"""Embedding near-duplicates by E8 lattice hashing (operator 8).

In each of several tables a vector of unit length is projected onto ``blocks`` random orthonormal frames of eight dimensions;
each projection is decoded to the nearest point of the scaled E8 lattice, and the points together name a cell.
A vector is filed under its own cell and under the cells with the nearest neighbouring lattice points. Pairs that
meet in a cell, one of them at home there, are verified by cosine in double precision.

The lattice is scaled to the length of the vectors, so that a pair at the threshold is as far apart in cells in any dimension.
Frames grow in number with the logarithm of the number of vectors, which keeps cells small; tables are then added until
simulated pairs at the threshold are found with probability ``recall``.

Equal vectors become one class first, with their number. A cell's rows are compared in blocks of at most ``block`` rows, for each
pair of blocks in a task of its own, so that a cell with many vectors is spread out. A pair counts only in the first
table, and there in one cell, where it meets, which is told from the cells of both. So no list of pairs is ever made: a
block pair gives one row for each vector that has links in it, with their number and the least vector that it reaches there.

Defined cases: vectors that are null, empty, zero, or hold nulls or numbers that aren't finite link with nothing. Vectors of
different lengths don't link with one another. Rows with one vec_id are one vector (the least, if they differ) and give one
row. A row without vec_id links with nothing and has component null. An empty table gives an empty result. Columns
besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signpath.shipping import ship

from .arrowmap import bound_batches, trimmed
from .components import connected
from .shared import stored


@dataclass(frozen=True)
class Params:
    """Threshold, the recall to reach at it, shape of the hash family, and the size of the blocks that are compared at once."""

    cosine: float = 0.95
    recall: float = 0.97
    most_tables: int = 24
    blocks: int = 2
    probes: int = 3
    block: int = 1024
    seed: int = 8


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, times two so that they are whole numbers."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((-1, 1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(x[odd] - near[odd]).argmax(1)
    off = x[odd, worst] - near[odd, worst]
    near[odd, worst] += np.where(off >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, times two."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half * 2, whole * 2).astype(np.int64)


@dataclass(frozen=True)
class Family:
    """Frames (tables, blocks, length, 8), weights of lattice coordinates in cell numbers, and a number for each table."""

    frames: np.ndarray
    weights: np.ndarray
    names: np.ndarray
    scale: float


def _drawn(dim: int, tables: int, blocks: int, seed: int) -> Family:
    """Random frames for vectors of length ``dim``; those for fewer tables are the first of those for more."""
    frames, weights = [], []
    for t in range(tables):
        rng = np.random.Generator(np.random.PCG64([seed, dim, t]))
        width = 8 * blocks
        frame = np.linalg.qr(rng.standard_normal((max(dim, width), width)))[0][:dim]
        frames.append(frame.reshape(dim, blocks, 8).transpose(1, 0, 2))
        weights.append(rng.integers(1, 2**62, (blocks, 8), dtype=np.int64) * 2 + 1)
    names = np.random.Generator(np.random.PCG64([seed, dim])).integers(-(2**62), 2**62, tables)
    # A random projection of a unit vector has length sqrt(8 / dim), about the distance of neighbouring lattice points.
    return Family(np.array(frames), np.array(weights), names, 2 / np.sqrt(max(dim, 8 * blocks)))


@functools.lru_cache(maxsize=16)
def family(dim: int, blocks: int, p: Params) -> Family:
    """The fewest tables that find pairs at the threshold with the stated probability, by simulation."""
    rng = np.random.Generator(np.random.PCG64([p.seed, dim, blocks, 1]))
    one, other = rng.standard_normal((2, 2000, dim))
    one /= np.linalg.norm(one, axis=1)[:, None]
    other -= (other * one).sum(1)[:, None] * one
    size = np.linalg.norm(other, axis=1)[:, None]
    if dim < 2 or not size.all():
        return _drawn(dim, 1, blocks, p.seed)
    two = p.cosine * one + np.sqrt(1 - p.cosine**2) * other / size
    most = _drawn(dim, p.most_tables, blocks, p.seed)
    a, b = cells(one, most, p), cells(two, most, p)
    met = (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)
    reached = np.logical_or.accumulate(met, axis=1).mean(0) >= p.recall
    tables = int(reached.argmax()) + 1 if reached.any() else p.most_tables
    return Family(most.frames[:tables], most.weights[:tables], most.names[:tables], most.scale)


def blocks_for(rows: int, p: Params) -> int:
    """Frames, so that cells of ``rows`` vectors in general position hold some hundreds: a frame tells about 60 apart."""
    n = p.blocks
    while rows / 60.0**n > 256:
        n += 1
    return n


def cells(unit: np.ndarray, f: Family, p: Params) -> np.ndarray:
    """(rows, tables, 1 + probes) cell numbers: the own cell first, then neighbours by distance."""
    n = len(unit)
    tables, blocks = f.frames.shape[:2]
    out = np.zeros((n, tables, 1 + p.probes), np.int64)
    each = np.arange(n)
    for t in range(tables):
        keys, steps, costs = np.full(n, f.names[t], np.int64), [], []
        for k in range(blocks):
            x = unit @ f.frames[t, k] / f.scale
            point = decode(x)
            keys += (point * f.weights[t, k]).sum(1)
            toward = (x - point / 2) @ (NEIGHBOURS.T / 2)
            top = np.argpartition(-toward, min(p.probes, 239), axis=1)[:, : max(p.probes, 1)]
            steps.append((NEIGHBOURS @ f.weights[t, k])[top])
            costs.append(2 - 2 * np.take_along_axis(toward, top, 1))
        step, cost = list(steps), list(costs)
        nearest = [c.argmin(1) for c in costs]
        for a, b in itertools.combinations(range(blocks), 2):  # also one step in each of two blocks
            step.append((steps[a][each, nearest[a]] + steps[b][each, nearest[b]])[:, None])
            cost.append((costs[a][each, nearest[a]] + costs[b][each, nearest[b]])[:, None])
        step, cost = np.concatenate(step, 1), np.concatenate(cost, 1)
        best = np.argsort(cost, axis=1, kind="stable")[:, : p.probes]
        out[:, t, 0] = keys
        out[:, t, 1:] = keys[:, None] + np.take_along_axis(step, best, 1)
    return out


def units(flat: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square overflows."""
    wide = flat.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1))[:, None]


_ROW = "cell long, tb int, home boolean, vec_id long, copies long, vec binary"


def filed(vectors: DataFrame, kind: str, blocks: int, p: Params, light: bool) -> DataFrame:
    """A row for each cell that a vector (vec_id, copies, embedding) is filed under; ``light`` leaves all but the cell out."""
    fields = "cell long" if light else _ROW
    schema = to_arrow_schema(T.StructType.fromDDL(fields))

    def run(batches):
        with trimmed():
            for whole in batches:
                for lo in range(0, whole.num_rows, 1000):
                    batch = whole.slice(lo, 1000)
                    lists = batch.column(2)
                    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(kind)
                    begin = np.cumsum(sizes) - sizes
                    for dim in np.unique(sizes):
                        rows = np.flatnonzero(sizes == dim)
                        own = flat[begin[rows][:, None] + np.arange(dim)]
                        f = family(int(dim), blocks, p)
                        at = cells(units(own), f, p)
                        n, t, width = at.shape
                        cell = pa.array(at.ravel())
                        if light:
                            yield pa.RecordBatch.from_arrays([cell], schema=schema)
                            continue
                        index = np.repeat(np.arange(n), t * width)
                        vec = pa.array([x.tobytes() for x in own], pa.binary()).take(pa.array(index))
                        tb = np.tile(np.repeat(np.arange(t, dtype=np.int32), width), n)
                        home = np.tile(np.arange(width) == 0, n * t)
                        ids, copies = (batch.column(k).to_numpy()[rows][index] for k in (0, 1))
                        yield pa.RecordBatch.from_arrays([cell, pa.array(tb), pa.array(home), pa.array(ids), pa.array(copies), vec], schema=schema)

    return vectors.select("vec_id", "copies", "embedding").mapInArrow(run, fields)


def compare(tb: int, home: np.ndarray, side: np.ndarray, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, f: Family, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(vec_id, links, least vec_id reached) of the vectors of one block pair of a cell that have links that count here."""
    near = unit @ unit.T >= p.cosine
    near &= home[:, None] | home[None, :]
    if side[0] != side[-1]:
        near &= side[:, None] != side[None, :]
    near &= ids[:, None] < ids[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return None
    some = np.unique(np.concatenate([i, j]))
    own = np.zeros((len(ids), len(f.frames), 1 + p.probes), np.int64)
    own[some] = cells(unit[some], f, p)
    counts = np.zeros(len(i), bool)
    for lo in range(0, len(i), 20_000):
        at = slice(lo, lo + 20_000)
        a, b = own[i[at]], own[j[at]]
        at_a, at_b = (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)
        first = (at_a | at_b).argmax(1) == tb
        same = a[:, tb, 0] == b[:, tb, 0]
        # Two homes meet twice if each is filed under the other; the home of the smaller vec_id then counts.
        both = at_a[:, tb] & at_b[:, tb] & ~same
        counts[at] = first & (~both | home[i[at]])
    i, j = i[counts], j[counts]
    if not len(i):
        return None
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    least = ids.copy()
    while True:
        old = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (old == least).all():
            break
    has = np.flatnonzero(links)
    return ids[has], links[has], least[has]


def _meetings(kind: str, blocks: int, p: Params, schema: pa.Schema):
    """Over sorted rows: a run is one block pair of one cell, at most some 2 * block rows."""

    def met(run: pa.Table) -> tuple | None:
        home = run.column("home").to_numpy()
        if run.num_rows < 2 or not home.any():
            return None
        lo, hi, tb = (run.column(c)[0].as_py() for c in ("lo", "hi", "tb"))
        side, ids, copies = (run.column(c).to_numpy() for c in ("side", "vec_id", "copies"))
        flat = np.stack([np.frombuffer(x, kind) for x in run.column("vec").to_pylist()])
        return compare(tb, home, side if lo != hi else np.zeros(len(ids), np.int64), ids, copies, units(flat), family(flat.shape[1], blocks, p), p)

    def meet(batches):
        with trimmed():
            rest = None
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                if rest is None or not rest.num_rows:
                    continue
                keys = [rest.column(c).to_numpy() for c in ("cell", "lo", "hi")]
                starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
                ends = np.append(starts[1:], rest.num_rows)
                whole = len(starts) if batch is None else len(starts) - 1
                out = [got for a, b in zip(starts[:whole], ends[:whole], strict=True) if b - a > 1 and (got := met(rest.slice(a, b - a)))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], schema=schema)
                rest = rest.slice(starts[whole]) if batch is not None else None

    return meet


def near_duplicates(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    ship(embeddings.sparkSession)
    bound_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = "f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    told = rows.agg(F.count("vec_id").alias("n"), F.countDistinct("vec_id").alias("d")).first()
    if told["n"] != told["d"]:
        rows = rows.where("vec_id is null").unionByName(rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    good = "vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null or isnan(x) or abs(double(x)) = double('Infinity'))"
    mark = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.size("embedding"), "embedding", F.lit(7)).alias("h2")]
    valid = rows.where(good)
    classes = stored(valid.select("vec_id", *mark).groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")), "vector-classes")
    blocks = blocks_for(classes.count(), p)
    vectors = stored(valid.join(classes.select(F.col("cls").alias("vec_id"), "copies"), "vec_id"), "class-vectors")
    counted = filed(vectors, kind, blocks, p, True).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > p.block)
    hot = stored(counted.select(F.col("cell").alias("hot"), F.ceil(F.col("n") / p.block).cast("long").alias("parts")), "hot-cells")
    if hot.count() <= 200_000:
        hot = F.broadcast(hot)
    placed = filed(vectors, kind, blocks, p, False).join(hot, F.col("cell") == F.col("hot"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("vec_id", "cell"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.select("cell", "tb", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "home", "vec_id", "copies", "vec")
    fields = "vec_id long, links long, to_id long"
    meet = _meetings(kind, blocks, p, to_arrow_schema(T.StructType.fromDDL(fields)))
    found = stored(placed.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "side").mapInArrow(meet, fields), "vector-links")
    least = connected(found.where("vec_id <> to_id").select(F.col("vec_id").alias("u"), F.col("to_id").alias("v"))).withColumnRenamed("id", "cls")
    links = found.groupBy(F.col("vec_id").alias("cls")).agg(F.sum("links").alias("links"))
    told = classes.join(links, "cls", "left").join(least, "cls", "left").where("copies > 1 or links is not null")
    told = told.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    # A class may hold a third of all rows.
    salts = 16
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = rows.select("vec_id", *[F.when(F.expr(good), m).alias(n) for m, n in zip(mark, ("h1", "h2"), strict=True)], F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(salts)).cast("int").alias("salt"))
    out = own.join(told, ["h1", "h2", "salt"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
