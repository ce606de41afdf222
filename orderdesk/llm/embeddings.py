"""Near-duplicate vectors by E8 lattice hashing.

Equal vectors are one class, led by their smallest id. In each of several
tables a leader's unit vector goes through a random projection to one or more
blocks of eight dimensions; each block is decoded to its nearest point of the
E8 lattice, and the points name the cell. A vector also visits the cells of
the neighbouring lattice points that lie nearest to it. Vectors that meet in a
cell and whose sign sketches are close enough are compared by cosine in double
precision.

The number of blocks follows the number of leaders (so that few unrelated
vectors share a cell at any size) and the number of tables follows from the
chance that a pair at the threshold meets in one table, worked out by
simulation, so that a pair is missed with probability ``MISS`` at most.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing, as does a row without id; vectors of different
lengths never link; rows that repeat an id are vectors of their own that share
a node; ties at the threshold link; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components
from .minhash import _mixed

THRESHOLD = 0.95
MISS = 1e-4
PROBES = 8
NEIGHBOURS_PER_CELL = 4  # unrelated vectors a cell may hold on average
SKETCH_BITS = 64
SEED = 11


@dataclass(frozen=True)
class Plan:
    tables: int
    blocks: int
    width: float
    probes: int
    sketch_distance: int


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0..) in any places and (+-1/2, ..) with evenly many minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    rest = x[odd] - point[odd]
    worst = np.abs(rest).argmax(axis=1)
    point[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of the two cosets of D8."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def neighbours(x: np.ndarray, point: np.ndarray, probes: int) -> np.ndarray:
    """(n, probes, 8): the neighbouring lattice points nearest to ``x``."""
    lead = -(x - point) @ ROOTS.T
    top = np.argpartition(lead, probes - 1, axis=1)[:, :probes]
    return point[:, None, :] + ROOTS[top]


@lru_cache(maxsize=64)
def meeting_rates(width: float, probes: int, threshold: float) -> tuple[float, float, float]:
    """Chances in one block: a pair at the threshold in one cell, or only by a probe; an unrelated pair in one cell."""
    rng = np.random.default_rng(SEED)
    n = 20_000
    a = rng.normal(size=(n, 8))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold ** 2)) * rng.normal(size=(n, 8))
    shift = rng.random(8)
    a, b = a / width + shift, b / width + shift
    pa_, pb = nearest_e8(a), nearest_e8(b)
    same = (pa_ == pb).all(axis=1)
    probed = (neighbours(a, pa_, probes) == pb[:, None]).all(axis=2).any(axis=1)
    probed |= (neighbours(b, pb, probes) == pa_[:, None]).all(axis=2).any(axis=1)
    cells = nearest_e8(rng.normal(size=(200_000, 8)) / width + shift)
    _, counts = np.unique((2 * cells).astype(np.int64), axis=0, return_counts=True)
    return float(same.mean()), float((probed & ~same).mean()), float((counts * (counts - 1.0)).sum() / (2e5 * (2e5 - 1)))


def plan_for(leaders: int, threshold: float = THRESHOLD, miss: float = MISS, probes: int = PROBES) -> Plan:
    blocks = 1
    while True:
        width = 1.0 if blocks == 1 else 1.4
        same, probed, unrelated = meeting_rates(width, probes, threshold)
        if leaders * unrelated ** blocks <= NEIGHBOURS_PER_CELL or blocks == 8:
            break
        blocks += 1
    meet = same ** blocks + blocks * same ** (blocks - 1) * probed
    angle = math.acos(threshold) / math.pi
    spread = 6.5 * math.sqrt(SKETCH_BITS * angle * (1 - angle))
    return Plan(max(1, math.ceil(math.log(miss) / math.log(1 - min(meet, 1 - 1e-9)))), blocks, width, probes,
                math.ceil(SKETCH_BITS * angle + spread))


def _cell(points: np.ndarray, name: int) -> np.ndarray:
    """64-bit names of cells; ``points`` is (..., 8 * blocks)."""
    twice = (2 * points).astype(np.int64).view(np.uint64)
    acc = np.full(points.shape[:-1], name, np.uint64)
    for k in range(points.shape[-1]):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + twice[..., k])
    return acc


def cells(units: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, tables) and visited cells (n, tables * blocks * probes) of unit vectors."""
    n, dim = units.shape
    homes, visits = [], []
    for t in range(plan.tables):
        rng = np.random.default_rng([SEED, dim, t])
        x = units @ rng.normal(size=(dim, 8 * plan.blocks)) / plan.width + rng.random(8 * plan.blocks)
        point = nearest_e8(x.reshape(-1, 8)).reshape(n, -1)
        name = dim * 100_003 + t
        homes.append(_cell(point, name))
        for b in range(plan.blocks):
            part = slice(8 * b, 8 * b + 8)
            moved = np.repeat(point[:, None, :], plan.probes, axis=1)
            moved[:, :, part] = neighbours(x[:, part], point[:, part], plan.probes)
            visits.append(_cell(moved, name))
    return np.stack(homes, axis=1), np.concatenate(visits, axis=1)


def sketches(units: np.ndarray) -> np.ndarray:
    """Signs of 64 random projections as bits."""
    rng = np.random.default_rng([SEED, units.shape[1]])
    signs = units @ rng.normal(size=(units.shape[1], SKETCH_BITS)) >= 0
    return np.packbits(signs, axis=1).view(np.int64)[:, 0]


def _hasher(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                units = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                homes, visits = cells(units, plan)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sketches(units)), _lists(homes), _lists(visits)],
                    ["__id", "__bits", "__homes", "__visits"])
    return run


def _lists(table: np.ndarray) -> pa.Array:
    n, k = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(table.reshape(-1).view(np.int64)))


def _unit_arrays(vectors: pa.Array) -> pa.Array:
    """Each vector scaled by its largest component, then to length 1; null unless all components are usable."""
    values = vectors.flatten().to_numpy(zero_copy_only=False)  # a null component becomes NaN
    sizes = [0 if not v.is_valid else len(v) for v in vectors]
    out, at = [], 0
    for size in sizes:
        v, at = values[at:at + size], at + size
        top = np.abs(v).max() if size else 0.0
        if top > 0 and np.isfinite(v).all():
            v = v / top
            out.append(v / np.sqrt(v @ v))
        else:
            out.append(None)
    return pa.array(out, pa.list_(pa.float64()))


def _unit(vector: Column) -> Column:
    def run(vectors: pa.Array) -> pa.Array:
        return _unit_arrays(vectors)
    run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(vector)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def leader_links(leaders: DataFrame, threshold: float, plan: Plan) -> DataFrame:
    """``a < b``: pairs of leaders (``__id``, ``__unit``) with at least the threshold."""
    hashed = checkpointed(leaders.select("__id", "__unit").mapInArrow(
        _hasher(plan), "__id long, __bits long, __homes array<long>, __visits array<long>"))
    home = hashed.select("__id", "__bits", F.explode("__homes").alias("__cell"))
    guest = hashed.select(F.col("__id").alias("__other"), F.col("__bits").alias("__obits"),
                          F.explode(F.concat("__homes", "__visits")).alias("__cell"))
    near = (F.col("__id") != F.col("__other")) & (
        F.bit_count(F.col("__bits").bitwiseXOR(F.col("__obits"))) <= plan.sketch_distance)
    pairs = (home.join(guest, (home["__cell"] == guest["__cell"]) & near)
             .select(F.least("__id", "__other").alias("a"), F.greatest("__id", "__other").alias("b")).distinct())
    left = leaders.select(F.col("__id").alias("a"), F.col("__unit").alias("__ua"))
    right = leaders.select(F.col("__id").alias("b"), F.col("__unit").alias("__ub"))
    return (pairs.join(left, "a").join(right, "b")
            .filter((F.size("__ua") == F.size("__ub")) & (cosine(F.col("__ua"), F.col("__ub")) >= threshold)).select("a", "b"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("__row"), F.col(embedding).cast("array<double>").alias("__v"))
    rows = rows.withColumn("__unit", F.when(F.col("__row").isNotNull(), _unit(F.col("__v"))))
    leaders = checkpointed(
        rows.filter("__unit IS NOT NULL").groupBy("__v", "__unit").agg(F.min("__row").alias("__id"), F.count("*").alias("__m")))
    links = checkpointed(leader_links(leaders, threshold, plan_for(leaders.count(), threshold, miss)))
    both = links.union(links.select("b", "a"))
    size = leaders.select(F.col("__id").alias("b"), F.col("__m").alias("__k"))
    counts = both.join(size, "b").groupBy(F.col("a").alias("__id")).agg(F.sum("__k").alias("__n"))
    labels = components(links)
    classes = (leaders.join(counts, "__id", "left").join(labels, F.col("__id") == labels["node"], "left")
               .select(F.col("__v").alias("__key"), (F.coalesce("__n", F.lit(0)) + F.col("__m") - 1).alias("__links"),
                       F.coalesce("label", "__id").alias("__component")))
    found = rows.join(classes, F.when(F.col("__unit").isNotNull(), F.col("__v")) == classes["__key"], "left")
    component = F.coalesce("__component", "__row")
    return found.select(F.col("__row").alias(vec_id), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), F.coalesce(F.col("__row") == component, F.lit(True)).alias("kept"))
