"""Hard-negative mining by slot-decomposed selection.

Anchors are a stated set of the vectors. An anchor's positives are its first
rows of the same label. Each positive opens a window of scores, between a
lower and an upper share of its own score, and the first rows of other labels
in that window are its hard negatives. The windows of one anchor overlap, so
their upper limits cut the scores into disjoint slots: a row falls into one
slot, every task keeps the first ``n_negatives`` rows per anchor and slot, and
a window's answer is a suffix of the slots in descending order of score, cut
at the window's lower limit. No row is looked at once per window.

All rows are scored against all anchors in blocks: rows and anchors are dealt
to blocks of bounded size and each pair of blocks is one matrix product in a
task, so neither side passes through the driver or has to fit one task. Tasks
hand on at most ``n_positives`` rows per anchor, then ``n_negatives`` per
anchor and slot; a grouped limit merges them.

Defined results
---------------
* Rows take no part when id, label or vector is null or when a component is
  null or not finite. Rows alike in id, label and vector count once; other
  rows that share an id are rows of their own, except that a row is never a
  positive of an anchor with its id.
* Components become ``floor(256 * x)``, x as double, held within +-2**62;
  scores are exact integers, held within the range of a long. A missing
  component of a shorter vector counts as zero, so an empty vector scores 0.
* Scores are ordered descending, ties by smaller id. An anchor without
  positives, or a window without rows, gives no rows; empty tables give none.
* Other columns of the input are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SCALE = 256.0
N_POSITIVES = 5
N_NEGATIVES = 10
# Lower and upper limit of a negative's score in tenths of the positive's.
LOWER, UPPER = 3, 9
# Rows and anchors of one block: two blocks and a strip of their products fit a task many times over.
BLOCK = 8192
# Smaller tables are dealt to this many blocks, so that a cluster shares their work.
LEAST_BLOCKS, LEAST_BLOCK = 64, 256
# Anchors scored at once inside a block.
STRIP = 128


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             label: Column | None = None) -> DataFrame:
    """One row per distinct usable vector: ``__id``, ``__label`` and ``__v``, its scaled components as bytes."""
    picked = vectors.select(F.col(id_col).cast("long").alias("__id"),
                            (F.col("label") if label is None else label).cast("long").alias("__label"),
                            F.col(vector_col).cast("array<double>").alias("__x"))
    usable = picked.filter(F.col("__id").isNotNull() & F.col("__label").isNotNull() & F.col("__x").isNotNull())

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__x")
            values = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            rows = np.flatnonzero(wrong[ends[1:]] == wrong[ends[:-1]])
            whole = np.floor(np.clip(SCALE * np.nan_to_num(values), -2.0**62, 2.0**62)).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array(rows)), batch.column("__label").take(pa.array(rows)),
                 pa.array([whole[ends[r]:ends[r + 1]].tobytes() for r in rows], pa.binary())], ["__id", "__label", "__v"])

    return usable.mapInArrow(scaled, "__id long, __label long, __v binary").distinct()


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all anchors with all rows.

    Doubles hold them exactly below 2**53; beyond that Python's integers do."""
    def most(m: np.ndarray) -> int:
        return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0

    if most(anchors) * most(rows) * max(1, anchors.shape[1]) < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _tenths_down(score: np.ndarray, n: int) -> np.ndarray:
    """floor(n * score / 10) without leaving 64 bits."""
    q, r = np.divmod(score, 10)
    return n * q + n * r // 10


def limits(positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of an anchor: distinct upper limits, ascending, and the lowest score each slot is asked for."""
    upper, lower = _tenths_down(positives, UPPER), -_tenths_down(-positives, LOWER)
    slots, at = np.unique(upper, return_inverse=True)
    least = np.full(len(slots), np.iinfo(np.int64).max)
    np.minimum.at(least, at, lower)
    # A row of one slot also serves the windows of all later slots.
    return slots, np.minimum.accumulate(least[::-1])[::-1]


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by descending score and ascending id."""
    if len(scores) > 4 * n:
        low = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= low)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:n]]


def _strips(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(place of an anchor, its scores with all rows), strip by strip."""
    a, r = anchors.column("__w").to_pylist(), rows.column("__v").to_pylist()
    width = max(len(v) for v in a + r) // 8
    right = _matrix(r, width)
    for at in range(0, len(a), STRIP):
        yield from enumerate(products(_matrix(a[at:at + STRIP], width), right), at)


ENTRIES = "__a long, __slot int, __score long, __id long"


def _table(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    def column(k: int, kind: type) -> np.ndarray:
        if k < 2:
            return np.repeat(np.array([p[k] for p in parts], kind), [len(p[2]) for p in parts])
        return np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.empty(0, kind)

    return pa.table({"__a": column(0, np.int64), "__slot": column(1, np.int32),
                     "__score": column(2, np.int64), "__id": column(3, np.int64)})


def _in_blocks(anchors: DataFrame, rows: DataFrame, score_block) -> DataFrame:
    """``score_block`` over every pair of a block of anchors and a block of rows, each pair in one task.

    Block numbers are ints on both sides: a shuffle places an int and an equal long differently, and a pair whose
    halves are placed apart would be lost without an error."""
    n_anchors, n_rows = anchors.count(), rows.count()
    a_blocks, r_blocks = max(1, -(-n_anchors // BLOCK)), max(1, -(-n_rows // BLOCK), min(LEAST_BLOCKS, n_rows // LEAST_BLOCK))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, *by: str) -> DataFrame:
        return df.withColumns({own: F.pmod(F.xxhash64(*by), F.lit(n_own)).cast("int"),
                               other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})

    left = dealt(anchors, "__ab", a_blocks, "__rb", r_blocks, "__a")
    right = dealt(rows, "__rb", r_blocks, "__ab", a_blocks, "__id", "__label", "__v")
    cells = left.groupBy("__ab", "__rb").cogroup(right.groupBy("__ab", "__rb"))
    return cells.applyInArrow(score_block, ENTRIES)


def _ranked(entries: DataFrame, n: int) -> DataFrame:
    """The first n entries per anchor and slot; every task keeps its own first n before the shuffle."""
    order = Window.partitionBy("__a", "__slot").orderBy(F.col("__score").desc(), "__id")
    return entries.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n)


def positives(anchors: DataFrame, rows: DataFrame, n: int = N_POSITIVES) -> DataFrame:
    """``__a`` and ``__positives``, its first n other rows of the same label, first ones first."""
    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            a, own, kind = (left.column(c).to_numpy() for c in ("__a", "__own", "__kind"))
            ids, labels = right.column("__id").to_numpy(), right.column("__label").to_numpy()
            for k, scores in _strips(left, right):
                same = np.flatnonzero((labels == kind[k]) & (ids != own[k]))
                same = same[_first(scores[same], ids[same], n)]
                parts.append((a[k], 0, scores[same], ids[same]))
        return _table(parts)

    first = _ranked(_in_blocks(anchors, rows, score_block), n)
    return first.groupBy("__a").agg(
        F.sort_array(F.collect_list(F.struct("__rank", "__score", "__id"))).alias("__positives"))


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | None = None, n_positives: int = N_POSITIVES,
                   n_negatives: int = N_NEGATIVES) -> DataFrame:
    """One row per anchor, positive and rank: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and the two scores.

    ``anchors`` is a condition on ``__id``, the row's id."""
    rows = checkpointed(prepared(vectors, id_col, vector_col, label))
    chosen = checkpointed(rows.filter(anchors).select(
        F.monotonically_increasing_id().alias("__a"), F.col("__id").alias("__own"), F.col("__label").alias("__kind"),
        F.col("__v").alias("__w")))
    found = checkpointed(positives(chosen, rows, n_positives))
    asked = chosen.join(found.withColumn("__p", F.transform("__positives", lambda p: p["__score"]))
                        .drop("__positives"), "__a")

    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            a, kind, scored = left.column("__a").to_numpy(), left.column("__kind").to_numpy(), left.column("__p").to_pylist()
            ids, labels = right.column("__id").to_numpy(), right.column("__label").to_numpy()
            for k, scores in _strips(left, right):
                slots, least = limits(np.array(scored[k], np.int64))
                others = np.flatnonzero((labels != kind[k]) & (scores <= slots[-1]) & (scores >= least.min()))
                at = np.searchsorted(slots, scores[others])
                for s in range(len(slots)):
                    mine = others[(at == s) & (scores[others] >= least[s])]
                    mine = mine[_first(scores[mine], ids[mine], n_negatives)]
                    if len(mine):
                        parts.append((a[k], s, scores[mine], ids[mine]))
        return _table(parts)

    entries = _ranked(_in_blocks(asked, rows, score_block), n_negatives)
    # At most n_negatives per slot, so a bounded list per anchor, in descending order through all its slots.
    merged = entries.groupBy("__a").agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("__score")).alias("__order"), "__id"))),
        lambda e: F.struct((-e["__order"]).alias("score"), e["__id"].alias("id"))).alias("__entries"))
    pairs = (chosen.select("__a", F.col("__own").alias("__anchor")).join(found, "__a").join(merged, "__a")
             .withColumn("__positive", F.explode("__positives")))
    score = F.col("__positive.__score")
    wide = score.cast("decimal(20,0)")
    window = F.filter("__entries", lambda e: (e["score"].cast("decimal(20,0)") * 10 >= wide * LOWER)
                      & (e["score"].cast("decimal(20,0)") * 10 <= wide * UPPER))
    return (pairs.select("__anchor", "__positive", F.posexplode(F.slice(window, 1, n_negatives)).alias("__at", "__e"))
            .select(F.col("__anchor").alias("anchor_id"), F.col("__positive.__id").alias("positive_id"),
                    (F.col("__at") + 1).cast("int").alias("rank"), F.col("__e.id").alias("negative_id"),
                    score.alias("positive_score"), F.col("__e.score").alias("negative_score")))
