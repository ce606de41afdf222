"""Near-duplicate documents by one-permutation MinHash.

1. One pass over the texts makes each document's set of word shingles, its
   one-permutation sketch (one hash of every shingle, its top bits name the
   bin, the rest is the value; empty bins borrow by optimal densification),
   the sketch's band hashes and the smallest hashes of the set.
2. Equal sets are one class, led by its smallest id; only leaders go on, numbered
   in the order of their ids (a leader is a set, not an id: ids may repeat).
3. In every band bucket one member is the centre and each other member forms
   a candidate edge with it (a star), so a bucket of m leaders gives m - 1
   pairs. Candidate edges are confirmed on the full shingle sets of the texts.
4. A bucket whose members already share one component has nothing left to
   find. The others get a second star around another member of their largest
   component, tried against members of other components.
5. What is still open, without the two centres, which are done, is compared in
   blocks: a bucket's members are dealt into blocks of about ``BLOCK``, those of
   its largest component apart (they are not compared with each other); a task takes two blocks at a time, compares the
   smallest hashes of members of different components by one matrix product
   and hands on candidate edges that are then confirmed on the full sets like
   all others. Sets of up to ``BOTTOM`` shingles are held whole, so of their
   pairs only those that are similar enough and join two components are handed
   on; of larger sets those whose estimate allows the similarity. A pair is
   compared in its first common bucket only. No bucket is capped and no group
   is collected into one task.

With 42 bands of 6 rows a pair of similarity 0.8 shares no bucket with
probability 3e-6; the estimate of such a pair falls ``SPREAD`` standard errors
short with a probability of 3e-6.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` of the text with A-Z lowered.

Edge cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; fewer words than a shingle make one shingle; a null
document id is linked with nothing and is kept; repeated rows of one id and
text share one decision; rows that share an id but not the text are judged by
their own text; an empty table gives an empty table; other columns may have any
name. Two sets count as equal
when a 128-bit digest of all their shingle hashes agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, broadcast_if_small, checkpointed, counted
from .components import components, joined

BANDS = 42
ROWS = 6
BOTTOM = 256  # smallest hashes kept for the comparison in blocks
SPREAD = 4.5
BLOCK = 256
PAIRS_AT_ONCE = 1 << 16
HASHES_AT_ONCE = 1 << 13
SHINGLE = 5
SIMILARITY = 80  # percent
ASKED_BYTES = 16 << 20  # of questions for texts that are broadcast; beyond it the texts are shuffled

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), element-wise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; bytes.split() cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=_U, count=len(words))
    n = max(1, len(h) - size + 1)
    acc = np.full(n, min(size, len(h)), _U)
    for k in range(min(size, len(h))):
        acc = _mixed(acc * _U(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(acc)


_PROBES: dict[tuple[int, int], np.ndarray] = {}


def _probes(bins: int, block: int, width: int = 32) -> np.ndarray:
    """Bins that each empty bin asks next: attempts block*width .. of a universal hash."""
    if (bins, block) in _PROBES:
        return _PROBES[bins, block]
    b, t = np.arange(bins, dtype=_U)[:, None], np.arange(block * width, (block + 1) * width, dtype=_U)[None, :]
    table = (_mixed(_mixed(b + _U(1)) + t * _U(0x9E3779B97F4A7C15)) % _U(bins)).astype(np.int64)
    if block < 64:
        _PROBES[bins, block] = table
    return table


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketch of a non-empty sorted hash array; ``bins`` is a power of two."""
    shift = _U(64 - bins.bit_length() + 1)
    names = np.arange(bins, dtype=_U)
    at = np.searchsorted(hashes, names << shift)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((first >> shift) == names)
    empty = np.flatnonzero(~full)
    block = 0
    donors = np.arange(bins)
    while len(empty):
        asked = _probes(bins, block)[empty]
        hit = full[asked]
        found = hit.any(axis=1)
        donors[empty[found]] = asked[found, hit[found].argmax(axis=1)]
        empty = empty[~found]
        block += 1
    return first[donors]


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = values.reshape(bands, rows)
    acc = np.arange(1, bands + 1, dtype=_U)
    for k in range(rows):
        acc = _mixed(acc * _U(0x9E3779B97F4A7C15) + table[:, k])
    return acc


def _signatures(size: int, bands: int, rows: int):
    bins = 1 << (bands * rows - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, low, high, parts, smallest, ends, tails = [], [], [], [], [], [0], [0]
            for text in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(words_of(text.as_py() or b""), size)
                counts.append(len(hashes))
                if len(hashes):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
                    low.append(int(digest[0]))
                    high.append(int(digest[1]))
                    parts.append(band_hashes(sketch(hashes, bins)[:bands * rows], bands, rows))
                    smallest.append((hashes[:BOTTOM] >> _U(32)).astype(np.uint32))
                else:
                    low.append(None)
                    high.append(None)
                ends.append(ends[-1] + (bands if len(hashes) else 0))
                tails.append(tails[-1] + min(BOTTOM, len(hashes)))
            values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            bottom = np.concatenate(smallest).view(np.int32) if smallest else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                 pa.ListArray.from_arrays(pa.array(tails, pa.int32()), pa.array(bottom))],
                ["__id", "__t", "__n", "__d1", "__d2", "__bands", "__low"])
    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``__id, __text`` and ``__t``, a hash of the text: rows of one id are told apart by it."""
    return docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"),
                       F.xxhash64(F.col(text).cast("string")).alias("__t"))


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``__id, __t, __n`` (set size), ``__d1, __d2`` (digest of the set), ``__bands``, ``__low``; texts are read whole."""
    return _rows(docs, doc_id, text).mapInArrow(
        _signatures(size, bands, rows),
        "__id long, __t long, __n long, __d1 long, __d2 long, __bands array<long>, __low array<int>")


def _confirm(size: int, percent: int):
    def shingles(text: bytes | None) -> set:
        words = words_of(text or b"")
        if len(words) < size:
            return {tuple(words)} if words else set()
        return set(zip(*[words[k:] for k in range(size)], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                a, b = shingles(ta.as_py()), shingles(tb.as_py())
                both = len(a & b)
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def confirmed(docs: DataFrame, edges: DataFrame, n: int, places: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The ``n`` edges (``a``, ``b``; checkpointed) whose full shingle sets are similar enough.

    ``places`` names a row for each leader: ``__node, __id, __t``. Each edge asks for two texts, so the texts
    move at most once; while the questions (five words of memory each) are within ``ASKED_BYTES`` they are broadcast and
    the texts do not move before.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")),
                             F.struct(F.col("b").alias("own"), F.col("a").alias("other"))))
    asked = edges.select(ends.alias("__e")).select(F.col("__e.own").alias("__node"), F.col("__e.other").alias("__other"))
    # Two questions an edge, 40 bytes each.
    asked = (broadcast_if_few(asked, n, ASKED_BYTES).join(places, "__node").select("__node", "__other", F.xxhash64("__id", "__t").alias("__h"), F.col("__id").alias("__of")))
    asked = broadcast_if_few(asked, n, ASKED_BYTES)
    own = F.col("__node") < F.col("__other")
    # One number is the key, which keeps a broadcast small; the id is compared beside it.
    rows = _rows(docs, doc_id, text).withColumn("__h", F.xxhash64("__id", "__t"))
    pairs = (rows.join(asked, (rows["__h"] == asked["__h"]) & rows["__id"].between(asked["__of"], asked["__of"]))
             .groupBy(F.least("__node", "__other").alias("a"), F.greatest("__node", "__other").alias("b"))
             .agg(F.max(F.when(own, F.col("__text"))).alias("__ta"), F.max(F.when(~own, F.col("__text"))).alias("__tb")))
    return pairs.select("a", "b", "__ta", "__tb").mapInArrow(_confirm(size, percent), "a long, b long")


def _fits(percent: int):
    """Sets whose sizes alone allow the similarity."""
    return 100 * F.least("__n", "__cn") >= percent * F.greatest("__n", "__cn")


def linked_leaders(docs: DataFrame, sets: DataFrame, places: DataFrame, buckets: DataFrame, doc_id: str, text: str, size: int,
                   percent: int) -> DataFrame:
    """``(node, label)`` of the leaders that have a link.

    ``places``: ``__node, __id, __t`` of the leaders; ``buckets``: ``__id`` (their node), ``__n, __band, __key``; ``sets``: signatures."""
    def confirm(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
        return counted(confirmed(docs, edges, n, places, doc_id, text, size, percent))

    # One shuffle for the centres and for their members: both read the same columns of it.
    rows = buckets.repartition("__key")
    centres = (rows.groupBy("__key").agg(F.min(F.struct("__id", "__n", "__band")).alias("__c"), F.count("*").alias("__m"))
               .filter("__m > 1").select("__key", F.col("__c.__id").alias("__centre"), F.col("__c.__n").alias("__cn"), "__m"))
    members = checkpointed(rows.join(centres, "__key"))
    edges, n = counted(members.filter("__id != __centre").filter(_fits(percent))
                       .select(F.col("__centre").alias("a"), F.col("__id").alias("b")).distinct())
    links, n = confirm(edges, n)
    labels, nodes = components(links), 2 * n

    open_, n = _open_buckets(members.filter("__m > 2"), labels, nodes)
    if not n:
        return labels
    seconds = checkpointed(_second_centres(open_))
    second = (seconds.join(open_.drop("__cn", "__centre"), "__key")
              .filter("__label != __clabel").filter(_fits(percent))
              .select(F.least("__id", "__second").alias("a"), F.greatest("__id", "__second").alias("b")).distinct())
    links, n = confirm(*counted(second.join(edges, ["a", "b"], "left_anti")))
    labels, nodes = joined(labels, links, nodes, n), nodes + 2 * n

    # The two stars tried their centres against all that they could join; what is left is among the other members.
    others = (open_.join(seconds.select("__key", "__second"), "__key").filter("__id != __centre AND __id != __second")
              .select("__key", "__band", "__id", "__n"))
    open_, n = _open_buckets(others, labels, nodes)
    if not n:
        return labels
    held = checkpointed(_held(open_, n, sets, places))
    rest, n = counted(_block_pairs(open_, held, percent))
    right, n = confirm(rest.select("a", "b"), n)
    if not rest.filter("sure").join(broadcast_if_few(right, n), ["a", "b"], "left_anti").isEmpty():
        # Equal halves of different hashes: a pair left out for a false one may be a link.
        rest, n = counted(_block_pairs(open_, held, percent, settle=False))
        right, n = confirm(rest.select("a", "b"), n)
    return joined(labels, right, nodes, n)


def _open_buckets(members: DataFrame, labels: DataFrame, nodes: int) -> tuple[DataFrame, int]:
    """Members (with ``__label``) of the buckets that hold several components, and their number.

    ``__all`` is the bucket's size, ``__top`` its largest component and ``__most`` that one's size."""
    labels = broadcast_if_few(labels, nodes)
    labelled = (members.join(labels, members["__id"] == labels["node"], "left")
                .withColumn("__label", F.coalesce("label", "__id")).drop("node", "label").repartition("__key"))
    several = (labelled.groupBy("__key", "__label").agg(F.count("*").alias("__k")).groupBy("__key")
               .agg(F.count("*").alias("__labels"), F.sum("__k").alias("__all"), F.max(F.struct("__k", "__label")).alias("__t"))
               .filter("__labels > 1").select("__key", "__all", F.col("__t.__label").alias("__top"), F.col("__t.__k").alias("__most")))
    return counted(labelled.join(several, "__key"))


def _second_centres(open_: DataFrame) -> DataFrame:
    """Per bucket a member of its largest component that was not its centre."""
    pick = F.min(F.struct(F.xxhash64("__id", "__key").alias("h"), "__id", "__n", "__label")).alias("__c")
    return (open_.filter("__id != __centre").groupBy("__key", "__label").agg(F.count("*").alias("__k"), pick)
            .groupBy("__key").agg(F.max_by("__c", F.struct("__k", "__label")).alias("__c"))
            .select("__key", F.col("__c.__id").alias("__second"), F.col("__c.__n").alias("__cn"),
                    F.col("__c.__label").alias("__clabel")))


def _held(open_: DataFrame, n: int, sets: DataFrame, places: DataFrame) -> DataFrame:
    """``__id`` (a node), ``__bands, __low`` of the ``n`` members of open buckets; broadcasts end at ``ASKED_BYTES``."""
    nodes = open_.select(F.col("__id").alias("__node")).distinct()
    asked, n = counted(broadcast_if_few(nodes, n, ASKED_BYTES).join(places, "__node"))
    return (sets.join(broadcast_if_few(asked, n, ASKED_BYTES), ["__id", "__t"])
            .groupBy("__node").agg(F.first("__bands").alias("__bands"), F.first("__low").alias("__low"))
            .withColumnRenamed("__node", "__id"))


def _block_pairs(open_: DataFrame, held: DataFrame, percent: int, settle: bool = True) -> DataFrame:
    """Pairs ``a < b`` of open buckets, from different components, whose smallest hashes look similar.

    The largest component of a bucket of several blocks has blocks of its own, which are compared with
    the blocks of the rest and not with each other.
    ``sure``: the hashes hold both sets whole. ``settle`` leaves out pairs that sure ones connect already."""
    large, top = F.col("__all") > BLOCK, F.col("__label") == F.col("__top")
    tops = F.when(large, F.ceil(F.col("__most") / BLOCK)).otherwise(0).cast("int")  # blocks of the largest component, numbered first
    rests = F.when(large, F.ceil((F.col("__all") - F.col("__most")) / BLOCK)).otherwise(1).cast("int")
    rows = (open_.withColumns({"__tops": tops, "__rests": rests, "__first": large & top})
            .withColumn("__block", F.when(F.col("__first"), F.pmod(F.xxhash64("__id"), "__tops"))
                        .otherwise(F.col("__tops") + F.pmod(F.xxhash64("__id"), "__rests")).cast("int"))
            .select("__key", "__band", "__id", "__label", "__n", "__block", F.when(F.col("__first"), F.col("__tops")).otherwise(0).alias("__from"),
                    (F.col("__tops") + F.col("__rests") - 1).alias("__to"))
            .join(held, "__id")
            .withColumn("__other", F.explode(F.sequence("__from", "__to")))
            .groupBy("__key", "__band", F.least("__block", "__other").alias("__i"), F.greatest("__block", "__other").alias("__j"))
            .agg(F.collect_list(F.struct("__id", "__label", "__n", "__block", "__bands", "__low")).alias("__rows")))
    return rows.select("__band", "__i", "__j", "__rows").mapInArrow(
        _compare(percent, settle), "a long, b long, sure boolean").distinct()  # ``sure`` depends on the pair alone


def _compare(percent: int, settle: bool):
    asked = percent / 100
    floor = asked - SPREAD * (asked * (1 - asked) / BOTTOM) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, held = [], [], []
            for row in range(batch.num_rows):
                group = batch.column(3)[row].values
                ids, labels, sizes, block = (group.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                if len(ids) < 2:
                    continue
                bands = group.field(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                ends = np.cumsum([0, *(len(x) for x in group.field(5))])
                low = group.field(5).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                x, y = np.triu_indices(len(ids), 1)  # of one pair of blocks
                ask = (labels[x] != labels[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
                if batch.column(1)[row].as_py() != batch.column(2)[row].as_py():
                    ask &= block[x] != block[y]
                x, y = x[ask], y[ask]
                here = batch.column(0)[row].as_py()
                first = np.concatenate([np.empty(0, bool)] + [
                    (bands[x[k:k + PAIRS_AT_ONCE]] == bands[y[k:k + PAIRS_AT_ONCE]]).argmax(axis=1) == here
                    for k in range(0, len(x), PAIRS_AT_ONCE)])
                x, y = x[first], y[first]
                both, union = overlaps(low, ends, sizes, x, y)
                whole = (sizes[x] <= BOTTOM) & (sizes[y] <= BOTTOM)
                # Hashes of one set that agree in their kept half count once; they may hide as many common shingles.
                twice = np.concatenate([[0], np.cumsum(np.diff(low.astype(np.int64), prepend=-1) == 0)])
                hidden = twice[ends[1:]] - twice[np.minimum(ends[:-1] + 1, ends[1:])]
                hidden = hidden[x] + hidden[y]
                near = np.flatnonzero(np.where(whole, 100 * (both + hidden) >= percent * (union - hidden), both >= floor * union) & (both > 0))
                whole = whole & (hidden == 0)
                if settle:
                    near = near[_joining(labels[x[near]], labels[y[near]], whole[near])]
                held.append(whole[near])
                left.append(np.minimum(ids[x[near]], ids[y[near]]))
                right.append(np.maximum(ids[x[near]], ids[y[near]]))
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *left])), pa.array(np.concatenate([none, *right])),
                                              pa.array(np.concatenate([np.empty(0, bool), *held]))], ["a", "b", "sure"])
    return run


def _joining(a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> list[int]:
    """Of sure links between components those that join two not yet joined; all that are not sure."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    keep = []
    for k in range(len(a)):
        if sure[k]:
            p, q = find(int(a[k])), find(int(b[k]))
            if p == q:
                continue
            root[p] = q
        keep.append(k)
    return keep


def overlaps(low: np.ndarray, ends: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of sets x and y among their smallest hashes (concatenated in ``low``).

    They count up to the smaller of the two largest kept hashes, where both
    sets are known whole; a set no larger than ``BOTTOM`` is known whole
    throughout, so the sizes of two such sets are exact.
    """
    if not len(x):
        return np.empty(0), np.empty(0)
    n = len(ends) - 1
    names, at = np.unique(low, return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(ends))
    common = np.zeros((n, n), np.float32)
    for k in range(0, len(names), HASHES_AT_ONCE):
        part = (at >= k) & (at < k + HASHES_AT_ONCE)
        held = np.zeros((n, min(HASHES_AT_ONCE, len(names) - k)), np.float32)
        held[owner[part], at[part] - k] = 1
        common += held @ held.T
    both = common[x, y]
    top = np.array([np.inf if sizes[k] <= BOTTOM else float(low[ends[k + 1] - 1]) for k in range(n)])
    below = np.stack([np.searchsorted(low[ends[k]:ends[k + 1]], top, side="right") for k in range(n)])  # of set k, up to each top
    nx = np.where(top[y] < top[x], below[x, y], np.diff(ends)[x])
    ny = np.where(top[x] < top[y], below[y, x], np.diff(ends)[y])
    return both, nx + ny - both


def _classed(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``__id, __t, __n`` of every row, its ``__component`` and whether it is ``__kept``."""
    sets = checkpointed(signatures(docs, doc_id, text, size, bands, rows))
    known = sets.filter("__n > 0 AND __id IS NOT NULL")
    # Numbers in the order of the ids, so that the smallest number of a component has its smallest id, and the
    # first of a group, often its original, is the centre of its buckets.
    first = known.groupBy("__d1", "__d2").agg(F.min(F.struct("__id", "__t")).alias("__lead")).select("__d1", "__d2", "__lead.*")
    numbers = checkpointed(first.orderBy("__id", "__d1", "__d2").withColumn("__node", F.monotonically_increasing_id()))
    # The smallest hashes stay in ``sets`` until step 5 asks for those of a few leaders.
    buckets = (known.groupBy("__d1", "__d2").agg(F.first("__n").alias("__n"), F.first("__bands").alias("__bands"))
               .join(numbers, ["__d1", "__d2"])
               .select(F.col("__node").alias("__id"), "__n", F.posexplode("__bands").alias("__band", "__key")))
    labels = linked_leaders(docs, known, numbers.select("__node", "__id", "__t"), buckets, doc_id, text, size, percent)
    linked = (labels.join(numbers.select(F.col("__node").alias("label"), F.col("__id").alias("__component")), "label")
              .select(F.col("node").alias("__node"), "__component"))
    classes = (numbers.select("__d1", "__d2", "__node", F.col("__id").alias("__own")).join(linked, "__node", "left")
               .select("__d1", "__d2", F.coalesce("__component", "__own").alias("__component")))
    component = F.when(F.col("__id").isNotNull(), F.coalesce("__component", "__id"))
    return (sets.drop("__bands", "__low").join(classes, ["__d1", "__d2"], "left")
            .select("__id", "__t", "__n", component.alias("__component"))
            .withColumn("__kept", F.coalesce(F.col("__id") == F.col("__component"), F.lit(True))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    return _classed(docs, doc_id, text, size, percent, bands, rows).select(
        F.col("__id").alias(doc_id), F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"),
        F.col("__kept").alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                 percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` without the rows that are not the first of their group."""
    drop = (_classed(docs, doc_id, text, size, percent, bands, rows).filter("NOT __kept")
            .select(F.col("__id").alias("__drop"), F.col("__t").alias("__of")).distinct())
    drop = broadcast_if_small(checkpointed(drop))
    return docs.join(drop, (docs[doc_id].cast("long") == drop["__drop"])
                     & (F.xxhash64(docs[text].cast("string")) == drop["__of"]), "left_anti")
