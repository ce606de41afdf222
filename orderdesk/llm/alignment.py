r"""Cross-tokenizer alignment by an associative monoid of fragments.

A text, with a space before it, is cut into tokens by two tokenizers: A, a
byte-level BPE file, and B, a piece model. Byte offsets where tokens of both
end cut the tokens into groups; tokens of A and B in one group are linked.

A text is read in byte ranges. The tokens that end in a range make a fragment:
an open prefix (the tokens up to the first common end; the text's start is one),
closed groups, and an open suffix (the tokens behind the last common end), or
only a prefix if no end is common. Two neighbouring fragments compose (``composed``): suffix and
prefix between them become one group. Composition is associative, so the
fragments of a long text, made in different tasks, are reduced as a tree of
``FAN`` children by Spark; a text of one range is done where it is read.

A range is tokenized together with the text up to the nearest safe cuts
around it. At a safe cut no token of the whole text can cross (``safe``), so
the tokens are those of the whole text, whatever the ranges are. A stretch
without any safe cut is read as one piece.

Pairs of linked ids are counted by document. Documents are held in blocks with
a dictionary of their pairs; only the dictionaries are shuffled to the counts
and back, so a pair found in every document is one row per block, and no
document's links are spread out as rows. The highest count per id of A has a
row per id of a vocabulary at most and is broadcast.

Defined results: a null or empty text, or one whose tokens' joined bytes
differ from the space and the text in A or B, has no tokens: counts 0, groups
''. Repeated rows are documents of their own; a null id stays null. An empty
table gives an empty table. Only the id and the text are read; other columns
may have any name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

TOKENIZERS = "/opt/tokenizers"
# Characters of a range.
RANGE = 1 << 15
# Fragments composed in one task of the tree.
FAN = 16
# Distinct pairs (summed over its documents) and documents that end a block.
BLOCK_PAIRS, BLOCK_DOCS = 2_000_000, 20_000

# Fixed value: how the byte-level tokenizer cuts a text before it merges bytes.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """One tokenizer in a task: ``encode`` cuts raw text (no space added; also given in UTF-8) into ids, or gives None
    if their bytes are not the text's."""

    encode: Callable[[str, bytes], np.ndarray | None]
    token_bytes: list[bytes]
    meets: Callable[[str, str], bool]  # whether a token may hold the two characters next to each other
    lengths: np.ndarray = field(init=False)
    digits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.digits = np.array([str(k) for k in range(len(self.token_bytes))], "S").view(np.uint8).reshape(len(self.token_bytes), -1)


def merges_alone(file: bytes) -> bool:
    """Whether the file's merges may be applied by rank of the merged token.

    So if ids ascend with the merges and every token's own bytes merge back to it: then a token
    can only ever come about by its own merge, and the next merge is that of the lowest id."""
    from tokenizers import Tokenizer

    spec = json.loads(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    if (spec["normalizer"], model["type"], cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != (
            None, "BPE", "ByteLevel", True, False) or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    vocab, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    rule = Tokenizer.from_str(file.decode()).model
    return made == sorted(made) and made[0] >= 0 and set(_byte_letters()) <= set(vocab) and all(
        t in added or len(rule.tokenize(t)) == 1 for t in vocab)


def byte_level(file: bytes, by_rank: bool) -> Vocabulary:
    """A byte-level BPE file of the library ``tokenizers``; special tokens inside texts are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(file)
    letters, added = _byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    raw = {t: bytes(map(letters.__getitem__, t)) for t in spec["model"]["vocab"] if t not in added}
    vocab = {raw[t]: k for t, k in spec["model"]["vocab"].items() if t not in added}
    names = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for b, k in vocab.items():
        names[k] = b
    for t, k in added.items():
        names[k] = t.encode()
    near = np.zeros((256, 256), bool)
    for b in vocab:
        if len(b) > 1:
            x = np.frombuffer(b, np.uint8)
            near[x[:-1], x[1:]] = True
    if by_rank:
        fast = tiktoken.Encoding("a", pat_str=PRETOKENS, mergeable_ranks=vocab, special_tokens={})

        def encode(text: str, raw: bytes) -> np.ndarray | None:
            # Merges of bytes under a whole alphabet: the tokens' bytes are the text's.
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    else:
        whole = Tokenizer.from_str(file.decode())
        whole.encode_special_tokens = True

        def encode(text: str, raw: bytes) -> np.ndarray | None:
            ids = whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, np.int64) if b"".join(map(names.__getitem__, ids)) == raw else None

    return Vocabulary(encode, names, lambda x, y: bool(near[x.encode()[-1], y.encode()[0]]))


def pieces(file: bytes) -> Vocabulary:
    """A piece model of the library ``sentencepiece``, without the space it adds to a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    names, near = [], set()
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            names.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k):
            names.append(b"")
        else:
            names.append(piece.replace("▁", " ").encode())
            near.update(zip(piece, piece[1:], strict=False))
    # A line feed before the text takes the added space; it must be tokens of its own.
    lead = model.encode("\n")
    if any("\n" in pair for pair in near) or not 1 <= len(lead) <= 2:
        raise ValueError("the piece model joins line feeds with other characters")

    def encode(text: str, raw: bytes) -> np.ndarray | None:
        ids = model.encode("\n" + text)[len(lead):]
        return np.array(ids, np.int64) if b"".join(map(names.__getitem__, ids)) == raw else None

    return Vocabulary(encode, names, lambda x, y: (x.replace(" ", "▁"), y.replace(" ", "▁")) in near)


@dataclass
class Pair:
    a: Vocabulary
    b: Vocabulary

    def safe(self, s: str, p: int) -> bool:
        """Whether no token of the whole text ``s`` can cross from character p - 1 to p.

        B: no piece holds the two next to each other, so no merge joins them. A: either white space begins
        after something else, where every text is cut before bytes are merged, or no token holds the two
        bytes next to each other (away from apostrophes, where the cut depends on what follows)."""
        if p <= 0 or p >= len(s):
            return True
        x, y = s[p - 1], s[p]
        if x.isspace() or self.b.meets(x, y):
            return False
        return y in " \n\t\r" or ("'" not in s[max(0, p - 2):p + 1] and not y.isspace() and not self.a.meets(x, y))


@dataclass
class Window:
    """A range of a text with the text around it that its tokens need; offsets are bytes of the whole text."""

    lo: int
    hi: int
    start: int
    text: str


def windows(s: str, pair: Pair, size: int = 0) -> list[Window]:
    """``s`` in ranges of about ``size`` characters, each with the text between the safe cuts around it.

    A range ends only where the next one begins behind the last one's safe cut, so no text is read
    more than twice."""
    size = size or RANGE
    edges, cuts = [0], [(0, 0)]
    for edge in range(size, len(s), size):
        if edge <= cuts[-1][1]:
            continue
        after = edge
        while not pair.safe(s, after):
            after += 1
        if after == len(s):
            break
        before = edge
        while not pair.safe(s, before):
            before -= 1
        edges.append(edge)
        cuts.append((before, after))
    edges.append(len(s))
    cuts.append((len(s), len(s)))
    out, lo, start, at = [], 0, 0, 0
    for k in range(len(edges) - 1):
        hi = lo + len(s[edges[k]:edges[k + 1]].encode())
        start += len(s[at:cuts[k][0]].encode())
        at = cuts[k][0]
        out.append(Window(lo, hi, start, s[cuts[k][0]:cuts[k + 1][1]]))
        lo = hi
    return out


@dataclass
class Fragment:
    """Tokens of a byte range. ``cut``: whether a common end lies in it; without one all tokens stand in the prefix."""

    right: bool  # whether both tokenizers give the text's bytes
    cut: bool
    pre_a: np.ndarray
    pre_b: np.ndarray
    groups: bytes  # closed groups, joined by ;
    n_groups: int
    n_links: int
    n_a: int
    n_b: int
    keys: np.ndarray  # distinct linked pairs, a << 32 | b, ascending
    times: np.ndarray  # links of each
    post_a: np.ndarray
    post_b: np.ndarray


_NONE = np.empty(0, np.int64)
_WRONG = Fragment(False, False, _NONE, _NONE, b"", 0, 0, 0, 0, _NONE, _NONE, _NONE, _NONE)


def _links(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n: int) -> np.ndarray:
    """All pairs of groups 0..n-1; ``in_a`` and ``in_b`` name the group of each token, ascending."""
    of_b = np.bincount(in_b, minlength=n)
    first = np.cumsum(of_b) - of_b
    times = of_b[in_a]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(a << 32, times) | b[np.repeat(first[in_a], times) + within]


def _counted(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(links, return_counts=True)


def _written(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n: int, pair: Pair) -> bytes:
    """The groups as text: ids of A, a bar, ids of B, groups joined by semicolons."""
    width = max(pair.a.digits.shape[1], pair.b.digits.shape[1])
    cells = np.zeros((len(a) + len(b), width + 1), np.uint8)
    at_a = np.arange(len(a)) + np.searchsorted(in_b, in_a, "left")
    at_b = np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")
    cells[at_a, :pair.a.digits.shape[1]] = pair.a.digits[a]
    cells[at_b, :pair.b.digits.shape[1]] = pair.b.digits[b]
    cells[:, width] = ord(",")
    cells[at_a[np.searchsorted(in_a, np.arange(n), "right") - 1], width] = ord("|")
    cells[at_b[np.searchsorted(in_b, np.arange(n), "right") - 1], width] = ord(";")
    return cells.tobytes().translate(None, b"\0")[:-1]


def fragment(window: Window, pair: Pair) -> Fragment:
    """The tokens that end in the window's range."""
    raw = window.text.encode()
    a, b = pair.a.encode(window.text, raw), pair.b.encode(window.text, raw)
    if a is None or b is None:
        return _WRONG
    ends = []
    for ids, vocabulary in ((a, pair.a), (b, pair.b)):
        end = window.start + np.cumsum(vocabulary.lengths[ids])
        mine = slice(np.searchsorted(end, window.lo, "right"), np.searchsorted(end, window.hi, "right"))
        ends.append((ids[mine], end[mine]))
    (a, end_a), (b, end_b) = ends
    at = np.searchsorted(end_b, end_a)
    common = end_a[end_b[np.minimum(at, len(end_b) - 1)] == end_a] if len(end_b) else _NONE
    if window.lo == 0:  # the start of the text is a common end
        common = np.concatenate([[0], common])
    if not len(common):
        return Fragment(True, False, a, b, b"", 0, 0, len(a), len(b), _NONE, _NONE, _NONE, _NONE)
    in_a, in_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    n = len(common)
    from_a, from_b = np.searchsorted(in_a, [1, n]), np.searchsorted(in_b, [1, n])
    inner_a, inner_b = slice(*from_a), slice(*from_b)
    links = _links(a[inner_a], b[inner_b], in_a[inner_a] - 1, in_b[inner_b] - 1, n - 1)
    keys, times = _counted(links)
    groups = _written(a[inner_a], b[inner_b], in_a[inner_a] - 1, in_b[inner_b] - 1, n - 1, pair) if n > 1 else b""
    return Fragment(True, True, a[:from_a[0]], b[:from_b[0]], groups, n - 1, len(links), len(a), len(b), keys, times,
                    a[from_a[1]:], b[from_b[1]:])


def _group(a: np.ndarray, b: np.ndarray) -> bytes:
    return (",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist()))).encode()


def composed(parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments as one. Associative; the same whatever the brackets."""
    if not all(f.right for f in parts):
        return _WRONG
    pre: list[tuple[np.ndarray, np.ndarray]] = []
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    groups, links, n_groups, n_links, cut = [], [], 0, 0, False
    for f in parts:
        open_.append((f.pre_a, f.pre_b))
        if not f.cut:
            continue
        if cut:
            a, b = (np.concatenate(x) for x in zip(*open_, strict=True))
            groups.append(_group(a, b))
            n_groups, n_links = n_groups + 1, n_links + len(a) * len(b)
            links.append(_counted((np.repeat(a, len(b)) << 32) | np.tile(b, len(a))))
        else:
            pre, cut = open_, True
        if f.n_groups:
            groups.append(f.groups)
            links.append((f.keys, f.times))
        n_groups, n_links = n_groups + f.n_groups, n_links + f.n_links
        open_ = [(f.post_a, f.post_b)]
    if not cut:
        pre, open_ = open_, []

    def joined(tokens: list[tuple[np.ndarray, np.ndarray]], side: int) -> np.ndarray:
        return np.concatenate([t[side] for t in tokens]) if tokens else _NONE

    keys, at = np.unique(np.concatenate([_NONE, *(k for k, _ in links)]), return_inverse=True)
    times = np.bincount(at, np.concatenate([_NONE, *(t for _, t in links)]), len(keys)).astype(np.int64)
    return Fragment(True, cut, joined(pre, 0), joined(pre, 1), b";".join(groups), n_groups, n_links, sum(f.n_a for f in parts),
                    sum(f.n_b for f in parts), keys, times, joined(open_, 0), joined(open_, 1))


def closed(f: Fragment) -> Fragment:
    """The fragment of a whole text; without any tokens if they do not give the text."""
    if not f.right or len(f.post_a) or len(f.post_b):
        return Fragment(True, True, _NONE, _NONE, b"", 0, 0, 0, 0, _NONE, _NONE, _NONE, _NONE)
    return f


_FRAGMENT = [("__right", "boolean"), ("__cut", "boolean"), ("__pre_a", "binary"), ("__pre_b", "binary"), ("__groups", "binary"),
             ("__n_groups", "long"), ("__n_links", "long"), ("__n_a", "long"), ("__n_b", "long"), ("__keys", "binary"),
             ("__times", "binary"), ("__post_a", "binary"), ("__post_b", "binary")]


def _packed(f: Fragment) -> tuple[Any, ...]:
    return tuple(x.astype("<i8").tobytes() if isinstance(x, np.ndarray) else x for x in vars(f).values())


def _unpacked(values: tuple[Any, ...]) -> Fragment:
    return Fragment(*(np.frombuffer(v, "<i8") if kind == "binary" and name != "__groups" else v
                      for v, (name, kind) in zip(values, _FRAGMENT, strict=True)))


def _held(spark: SparkSession, a_file: str, b_file: str) -> Broadcast:
    """The two tokenizer files, for the tasks. Files of a vocabulary are small and do not grow with the data."""
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        files = {"a": a.read(), "b": b.read()}
    return spark.sparkContext.broadcast(files | {"by_rank": merges_alone(files["a"])})


def _pair(held: dict[str, Any]) -> Pair:
    """The tokenizers, built once per Python worker."""
    if "pair" not in held:
        held["pair"] = Pair(byte_level(held["a"], held["by_rank"]), pieces(held["b"]))
    return held["pair"]


# Kinds of stored rows: a document, a window of a longer one, and the dictionary of a block.
_DOC, _WINDOW, _DICTIONARY = 0, 1, 2
_COLUMNS = [("__kind", "int"), ("__id", "long"), ("__key", "string"), ("__k", "int"), ("__lo", "long"), ("__hi", "long"),
            ("__start", "long"), ("__slice", "string"), ("__n_a", "long"), ("__n_b", "long"), ("__n_groups", "long"),
            ("__n_links", "long"), ("__written", "string"), ("__block", "string"), ("__n_pairs", "long"), ("__pairs", "binary")]
_DDL = ", ".join(f"{name} {kind}" for name, kind in _COLUMNS)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[dict[str, Any]], columns: list[tuple[str, str]] = _COLUMNS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], _ARROW[kind]) for name, kind in columns],
                                      [name for name, _ in columns])


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of equal length below 2**32 (or keys) in few bytes."""
    return pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True)


def _whole(n: int, data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [n * np.dtype(kind).itemsize for kind in kinds]
    raw = pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if n else b""
    starts = np.cumsum([0, *sizes[:-1]])
    return [np.frombuffer(raw[s:s + size], kind) for s, size, kind in zip(starts, sizes, kinds, strict=True)]


class _Block:
    """A block under construction: documents refer to pairs by their place in its dictionary."""

    def __init__(self) -> None:
        self.name = uuid.uuid4().hex
        self.keys, self.places, self.docs = _NONE, _NONE, _NONE
        self.n_pairs = self.n_docs = 0

    def add(self, docs: list[tuple[dict[str, Any], Fragment]]) -> Iterator[dict[str, Any]]:
        found = np.concatenate([f.keys for _, f in docs]) if docs else _NONE
        keys, at, counts = np.unique(found, return_inverse=True, return_counts=True)
        fresh = keys[~np.isin(keys, self.keys, assume_unique=True)]
        order = np.argsort(merged := np.concatenate([self.keys, fresh]), kind="stable")
        self.places = np.concatenate([self.places, len(self.keys) + np.arange(len(fresh))])[order]
        self.keys, self.docs = merged[order], np.concatenate([self.docs, np.zeros(len(fresh), np.int64)])
        place = self.places[np.searchsorted(self.keys, keys)]
        self.docs[place] += counts
        ends = np.cumsum([len(f.keys) for _, f in docs])
        for (row, f), end in zip(docs, ends, strict=True):
            mine = place[at[end - len(f.keys):end]]
            by_place = np.argsort(mine)
            steps = np.diff(mine[by_place], prepend=0).astype("<u4")
            yield row | {"__kind": _DOC, "__n_a": f.n_a, "__n_b": f.n_b, "__n_groups": f.n_groups, "__n_links": f.n_links,
                         "__block": self.name, "__n_pairs": len(mine), "__pairs": _squeezed(steps, f.times[by_place].astype("<u4"))}
        self.n_pairs += len(found)
        self.n_docs += len(docs)

    def full(self) -> bool:
        return self.n_pairs >= BLOCK_PAIRS or self.n_docs >= BLOCK_DOCS

    def dictionary(self) -> dict[str, Any]:
        by_place = np.empty_like(self.keys)
        by_place[self.places] = self.keys
        return {"__kind": _DICTIONARY, "__block": self.name, "__n_pairs": len(self.keys),
                "__pairs": _squeezed(by_place, self.docs)}


_Done = tuple[dict[str, Any], Fragment]


def _in_blocks(parts: Iterator[tuple[list[_Done], list[dict[str, Any]]]]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with a dictionary behind each block, and other rows as they come."""
    block = _Block()
    for done, others in parts:
        rows = [*others, *block.add(done)]
        if block.full():
            rows.append(block.dictionary())
            block = _Block()
        for k in range(0, len(rows), 1000):
            yield _batch(rows[k:k + 1000])
    yield _batch([block.dictionary()] if block.n_docs else [])


# Characters of documents that are put into a block at once.
_PART = 1 << 22


def aligned(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model",
            doc_id: str = "doc_id", text: str = "text", written: Callable[[bytes], str] = bytes.decode) -> DataFrame:
    """Stored alignments of whole texts, in blocks; read them with ``scored`` and ``pair_counts``.

    ``written`` makes the stored text of a document's groups (``a1,a2|b1;a3|b2,b3``), the groups themselves by default."""
    spark = docs.sparkSession
    held = _held(spark, a_file, b_file)

    def done(number: int | None, f: Fragment) -> _Done:
        f = closed(f)
        return {"__id": number, "__written": written(f.groups) if f.n_groups else ""}, f

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(held.value)

        def parts() -> Iterator[tuple[list[_Done], list[dict[str, Any]]]]:
            short: list[_Done] = []
            pieces: list[dict[str, Any]] = []
            size = 0
            for batch in batches:
                for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    body = body.as_py()
                    ranges = windows(" " + body if body else "", pair)
                    if len(ranges) == 1:
                        short.append(done(number, fragment(ranges[0], pair)))
                    else:
                        key = uuid.uuid4().hex
                        pieces += [{"__kind": _WINDOW, "__id": number, "__key": key, "__k": k, "__lo": w.lo, "__hi": w.hi,
                                    "__start": w.start, "__slice": w.text} for k, w in enumerate(ranges)]
                    size += len(body or "")
                    if size >= _PART:
                        yield short, pieces
                        short, pieces, size = [], [], 0
            yield short, pieces

        yield from _in_blocks(parts())

    first = stored(docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
                   .mapInArrow(read, _DDL), "__kind")
    rows = first.filter(F.col("__kind") != _WINDOW)
    long_rows = _reduced(first.filter(F.col("__kind") == _WINDOW), held)
    if long_rows is None:
        return rows

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_blocks(([done(r["__id"], _unpacked(tuple(r[name] for name, _ in _FRAGMENT)))], [])
                              for batch in batches for r in batch.to_pylist())

    return rows.unionByName(stored(long_rows.mapInArrow(finish, _DDL), "__kind"))


_ADDRESSED = [("__id", "long"), ("__key", "string"), ("__k", "int"), *_FRAGMENT]


def _reduced(rows: DataFrame, held: Broadcast) -> DataFrame | None:
    """One fragment per long document, from its windows: fragments in all tasks, then a tree of compositions."""
    most = rows.agg(F.max("__k").alias("k")).first()["k"]
    if most is None:
        return None
    ddl = ", ".join(f"{name} {kind}" for name, kind in _ADDRESSED)

    def addressed(rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
        return _batch([dict(zip((name for name, _ in _ADDRESSED), r, strict=True)) for r in rows], _ADDRESSED)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(held.value)
        for batch in batches:
            for r in batch.to_pylist():
                f = fragment(Window(r["__lo"], r["__hi"], r["__start"], r["__slice"]), pair)
                yield addressed([(r["__id"], r["__key"], r["__k"], *_packed(f))])

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["__k"])
        f = composed([_unpacked(tuple(r[name] for name, _ in _FRAGMENT)) for r in rows])
        return pa.Table.from_batches([addressed([(rows[0]["__id"], rows[0]["__key"], rows[0]["__k"] // FAN, *_packed(f))])])

    level = stored(rows.select("__id", "__key", "__k", "__lo", "__hi", "__start", "__slice")
                   .repartition("__key", "__k").mapInArrow(fragments, ddl))
    while most > 0:
        level = stored(level.groupBy("__key", F.floor(F.col("__k") / FAN).alias("__parent")).applyInArrow(compose, ddl))
        most //= FAN
    return level


def _dictionaries(rows: DataFrame) -> DataFrame:
    """One row per block and pair: ``__block, __place, __pair, __docs``."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, data in zip(*(batch.column(c).to_pylist() for c in ("__block", "__n_pairs", "__pairs")), strict=True):
                keys, docs = _whole(n, data, "<i8", "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.string()).take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(n), pa.int64()),
                     pa.array(keys, pa.int64()), pa.array(docs, pa.int64())], ["__block", "__place", "__pair", "__docs"])

    return (rows.filter(F.col("__kind") == _DICTIONARY).select("__block", "__n_pairs", "__pairs")
            .mapInArrow(spread, "__block string, __place long, __pair long, __docs long"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """One row per linked pair of ids: ``a, b, docs`` (documents that hold it linked) and ``best`` (the highest of its a)."""
    counts = _dictionaries(rows).groupBy("__pair").agg(F.sum("__docs").alias("docs")).select(
        F.shiftright("__pair", 32).alias("a"), F.col("__pair").bitwiseAND(0xFFFFFFFF).alias("b"), "docs", "__pair")
    # At most one row per id of the vocabulary of A.
    highest = counts.groupBy(F.col("a").alias("__a")).agg(F.max("docs").alias("__highest"))
    joined = counts.join(F.broadcast(highest), F.col("a") == F.col("__a"))
    return joined.select("a", "b", "docs", (F.col("docs") == F.col("__highest")).alias("best"), "__pair")


_SCORED = [("__id", "long"), ("__n_a", "long"), ("__n_b", "long"), ("__n_groups", "long"), ("__n_links", "long"),
           ("__n_best", "long"), ("__count_sum", "long"), ("__written", "string")]


def scored(rows: DataFrame) -> DataFrame:
    """One row per document: ``__id``, its numbers of tokens, groups and links, ``__n_best`` links whose pair is the most
    frequent of its id of A, ``__count_sum`` over the pairs of its links, and ``__written``."""
    answers = _dictionaries(rows).join(pair_counts(rows).select("__pair", "docs", "best"), "__pair").select(
        F.col("__block").alias("__in"), F.col("__place"), F.col("docs").alias("__count"), F.col("best").alias("__best"))
    docs = rows.filter(F.col("__kind") == _DOC).select(
        "__block", "__id", "__n_a", "__n_b", "__n_groups", "__n_links", "__written", "__n_pairs", "__pairs")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("__place").to_numpy()
        count, best = np.zeros((2, int(place.max(initial=-1)) + 1), np.int64)
        count[place] = right.column("__count").to_numpy()
        best[place] = right.column("__best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for n, data in zip(left.column("__n_pairs").to_pylist(), left.column("__pairs").to_pylist(), strict=True):
            steps, times = _whole(n, data, "<u4", "<u4")
            at, times = np.cumsum(steps.astype(np.int64)), times.astype(np.int64)
            n_best.append(int((times * best[at]).sum()))
            count_sum.append(int((times * count[at]).sum()))
        made = {"__n_best": pa.array(n_best, pa.int64()), "__count_sum": pa.array(count_sum, pa.int64())}
        return pa.table({name: made[name] if name in made else left.column(name) for name, _ in _SCORED})

    return docs.groupBy("__block").cogroup(answers.groupBy("__in")).applyInArrow(
        look_up, ", ".join(f"{name} {kind}" for name, kind in _SCORED))
