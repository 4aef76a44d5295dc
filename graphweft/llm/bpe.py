"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point gets a class, classes and their neighbours give a
symbol, and each symbol is a function from the state before a code point to the state after it. Composition of such
functions is associative: texts are cut in equal chunks, the chunks' functions are computed side by side, a doubling
scan composes them, and a second pass over all chunks at once, each now with its known first state, marks the code
points at which a token starts. Equal slices between the marks are found by hashes and checked code point by code
point; byte pair merging behind a bounded cache sees each different one once. Ids come with the byte at which each of
them starts; decoding puts the ids' bytes at these offsets.

Defined results: a null text is an empty text; an empty text has no ids. Rows are handled one by one, so repeated
rows and repeated doc_ids give repeated results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import slices
from graphweft.llm.words import mix, powers_for

# Symbols: what a code point is, with what the text goes on.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_ON, BLANK_LAST, SPACE_LAST = range(8)
# States after a code point: in a token of letters, numbers or others, in white space, after a blank that joins
# what follows, with one or two letters of a contraction to come, or at the end of a token.
END, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, JOINING, ONE_MORE, TWO_MORE = range(8)
#: Added to the symbol of a text's first code point, whose state before it is END whatever came in.
FIRST = 8
CHUNK = 256
#: Pieces up to this many bytes are merged side by side, longer ones with a heap each.
SHORT = 64
CACHE_ENTRIES = 250_000
#: Texts are encoded in slices of about this many characters, new pieces merged so many at a time: bounds of memory.
SLICE, MERGED = 1 << 19, 16_384
#: White_Space of Unicode; str.isspace() has four control characters more.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE_ON or OTHER for each code point.

    Versions of Unicode differ in what is a letter, so the encoding library is asked which code points it takes for
    letters and numbers.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype(np.uint32)
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = SPACE_ON
    return table


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by symbol * 8 + state."""
    after, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for state in range(8):
        after[LETTER, state] = {TWO_MORE: ONE_MORE, ONE_MORE: END}.get(state, IN_LETTERS)
        after[NUMBER, state], after[OTHER, state] = IN_NUMBERS, IN_OTHERS
        after[QUOTE1, state], after[QUOTE2, state] = (IN_OTHERS, IN_OTHERS) if state in (IN_OTHERS, JOINING) else (ONE_MORE, TWO_MORE)
        after[SPACE_ON, state], after[BLANK_LAST, state], after[SPACE_LAST, state] = IN_SPACE, JOINING, END
    for symbol, states in ((LETTER, (IN_LETTERS, JOINING, ONE_MORE, TWO_MORE)), (NUMBER, (IN_NUMBERS, JOINING)), (OTHER, (IN_OTHERS, JOINING)), (QUOTE1, (IN_OTHERS, JOINING)), (QUOTE2, (IN_OTHERS, JOINING)), (SPACE_ON, (IN_SPACE,))):
        starts[symbol, list(states)] = False
    after[FIRST:] = after[:FIRST, [END]]
    return after.reshape(-1), starts.reshape(-1)


def symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """codes: the code points of all texts, one after another; first: where each text starts."""
    kind = code_point_classes()[codes]
    opens = np.zeros(len(codes) + 3, bool)
    opens[first] = True
    opens[len(codes) :] = True
    after = np.pad(codes, (0, 3))
    inside1 = ~opens[1 : len(codes) + 1]
    inside2 = inside1 & ~opens[2 : len(codes) + 2]
    next1, next2 = after[1 : len(codes) + 1], after[2 : len(codes) + 2]
    out = kind.copy()
    quote = codes == ord("'")
    if quote.any():
        one = quote & inside1 & np.isin(next1, [ord(c) for c in "stmd"])
        two = np.zeros_like(quote)
        for a, b in ("re", "ve", "ll"):
            two |= (next1 == ord(a)) & (next2 == ord(b))
        out[one] = QUOTE1
        out[quote & inside2 & two] = QUOTE2
    last = (kind == SPACE_ON) & inside1
    last[:-1] &= kind[1:] != SPACE_ON
    out[last] = np.where(codes[last] == 0x20, BLANK_LAST, SPACE_LAST)
    out[first] += FIRST
    return out


def token_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which tokens start."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    after, starts = transitions()
    chunks = -(-n // CHUNK)
    syms = np.zeros(chunks * CHUNK, np.uint8)
    syms[:n] = symbols(codes, first)
    syms = np.ascontiguousarray(syms.reshape(chunks, CHUNK).T) * np.uint8(8)
    whole = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for row in syms:  # the function of each chunk, all chunks side by side
        whole = after[row[:, None] + whole]
    step = 1
    while step < chunks:  # inclusive scan: whole[i] becomes the function of chunks 0 to i
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].copy(), 1)
        step *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = whole[:-1, END]
    marks = np.empty((CHUNK, chunks), bool)
    for j, row in enumerate(syms):
        at = row + state
        marks[j] = starts[at]
        state = after[at]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which two ids give which third, as sorted keys first << 20 | second and values."""
    pairs = {ranks[t[:i]] << 20 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
    order = np.argsort(keys)
    return keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, ...]]:
    """Ids of short pieces, side by side: in each round every piece merges its pair of lowest rank, the leftmost of equals."""
    keys, values = table
    none = np.int32((1 << 31) - 1)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    out: list[tuple[int, ...]] = [()] * len(pieces)

    def lookup(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((b >= 0) & (a >= 0) & (keys[at] == key), values[at], none)

    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for low, high in pairwise((0, 4, 6, 8, 10, 12, 16, 24, SHORT)):
        row = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(row):
            continue
        raw = np.frombuffer(b"".join(pieces[i].ljust(high, b"\0") for i in row), np.uint8).reshape(-1, high)
        ids = np.where(np.arange(high) < lengths[row, None], single[raw], np.int32(-1))
        ids = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)
        found = lookup(ids[:, :-1], ids[:, 1:])
        columns = np.arange(high + 1)
        while len(row):
            at = found.argmin(1)
            least = found[np.arange(len(row)), at]
            if (done := least == none).any():
                for i, x in zip(row[done].tolist(), ids[done].tolist()):
                    out[i] = tuple(x[: x.index(-1)])
                row, ids, found, at, least = row[~done], ids[~done], found[~done], at[~done], least[~done]
                if not len(row):
                    break
            lines = np.arange(len(row))
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > at[:, None]), high), 1)
            ids[lines, at] = least
            found = np.take_along_axis(found, np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), high - 1), 1)
            found[:, -1] = none
            found[lines, at] = lookup(least, ids[lines, at + 1])
            before = lines[at > 0]
            found[before, at[before] - 1] = lookup(ids[before, at[before] - 1], least[before])
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(piece)
    ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and right[i] < n and (r := ranks.get(piece[i : ends[right[i]]])) is not None:
            heapq.heappush(heap, (r, i, ends[right[i]]))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or ends[right[i]] != end:
            continue
        gone = right[i]
        alive[gone], ends[i], right[i] = 0, end, right[gone]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        offer(left[i])
    return tuple(ranks[piece[i : ends[i]]] for i in range(n) if alive[i])


class Pieces(dict):
    """Ids by piece; emptied when full."""

    def __init__(self, ranks: dict[bytes, int], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.ranks, self.entries, self.table = ranks, entries, pair_table(ranks)

    def learn(self, pieces: set[str]) -> None:
        """Makes room for and merges those pieces that aren't there."""
        missing = pieces.difference(self)
        if len(self) + len(missing) > self.entries:
            self.clear()
            missing = pieces
        short, new = [], []
        for piece in missing:
            raw = piece.encode("utf-8")
            if raw in self.ranks:
                self[piece] = (self.ranks[raw],)
            elif len(raw) > SHORT:
                self[piece] = _merge_long(raw, self.ranks)
            else:
                short.append(piece)
                new.append(raw)
        for i in range(0, len(new), MERGED):
            self.update(zip(short[i : i + MERGED], merge_many(new[i : i + MERGED], self.ranks, self.table)))


def distinct_pieces(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pieces that differ among those that begin at ``start``, and which of them each piece is."""
    end = np.append(start[1:], len(codes))
    forth, back = powers_for(0x2545F4914F6CDD1D, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * forth[: len(codes)], out=sums[1:])
    _, first, which = np.unique((sums[end] - sums[start]) * back[start], return_index=True, return_inverse=True)
    size, twin = end - start, first[which]
    if (size == size[twin]).all() and (codes == codes[np.repeat(start[twin] - start, size) + np.arange(len(codes))]).all():
        return first, which
    seen: dict[bytes, int] = {}  # two pieces with one hash: they are told apart one by one
    which = np.array([seen.setdefault(codes[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist())])
    return np.unique(which, return_index=True)[1], which


def encode_texts(texts: list[str], cache: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where each text's ids end."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    first = np.unique(np.concatenate(([0], ends))[:-1])
    start = token_starts(codes, first[first < len(codes)])
    places, which = distinct_pieces(codes, start)
    end = np.append(start[1:], len(codes))
    pieces = [whole[a:b] for a, b in zip(start[places].tolist(), end[places].tolist())]
    cache.learn(set(pieces))
    found = list(map(cache.__getitem__, pieces))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
    counts = sizes[which]
    after = np.cumsum(counts)
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (after - counts), counts) + np.arange(after[-1])]
    return ids, np.append(0, after)[np.searchsorted(start, ends)]


class Tokens:
    """The bytes of all ids, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.written = [str(i) for i in range(len(tokens))]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """At which byte of their text each of the ids starts, and where the last one ends."""
        return np.append(0, np.cumsum(self.size[ids]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the ids, put at their offsets."""
        return self.bytes[np.repeat(self.start[ids] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])].tobytes()


_CACHES: dict[str, tuple[Pieces, Tokens]] = {}


def _vocabulary(key: str, ranks: dict[bytes, int]) -> tuple[Pieces, Tokens]:
    """One cache for each worker process and vocabulary."""
    if key not in _CACHES:
        _CACHES[key] = Pieces(ranks), Tokens(ranks)
    return _CACHES[key]


def _encoded(texts: list[str], cache: Pieces) -> Iterator[np.ndarray]:
    ids, ends = encode_texts(texts, cache)
    begin = 0
    for end in ends.tolist():
        yield ids[begin:end]
        begin = end


def encode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids array<int> and the byte offset of each id in the text, array<long>.

    The vocabulary is read once by the driver and broadcast: its size is that of the file, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tokens = _vocabulary(ranks_path, shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE):
                ids = list(_encoded(texts[a:b], cache))
                offsets = [tokens.offsets(x)[:-1] for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], names=[id_column, "ids", "offsets"])

    kept = docs.select(id_column, text_column)
    return kept.mapInArrow(run, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, ranks_path: str, id_column: str = "doc_id") -> DataFrame:
    """id and the decoded bytes of rows (id, ids, offsets); a null ids is no text, b""."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = _vocabulary(ranks_path, shared.value)
        for batch in batches:
            found = []
            for ids, offsets in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.array(ids or [], np.int32)
                last = offsets[-1] + tokens.size[ids[-1]] if len(ids) else 0
                found.append(tokens.decode(ids, np.array([*(offsets or []), last], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[id_column, "decoded"])

    kept = encoded.select(id_column, "ids", "offsets")
    return kept.mapInArrow(run, f"{id_column} {kept.schema[id_column].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and their offsets: encodes, decodes the ids by
    their offsets, and digests both in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    more = ["ids", "offsets"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tokens = _vocabulary(ranks_path, shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE):
                found = list(_encoded(texts[a:b], cache))
                places = [tokens.offsets(ids) for ids in found]
                id_digests = [hashlib.sha256(",".join(map(tokens.written.__getitem__, ids.tolist())).encode()).hexdigest() for ids in found]
                digests = [hashlib.sha256(tokens.decode(ids, at)).hexdigest() for ids, at in zip(found, places)]
                columns = [batch.column(0)[a:b], pa.array(map(len, found), pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())]
                if with_ids:
                    columns += [pa.array(found, pa.list_(pa.int32())), pa.array([at[:-1] for at in places], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<bigint>" * with_ids)
