"""Collocations: phrases of two to four words whose words stand together more often than apart.

A suffix pointer is the place of a word; its suffix are the words from there on to the end of the piece, four at most.
Sorted suffixes have all places of a phrase next to each other. Three passes over the texts:

1. Words are counted; those that are too rare end every suffix before them.
2. Pairs of frequent words are counted by hashes. Pairs that are too rare end suffixes as well, and the counts tell how
   suffixes are to be dealt.
3. Suffixes are sorted in each task by multikey three-way quicksort, equal ones become one with a number, and all are
   routed by their leading pair, in the case of a very frequent pair by what follows as well. Where they meet they are
   sorted once more: at each depth the pointers equal to the pivot are a phrase and their number is its count; a part
   with too small a number is abandoned before its next word is looked at.

Words are 64-bit hashes of language and word, and pairs are hashes of two of these. That words have different hashes is
checked among all words of the corpus; if two meet, other hashes are taken. The set of frequent words and that of
frequent pairs go to the tasks as bitmaps, which may let rare ones pass but never hold back a frequent one; counts are
exact since phrases are compared word by word.

Defined results: null texts are empty texts; a null lang is ``und``. Rows are counted one by one, whatever their doc_id.
Empty texts and those of separators alone have no words. Without candidates there are no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, slices, text_session
from graphweft.llm.words import byte_tables, mix, powers_for

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE, DROP_SHARE = 2_000_000, 80
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
NO_LANG = "und"
#: Texts are looked at in slices of about this many bytes.
SLICE = 1 << 20
#: Words that a task holds before it sorts and hands on: a bound of memory.
HELD = 1 << 21
#: Parts up to this many pointers are sorted at once instead of by pivots.
SMALL = 1 << 12
#: Suffixes that one task is to get, about. A pair with more than a sixteenth of that is dealt by all of its words.
PER_TASK, HOT_SHARE = 1 << 21, 16
#: Bits of a bitmap for each of its members, and the most bits one has (32 MB).
MEMBER_BITS, MOST_BITS = 16, 1 << 28
#: The last ranking of a language starts from the best of this many parts.
RANKED_PARTS = 64


@functools.cache
def _kinds() -> np.ndarray:
    """0: of a word, 1: blank, 2: end of a piece."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(BLANKS)] = 1
    kinds[list(BREAKS)] = 2
    return kinds


def lang_seed(lang: str, seed: int) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(f"{seed} {lang}".encode(), digest_size=8).digest(), np.uint64)[0]


def find_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Where words start and end in the joined texts, hashes of the words with A-Z as a-z, how many pieces end before each, and the
    joined texts. Texts end pieces."""
    whole = b"\n".join([*texts, b""])
    raw = np.frombuffer(whole, np.uint8)
    kinds = _kinds()[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kinds == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    forth, back = powers_for(0x2545F4914F6CDD1D, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_tables()[1][raw] * forth[: len(raw)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return start, end, hashes, np.cumsum(kinds == 2)[start], whole


def cut_long(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes that end where pieces end; a longer piece stays whole."""
    start = 0
    while len(text) - start > limit:
        end = max(text.rfind(bytes([b]), start, start + limit) for b in BREAKS)
        if end < 0:
            found = [i for b in BREAKS if (i := text.find(bytes([b]), start + limit)) >= 0]
            if not found:
                break
            end = min(found)
        yield text[start : end + 1]
        start = end + 1
    yield text[start:]


def batches_of_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    """(langs, lang of each word, keys, piece of each word, start, end, whole) for slices of the texts; columns lang, text."""
    for batch in batches:
        langs, every = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in cut_long(text or b"", SLICE):
                langs.append(lang)
                every.append(part)
        for a, b in slices(every, SLICE):
            names = list(dict.fromkeys(langs[a:b]))
            start, end, hashes, piece, whole = find_words(every[a:b])
            ends = np.cumsum([len(t) + 1 for t in every[a:b]])
            of = np.array([names.index(x) for x in langs[a:b]])[np.searchsorted(ends, start, "right")]
            keys = mix(hashes + np.array([lang_seed(x, seed) for x in names], np.uint64)[of])
            yield names, of, np.maximum(keys, np.uint64(1)), piece, start, end, whole


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))


def count_words(docs: DataFrame, least: int = LEAST, seed: int = 0) -> DataFrame:
    """key, lang, word, n, variants of frequent words and of those whose hashes meet; and a row for each language with no
    word and the number of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        totals: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            rows = [(k, *v) for k, v in found.items()] + [(int(lang_seed(x, seed)), x, None, n) for x, n in totals.items()]
            key, lang, word, n = zip(*rows)
            found.clear(), totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["key", "lang", "word", "n"])

        for names, of, keys, _, start, end, whole in batches_of_words(batches, seed):
            for x, n in zip(names, np.bincount(of, minlength=len(names)).tolist()):
                totals[x] = totals.get(x, 0) + n
            each, first, n = np.unique(keys, return_index=True, return_counts=True)
            for k, a, b, lang, m in zip(each.tolist(), start[first].tolist(), end[first].tolist(), of[first].tolist(), n.tolist()):
                if k in found:
                    found[k][2] += m
                else:
                    found[k] = [names[lang], whole[a:b].lower(), m]
            if len(found) >= HELD // 4:
                yield counted()
        if totals:
            yield counted()

    parts = _texts(docs).mapInArrow(run, "key long, lang string, word binary, n long")
    each = parts.repartition("key").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))  # both groupings with one exchange
    each = each.groupBy("key").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("variants"))
    return materialise(each.filter(f"word IS NULL OR n >= {least} OR variants > 1").withColumn("word", F.col("word").cast("string")))


class Bitmap:
    """A set of 64-bit hashes by one bit each: has() may be true of others, never false of members."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = np.uint64(bits - 1), words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(members: DataFrame, name: str) -> Bitmap:
    """The bitmap of a column of hashes, put together by Spark. Its size follows the number of members up to MOST_BITS;
    of more it is fuller and lets more rare ones pass."""
    count = members.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (count * MEMBER_BITS - 1).bit_length() if count else 0))
    at = F.col(name).bitwiseAND(F.lit(bits - 1))
    words = members.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    out = np.zeros(bits >> 6, np.uint64)
    for batch in words.toArrow().to_batches():  # MOST_BITS / 64 rows at most
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return Bitmap(bits, out)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9DDFEA08EB382D69) + second)


def joined(keys: np.ndarray, piece: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each word and the next stand in one piece and are both known; the last word has no next."""
    out = np.zeros(len(keys), bool)
    out[:-1] = (piece[1:] == piece[:-1]) & known[1:] & known[:-1]
    return out


def count_pairs(docs: DataFrame, frequent: Bitmap, least: int, seed: int) -> DataFrame:
    """pair, n: hashes of pairs of words with the numbers of those frequent enough."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, _, keys, piece, *_ in batches_of_words(batches, seed):
            at = np.flatnonzero(joined(keys, piece, shared.value.has(keys)))
            held.append(pair_hash(keys[at], keys[at + 1]))
            if sum(map(len, held)) >= HELD:
                yield counted(held)
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])

    return materialise(_texts(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def multikey_sort(columns: list[np.ndarray], n: np.ndarray, least: int) -> np.ndarray:
    """Pointers to rows in the order of their columns, by three-way quicksort: a part is split at a pivot of one column
    into smaller, equal and larger rows, and only the equal ones go on with the next column. Equal rows that count less
    than ``least`` together are abandoned. Small parts are put in order side by side at the end, like the insertion sort
    of small parts in the usual form; among these, rare rows stay.
    """
    parts: list[np.ndarray] = []
    todo = [(np.arange(len(n)), 0)]
    while todo:
        part, depth = todo.pop()
        if depth == len(columns) or len(part) <= SMALL:
            if len(part):
                parts.append(part)
            continue
        values = columns[depth][part]
        pivot = np.sort(values[:: max(1, len(values) // 31)])[len(values[:: max(1, len(values) // 31)]) // 2]
        less, more = values < pivot, values > pivot
        equal = part[~(less | more)]
        todo.append((part[more], depth))
        if int(n[equal].sum()) >= least:
            todo.append((equal, depth + 1))
        todo.append((part[less], depth))
    if not parts:
        return np.zeros(0, np.int64)
    pointers = np.concatenate(parts)
    number = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return pointers[np.lexsort([*(c[pointers] for c in reversed(columns)), number])]


def equal_parts(columns: list[np.ndarray], n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows and numbers of the parts of sorted rows that are equal in the first ``depth`` columns."""
    change = np.zeros(len(n), bool)
    change[:1] = True
    for c in columns[:depth]:
        change[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(change)
    return first, np.add.reduceat(n, first) if len(first) else n[:0]


_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]
_SUFFIX = ", ".join(f"{c} long" for c in _COLUMNS)


def suffixes(docs: DataFrame, pairs: Bitmap, hot: tuple[np.ndarray, np.ndarray], seed: int) -> DataFrame:
    """w1 to w4 (0 where a suffix ends), n, split, route: a row for each different suffix of what a task holds. hot: hashes of very
    frequent pairs, sorted, and over how many routes each is split by the words behind it."""
    shared = docs.sparkSession.sparkContext.broadcast((pairs, hot))
    names = [*_COLUMNS, "n", "split", "route"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (hot_pairs, ways) = shared.value
        held: list[list[np.ndarray]] = []

        def sorted_() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            one = np.ones(len(columns[0]), np.int64)
            order = multikey_sort(columns, one, 1)
            columns = [c[order] for c in columns]
            first, n = equal_parts(columns, one, LONGEST)
            columns = [c[first] for c in columns]
            pair, routes = pair_hash(columns[0], columns[1]), np.ones(len(first), np.int64)
            if len(hot_pairs):
                at = np.minimum(np.searchsorted(hot_pairs, pair), len(hot_pairs) - 1)
                routes = np.where(hot_pairs[at] == pair, ways[at], 1)
            route = mix(pair + pair_hash(columns[2], columns[3]) % routes.astype(np.uint64))
            return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n), pa.array(routes > 1), pa.array(route.view(np.int64))], names=names)

        for _, _, keys, piece, *_ in batches_of_words(batches, seed):
            link = joined(keys, piece, np.ones(len(keys), bool))
            at = np.flatnonzero(link)
            link[at] = known.has(pair_hash(keys[at], keys[at + 1]))
            at = np.flatnonzero(link)
            columns, goes_on, link = [keys[at]], np.ones(len(at), bool), np.append(link, np.zeros(LONGEST, bool))
            keys = np.append(keys, np.zeros(LONGEST, np.uint64))
            for i in range(1, LONGEST):
                goes_on = goes_on & link[at + i - 1]
                columns.append(np.where(goes_on, keys[at + i], np.uint64(0)))
            held.append(columns)
            if sum(len(h[0]) for h in held) >= HELD:
                yield sorted_()
        if held:
            yield sorted_()

    return _texts(docs).mapInArrow(run, f"{_SUFFIX}, n long, split boolean, route long")


def count_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, seed: int = 0) -> DataFrame:
    """d, w1 to w4, a: the frequent phrases of two words and more, by hashes of their words."""
    spark = docs.sparkSession
    frequent = words.filter("word IS NOT NULL")
    pairs = count_pairs(docs, bitmap(frequent, "key"), least, seed)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_TASK))
    much = max(1, total // (HOT_SHARE * tasks))  # so that at most HOT_SHARE * tasks pairs are hot
    hot = pairs.filter(F.col("n") > max(much, least * HOT_SHARE)).toArrow()
    hot_pairs, ways = hot.column("pair").to_numpy().view(np.uint64), -(-hot.column("n").to_numpy() // much)
    order = np.argsort(hot_pairs)
    rows = suffixes(docs, bitmap(pairs, "pair"), (hot_pairs[order], ways[order]), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        columns, n, split = [whole.column(c).to_numpy().view(np.uint64) for c in _COLUMNS], whole.column("n").to_numpy(), whole.column("split").to_numpy()
        for some, of in ((least, np.flatnonzero(~split)), (1, np.flatnonzero(split))):  # parts of a split pair are counted elsewhere too
            own, m = [c[of] for c in columns], n[of]
            order = multikey_sort(own, m, some)
            own, m = [c[order] for c in own], m[order]
            for depth in range(2, LONGEST + 1):
                first, a = equal_parts(own, m, depth)
                kept = (a >= (least if depth == LONGEST else some)) & (own[depth - 1][first] != 0)  # whole suffixes meet in any case
                first, a = first[kept], a[kept]
                zero = pa.array(np.zeros(len(first), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), depth, np.int32)), *(pa.array(c[first].view(np.int64)) if i < depth else zero for i, c in enumerate(own)), pa.array(a)], names=["d", *_COLUMNS, "a"])

    counted = rows.repartition(tasks, "route").drop("route").mapInArrow(run, f"d int, {_SUFFIX}, a long")
    return materialise(counted.groupBy("d", *_COLUMNS).agg(F.sum("a").alias("a")).filter(F.col("a") >= least))


def _part(start: int, size: int) -> list[Column]:
    """w1 to w4 of the ``size`` words from the one at ``start`` on."""
    return [F.col(_COLUMNS[start + i]) if i < size else F.lit(0).cast("long") for i in range(LONGEST)]


def _struct(words: list[Column], **more: Column) -> Column:
    return F.struct(*[w.alias(f"p{i}") for i, w in enumerate(words, 1)], *[c.alias(k) for k, c in more.items()])


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """d, w1 to w4, a, l, r, score of all candidates: the cut with the lowest score, the first of equals."""
    counts = phrases.select(*_COLUMNS, "a").union(words.filter("word IS NOT NULL").select("key", *[F.lit(0).cast("long")] * (LONGEST - 1), "n")).toDF("p1", "p2", "p3", "p4", "f")
    parts = []
    for d in range(2, LONGEST + 1):
        each = [_struct(_part(0 if left else k, k if left else d - k), k=F.lit(k), left=F.lit(left)) for k in range(1, d) for left in (True, False)]
        parts.append(F.when(F.col("d") == d, F.array(*each)))
    rows = phrases.select("d", *_COLUMNS, "a", F.explode(F.coalesce(*parts)).alias("part")).select("d", *_COLUMNS, "a", "part.*")
    rows = rows.join(counts, ["p1", "p2", "p3", "p4"])
    side = {f"{side}{k}": F.max(F.when((F.col("k") == k) & (F.col("left") == F.lit(side == "l")), F.col("f"))) for k in range(1, LONGEST) for side in "lr"}
    rows = rows.groupBy("d", *_COLUMNS, "a").agg(*[c.alias(name) for name, c in side.items()])
    score = lambda k: F.expr(f"CAST({SCALE} AS DECIMAL(20, 0)) * CAST(a AS DECIMAL(18, 0)) DIV CAST(l{k} + r{k} AS DECIMAL(20, 0))")
    cuts = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)])))
    return rows.select("d", *_COLUMNS, "a", cuts.alias("cut")).select("d", *_COLUMNS, "a", "cut.l", "cut.r", "cut.score")


def contained(phrases: DataFrame) -> DataFrame:
    """p1 to p4, longer: for each phrase inside a longer candidate the largest number of one that holds it."""
    inner = []
    for d in range(3, LONGEST + 1):
        each = [_struct(_part(start, size)) for size in range(2, d) for start in range(d - size + 1)]
        inner.append(F.when(F.col("d") == d, F.array(*each)))
    return phrases.filter("d > 2").select("a", F.explode(F.coalesce(*inner)).alias("part")).select("a", "part.*").groupBy("p1", "p2", "p3", "p4").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    text_session(docs.sparkSession)
    for seed in range(8):
        words = count_words(docs, least, seed)
        if not words.filter("variants > 1").limit(1).count():
            break
    else:
        raise ValueError("words have equal hashes under every seed")
    phrases = count_phrases(docs, words, least, seed)
    inside = contained(phrases).withColumnsRenamed({f"p{i}": f"w{i}" for i in range(1, LONGEST + 1)})
    kept = scored(phrases, words).join(inside, _COLUMNS, "left").filter(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(20, 0)) < {DROP_SHARE} * CAST(a AS DECIMAL(20, 0))")
    spelled = kept.select("*", F.posexplode(F.slice(F.array(*_COLUMNS), F.lit(1), F.col("d"))).alias("place", "key")).join(words.filter("word IS NOT NULL").select("key", "lang", "word"), "key")
    spelled = spelled.groupBy(*_COLUMNS, "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelled"))
    named = spelled.select("lang", F.array_join("spelled.word", " ").alias("phrase"), "a", "l", "r", "score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    named = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top).drop("rank", "part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    totals = words.filter("word IS NULL").select("lang", "n")  # a row a language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
