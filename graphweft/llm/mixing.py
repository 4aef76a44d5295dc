"""Mixing sources to target weights.

Words are cut in blocks of equal size. In each shard of the corpus, Sainte-Laguë apportionment gives the blocks that
the shard owes to the mix to its sources: one by one to the highest quotient target / (2 * seats + 1). A source's
documents of a shard lie in an order drawn from the seed; from a block drawn from the seed on, its quota of blocks is
taken, going round, so most documents are taken whole or not at all, and any word at most MOST_REPEATS times.

Defined results: null and empty texts have size 0 and nothing is taken of them. Null is a source by itself, the last
one. Rows without a doc_id are named by their texts. Rows of a source with one name and size are told apart by a number,
which one has which is left open; all but the first are drawn by name and number, so that they lie apart. In the mix
itself each row is taken as its own number says. Without words all targets are 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.ranking import ROW_BITS
from graphweft.llm.common import WORD, materialise, n_words, unused

#: Weights of the sources in the order of their names, again and again.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 16
#: Documents of a source that one shard holds, about.
SHARD_DOCS = 1_000
SEED = 7


def draw(*parts: Column) -> Column:
    """A number below 2 ** 32 from the seed and the parts, the same in Spark and SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_docs, source_size, target from rows (source, size).

    Targets share the sum of sizes by weight, none above ``most`` times its source's size. Sorted by the ratio of
    limit and weight, the sources at their limit come first: source k is below it exactly if what is left for it and
    those after it, divided by their weights, is below its own ratio. One row a source, so the sort is small.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most).cast("double"))
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("rate", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the rates rise up to the first source below its limit and fall after it
    level = F.max(F.when(F.col("rate") * F.col("weight") <= F.col("most"), F.col("rate"))).over(everything)
    return per.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).select("source", "source_docs", "source_size", "target")


def sainte_lague(target: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients target / (2 * got + 1), the first of equals; starts from rounded shares, whose sum
    is off by at most half the number of parties, and gives or takes back seat by seat."""
    if seats <= 0 or target.sum() <= 0:
        return np.zeros(len(target), np.int64)
    got = np.floor(target * seats / target.sum() + 0.5).astype(np.int64)
    while got.sum() < seats:
        got[np.argmax(target / (2 * got + 1))] += 1
    while got.sum() > seats:
        last = np.where(got > 0, target / np.maximum(2 * got - 1, 1), np.inf)
        got[len(last) - 1 - np.argmin(last[::-1])] -= 1
    return got


def name_of(doc_id: Column, text: Column) -> Column:
    """What stands for a row in draws."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


#: Columns that tell rows from each other, with their number: the source's name with a letter before it, empty for null.
GROUP = ["name", "size", "source_key"]
#: Equal rows that one task writes out.
RUN = 10_000


def sizes_of(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"], docs["source"], n_words(docs["text"]).alias("size"), name_of(docs["doc_id"], docs["text"]).alias("name")]


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def numbered(sized: DataFrame) -> DataFrame:
    """The same rows with number: 1, 2, ... in each group. Equal rows are counted and written out again, in runs that
    are dealt to tasks, so no group is ordered in one place."""
    groups = sized.groupBy("doc_id", "source", "size", "name").agg(F.count(F.lit(1)).alias("n"))
    runs = groups.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).repartition("name", "size", "run")
    first = F.col("run") * RUN + 1
    return runs.select("doc_id", "source", "size", "name", F.explode(F.sequence(first, F.least(first + RUN - 1, F.col("n")))).alias("number"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and where the cell's taken stretch lies: offset of the document,
    cell_size, rounds (times that all is taken), first and stretch (words taken once more, going round)."""
    return mix_sized(materialise(docs.select(*sizes_of(docs))), weights, block_words, shard_docs)  # texts are counted once


def mix_sized(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The same from rows (doc_id, source, size, name), and which row of its group (GROUP, number) each is."""
    per = targets(sized, weights)
    # sources are few beside documents, but only Spark's own check of their size decides on a broadcast
    label = F.when(F.col("number") > 1, F.concat_ws("#", "name", "number")).otherwise(F.col("name"))
    shard = F.pmod(draw(F.lit("shard"), F.col("label")), F.ceil(F.col("source_docs") / shard_docs)).cast("int")
    rows = numbered(sized).withColumn("label", label)
    rows = rows.join(per, rows.source.eqNullSafe(per.source)).drop(per.source).withColumn("shard", shard)
    cells = rows.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").cast("long").alias("cell_size"))
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("cell_size") / F.col("source_size")).otherwise(0.0)

    def apportion(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("source", na_position="last")
        due = cell["share"].to_numpy()
        cell["quota"] = sainte_lague(due, int(np.floor(due.sum() / block_words + 0.5)))
        return cell[["source", "shard", "cell_size", "quota"]]

    cells = cells.select("source", "shard", "cell_size", share.alias("share")).groupBy("shard").applyInPandas(apportion, "source string, shard int, cell_size long, quota long")
    blocks = F.ceil(F.col("cell_size") / block_words)
    quota = F.least("quota", blocks * int(MOST_REPEATS))
    # words of `extra` blocks from block `start` on, going round; the last block may be short
    cells = cells.withColumn("rounds", F.when(blocks > 0, F.floor(quota / blocks)).otherwise(0)).withColumn("extra", F.when(blocks > 0, quota - F.col("rounds") * blocks).otherwise(0)).withColumn("first", F.when(blocks > 0, F.pmod(draw(F.lit("start"), F.coalesce("source", F.lit("")), F.col("shard").cast("string")), blocks)).otherwise(0) * block_words).withColumn("stretch", F.least(F.col("extra") * block_words, F.col("cell_size")))
    order = Window.partitionBy("source", "shard").orderBy(draw(F.lit("order"), F.col("label")), "label", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
    out = rows.join(cells.withColumnRenamed("source", "cell_source").withColumnRenamed("shard", "cell_shard"), F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("shard") == F.col("cell_shard")))
    low, high, size = F.col("offset"), F.col("offset") + F.col("size"), F.col("cell_size")
    inside = lambda a, b: F.greatest(F.least(high, b) - F.greatest(low, a), F.lit(0))
    end = F.col("first") + F.col("stretch")
    once = inside(F.col("first"), F.least(end, size)) + inside(F.lit(0), F.greatest(end - size, F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + once).cast("long").alias("taken"), "offset", "cell_size", "rounds", "first", "stretch", "name", source_key(F.col("source")).alias("source_key"), "number")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands in it once for each time it is taken whole, and once
    more, cut to the taken words with single spaces, where a stretch ends inside it."""
    own_row, own_name, own_size, own_at, own_copy = unused(docs, "own_row", "own_name", "own_size", "own_at", "own_copy")
    _, _, size, name = sizes_of(docs)
    # rows are numbered where they are written: a task's number is above the bits that count its rows
    rows = materialise(docs.withColumns({own_row: F.monotonically_increasing_id(), own_size: size, own_name: name}))
    sized = rows.select("doc_id", "source", F.col(own_size).alias("size"), F.col(own_name).alias("name"))
    place = F.struct("offset", "cell_size", "rounds", "first", "stretch", "taken").alias(own_at)
    taken = mix_sized(sized, **options).filter("taken > 0").select(*GROUP, "number", place)
    ids = rows.select(F.col(own_name).alias("name"), F.col(own_size).alias("size"), source_key(F.col("source")).alias("source_key"), F.col(own_row).alias("row"), F.shiftright(own_row, ROW_BITS).alias("task"))
    earlier = Window.partitionBy(*GROUP).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    shifts = ids.groupBy(*GROUP, "task").agg(F.count(F.lit(1)).alias("n")).select(*GROUP, "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ids = ids.withColumn("number", F.row_number().over(Window.partitionBy(*GROUP, "task").orderBy("row")))  # of a task's rows
    ids = ids.join(shifts, [*GROUP, "task"]).select(*GROUP, (F.col("number") + F.col("shift")).alias("number"), "row")
    rows = rows.join(ids.join(taken, [*GROUP, "number"]).select(F.col("row").alias(own_row), own_at), own_row)
    at, size = F.col(own_at), F.col(own_size)
    rounds = at["rounds"]
    rest = at["taken"] - rounds * size
    copies = rounds + F.when(rest > 0, 1).otherwise(0)
    rows = rows.withColumn(own_copy, F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    low, high, end, cell = at["offset"], at["offset"] + size, at["first"] + at["stretch"], at["cell_size"]
    piece = lambda a, b: F.slice(words, (F.greatest(a - low, F.lit(0)) + 1).cast("int"), F.greatest(F.least(b, high) - F.greatest(a, low), F.lit(0)).cast("int"))
    cut = F.array_join(F.concat(piece(F.lit(0), F.greatest(end - cell, F.lit(0))), piece(at["first"], F.least(end, cell))), " ")
    partly = (F.col(own_copy) > rounds) & (rest < size)
    text = F.when(partly, cut).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(partly, F.length(cut)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
