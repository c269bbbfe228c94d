"""What the two passage operators share: document keys, shared hashes, and slices of documents' words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.llm.common import slices, staged, word_hashes

#: Bits of the table that tells the readers of the texts which hashes several documents hold.
FILTER_BITS = 1 << 27
GRID = 64
#: Pairs of one slice that a task takes, and slices that are dealt so: others have less than one in ``HEAVY`` of all pairs.
SPLIT, HEAVY = 20_000, 1 << 20


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) of the documents with an id and a text. Rows of one id and text are one document;
    rows of one id with several texts are several."""
    return docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def window_starts(words: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Which words begin ``k`` words of one text."""
    n = np.diff(ends)
    return np.arange(len(words)) + k <= np.repeat(ends[1:], n)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A bit for each of ``hashes(h)``, at the place of its lower bits. At most ``FILTER_BITS`` / 64 rows come to the driver."""
    slot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    filled = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63L))")).alias("m")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[filled.column("w").to_numpy()] = filled.column("m").to_numpy()
    return table.view(np.uint64)


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(FILTER_BITS - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0


def shared_hashes(docs: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(h, n): the hashes that ``find(words, ends)`` picks (as document numbers and hashes) in two documents or more, with
    the number of documents. Repeated rows count each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                doc, h = find(*word_hashes(b.column(0)))
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                own = np.ones(len(h), bool)
                own[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


def found_rows(docs: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple], schema: dict[str, pa.DataType]) -> DataFrame:
    """One row (row, id, *schema) for each document number and columns that ``find(words, ends)`` returns."""
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                doc, *cols = find(*word_hashes(b.column(2)))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.values(), strict=True))], ["row", "id", *schema])

    return docs.select("row", "id", "text").mapInArrow(run, f"row long, id {dict(docs.dtypes)['id']}, " + ", ".join(f"{c} {names[t]}" for c, t in schema.items()))


def word_slices(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """(row, lo, hi, words): for each of the distinct ``requests(row, lo, hi)`` the 32-bit hashes of words lo..hi of that
    document, clipped to the text. A document's requests lie on a grid, so they are bounded by its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for b in slices(whole):
                words, ends = word_hashes(b.column(1))
                words = words.astype(np.uint32)
                at, lo, hi, out = [], [], [], []
                for i, (row, asked, s, e) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    if row != last:  # a repeated row is read once
                        for x in asked:
                            at.append(i)
                            lo.append(x["lo"])
                            hi.append(x["hi"])
                            out.append(words[s + x["lo"] : min(s + x["hi"], e)].tobytes())
                    last = row
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(out, pa.binary())], ["row", "lo", "hi", "words"])

    each = requests.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("asked"))
    return docs.select("row", "text").join(each.hint("merge"), "row").sortWithinPartitions("row").select("row", "text", "asked").mapInArrow(run, "row long, lo int, hi int, words binary")


def both_sides(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, a_lo, a_hi, b, b_lo, b_hi, ...)`` with the words of both sides as (a_base, a_words, b_base, b_words):
    somewhat wider slices, so that the many partners of a document ask for few. ``base`` is a slice's first place. Slices are
    staged, so that the shuffled texts can go before the slices are shuffled."""
    down = lambda c: (F.greatest(F.floor(F.col(c) / GRID), F.lit(0)) * GRID).cast("int")
    up = lambda c: (F.ceil(F.col(c) / GRID) * GRID).cast("int")
    pairs = pairs.withColumns({"a_base": down("a_lo"), "a_top": up("a_hi"), "b_base": down("b_lo"), "b_top": up("b_hi")}).drop("a_lo", "a_hi", "b_lo", "b_hi")
    side = lambda df, s: df.select(F.col(s).alias("row"), F.col(f"{s}_base").alias("lo"), F.col(f"{s}_top").alias("hi"))
    # A slice that many pairs ask for as b is dealt to several tasks, and so are its pairs.
    asked = pairs.groupBy(F.col("b").alias("row"), F.col("b_base").alias("lo"), F.col("b_top").alias("hi")).count().where(F.col("count") > SPLIT)
    often = F.broadcast(asked.orderBy(F.desc("count"), "row", "lo", "hi").limit(HEAVY).select("row", "lo", "hi", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")))
    cut = staged(word_slices(docs, side(pairs, "a").unionByName(side(pairs, "b"))), "slices").join(often, ["row", "lo", "hi"], "left")
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).repartition("row", "lo", "hi", "part")  # one exchange for both joins
    pairs = pairs.join(often.withColumnsRenamed({"row": "b", "lo": "b_base", "hi": "b_top"}), ["b", "b_base", "b_top"], "left")
    pairs = pairs.withColumns({"b_part": F.pmod("a", F.coalesce("parts", F.lit(1))).cast("int"), "a_part": F.pmod("a", F.lit(1)).cast("int")}).drop("parts")  # 0, but no constant, which would part the exchanges
    for s in "ba":
        pairs = pairs.join(cut.select(F.col("row").alias(s), F.col("lo").alias(f"{s}_base"), F.col("hi").alias(f"{s}_top"), F.col("part").alias(f"{s}_part"), F.col("words").alias(f"{s}_words")), [s, f"{s}_base", f"{s}_top", f"{s}_part"])
    return pairs
