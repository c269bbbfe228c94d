"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is modelled as the bytes of its words (A-Z lowered), each closed by a blank, then an end symbol. The trie of
context counts is learned from the training documents: contexts of ``ORDER`` bytes come from the running text, across
blanks; a shorter context counts in how many longer ones a symbol was seen (update exclusion). A symbol with
count c in a context has c - ``DISCOUNT`` of it; the rest escapes to the next shorter context, where the symbols
of the longer one are excluded.

Scale: grams and words are counted in tasks before the shuffle. All statistics are aggregations and equi-joins over
48-bit context keys and 64-bit word hashes. A text's score is a sum over its symbols; the most frequent keys and words,
of a bounded number, are looked up in the worker, others by a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artisieve.llm.common import slices, staged, word_bytes, word_hashes
from artisieve.llm.toxicity import in_fold

ORDER = 5
DISCOUNT = 0.3
#: Bytes that no word holds: before the first context byte, the blank between words, the end of a text.
PAD, BLANK, END = b"\t \n"
#: 250 bytes can occur in words; the blank and the end are symbols as well.
ALPHABET = 252
#: Stands for the end of a text among word hashes.
END_WORD = -1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def running(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each text after ``ORDER`` anchors, and where each text begins and the last one ends."""
    raw, bounds, inside, first = word_bytes(texts)
    before = lambda flags: np.concatenate([[0], np.cumsum(flags)])[bounds]
    size, words, n = before(inside), before(first), len(bounds) - 1
    starts = size + words + np.arange(n + 1) * (ORDER + 1)
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) + np.cumsum(first[at]) - 1 + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, np.diff(size))
    out = np.full(starts[-1], BLANK, np.uint8)
    out[place] = LOWER[raw[at]]
    out[(starts[:-1, None] + np.arange(ORDER - 1)).ravel()] = PAD
    out[starts[1:] - 1] = END
    return out, starts


def text_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) key of each symbol of the texts, and the number of symbols of each."""
    raw, starts = running(texts)
    keys = np.zeros(max(len(raw) - ORDER, 0), np.int64)
    for i in range(ORDER + 1):
        keys <<= 8
        keys |= raw[i : len(raw) - ORDER + i]
    inside = np.ones(len(raw), bool)
    inside[(starts[:-1, None] + np.arange(ORDER)).ravel()] = False
    return keys[inside[ORDER:]], np.diff(starts) - ORDER


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Tables of (key, count, ...) added up by key."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in range(1, len(parts[0])))


def counted(docs: DataFrame, find, most: int = 2_000_000) -> DataFrame:
    """(g, c, s): each key that ``find(texts)`` returns with the number for each text, with its count in training
    documents and in all. ``docs`` has columns text and held_out. Tasks count before the shuffle, in tables of
    about ``most`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for whole in batches:
            for b in slices(whole):
                keys, n = find(b.column(0))
                train = np.repeat(~np.fromiter(b.column(1).to_pylist(), bool, b.num_rows), n)
                g, at = np.unique(keys, return_inverse=True)
                parts.append((g, np.bincount(at, train, len(g)).astype(np.int64), np.bincount(at, minlength=len(g))))
                if sum(len(p[0]) for p in parts) > most:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > most // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, parts[0])], ["g", "c", "s"])
                        parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged(parts))], ["g", "c", "s"])

    return docs.select("text", "held_out").mapInArrow(run, "g long, c long, s long").groupBy("g").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts and of their ends, and their number for each."""
    words, ends = word_hashes(texts)
    return np.insert(words.view(np.int64), ends[1:], END_WORD), np.diff(ends) + 1


def code_lengths(grams: DataFrame) -> DataFrame:
    """(g, s, lp): log10 probability of each key's symbol in its context, escapes and exclusions included."""
    mask = lambda bytes_: F.lit((1 << 8 * bytes_) - 1).cast("long")
    symbols = {ORDER: grams.where("c > 0").select(F.col("g").alias(f"g{ORDER}"), F.col("c").alias(f"c{ORDER}"))}
    for k in range(ORDER - 1, -1, -1):
        up = symbols[k + 1]
        symbols[k] = staged(up.groupBy(up[f"g{k + 1}"].bitwiseAND(mask(k + 1)).alias(f"g{k}")).agg(F.count("*").alias(f"c{k}")), f"ppm-{k}")
    out = grams.select("g", "s")
    for k in range(ORDER, -1, -1):
        rows = symbols[k].withColumn(f"x{k}", F.shiftright(f"g{k}", 8))
        if k:  # the count that this context's symbols have one order below, where they will be excluded
            rows = rows.withColumn(f"g{k - 1}", F.col(f"g{k}").bitwiseAND(mask(k))).join(symbols[k - 1], f"g{k - 1}")
        contexts = rows.groupBy(f"x{k}").agg(F.sum(f"c{k}").alias(f"t{k}"), F.count("*").alias(f"d{k}"), F.sum(f"c{k - 1}" if k else F.lit(0).cast("long")).alias(f"e{k}"))
        small = F.broadcast if k <= 1 else (lambda df: df)  # at most 256 ** 2 rows
        out = out.withColumn(f"g{k}", F.col("g").bitwiseAND(mask(k + 1))).withColumn(f"x{k}", F.shiftright("g", 8).bitwiseAND(mask(k)))
        out = out.join(small(symbols[k]), f"g{k}", "left").join(small(contexts), f"x{k}", "left").drop(f"g{k}", f"x{k}")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda name, b=b: pc.fill_null(b.column(name), 0).to_numpy(zero_copy_only=False).astype(np.float64)
            n = b.num_rows
            lp, done, gone, mass = np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n)
            for k in range(ORDER, -1, -1):
                c, t, d, e = (get(f"{x}{k}") for x in "ctde")
                total, kinds = t - mass, d - gone  # what symbol exclusion leaves of this context
                found = ~done & (c > 0)
                escape = ~done & (c == 0) & (d > 0)
                lp[found] += np.log10((c[found] - DISCOUNT) / total[found])
                some = escape & (kinds > 0)
                lp[some] += np.log10(kinds[some] * DISCOUNT / total[some])
                done |= found
                gone, mass = np.where(escape, d, gone * (d > 0)), np.where(escape, e, mass * (d > 0))
            lp[~done] -= np.log10(ALPHABET - gone[~done])
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("s"), pa.array(lp)], ["g", "s", "lp"])

    return out.mapInArrow(walk, "g long, s long, lp double")


def least_count(table: DataFrame, most: int, top: int = 4096) -> int:
    """The least count ``s`` that at most ``most`` keys reach."""
    capped = F.when(F.col("s") < top, F.col("s")).otherwise(F.lit(top) * F.pow(2.0, F.floor(F.log2(F.col("s") / top))).cast("long"))
    least = 1 << 62
    for r in sorted(table.groupBy(capped.alias("s")).count().collect(), key=lambda r: -r["s"]):  # at most top + 50 rows
        most -= r["count"]
        if most < 0:
            break
        least = r["s"]
    return least


def sorted_by_key(table: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    """The columns of a bounded table as arrays in order of the first."""
    got = table.select(*columns).toArrow()
    order = np.argsort(got.column(0).to_numpy())
    return tuple(c.to_numpy()[order] for c in got.columns)


def looked_up(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of the keys in a sorted array."""
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


def lists_of(values: np.ndarray, some: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each text, of ``size`` values, a list of those at which ``some`` holds."""
    ends = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(size)])]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[some]))


def text_scores(docs: DataFrame, folds: int = 7, fold: int = 2, frequent: int = 1 << 20, broadcast_rows: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows whose crc32(id as text) mod ``folds`` is ``fold`` are held out of all counts. ``base_score`` is the
    add-one unigram word model, ``score`` the PPM model, both log10. Null texts are empty (one end token); a null
    id is a training row; repeated rows are counted and scored each; an empty table gives no rows. At most
    ``frequent`` words and ``broadcast_rows`` keys, the most frequent, are broadcast.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), in_fold(id_col, folds, fold).alias("held_out"))
    vocab = staged(counted(source, text_words), "ppm-vocab")
    size = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, floor = size["n"], log10(size["n"] + size["v"] + 1)
    common = least_count(vocab, frequent)
    words_ = spark.sparkContext.broadcast(sorted_by_key(vocab.where(F.col("s") >= common), "g", "c"))
    lengths = staged(code_lengths(staged(counted(source, text_grams), "ppm-text")), "ppm-lengths")
    least = least_count(lengths, broadcast_rows)
    keys_ = spark.sparkContext.broadcast(sorted_by_key(lengths.where(F.col("s") >= least), "g", "lp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, counts), (grams, lps) = words_.value, keys_.value
        costs = np.log10(counts + 1) - floor
        for whole in batches:
            for b in slices(whole):
                w, size = text_words(b.column(1))
                at, there = looked_up(words, w)
                doc = np.repeat(np.arange(len(size)), size)[there]
                total = lambda x, doc=doc, n=len(size): np.bincount(doc, x, n)
                known, base = total(counts[at[there]] > 0).astype(np.int64), total(costs[at[there]])
                rare = lists_of(w, ~there, size)
                keys, long = text_grams(b.column(1))
                g, back = np.unique(keys, return_inverse=True)
                at, there = looked_up(grams, g)
                lp = np.zeros(len(g))
                lp[there] = lps[at[there]]
                scores = np.add.reduceat(lp[back], np.cumsum(long) - long)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, (size, known, base, scores)), rare, lists_of(keys, ~there[back], long)], ["id", "held_out", "n_tokens", "known", "base", "lp", "rare", "grams"])

    rows = source.select("id", "text", "held_out").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, known long, base double, lp double, rare array<long>, grams array<long>")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "ppm-rows")
    each = rows.select("row", F.explode("rare").alias("g")).join(vocab.where(F.col("s") < common), "g")
    added = each.groupBy("row").agg(F.count(F.when(F.col("c") > 0, 1)).alias("known_"), F.sum(F.log10(F.col("c") + 1) - F.lit(floor)).alias("base_"))
    spelt = rows.select("row", F.explode("grams").alias("g")).join(lengths.where(F.col("s") < least), "g").groupBy("row").agg(F.sum("lp").alias("lp_"))
    plus = lambda a: F.col(a) + F.coalesce(F.col(a + "_"), F.lit(0))
    return rows.drop("rare", "grams").join(added, "row", "left").join(spelt, "row", "left").select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("lp").alias("score"))
