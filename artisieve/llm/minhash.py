"""Near-duplicate classes by circulant MinHash.

Two permutations of the 64-bit shingle hashes make a whole signature: the first breaks whatever order the hashes have,
the second is shifted circularly by one place from a coordinate to the next, so coordinate ``i`` of a set is the least
``second(first(shingle) + i)``. Bands of ``rows`` coordinates are hashed; sets that agree in a band are candidates. With 32
bands of 4 a pair of similarity 0.8 meets in no band once in 20 million.

Vertices are distinct sets, named by a 64-bit hash, so that copies cost a row each and no more. Candidates are settled

1. by stars: a band's sets are compared with its most central one, and linked where the exact similarity of the full
   sets suffices;
2. where a band still holds several classes, by signatures: pairs of different classes whose sizes fit and whose signatures
   agree in ``agreement`` of their coordinates connect families, whose members' full sets are brought together once; all
   pairs of a family that signatures do not rule out and whose classes differ are decided there. Bands and families
   of more than ``BLOCK_SETS`` sets or ``BLOCK_BYTES`` are dealt in pairs of blocks.

A pair of similarity ``t`` agrees in fewer coordinates than ``agree`` less than once in a million. All counts of a band
are aggregated before the shuffle; joins on bands may be split by Spark where one is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artisieve.llm.common import mix64, scratch, slices, staged
from artisieve.llm.graph import components
from artisieve.llm.jaccard_join import by_tree, set_name, shingle_sets, shingle_sets_of, unpacked, verified

BLOCK_SETS = 4096
BLOCK_BYTES = 16 << 20
SECOND = np.uint64(0x632BE59BD9B4E019)


def coordinates(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` signature coordinates of each non-empty set of shingle hashes, one row a set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint64)
    with np.errstate(over="ignore"):
        first = mix64(flat ^ SECOND)
        for i in range(n):
            out[:, i] = np.minimum.reduceat(mix64((first + np.uint64(i)) * SECOND), starts)
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each row."""
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.arange(bands, dtype=np.uint64) + np.zeros((len(signatures), 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = mix64(key * SECOND + parts[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, v, marks, keys): size and name of the set, a byte of each coordinate, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 20):
                sets = shingle_sets_of(b.column(1), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                v, marks, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    sig = coordinates([sets[i] for i in full], bands * rows)
                    for i, low, key in zip(full, (sig & np.uint64(255)).astype(np.uint8), band_keys(sig, bands), strict=True):
                        v[i], marks[i], keys[i] = set_name(sets[i]), low.tobytes(), key
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(v, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "v", "marks", "keys"])

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, v long, marks binary, keys array<long>")


def agreement(num: int, den: int, coordinates: int) -> int:
    """Least number of equal coordinates that is asked of a pair: five deviations below the mean at similarity num / den."""
    t = num / den
    return max(1, int(coordinates * t - 5 * (coordinates * t * (1 - t)) ** 0.5))


def undecided(label: np.ndarray, joined: np.ndarray, n: np.ndarray, marks: np.ndarray, least: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of different labels that sizes and signatures leave open, but none whose ends are joined already. ``joined`` may
    change between pairs."""
    for i in range(len(n) - 1):
        rest = np.flatnonzero((label[i + 1 :] != label[i]) & (joined[i + 1 :] != joined[i])) + i + 1
        rest = rest[den * np.minimum(n[rest], n[i]) >= num * np.maximum(n[rest], n[i])]
        if len(rest):
            for j in rest[(marks[rest] == marks[i]).sum(axis=1) >= least].tolist():
                if joined[j] != joined[i]:
                    yield i, j


def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, renumbered, sizes and signatures of a tree's rows."""
    label = np.unique(b.column("label").to_numpy(), return_inverse=True)[1]
    return label, b.column("n").to_numpy(), np.frombuffer(b"".join(b.column("marks").to_pylist()), np.uint8).reshape(b.num_rows, -1)


def forests(rows: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """(a, b): of each tree of ``rows(tree, v, n, label, marks)`` a spanning forest of the pairs left open. It spans sets, not
    classes: an open pair may turn out to be no link, and then another pair of the same two classes has to be decided, so that
    the ends of all open pairs belong to the family."""

    def grow(b: pa.RecordBatch) -> list[tuple[int, int]]:
        label, n, marks = columns(b)
        out, tree = [], np.arange(len(n))
        for i, j in undecided(label, tree, n, marks, least, num, den):
            out.append((i, j))
            tree[tree == tree[j]] = tree[i]
        return out

    return by_tree(rows.select("tree", "v", "n", "label", "marks"), grow)


def family_links(rows: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """(a, b): links that join the classes of each tree of ``rows(tree, v, n, label, marks, shingles)``; every pair left open is
    decided on its full sets, but none whose ends are joined already."""

    def grow(b: pa.RecordBatch) -> list[tuple[int, int]]:
        own = np.unique(b.column("v").to_numpy(), return_index=True)[1]  # a set comes twice where an id is repeated
        b = b.take(pa.array(own))
        label, n, marks = columns(b)
        sets, out = [unpacked(x) for x in b.column("shingles").to_pylist()], []
        for i, j in undecided(label, label, n, marks, least, num, den):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (int(n[i] + n[j]) - both):
                out.append((int(own[i]), int(own[j])))
                label[label == label[j]] = label[i]
        return out

    return by_tree(rows.select("tree", "v", "n", "label", "marks", "shingles"), grow)


def in_blocks(rows: DataFrame, by: str, weight: DataFrame) -> DataFrame:
    """``rows(by, v, label)`` as (tree, v, label), each in all pairs of blocks that hold its own; ``weight(by, blocks)``."""
    rows = rows.join(weight, by).withColumn("nb", F.ceil("blocks").cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select(F.xxhash64(by, F.least("i", "j"), F.greatest("i", "j")).alias("tree"), "v", "label")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): the class of each document under links of similarity >= num / den over its
    distinct ``k``-word shingles (with fewer words, the whole sequence), and whether it stays for its class.

    ``component_id`` is the least id reachable. An empty or null text has no shingles and is its own class; a null id has a
    null class unless its text links it to others, and is kept only where its class is null. Repeated ids and texts share a
    class where their texts are similar, and all rows of the class's id are kept. Other columns are not read. The result is
    staged, what led to it is deleted.
    """
    with scratch(docs.sparkSession):
        source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        sig = staged(signatures(source, k, bands, rows), "minhash")
        vertices = staged(sig.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("marks").alias("marks"), F.any_value("keys").alias("keys")), "minhash-sets")

        every = vertices.select("v", F.explode("keys").alias("key"))
        shared = every.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        members = staged(every.join(shared.select("key"), "key"), "bands")
        # A band's centre is its set with most shared bands: an original, whose copies each have shingles of their own.
        degree = members.groupBy("v").agg(F.count("*").alias("d"))
        centre = members.join(degree, "v").groupBy("key").agg(F.max(F.struct("d", "v"))["v"].alias("b"))
        stars = members.join(centre, "key").where("v <> b").select(F.col("v").alias("a"), "b").distinct()
        for side in "ab":
            stars = stars.join(vertices.select(F.col("v").alias(side), F.col("n").alias(f"n{side}")), side)
        stars = staged(stars.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)").select("a", "b"), "stars")
        links = staged(verified(source, stars, vertices, k, num, den), "star-links")
        first = staged(components(links), "star-classes")
        least = agreement(num, den, bands * rows)
        label = F.coalesce("label", "v").alias("label")

        named = members.join(first, "v", "left").select("key", "v", label)
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), (F.count("*") / BLOCK_SETS).alias("blocks")).where("lo <> hi")
        dealt = staged(in_blocks(named, "key", mixed.select("key", "blocks")), "mixed-bands")
        # Blocks with the same members are one.
        whole = dealt.groupBy("tree").agg(F.xxhash64(*(F.sum(F.shiftright(F.xxhash64("v", F.lit(i)), 24)) for i in (0, 1)), F.count("*")).alias("members"))
        one = whole.groupBy("members").agg(F.min("tree").alias("tree")).select("tree")
        marked = vertices.select("v", "n", "marks")
        open_ = forests(dealt.join(one, "tree", "left_semi").join(marked, "v"), least, num, den)
        families = components(staged(open_.distinct(), "open")).select("v", F.col("label").alias("family"))
        families = staged(families.join(marked, "v").join(first, "v", "left").select("v", "n", "marks", "family", label), "families")
        weight = families.groupBy("family").agg((F.count("*") / BLOCK_SETS + F.sum("n") * 6 / BLOCK_BYTES).alias("blocks"))
        wanted = vertices.select("v", "id").join(families.select("v"), "v", "left_semi")
        rows_of = in_blocks(families, "family", weight).join(families.select("v", "n", "marks"), "v").join(shingle_sets(source, wanted, k), "v")
        classes = components(links.unionByName(family_links(rows_of, least, num, den)))

        joined = sig.select("id", "n", "v").join(classes, "v", "left").withColumn("label", F.coalesce("label", "v"))
        lowest = joined.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component_id"))
        out = joined.join(lowest, "label", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
        return staged(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), "classes", keep=True)
