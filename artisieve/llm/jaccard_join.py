"""Exact n-gram Jaccard join: near-duplicate classes by prefix routing and signature trees.

Vertices are distinct shingle sets, named by a 64-bit hash (so are shingles). Sets that reach similarity t
share one of their first ``n - ceil(t n) + 1`` shingles in any common order; the order puts shingles that
are frequent in a sample of documents last, which changes costs only. Rows that meet at such a key

1. are compared with the key's most central set (a star, not all pairs) and linked where similar;
2. where a key still holds several classes, a signature tree over its sets is traversed against itself:
   nodes hold the OR of their members' token bitmaps, their size range and their greatest excess (tokens
   beyond one a bit), and a pair of nodes is left as soon as its greatest possible overlap is too small. At the
   leaves a parity bitmap bounds the symmetric difference as well, which rules out nearly all that is not
   similar. What is left connects families, whose members' sets are brought together; there all pairs of
   different classes are decided, by wider bitmaps and then by the sets (their hashes' upper 48 bits).

Keys of frequent shingles are never gathered: their centre comes from a map-side aggregation of at most
``HEAVY`` keys; a key beyond those has less than one in ``HEAVY`` of all rows. Trees and families of more than
``BLOCK_SETS`` sets or ``BLOCK_BYTES`` are dealt in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artisieve.llm.common import ngram_hashes, scratch, slices, small_batches, staged, word_hashes
from artisieve.llm.graph import components

HEAVY = 1 << 20
FILTER_BITS = 1 << 26
BLOCK_SETS = 8192
BLOCK_BYTES = 16 << 20
LEAF = 8


def shingle_sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; with fewer words, of the whole sequence."""
    words, ends = word_hashes(texts)
    grams = ngram_hashes(words, k)
    return [np.unique(grams[s : e - k + 1] if e - s >= k else ngram_hashes(words[s:e], k)) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def set_name(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def width(n: int) -> int:
    """Bits of a parity bitmap of ``n`` shingles: the least power of two >= n, 128 at least. A token bitmap has twice as many."""
    return max(128, 1 << int(n - 1).bit_length())


def bitmaps(shingles: np.ndarray, room: int = 1) -> np.ndarray:
    """The token bitmap (which residues occur) and the parity bitmap (which occur an odd number of times), one after the other."""
    w = room * width(len(shingles))
    tokens, parity = np.zeros(2 * w, np.uint8), np.bincount((shingles & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
    tokens[(shingles & np.uint64(2 * w - 1)).astype(np.int64)] = 1
    return np.packbits(np.concatenate([tokens, parity.astype(np.uint8)]), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int, how: np.ufunc = np.bitwise_or) -> np.ndarray:
    """The bitmap of a narrower width: its residues are those of the wider one."""
    return how.reduce(bits.reshape(-1, words), axis=0)


def unfolded(bits: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Token and parity bitmaps, folded to 2 * ``words`` and ``words`` 64-bit words."""
    third = len(bits) // 3
    return fold(bits[: 2 * third], 2 * words), fold(bits[2 * third :], words, np.bitwise_xor)


def packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to tell apart the members of two sets."""
    return (shingles >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def frequent_shingles(docs: DataFrame, k: int, one_in: int = 16, least: int = 6) -> np.ndarray:
    """At most ``HEAVY`` shingles found often among one in ``one_in`` documents; they only order prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                found = shingle_sets_of(b.column(0), k)
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("text")
    counted = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(counted.orderBy(F.desc("n"), "h").limit(HEAVY).toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def signatures(docs: DataFrame, k: int, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """(id, n, v, bits, light, hot): size, name and bitmap of the set, its prefix keys that are not frequent and that are."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for whole in batches:
            for b in slices(whole):
                out: list[tuple] = []
                for s in shingle_sets_of(b.column(1), k):
                    n = len(s)
                    is_hot = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(n, bool)
                    p = n - -(-num * n // den) + 1 if n else 0
                    light = s[~is_hot][:p]
                    out.append((n, set_name(s) if n else None, bitmaps(s).tobytes() if n else None, light.view(np.int64), s[is_hot][: p - len(light)].view(np.int64)))
                n, v, bits, light, hot = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(v, pa.int64()), pa.array(bits, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (light, hot))], ["id", "n", "v", "bits", "light", "hot"])

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, v long, bits binary, light array<long>, hot array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(v, shingles) of the documents whose id is in ``ids(id)``, and of a few more: a bit table of fixed size
    (``FILTER_BITS``) tells the readers of the texts which ids are wanted, so that no text is shuffled. A full table
    would only let more sets pass; the joins that follow are exact."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    filled = ids.select((slot / 64).cast("int").alias("w"), F.expr("shiftleft(1L, int(pmod(xxhash64(id), 64)))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # at most FILTER_BITS / 64 rows
    table[filled.column("w").to_numpy()] = filled.column("m").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.column(1).to_numpy()
            keep = shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0
            for b in slices(whole.select([0]).filter(pa.array(keep))):
                found = shingle_sets_of(b.column(0), k)
                yield pa.RecordBatch.from_arrays([pa.array([set_name(x) for x in found], pa.int64()), pa.array([packed(x) for x in found], pa.binary())], ["v", "shingles"])

    return docs.select("text", slot.alias("slot")).mapInArrow(run, "v long, shingles binary")


def may_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int, num: int, den: int) -> bool:
    """Whether two sets' bitmaps and sizes leave room for the similarity. Tokens bound the overlap from above, odd
    residues that differ bound the symmetric difference from below."""
    words = min(len(x), len(y)) // 3
    (x, px), (y, py) = unfolded(x, words), unfolded(y, words)
    most = int(np.bitwise_count(x & y).sum()) + min(nx - int(np.bitwise_count(x).sum()), ny - int(np.bitwise_count(y).sum()))
    most = min(most, nx, ny, (nx + ny - int(np.bitwise_count(px ^ py).sum())) // 2)
    return (num + den) * most >= num * (nx + ny)


def possible(pairs: DataFrame, vertices: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that bitmaps and sizes do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_link(np.frombuffer(x, np.uint64), nx, np.frombuffer(y, np.uint64), ny, num, den) for x, nx, y, ny in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(vertices.select(F.col("v").alias(side), F.col("bits").alias(f"x{side}"), F.col("n").alias(f"n{side}")), side)
    sized = pairs.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    return sized.select("a", "b", "xa", "na", "xb", "nb").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, vertices: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets' exact Jaccard similarity is at least num / den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                ok = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x, y = unpacked(x), unpacked(y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    sets = shingle_sets(docs, vertices.select("v", "id").join(ends, "v", "left_semi"), k).repartition("v")  # one exchange serves both joins
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("v").alias(side), F.col("shingles").alias(f"x{side}")), side)
    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long").distinct()


def tree_pairs(n: np.ndarray, label: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different labels that the signature trees of these sets cannot rule out: a tree for each two
    neighbouring size bands, so that large sets do not fold to the width of small ones."""
    band = np.floor(np.log(n) / np.log(den / num) + 1e-9).astype(np.int64)
    for x in np.unique(band):
        at = np.flatnonzero((band == x) | (band == x + 1))
        if len(at) > 1 and (label[at] != label[at[0]]).any():
            for i, j in band_pairs(n[at], label[at], [bits[k] for k in at], num, den):
                own = (band[at[i]] == x) | (band[at[j]] == x)
                yield at[i[own]], at[j[own]]


def band_pairs(n: np.ndarray, label: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(n, kind="stable")
    n, label = n[order], label[order]
    words = min(map(len, bits)) // 3
    both = [unfolded(bits[i], words) for i in order]
    rows, odd = np.stack([x for x, _ in both]), np.stack([x for _, x in both])
    excess = n - np.bitwise_count(rows).sum(1)
    # Levels from the leaves up; node i of a level covers LEAF nodes of the one below.
    levels = [(rows, n, n, excess, label, label)]
    while len(levels[-1][0]) > 1:
        at = np.arange(0, len(levels[-1][0]), LEAF)
        over = lambda f, x, at=at: f.reduceat(x, at, axis=0)
        r, lo, hi, e, l0, l1 = levels[-1]
        levels.append((over(np.bitwise_or, r), over(np.minimum, lo), over(np.maximum, hi), over(np.maximum, e), over(np.minimum, l0), over(np.maximum, l1)))
    grid_i, grid_j = np.repeat(np.arange(LEAF), LEAF), np.tile(np.arange(LEAF), LEAF)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:  # depth first, at most 256 * LEAF ** 2 node pairs at once
        depth, i, j = todo.pop()
        r, lo, hi, e, l0, l1 = levels[depth]
        ok = (i <= j) & (den * hi[i] >= num * lo[j])  # rows are sorted by size
        ok &= ~((l0[i] == l1[i]) & (l0[j] == l1[j]) & (l0[i] == l0[j]))
        i, j = i[ok], j[ok]
        most = np.bitwise_count(r[i] & r[j]).sum(1) + np.minimum(e[i], e[j])
        if depth == 0:
            most = np.minimum(most, (n[i] + n[j] - np.bitwise_count(odd[i] ^ odd[j]).sum(1).astype(np.int64)) // 2)
        ok = (num + den) * np.minimum(most, np.minimum(hi[i], hi[j])) >= num * (lo[i] + lo[j])
        i, j = i[ok], j[ok]
        if depth == 0:
            if len(i):
                yield order[i], order[j]
            continue
        below = len(levels[depth - 1][0])
        for s in range(0, len(i), 256):
            ci, cj = (i[s : s + 256, None] * LEAF + grid_i).ravel(), (j[s : s + 256, None] * LEAF + grid_j).ravel()
            inside = (ci < below) & (cj < below)
            todo.append((depth - 1, ci[inside], cj[inside]))


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """False where both were in one set already."""
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def by_tree(rows: DataFrame, grow: Callable[[pa.RecordBatch], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) of ``grow(members)`` for the members of each ``tree``; trees are read one after the other, each whole."""

    def grown(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tree, v = b.column("tree").to_numpy(), b.column("v").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
        pairs = np.array([(s + i, s + j) for s, e in zip(cut[:-1], cut[1:], strict=True) if e - s > 1 for i, j in grow(b.slice(s, e - s))], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(v[pairs].max(axis=1)), pa.array(v[pairs].min(axis=1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            start = int(np.searchsorted(b.column("tree").to_numpy(), b.column("tree")[b.num_rows - 1].as_py()))
            rest = b.slice(start)
            if start:
                yield from grown(b.slice(0, start))
        if rest is not None:
            yield from grown(rest)

    return rows.repartition("tree").sortWithinPartitions("tree").mapInArrow(run, "a long, b long")


def sized(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows(tree, v, n, label)`` cut into trees between whose sizes no link is possible, without trees of one label and
    with one tree where several have the same members."""
    by_size = Window.partitionBy("tree").orderBy("n", "v")
    rows = rows.withColumn("gap", F.when(F.col("n") * num > F.lag("n").over(by_size) * den, 1).otherwise(0))
    rows = rows.withColumn("gap", F.sum("gap").over(by_size)).withColumn("tree", F.xxhash64("tree", "gap"))
    within = Window.partitionBy("tree")
    members = (F.sum(F.shiftright(F.xxhash64("v", F.lit(i)), 24)).over(within) for i in (0, 1))
    rows = rows.withColumns({"l0": F.min("label").over(within), "l1": F.max("label").over(within), "members": F.xxhash64(*members, F.count("*").over(within))})
    return rows.where("l0 <> l1").select(F.col("members").alias("tree"), "v", "n", "label").distinct()


def candidate_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): for each tree of ``rows(tree, v, n, label, bits)`` a spanning forest of the pairs that it leaves, so that the
    output never exceeds the members. Every pair that may link lies within one component of these edges."""

    def grow(b: pa.RecordBatch) -> list[tuple[int, int]]:
        n, label = b.column("n").to_numpy(), b.column("label").to_numpy()
        if (label == label[0]).all():
            return []
        bits = [np.frombuffer(x, np.uint64) for x in b.column("bits").to_pylist()]
        if len(n) == 2:
            return [(0, 1)] if may_link(bits[0], n[0], bits[1], n[1], num, den) else []
        found = Union(len(n))
        return [(x, y) for i, j in tree_pairs(n, label, bits, num, den) for x, y in zip(i.tolist(), j.tolist(), strict=True) if found.join(x, y)]

    return by_tree(rows.select("tree", "v", "n", "label", "bits"), grow)


def family_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): exact links that join the classes of each tree of ``rows(tree, v, label, shingles)``. All pairs of different
    classes are decided, by bitmaps of 16 bits a shingle and then by the sets, but none whose ends are joined already."""

    def grow(b: pa.RecordBatch) -> list[tuple[int, int]]:
        own = np.unique(b.column("v").to_numpy(), return_index=True)[1]  # a set comes twice where an id is repeated
        b = b.take(pa.array(own))
        sets = [unpacked(x) for x in b.column("shingles").to_pylist()]
        n, label, found, links = np.array([len(x) for x in sets]), b.column("label").to_numpy(), Union(len(sets)), []
        for at in (np.flatnonzero(label == x) for x in np.unique(label)):
            for i in at[1:].tolist():
                found.join(int(at[0]), i)
        for i, j in tree_pairs(n, label, [bitmaps(x >> np.uint64(16), 8) for x in sets], num, den):
            roots = np.fromiter(map(found.root, range(len(sets))), np.int64, len(sets))
            apart = roots[i] != roots[j]
            for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                if found.root(x) != found.root(y):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * both >= num * (int(n[x] + n[y]) - both):
                        found.join(x, y)
                        links.append((int(own[x]), int(own[y])))
        return links

    return by_tree(rows.select("tree", "v", "label", "shingles"), grow)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the class of each document under links of similarity >= num / den.

    ``component_id`` is the least id reachable. An empty or null text has no shingles and is its own class;
    a null id has a null class unless its text links it to others; repeated ids and texts share a class
    where their texts are similar. Other columns are not read. The result is staged, what led to it is deleted.
    """
    with scratch(docs.sparkSession), small_batches(docs.sparkSession):
        source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        heavy = frequent_shingles(source, k)
        sig = staged(signatures(source, k, num, den, heavy), "signatures")

        # Keys that several sets share. Frequent keys: at most HEAVY of them, aggregated before the shuffle.
        by_key = Window.partitionBy("key")
        light = sig.select("v", "n", F.explode("light").alias("key"))
        light = light.withColumns({"lo": F.min("v").over(by_key), "hi": F.max("v").over(by_key), "m": F.count("*").over(by_key), "shingles": F.sum("n").over(by_key)}).where("lo <> hi").select("key", "v", "n", "m", "shingles")
        light = staged(light.distinct(), "light-keys")
        hot = sig.select("v", "n", F.explode("hot").alias("key")).distinct()
        shared = hot.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("shingles")).where("lo <> hi").select("key", "m", "shingles")
        hot = staged(hot.join(F.broadcast(shared), "key"), "hot-keys")

        # A key's centre is its set with most shared keys: an original, whose copies each have shingles of their own.
        degree = staged(light.select("v").unionByName(hot.select("v")).groupBy("v").agg(F.count("*").alias("d")), "degrees")
        centre = lambda df: df.join(degree, "v").groupBy("key").agg(F.max(F.struct("d", "v"))["v"].alias("b"))
        pairs = light.join(centre(light), "key").select(F.col("v").alias("a"), "b").unionByName(hot.join(F.broadcast(centre(hot)), "key").select(F.col("v").alias("a"), "b"))
        stars = staged(pairs.where("a <> b").distinct(), "stars")
        vertices = staged(sig.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "vertices")
        links = staged(verified(source, staged(possible(stars, vertices, num, den), "star-pairs"), vertices, k, num, den), "star-links")
        first = staged(components(links), "star-classes")

        # Keys where classes still differ; keys with the same members are one tree.
        label = F.coalesce("label", "v").alias("label")
        named = lambda df: df.join(first, "v", "left").select(*df.columns, label)
        def mixed(df: DataFrame) -> DataFrame:
            return df.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")

        light, hot = staged(named(light), "light-named"), staged(named(hot), "hot-named")

        def in_blocks(df: DataFrame, by: str, weight: Column) -> DataFrame:
            """Each row of a group of total ``weight`` (in blocks) in all pairs of blocks that hold its own; most groups are one block."""
            df = df.withColumn("nb", F.ceil(weight).cast("int"))
            df = df.withColumn("i", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            return df.withColumn("tree", F.xxhash64(by, F.least("i", "j"), F.greatest("i", "j")))

        light, hot = (in_blocks(df, "key", F.col("m") / BLOCK_SETS + (F.col("m") * 64 + F.col("shingles")) * 0.75 / BLOCK_BYTES) for df in (light.join(mixed(light), "key", "left_semi"), hot.join(F.broadcast(mixed(hot)), "key", "left_semi")))
        cols = ["tree", "v", "n", "label"]
        rows = sized(light.select(*cols).unionByName(hot.select(*cols)), num, den).join(vertices.select("v", "bits"), "v")
        # Families that may still hold links: each member's set is sent once to its family, or to the block pairs of a large one.
        families = components(staged(candidate_edges(rows, num, den).distinct(), "candidates")).select("v", F.col("label").alias("family"))
        families = staged(families.join(vertices.select("v", "n"), "v").join(first, "v", "left").select("v", "n", "family", label), "families")
        size = families.groupBy("family").agg((F.count("*") / BLOCK_SETS + F.sum("n") * 6 / BLOCK_BYTES).alias("weight"))
        dealt = in_blocks(families.join(size, "family"), "family", F.col("weight")).select("tree", "v", "label")
        wanted = vertices.select("v", "id").join(families.select("v"), "v", "left_semi")
        more = family_links(dealt.join(shingle_sets(source, wanted, k), "v"), num, den)
        classes = components(links.unionByName(more))

        joined = sig.select("id", "n", "v").join(classes, "v", "left").withColumn("label", F.coalesce("label", "v"))
        least = joined.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component_id"))
        return staged(joined.join(least, "label", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "classes", keep=True)
