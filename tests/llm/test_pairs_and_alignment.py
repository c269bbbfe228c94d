"""Cross-tokenizer alignment, circulant MinHash and hard negatives against brute force, on rows with awkward cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
DOCS = "doc_id long, text string, row long, pairs string, v string, tile string"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["the", "an", "er", "tion", "ou", "qué", "ñ", "ß", "日本", " "]) for _ in range(r.randint(1, 4))) + r.choice(["", "", ",", ".\n", "!!", "'s"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    texts = [sentence(r, r.randint(1, 60)) for _ in range(40)]
    texts += [None, "", " ", "\n", "a", " a", "a ", "  two  blanks  ", "\ttab\n\n x \r\n", "▁ marker", "<|endoftext|> <s> </s> <0x41>", "😀👍🏽 é é ﬁ", "x" * 3000, " ".join(["word"] * 5000), "one two　three", "\x00 \x07"]
    texts += [texts[0]] * 6
    out = [(i, t, 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, (3, texts[3], None, None, None, None), (3, texts[4], None, None, None, None), (None, texts[5], None, None, None, None)]


def spelled_pieces(model):
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    return out


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(A))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    spell_b = spelled_pieces(model)
    docs, held = [], Counter()
    for t in texts:
        a = library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        raw = (" " + t).encode() if t else b""
        if b"".join(spell_b[i] for i in b) != raw:
            a, b = [], []
        size_a = [len(library.decode([i]).encode()) if "�" not in library.decode([i]) else len(library.id_to_token(i)) for i in a]
        ends_a, ends_b = np.cumsum(size_a).tolist() if a else [], np.cumsum([len(spell_b[i]) for i in b]).tolist() if b else []
        assert not a or ends_a[-1] == ends_b[-1] == len(raw)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if last < e <= c) for ids, ends in ((a, ends_a), (b, ends_b))))
            last = c
        links = [(x, y) for x, ex, sx in zip(a, ends_a, size_a) for y, ey in zip(b, ends_b) if ex - sx < ey and ey - len(spell_b[y]) < ex]
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(na, nb, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for na, nb, g, links, sha in docs]


@pytest.mark.parametrize("broadcast_pairs", [0, 1_000_000])
def test_alignment(spark, rows, broadcast_pairs):
    from artisieve.llm.alignment import corpus_alignment

    short = [r for r in rows if len(r[1] or "") < 4000]  # the brute force is quadratic
    docs = spark.createDataFrame(short, DOCS).repartition(3)
    got = corpus_alignment(docs, public_tokenizers.path(A), public_tokenizers.path(B), broadcast_pairs=broadcast_pairs).collect()
    want = [(r[0], *w) for r, w in zip(short, brute_alignment([r[1] for r in short]), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(1 for r in got if not r.n_a) >= 3
    assert corpus_alignment(docs.limit(0), public_tokenizers.path(A), public_tokenizers.path(B)).count() == 0


def test_fast_ids_are_the_libraries_on_every_character():
    import sentencepiece
    from tokenizers import Tokenizer

    from artisieve.llm.alignment import byte_level, pieces

    library = Tokenizer.from_file(public_tokenizers.path(A))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    a, b = byte_level(public_tokenizers.path(A)), pieces(public_tokenizers.path(B))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}{chr(c)}1 {chr(c)}!{chr(c)} \n" for c in points[s : s + 500]) for s in range(0, len(points), 500)]
    for s in range(0, len(texts), 100):
        assert [x.tolist() for x in a.encode(texts[s : s + 100])] == [e.ids for e in library.encode_batch([" " + t for t in texts[s : s + 100]], add_special_tokens=False)]
    for s in range(0, len(texts), 40):
        got, want = b.encode(texts[s : s + 1])[0], model.encode(texts[s])
        assert got.tolist() == want if got is not None else "▁" in texts[s]


def test_alignment_memo_may_fill(rows):
    from artisieve.llm.alignment import Aligner

    texts = [r[1] for r in rows]
    plain, tight = (Aligner(public_tokenizers.path(A), public_tokenizers.path(B), bound) for bound in (300_000, 5))
    one = plain.align(texts)
    for _ in range(2):
        two = tight.align(texts)
        assert one["groups_sha256"] == two["groups_sha256"] and one["pairs"].equals(two["pairs"]) and one["times"].equals(two["times"])


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_classes(rows, k, num):
    sets = [shingles(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(s), c := least.get(root(i)), r[0] == c) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("block", "num", "k"), [(4096, 80, 4), (3, 80, 4), (4096, 60, 5)])
def test_minhash_classes(spark, rows, monkeypatch, block, num, k):
    from artisieve.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    r = random.Random(2)
    base = sentence(r, 120).split()
    family = []
    for i in range(40):  # most are alike to the first, some only to each other, some just below the threshold
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 7])):
            w[r.randrange(len(w))] = f"new{r.randrange(9)}"
        family.append((100 + i, " ".join(w), 1, "", "", ""))
    chain = list(base)
    for i in range(12):  # a chain: neighbours are alike, ends are not
        chain[i * 9 % 120] = f"link{i}"
        family.append((200 + i, " ".join(chain), 1, "", "", ""))
    every = rows + family
    got = Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(every, DOCS).repartition(5), k=k, num=num).collect()))
    assert got == brute_classes(every, k, num)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_minhash_forests_hold_both_ends_of_every_open_pair(spark):
    from artisieve.llm import minhash

    marks = bytearray(bytes(128))
    # Sets 1 and 2 are one class, set 3 is another; both of its pairs with the class are open.
    rows = [(t, 10 * t + i, 50, 10 * t if i < 2 else 10 * t + i, marks) for t in range(5) for i in range(3)]
    found = minhash.forests(spark.createDataFrame(rows, "tree long, v long, n long, label long, marks binary"), 79, 80, 100).collect()
    assert {x for pair in found for x in pair} == {r[1] for r in rows}
    assert len(found) == 10


def test_circulant_signatures_follow_their_definition():
    from artisieve.llm import minhash
    from artisieve.llm.common import mix64

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 2000).astype(np.uint64)
    sets = [base[:1000], base[100:1100], base[:1], base[500:1500]]
    got = minhash.coordinates(sets, 256)
    assert np.unique(mix64(np.arange(1 << 16, dtype=np.uint64))).size == 1 << 16
    assert got.shape == (4, 256)
    for i in (0, 1, 255):
        with np.errstate(over="ignore"):
            want = min(int(x) for x in mix64((mix64(sets[1] ^ minhash.SECOND) + np.uint64(i)) * minhash.SECOND))
        assert int(got[1, i]) == want
    for other, t in ((1, 900 / 1100), (3, 500 / 1500)):
        assert abs((got[0] == got[other]).mean() - t) < 0.1
    assert minhash.agreement(80, 100, 128) == 79


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (65, 7, 129), (200, 131, 90), (3, 0, 5)])
def test_strassen_is_exact(shape):
    from artisieve.llm.hard_negatives import strassen

    m, k, n = shape
    r = np.random.default_rng(1)
    a, b = r.integers(-(1 << 24), 1 << 24, (m, k)), r.integers(-(1 << 24), 1 << 24, (k, n))
    for leaf in (1, 16, 32):
        assert (strassen(a, b, leaf) == a @ b).all()
    wide = r.integers(-(1 << 62), 1 << 62, (40, 40))  # sums overflow on the way, the product by the identity does not
    assert (strassen(wide, np.eye(40, dtype=np.int64), 4) == wide).all()


def brute_negatives(rows, is_anchor, many, share):
    good = {(i, l, tuple(int(np.floor(256.0 * c)) for c in x)) for i, x, l in rows if i is not None and l is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    out = Counter()
    for i, l, x in good:
        if is_anchor(i):
            scored = {(-dot(x, y), j, m) for j, m, y in good}
            for s, j in sorted({(s, j) for s, j, m in scored if m == l and j != i})[:many]:
                window = sorted({(t, k) for t, k, m in scored if m != l and share * -s <= 100 * -t <= 100 * -s})[:many]
                out.update((i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(window))
    return out


@pytest.mark.parametrize("blocks", [None, (3, 50)])
def test_hard_negatives(spark, blocks):
    from artisieve.llm.hard_negatives import hard_negatives

    r = np.random.default_rng(6)
    rows = [(i, r.normal(0, 0.2, 20).round(2).tolist(), int(l)) for i, l in enumerate(r.integers(0, 3, 260))]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]  # copies of an anchor's vector, so that scores tie
    rows += [(300, [None] * 20, 1), (301, [float("nan")] * 20, 1), (302, [float("inf")] + [0.0] * 19, 1), (303, None, 1), (304, [0.1] * 20, None), (None, [0.1] * 20, 1), (305, [], 1), (306, [0.5, -0.5], 0), (307, [0.0] * 20, 2)]
    rows += [rows[10], rows[10], (10, rows[11][1], 2), (400, [-1.0] * 20, 7)]
    table = spark.createDataFrame([(i, x, l, "c", 1, 2) for i, x, l in rows], "vec_id long, embedding array<double>, label int, chosen string, tile int, kind int").repartition(4)
    got = Counter(map(tuple, hard_negatives(table, "vec_id % 10 = 0", blocks=blocks).collect()))
    assert got == brute_negatives(rows, lambda i: i % 10 == 0, 5, 80)
    assert len(got) > 300
    assert hard_negatives(table, "vec_id < 0").count() == 0
    assert hard_negatives(table.limit(0), "vec_id % 10 = 0").count() == 0


@pytest.mark.parametrize("rotations", [1, 2])
def test_ann_recall_holds_with_keys_of_two_axes(spark, rotations):
    from artisieve.llm.ann import nearest

    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for q, v in nearest(table, table.where("vec_id % 60 = 0").select("vec_id"), rotations=rotations).select("query_id", "vec_id").collect():
        got[q].add(v)
    found = total = 0
    for q in range(0, 3000, 60):
        scores = x @ x[q]
        scores[q] = -2
        want = set(np.argsort(-scores)[:20].tolist())  # cosines of 0.3 to 0.45
        found, total = found + len(want & got[q]), total + 20
    assert found / total >= 0.9
