"""The ten operators and the pipeline against brute force, on small fixtures with awkward rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string"


def sentence(r: random.Random, n: int) -> str:
    syllables = ["the", "an", "er", "tion", "ou", "ble", "st", "re", "qué", "ñ", "ß"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ",", "%%%"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    texts = [sentence(r, r.randint(1, 160)) for _ in range(60)]
    base = sentence(r, 120)
    words = base.split()
    near = []
    for i in range(12):
        w = list(words)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "changed%d" % r.randrange(99)
        near.append(" ".join(w))
    passage = sentence(r, 70)
    shared = [sentence(r, 40) + "\n" + passage + "\n" + sentence(r, 30) for _ in range(6)]
    long = " ".join([sentence(r, 9000), "x" * 5000])
    texts += near + [base] * 5 + shared + ["", " \n\t", None, "one", "one", "one two three", long, "Some CAPITAL Words\tand\x0btabs", "Ünïcode İ ß   日本 <|endoftext|> <s> ▁ ▁▁"]
    out = [(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return out + [(None, texts[0], None, None, None, None, None), (3, texts[3], "en", "s", 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_token_counts(docs, empty, rows):
    import sentencepiece

    from artisieve.llm.token_counts import counter, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, path).collect())
    want = []
    for r in rows:
        n = len(library.encode(r[1] or ""))
        want.append((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), n, n > 4096))
    assert got == sorted(want)
    assert token_counts(empty, path).count() == 0
    assert counter(path).splits and all(len(library.encode(" " + p)) - len(library.encode("")) <= 2 for p in list(counter(path).proven)[:50])


def check_packing(pieces, rows, tokenizer):
    ids = defaultdict(list)
    for r in rows:
        key = r[0] if r[0] is not None else -1
        ids[key].append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id if p.doc_id is not None else -1].append(p)
        by_seq[p.sequence_id].append(p)
    assert sorted(by_doc) == sorted(ids)
    for key, got in by_doc.items():
        assert sum(p.length for p in got) == sum(map(len, ids[key]))
        if len(ids[key]) == 1:
            at = 0
            for p in sorted(got, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[key][0])
                assert p.ids_crc32 == zlib.crc32(ids[key][0][at : at + p.length].tobytes())
                at += p.length
    padding = 0
    for got in by_seq.values():
        at = 0
        for p in sorted(got, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    from artisieve.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(docs, path).collect()
    check_packing(pieces, rows, Tokenizer.from_file(path))
    assert pack(empty, path).count() == 0


def test_nnls_stays_within_the_histogram():
    from artisieve.llm.packing import bin_edges, combinations, nnls_counts

    edges = bin_edges(512)
    combos = combinations(edges, 512)
    histogram = np.random.default_rng(0).integers(0, 90, len(edges))
    counts = nnls_counts(combos, histogram)
    used = np.zeros(len(edges), int)
    for c, n in zip(combos, counts, strict=True):
        assert sum(int(edges[b]) * m for b, m in c.items()) <= 512
        for b, m in c.items():
            used[b] += n * m
    assert (used <= histogram).all() and (used * edges).sum() > 0.8 * (histogram * edges).sum()


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, empty, rows, k, num):
    from artisieve.llm.jaccard_join import near_duplicates

    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = sorted((-1 if r[0] is None else r[0], len(sets[i]), min(least[find(i)])) for i, r in enumerate(rows))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, k, num, 100).collect())
    assert got == want
    assert near_duplicates(empty, k, num, 100).count() == 0


def test_signature_tree_loses_no_pair():
    from artisieve.llm.jaccard_join import bitmaps, tree_pairs

    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, n, replace=False), r.integers(0, 2**63, m).astype(np.uint64)])) for n, m in [(380, 5), (390, 3), (360, 10), (200, 3), (100, 200), (370, 2)] * 8]
    n = np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for a, b in tree_pairs(n, np.arange(len(n)), [bitmaps(s) for s in sets], 80, 100) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert (j, i) in found


def repeated_words(rows, least=50):
    seen, cover = defaultdict(set), defaultdict(set)
    for r in rows:
        if r[0] is not None:
            w = words(r[1])
            for i in range(len(w) - least + 1):
                seen[tuple(w[i : i + least])].add((r[0], i))
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                cover[d].update(range(i, i + least))
    return cover


def test_suffix_dedup(docs, empty, rows):
    from artisieve.llm.suffix_dedup import repeated_passages

    cover = defaultdict(set)
    for r in repeated_passages(docs).collect():
        assert r.end_word - r.start_word >= 50
        cover[r.doc_id].update(range(r.start_word, r.end_word))
    assert cover == repeated_words(rows)
    assert repeated_passages(empty).count() == 0


def test_chain_dedup(docs, empty, rows):
    from artisieve.llm.chain_dedup import drop_repeats, fuzzy_passages

    found = fuzzy_passages(docs).collect()
    cover = defaultdict(set)
    for r in found:
        assert r.source_id < r.doc_id and 0.8 <= r.identity <= 1
        cover[r.doc_id].update(range(r.start_word, r.end_word))
        cover[r.source_id].update(range(r.source_start, r.source_end))
    want = repeated_words(rows)
    assert set(want) <= set(cover)
    assert all(want[d] <= cover[d] for d in want)
    kept = drop_repeats(docs).collect()
    left = {r.doc_id: r.text for r in kept}
    first = min(want)
    assert left[first] == dict((r[0], r[1]) for r in rows)[first]
    assert not repeated_words([(r.doc_id, r.text) for r in kept if r.doc_id is not None])
    assert fuzzy_passages(empty).count() == 0 and drop_repeats(empty).count() == 0


def test_chain_and_cut():
    from artisieve.llm.chain_dedup import chain, cut_words

    assert chain([0, 10, 20, 30], [5, 15, 90, 35], 8) == [[0, 1, 3], [2]]
    assert chain([0, 0, 5], [3, 9, 4], 8)[0] in ([0, 2],)
    assert cut_words("a b  c\nd e", [(1, 3)]) == "a d e"
    assert cut_words("a b", [(0, 2)]) == ""


def test_template_leaks(spark, docs, empty):
    from artisieve.llm.decontamination import keep_unleaked, leaks

    r = random.Random(9)
    filler = sentence(r, 50)
    item = "A train leaves Boston at 60 km per hour and after 60 minutes Anna counts 12 wagons behind the slow red engine of the train"
    other = item.replace("60 km", "75 km").replace("60 minutes", "75 minutes").replace("Anna", "Bela").replace("12", "40")
    mixed = item.replace("60 km", "75 km").replace("Anna", "Bela")  # 60 becomes 75 in one place only
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (5, "12 13 14")], "item_id long, text string")
    table = spark.createDataFrame([(1, f"{filler}\n{item} {filler}"), (2, f"{filler}\n{other}. {filler}"), (3, f"{filler}\n{mixed} {filler}"), (4, filler), (5, None), (6, "")], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.reparameterised for x in leaks(table, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True}
    assert sorted(x.doc_id for x in keep_unleaked(table, bench).collect()) == [3, 4, 5, 6]
    assert leaks(empty, bench).count() == 0 and leaks(table, bench.limit(0)).count() == 0
    assert keep_unleaked(docs, bench.limit(0)).count() == docs.count()


def test_nearest(spark):
    from artisieve.llm.ann import hadamard, nearest

    x = np.random.default_rng(0).normal(size=(4, 8))
    assert np.allclose(hadamard(hadamard(x)), x)
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + 0.3 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    data += [(600 + i, data[0][1]) for i in range(50)]
    bad = [(None, data[1][1]), (700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, None] * 8), (704, [float("inf")] * 16)]
    vectors = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for a in sorted(nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"), tables=8).collect(), key=lambda a: (a.query_id, a["rank"])):
        got[a.query_id].append((a.vec_id, a.score))
    m = {i: np.array(v, np.float64) for i, v in data}
    hit = 0
    queries = [i for i in m if i % 20 == 0]
    for q in queries:
        want = sorted(((-float(m[q] @ m[v]), v) for v in m if v != q))[:20]
        assert len(got[q]) == 20 and all(abs(s - float(m[q] @ m[v])) < 1e-9 for v, s in got[q])
        assert [v for v, _ in got[q]] == [v for _, v in sorted((-s, v) for v, s in got[q])]
        hit += len({v for _, v in want} & {v for v, _ in got[q]})
    assert set(got) == set(queries) and hit >= 0.9 * 20 * len(queries)
    assert nearest(vectors.limit(0), vectors.select("vec_id").limit(0)).count() == 0


def labelled(spark):
    r = random.Random(1)
    rows = []
    for i in range(1500):
        bad = i % 5 == 0
        text = sentence(r, 60).split()
        if bad:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["idiot", "moron", "scum", "trash"]))
        rows.append((i, " ".join(text) if i % 3 else " | ".join(text), "en", "s", 1, "x", "y"))
    labels = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(1500)] + [(None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality(spark, docs, empty):
    from artisieve.llm import toxicity
    from artisieve.llm.quality import quality_scores

    data, labels = labelled(spark)
    model = toxicity.train(data, labels, held_out=(5, 0))
    held = lambda i, n, k: zlib.crc32(str(i).encode()) % n == k
    got = {r.doc_id: r.score for r in toxicity.score(data, model).collect()}
    right = [(s >= 0.5) == (i % 5 == 0) for i, s in got.items() if held(i, 5, 0)]
    assert len(right) > 100 and sum(right) > 0.97 * len(right)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.keep_clean(data, model).count() == sum(s < 0.5 for s in got.values())
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    got = {r.doc_id: r.score for r in quality_scores(data, labels, held_out=(4, 2)).collect()}
    right = [(s >= 0.7) == (i % 3 != 0) for i, s in got.items() if held(i, 4, 2)]
    assert len(right) > 100 and sum(right) > 0.95 * len(right)
    assert quality_scores(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert quality_scores(empty, labels).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    data, labels = labelled(spark)
    r = random.Random(3)
    passage, question, copy = sentence(r, 70), sentence(r, 40), sentence(r, 90)
    extra = [(2000, sentence(r, 80) + " " + passage), (2001, sentence(r, 90) + " " + passage), (2002, sentence(r, 60) + " " + question), (2003, copy), (2004, copy), (2005, None), (2006, ""), (None, sentence(r, 30))]
    docs = data.drop("id", "row").unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES][-1] == "packing" and len(corpus_pipeline.STAGES) == 5
    table, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, str(tmp_path))
        if k < 4:
            assert table.columns == docs.columns, name
            table.write.parquet(f"{tmp_path}/{name}")
            table = spark.read.parquet(f"{tmp_path}/{name}")
            before = {x.doc_id: x.text for x in table.collect()}
    toxic = [i for i in range(1500) if i % 5 == 0]
    assert sum(i in before for i in toxic) < 0.03 * len(toxic)
    assert sum(i in before for i in range(1500) if i % 5) > 0.99 * 1200
    assert passage in before[2000] and passage not in before[2001] and 2002 not in before and 2003 in before and 2004 not in before
    assert before[2005] is None and before[2006] == "" and None in before
    check_packing(table.collect(), [(k, v) for k, v in before.items()], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
