"""Cases that earlier forms of the corpus operators lost."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest


def brute_text_ppm(train, texts, order=5, discount=0.3):
    """Prediction by partial matching over running texts with a dictionary trie, update and symbol exclusion."""
    spell = lambda t: b"\t" * (order - 1) + b" " + b" ".join([*t.encode().lower().split(), b"\n"])
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in map(spell, train):
        for i in range(order, len(t)):
            counts[order][t[i - order : i]][t[i]] += 1
    for k in range(order, 0, -1):
        for context, seen in counts[k].items():
            for symbol in seen:
                counts[k - 1][context[1:]][symbol] += 1
    out = []
    for t in map(spell, texts):
        total = 0.0
        for i in range(order, len(t)):
            gone: set = set()
            for k in range(order, -1, -1):
                seen = counts[k].get(t[i - k : i])
                if not seen:
                    gone = set()
                    continue
                here = {x: c for x, c in seen.items() if x not in gone}
                size = sum(here.values())
                if t[i] in here:
                    total += math.log10((here[t[i]] - discount) / size)
                    break
                if here:
                    total += math.log10(len(here) * discount / size)
                gone = set(seen)
            else:
                total -= math.log10(252 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 100, 4_000_000])
def test_op9_contexts_cross_blanks(spark, monkeypatch, broadcast_rows):
    from artisieve.llm import lm_scoring, queries

    r = random.Random(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = [" ".join(r.choice(["red fox", "red fox", "old dog", "one Ünï"]) for _ in range(r.randint(0, 30))) for _ in range(80)]
    texts += ["fox red", "dog old fox", None, "", " \n", "x" * 5000, "red fox old dog", "dog old fox red"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = lm_scoring.text_scores
    monkeypatch.setattr(lm_scoring, "text_scores", lambda d, **o: plain(d, broadcast_rows=broadcast_rows, frequent=3, **o))
    monkeypatch.setattr(queries, "table", lambda *_: table)
    got = {x.doc_id: x for x in queries.op9_lm_scoring(spark, "").collect()}
    texts = [t or "" for t in texts]
    assert got[len(texts) - 1].score != got[len(texts) - 2].score  # the order of words counts
    want = brute_text_ppm([t for i, t in enumerate(texts) if not held(i)], texts)
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-9)
    train = Counter(w for i, t in enumerate(texts) if not held(i) for w in [*t.encode().lower().split(), b"\n"])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(texts):
        w = [*t.encode().lower().split(), b"\n"]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held(i), len(w), sum(train[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
    assert plain(table.limit(0)).count() == 0


def test_op7_short_chains_beside_another_source(spark):
    from artisieve.llm.chain_dedup import fuzzy_passages, seeds
    from artisieve.llm.common import word_hashes

    k, window = 8, 16
    picked = lambda w: set(seeds(*word_hashes(pa.array([" ".join(w)])), k, window)[0].tolist())
    fresh = lambda name, n, i: [f"{name}{i}x{j}" for j in range(n)]
    for i in range(5000):  # a and c share two phrases 18 to 37 words apart, b and c all 55 words
        p = fresh("p", 55, i)
        b, c = fresh("b", 40, i) + p + fresh("d", 40, i), fresh("e", 40, i) + p + fresh("f", 40, i)
        both = sorted(x - 40 for x in picked(b) & picked(c) if 40 <= x <= 40 + 55 - k)
        if len(both) < 4 or not 18 <= both[-1] - both[0] <= 37:
            continue
        u, v = both[0], both[-1]
        a = fresh("g", 40, i) + p[u : u + k] + fresh("h", v - u - k, i) + p[v : v + k] + fresh("k", 40, i)
        if {40, 40 + v - u} <= picked(a):
            break
    else:
        pytest.fail("no such texts")
    table = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
    got = [(x.doc_id, x.start_word, x.end_word, x.source_id) for x in fuzzy_passages(table, k=k, window=window).collect()]
    assert got == [(3, 40, 95, 2)]


def test_op3_measures_outlive_a_full_memo():
    from artisieve.llm.decontamination import Spelling, template

    text = "It ran 12km in a day and then 5kg of red sand fell"
    small = Spelling(bound=3)
    for _ in range(2):
        assert np.array_equal(template(text, small).values, template(text, Spelling()).values)


def test_op3_literal_copies_and_consistent_stretches(spark):
    from artisieve.llm.decontamination import leaks, stretches

    assert [*stretches(np.array([1, 2, 1, 3, 1]), np.array([1, 2, 9, 3, 9]))] == [(0, 2), (1, 5)]
    assert [*stretches(np.array([1, 2, 3]), np.array([5, 5, 6]))] == [(0, 1), (1, 3)]
    assert [*stretches(np.zeros(0), np.zeros(0))] == [(0, 0)]
    short = "What is the capital of France?"
    tail = " ".join(f"word{chr(97 + i)}" for i in range(30))
    long = f"A cart takes 60 bricks and then it takes 60 stones while we wait here {tail}"
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    texts = [short, "Q: " + short, "so what is the capital of france then", long, long.replace("60 stones", "61 stones"), "nothing of it is here"]
    got = {(x.doc_id, x.item_id): x.reparameterised for x in leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1): False, (1, 1): False, (2, 1): False, (3, 2): False, (4, 2): True}


def test_op7_finds_fuzzy_passages(spark):
    from artisieve.llm.chain_dedup import fuzzy_passages

    r, rows = random.Random(1), []
    for i in range(200):  # 60 words of which 9 are changed
        p = [f"p{i}x{j}" for j in range(60)]
        q = list(p)
        for j in r.sample(range(60), 9):
            q[j] = f"q{i}x{j}"
        rows += [(2 * i, " ".join(f"a{i}x{j}" for j in range(40)) + " " + " ".join(p)), (2 * i + 1, " ".join(q) + " " + " ".join(f"b{i}x{j}" for j in range(40)))]
    found = {(x.doc_id, x.source_id) for x in fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(2 * i + 1, 2 * i) for i in range(200)} and len(found) > 0.85 * 200


@pytest.mark.parametrize(("words", "kind"), [(60, "replaced"), (60, "moved"), (100, "replaced"), (100, "moved")])
def test_op7_recall_at_identity_85(spark, words, kind):
    """Of passages with 15 % of their words replaced, or half of that added and half lost, 0.9 are found at least."""
    from artisieve.llm.chain_dedup import fuzzy_passages

    r, rows = random.Random(7), []
    for i in range(150):
        p = [f"p{i}x{j}" for j in range(words)]
        q, edits = list(p), round(words * 0.15)
        if kind == "replaced":
            for j in r.sample(range(words), edits):
                q[j] = f"q{i}x{j}"
        else:
            for j in sorted(r.sample(range(words), edits // 2), reverse=True):
                del q[j]
            for j in range(edits - edits // 2):
                q.insert(r.randrange(len(q) + 1), f"q{i}x{j}")
        for d, (name, body) in enumerate((("a", p), ("b", q))):
            around = [[f"{name}{side}{i}x{j}" for j in range(40)] for side in "lr"]
            rows.append((2 * i + d, " ".join(around[0] + body + around[1])))
    found = fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.source_id) for x in found} <= {(2 * i + 1, 2 * i) for i in range(150)}
    assert len({x.doc_id for x in found}) >= 0.9 * 150
    for x in found:  # nothing but the passages
        assert 40 <= x.start_word < x.end_word <= 40 + words + 9 and 40 <= x.source_start < x.source_end <= 40 + words and 0.8 <= x.identity <= 1


def test_op7_chain_equals_square_time_chaining():
    from artisieve.llm.chain_dedup import chain

    r = random.Random(3)
    for _ in range(300):
        n, span = r.randrange(1, 30), r.choice([6, 30, 200])
        found = sorted({(r.randrange(span), r.randrange(span)) for _ in range(n)})
        p, q = [x for x, _ in found], [y for _, y in found]
        f = []
        for j in range(len(p)):
            ways = [f[i] - 0.1 * (p[j] - p[i] + q[j] - q[i]) for i in range(j) if p[i] < p[j] and q[i] < q[j]]
            f.append(8 + max(0.0, *ways, 0.0))
        got = chain(p, q, 8)
        assert sorted(i for c in got for i in c) == list(range(len(p)))
        assert all(p[a] < p[b] and q[a] < q[b] for c in got for a, b in zip(c, c[1:]))
        score = lambda c: 8 * len(c) - sum(0.1 * (p[b] - p[a] + q[b] - q[a]) for a, b in zip(c, c[1:]))
        assert score(got[0]) == pytest.approx(max(f))


def test_op7_alignment_equals_dynamic_programming():
    from artisieve.llm.chain_dedup import align, common, extend, reach

    r = random.Random(4)
    for _ in range(300):
        x, y = ([r.randrange(r.choice([2, 5])) for _ in range(r.randrange(14))] for _ in range(2))
        longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        score = [[-3.0 * (i + j) + (i + j) / 2 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                same = x[i - 1] == y[j - 1]
                longest[i][j] = max(longest[i - 1][j], longest[i][j - 1], longest[i - 1][j - 1] + same)
                score[i][j] = max(score[i - 1][j] - 2.5, score[i][j - 1] - 2.5, score[i - 1][j - 1] + (1 if same else -2))
        assert common(np.array(x, np.uint32), np.array(y, np.uint32)) == longest[-1][-1]
        i, j = extend(x, y, drop=1e9)
        assert score[i][j] == max(max(row) for row in score)
    a, b = np.arange(100, dtype=np.uint32), np.concatenate([np.arange(20), [500], np.arange(20, 60), np.arange(63, 100)]).astype(np.uint32)
    assert reach(a, b) == (100, 98, 97) and reach(a, b[:0]) == (0, 0, 0)
    assert align(a, b, np.array([30, 40]), np.array([31, 41]), 8) == (0, 100, 0, 98, 97)
    assert align(a, b, np.array([10, 40]), np.array([10, 41]), 8) == (0, 100, 0, 98, 97)


def test_op7_chains_of_a_batch_equal_single_ones():
    from artisieve.llm.chain_dedup import align, plain_spans

    r, rows = random.Random(6), []
    for _ in range(400):
        core = [r.randrange(1000) for _ in range(r.choice([8, 20]))]
        side = lambda: [r.randrange(r.choice([3, 40, 1000])) for _ in range(r.randrange(30))]
        lead, trail = side(), side()
        x, y = ((lead if r.random() < 0.5 else side()), (trail if r.random() < 0.5 else side())), (lead, trail)
        base = r.randrange(3) * 64, r.randrange(3) * 64
        changed = [-1 if r.random() < 0.02 else w for w in core]
        anchors = [0] if len(core) == 8 else [0, 3, 12]
        bend = r.choice([0, 0, 0, 1])
        ps, qs = [base[0] + len(x[0]) + i for i in anchors], [base[1] + len(y[0]) + i for i in anchors]
        if len(anchors) > 1:
            qs[-1] -= bend
        a, b = ([*s[0], *c, *s[1]] for s, c in ((x, core), (y, changed)))
        rows.append((ps, qs, base[0], np.array(a, np.int64).astype(np.uint32), base[1], np.array(b, np.int64).astype(np.uint32)))
    cols = [*zip(*rows, strict=True)]
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    arrays = [pa.array([w.tobytes() for w in c] if t == pa.binary() else list(c), t) for c, t in zip(cols, kinds, strict=True)]
    batch = pa.RecordBatch.from_arrays(arrays, ["ps", "qs", "a_base", "a_words", "b_base", "b_words"])
    done = 0
    for part, first in ((batch.slice(0, 150), 0), (batch.slice(150), 150)):
        at, spans = plain_spans(part, 8)
        done += len(at)
        for i, got in zip(at.tolist(), spans.T.tolist(), strict=True):
            ps, qs, a0, a, b0, b = rows[first + i]
            assert tuple(got) == align(a, b, np.array(ps) - a0, np.array(qs) - b0, 8)
    assert 100 < done < 400


def test_word_hashes_read_all_words():
    from artisieve.llm.common import minimisers, word_hashes, words_of

    r = random.Random(3)
    texts = ["", None, "  ", "A b\tA", "b", " \x0b\x0c\r\nÜx y  Z ", "z" * 3000, "ab", "c", *("".join(r.choice("abAB \n") for _ in range(r.randint(0, 60))) for _ in range(200))]
    for array in (pa.array(texts), pa.array([None, *texts, "x"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        for most in (4, 1 << 18):
            hashes, ends = word_hashes(array, most)
            spelt = [words_of(t) for t in texts]
            assert np.diff(ends).tolist() == [len(w) for w in spelt]
            names = dict(zip((w for ws in spelt for w in ws), hashes.tolist(), strict=True))
            assert len(set(names.values())) == len(names)
            assert hashes.tolist() == [names[w] for ws in spelt for w in ws]
    for n, window in [(0, 4), (3, 4), (4, 4), (200, 1), (200, 7), (200, 15)]:
        h = np.random.default_rng(n).integers(0, 90, n).astype(np.uint64)
        want = {i for s in range(max(n - window + 1, min(n, 1))) for i in range(s, min(s + window, n)) if h[i] == h[s : s + window].min()}
        assert set(minimisers(h, window).tolist()) == want


@pytest.mark.parametrize("block", [4, 8192])
def test_op2_family_below_the_threshold_stays_linear(spark, monkeypatch, block):
    """2,000 sets of which all pairs are nearly similar and few are: whole families go to few blocks."""
    from artisieve.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block * 100)
    made = []
    plain = jaccard_join.family_links
    monkeypatch.setattr(jaccard_join, "family_links", lambda rows, *a: (made.append(rows.count()), plain(rows, *a))[1])
    r = random.Random(7)
    core = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(600):
        w = list(core)
        for j in r.sample(range(100), 2 if i % 50 else 1):
            w[j] = f"x{i}y{j}"
        texts.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [{tuple(t.split()[i : i + 4]) for i in range(97)} for t in texts]
    up = list(range(600))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(600):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 88 * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(table, 4, 88, 100).collect()}
    assert got == {i: find(i) for i in range(600)}
    assert sum(made) <= 600 * -(-600 // (block * 100))


@pytest.mark.parametrize("rotations", [None, 2])
def test_op1_few_candidates_ties_and_repeated_ids(spark, rotations):
    from artisieve.llm.ann import nearest

    r = np.random.default_rng(4)
    data = [(i, r.normal(size=8).tolist()) for i in range(30)] + [(40 + i, [float(i + 1), 0.0]) for i in range(5)]
    data += [(50, [0.0, -0.0, 1.0]), (51, [-0.0, 0.0, 1.0]), (52, [0.0, 0.0, 2.0]), (53, [1.0, 0.0, 2.0]), (54, [0.0, 1.0, 2.0]), (53, [1.0, 0.0, 2.0])]
    data += [(60, [1.0, 2.0, 3.0, 4.0]), (60, [4.0, 3.0, 2.0, 1.0]), (61, [1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*x, 7) for x in data], "vec_id long, embedding array<double>, score int").repartition(3)
    got: dict = {}
    for x in sorted(nearest(table, table.select("vec_id"), top=20, rotations=rotations).collect(), key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for q in range(30):
        want = sorted((-float(np.dot(data[q][1], v)), i) for i, v in data[:30] if i != q)[:20]
        assert len(got[q]) == 20 and sum(v in {i for _, i in want} for v, _ in got[q]) >= 14
    assert [v for v, _ in got[40]] == [44, 43, 42, 41]
    assert got[50] == [(52, 2.0), (53, 2.0), (54, 2.0), (51, 1.0)]
    assert got[60] == [(61, 10.0)] and got[61] == [(60, 10.0)]


def test_near_duplicate_stage_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(60))
    near, other = base.replace("w30", "x30"), " ".join(f"o{i}" for i in range(60))
    rows = [(1, base), (1, base), (2, near), (2, other), (None, base), (3, "  "), (3, "  "), (4, None), (4, None), (5, other + " more"), (6, "short"), (6, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, rank string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((x.doc_id, x.text) for x in kept.collect() if x.text)
    assert got == [(1, base), (2, other), (3, "  "), (3, "  "), (6, "short")]
    assert kept.where("text IS NULL").count() == 2


def test_pipeline_runs_do_not_share_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["red", "fox", "sees", "old", "dog", "sun"]) + str(r.randrange(40)) for _ in range(30)), "en", "s", 1) for i in range(40)]
    spark.createDataFrame([*docs, docs[0], (1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a question that nothing holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert first.count() == second.count() > 30


def test_op3_repeated_rows_clashes_and_long_texts(spark):
    from artisieve.llm.decontamination import keep_unleaked, leaks

    item = "what is the slow red fox doing at night when all others sleep"
    loop = " ".join([item] * 40)  # one window of the item at 40 places
    rows = [(1, item), (1, item), (2, loop), (None, "so " + item), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, "k", 3) for i, t in rows], "doc_id long, text string, h long, item long, key string, row int").repartition(2)
    bench = spark.createDataFrame([(7, item, "x"), (8, item, "y"), (8, loop, "z"), (None, item, "n")], "item_id long, text string, h string")
    for table in (docs, docs.withColumn("doc_id", docs["doc_id"].cast("string"))):
        got = Counter((x.doc_id and int(x.doc_id), x.item_id) for x in leaks(table, bench).collect())
        assert got == {(d, i): 1 + (d == 1) for d in (1, 2, None) for i in (7, 8, None)}
    assert sorted(x.doc_id for x in keep_unleaked(docs, bench).collect()) == [3, 4]


def test_first_holders_without_joins_of_large_groups(spark, monkeypatch):
    from artisieve.llm import chain_dedup

    monkeypatch.setattr(chain_dedup, "OFTEN", 10)
    rows = [(row, row % 50, p, seed, seed * 10 + row % (1 + seed)) for seed in range(6) for row in range(4 + 10 * (seed % 3)) for p in range(1 + (row + seed) % 2)] + [(7, 7, 3, 99, 1)]
    made = chain_dedup.first_holders(spark.createDataFrame(rows, "row long, id long, p int, seed long, block long"))
    want = set()
    for row, i, p, seed, block in rows:
        for same in ([x for x in rows if x[3] == seed], [x for x in rows if x[3:] == (seed, block)]):
            b = min((x[1], x[0], x[2]) for x in same)
            if b[1] != row:
                want.add((row, i, p, b[1], b[0], b[2]))
    got = [tuple(x) for x in made.collect()]
    assert set(got) == want and len(want) > 50
    # Joins keep all places, hot or not: none has the large groups alone on both sides.
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_first_holders_use_one_exchange(spark):
    from artisieve.llm import chain_dedup

    made = chain_dedup.first_holders(spark.createDataFrame([(1, 1, 0, 5, 6), (2, 2, 0, 5, 6)], "row long, id long, p int, seed long, block long"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(x) for x in made.collect()} == {(2, 2, 0, 1, 1, 0)}


def test_matches_that_come_twice_count_once(spark):
    from artisieve.llm.chain_dedup import chains

    rows = [(1, 1, 0, 0, x, x + 3) for x in (0, 20, 50)]
    got = [chains(spark.createDataFrame(r, "row long, id long, b long, b_id long, p int, q int"), 8, 50).collect() for r in (rows, rows + rows[1:])]
    assert got[0] == got[1] and len(got[0]) > 0


def test_op7_seeds_go_before_slices_are_cut(spark, monkeypatch, tmp_path):
    from artisieve.llm import chain_dedup, common

    left, plain = [], chain_dedup.both_sides
    text = " ".join(f"w{j}" for j in range(80))

    def seen(*args):
        left.extend(sorted(x.name.rsplit("-", 1)[0] for x in (tmp_path / "artisieve").iterdir()))
        return plain(*args)

    monkeypatch.setattr(chain_dedup, "both_sides", seen)
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    got = chain_dedup.fuzzy_passages(spark.createDataFrame([(1, text), (2, "x y " + text)], "doc_id long, text string"))
    assert [(x.doc_id, x.start_word, x.end_word, x.source_id) for x in got.collect()] == [(2, 2, 82, 1)]
    assert left == ["chains"]
    assert [x.name.rsplit("-", 1)[0] for x in (tmp_path / "artisieve").iterdir()] == ["fuzzy-passages"]


def test_both_sides_share_one_exchange_of_slices(spark, monkeypatch):
    from artisieve.llm import spans

    monkeypatch.setattr(spans, "SPLIT", 3)  # the slice of document 0 is dealt to four tasks
    texts = {i: " ".join(f"w{(i * 7 + j) % 50}" for j in range(200)) for i in range(13)}
    docs = spark.createDataFrame(list(texts.items()), "row long, text string")
    pairs = spark.createDataFrame([(i, 3, 90, 0, 70, 120) for i in range(1, 13)], "a long, a_lo int, a_hi int, b long, b_lo int, b_hi int")
    words = lambda i, lo, hi: spans.word_hashes(pa.array([texts[i]]))[0].astype(np.uint32)[lo:hi].tobytes()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = spans.both_sides(docs, pairs)
        got = sorted((x.a, x.a_base, bytes(x.a_words), x.b, x.b_base, bytes(x.b_words)) for x in made.collect())
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [(i, 0, words(i, 0, 128), 0, 64, words(0, 64, 128)) for i in range(1, 13)]
    assert re.search(r"ReusedExchange \[row.*, Exchange hashpartitioning\(row.*REPARTITION_BY_COL", plan)


def test_near_duplicates_hand_python_small_batches(spark, monkeypatch):
    from artisieve.llm import jaccard_join

    name, sizes, plain = "spark.sql.execution.arrow.maxBytesPerBatch", [], jaccard_join.staged
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat(id, repeat(' x', 4000), ' ', id) AS text").coalesce(1)

    def bytes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def spied(df, label, keep=False):
        if label == "signatures":
            sizes.extend(x.n for x in docs.mapInArrow(bytes_of, "n long").collect())
        return plain(df, label, keep)

    before = spark.conf.get(name)
    monkeypatch.setattr(jaccard_join, "staged", spied)
    assert jaccard_join.near_duplicates(docs).count() == 4000
    assert sum(sizes) > 32e6 and max(sizes) < 5e6
    assert spark.conf.get(name) == before


def test_toxicity_remembers_few_terms():
    from artisieve.llm.toxicity import TermIds

    ids, terms = TermIds(18), [f"t{i}" for i in range(100_000)]
    assert ids.of(" ".join(terms)).tolist() == sorted({zlib.crc32(t.encode()) & (1 << 18) - 1 for t in terms})
    assert len(ids) <= 20_000


@pytest.mark.parametrize("kind", ["exact", "replaced", "moved"])
def test_op7_meets_holders_behind_the_first(spark, monkeypatch, kind):
    """Passages whose seeds all occur first in documents that hold a part of 35 words."""
    from artisieve.llm import chain_dedup, holders

    monkeypatch.setattr(holders, "BLOCK", 2)
    r, rows, want = random.Random(3), [], set()
    line = " ".join(f"line{j}" for j in range(12))  # in all documents
    for i in range(6):
        p = [f"p{i}x{j}" for j in range(60)]
        fuzzy = list(p)
        if kind == "replaced":
            for j in (29, 44, 55):
                fuzzy[j] = f"q{i}x{j}"
        elif kind == "moved":
            fuzzy = [*p[:20], "add", *p[20:41], *p[43:]]
        for d, body in enumerate((p[:35], p[25:], p, fuzzy, p)):
            around = [" ".join(f"{side}{i}x{d}x{j}" for j in range(30 + r.randrange(9))) for side in "lr"]
            rows.append((f"{10 * i + d:03}", f"{around[0]} {' '.join(body)} {around[1]} {line}"))
        want |= {(f"{10 * i + d:03}", f"{10 * i + 2:03}") for d in (3, 4)}
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    pairs = {(x.doc_id, x.source_id) for x in found}
    assert want <= pairs | {(a, b) for a, b in want if (a, f"{int(b) + 1:03}") in pairs} and {a for a, _ in pairs} == {a for a, _ in want}
    assert all(x.end_word - x.start_word >= 50 and x.identity >= 0.8 for x in found)


def test_op7_runs_of_one_word(spark):
    from artisieve.llm.chain_dedup import fuzzy_passages

    own = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    run = lambda n: " ".join(["to"] * n)
    broken = f"{run(4)} z {run(30)} w {run(14)}"
    texts = [f"{own('a', 40)} {run(10)} {own('b', 40)}", f"{own('c', 40)} {run(53)} {own('d', 40)}", f"{own('e', 40)} {broken} {own('f', 40)}", f"{own('g', 40)} {run(300)} {own('h', 40)}"]
    found = fuzzy_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    cover = {d: {j for x in found if x.doc_id == d for j in range(x.start_word, x.end_word)} for d in (2, 3)}
    assert {x.doc_id for x in found} == {2, 3}
    assert cover[2] == set(range(40, 90)) and set(range(40, 340)) <= cover[3] <= set(range(38, 342))


def test_bags_never_hide_common_words():
    from artisieve.llm.holders import BITS, bags

    r = np.random.default_rng(5)
    words = r.integers(0, 1 << 63, 40, dtype=np.uint64)[r.integers(0, 40, 4000)]
    lo = r.integers(0, 3900, 60)
    sides = [(lo, lo + r.integers(0, 42, 60)), (lo + 50, lo + 50 + r.integers(0, 42, 60))]
    bits, hidden = bags(words, sides, 42)
    assert bits.shape == (60, BITS // 64)
    for i in range(60):
        for j in range(60):
            true = sum(sum((Counter(words[s[i] : e[i]].tolist()) & Counter(words[s[j] : e[j]].tolist())).values()) for s, e in sides)
            assert true <= int(np.bitwise_count(bits[i] & bits[j]).sum()) + min(hidden[i], hidden[j])
