import itertools
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.llm import neardup
from tesselon.llm import shingles as S
from tesselon.llm.neardup import banding, near_duplicates, one_of_each_group


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, percent=85):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            comp[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    passage = [rnd.choice(vocab) for _ in range(120)]
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 8)):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append("\n".join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    for _ in range(20):
        texts.append(" ".join(passage + [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]))
    # A chain: neighbours are similar, ends are not.
    chain = [rnd.choice(vocab) for _ in range(200)]
    for k in range(12):
        texts.append(" ".join(chain[k * 8 : k * 8 + 120]))
    rnd.shuffle(texts)
    return texts


def test_sets_match_brute_force(odd_texts):
    texts = odd_texts + ["A b C d e F", "a B c D E f g", "é É"]
    for s, t in zip(S.shingle_sets(texts), texts, strict=True):
        assert len(s) == len(shingle_set(t))
    assert S.similar(*S.shingle_sets(["A b c", "a B c"]), 100)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = ["x" * 5000 + " " + "yz " * 700, None, " a b", "w" * 3000]
    want = [s.tolist() for s in S.shingle_sets(texts)]
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S.grouped, "__defaults__", (100,))
    monkeypatch.setattr(S, "_powers", [np.ones(1, S.U), np.ones(1, S.U)])
    assert [s.tolist() for s in S.shingle_sets(texts)] == want


def test_every_coordinate_fills_and_estimates():
    rnd = np.random.default_rng(0)
    for n in (1, 3, 40, 5000):
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        assert (S.similarity_sketches([a]) != np.iinfo(np.uint64).max).all()
    pool = rnd.integers(0, 2**63, 1000, dtype=np.uint64)
    x, y = S.similarity_sketches([np.unique(pool[:900]), np.unique(pool[100:])])
    assert abs((x == y).mean() - 0.8) < 0.1
    one, two = S.similarity_sketches([pool[:3], pool[:3]]), S.similarity_sketches([pool[:3]])
    assert (one[0] == one[1]).all() and (one[0] == two[0]).all()


def test_bands_follow_the_threshold():
    assert banding(85) == (36, 7) and banding(80) == (42, 6)
    for percent in (50, 80, 85, 95, 100):
        bands, rows = banding(percent)
        assert bands * rows <= 256 and (1 - (percent / 100) ** rows) ** bands <= 3e-6


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(make_docs, odd_texts, percent):
    texts = corpus() + odd_texts
    comp, sizes = brute(texts, percent)
    rows = near_duplicates(make_docs(texts), percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (comp[r.doc_id], sizes[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_large_group_of_near_copies(make_docs):
    rnd = random.Random(2)
    base = [f"v{i}" for i in range(150)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6, 9, 15])):
            w[rnd.randrange(150)] = f"x{rnd.random()}"
        texts.append(" ".join(w))
    comp, _ = brute(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(make_docs(texts), 85).collect()}
    assert got == dict(enumerate(comp))


def test_null_ids_repeats_and_empty_table(make_docs):
    docs = make_docs(["a b c", "a b c", "a b c", None, "a b c"], ids=[None, 4, 4, 5, 2])
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert rows == [(2, 2, True), (4, 2, False), (4, 2, False), (5, 5, True), (None, None, True)]
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id) for r in out.collect())) == ["2", "5", "None"]
    assert near_duplicates(docs.filter("doc_id < 0")).count() == 0


def test_families_around_one_passage(make_docs):
    """Families of near copies that all hold a common passage: many share buckets, few are linked across."""
    rnd = random.Random(6)
    passage, texts = [f"p{i}" for i in range(150)], []
    for f in range(12):
        own = [f"f{f}x{i}" for i in range(50)]
        for _ in range(15):
            w = passage + own
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                w[rnd.randrange(200)] = f"x{rnd.random()}"
            texts.append(" ".join(w))
    comp, _ = brute(texts, 80)
    got = {r.doc_id: r.component_id for r in near_duplicates(make_docs(texts), 80).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp)) >= 12


def test_a_very_long_text_and_one_id_for_two_texts(make_docs):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = make_docs([long, long + " end", "a b c d e f g h", "z y x w v u t s", "z y x w v u t s"], ids=[1, 2, 3, 3, 4])
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]


def test_a_worker_holds_little_beside_its_batch():
    """A batch of 8 MB, as large as they come, is worked on in parts, whose sets and sketches go before the next part's are made."""
    import tracemalloc

    import pyarrow as pa

    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(vocab, k=1500)) for _ in range(900)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(902)), pa.array(texts)], ["doc_id", "text"])
    for made in (lambda: neardup._features([batch], 80), lambda: neardup._hash_sets([batch])):
        tracemalloc.start()
        assert [i for b in made() for i in b.column(0).to_pylist()] == list(range(902))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 45e6


def test_members_are_found_with_one_exchange_of_the_band_keys(make_docs, monkeypatch):
    """Counting the buckets and joining the counts both read one exchange, made without a sort before it."""
    plans, write = {}, neardup.Scratch.write

    def seen(self, df, name):
        out = write(self, df, name)
        if name == "members":
            ran = df.select("*")
            ran.collect()
            plans[name] = ran._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return out

    monkeypatch.setattr(neardup.Scratch, "write", seen)
    assert near_duplicates(make_docs(corpus()), 80).count()
    dealt = [line for line in plans["members"].splitlines() if "Exchange hashpartitioning(bucket" in line]
    assert ["ReusedExchange" in line for line in dealt] == [False, True], plans["members"]


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(4)
    pool = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(rnd.choice(pool, n)) for n in (1, 5, 400, 500, 2900)] + [np.empty(0, np.uint64)]
    words = S.parities(sets, 1024)
    for i, j in itertools.product(range(len(sets)), repeat=2):
        assert np.bitwise_count(words[i] ^ words[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_few_pairs_of_a_group_below_the_threshold_take_their_sets_along(make_docs):
    """300 variants of one text, nearly all pairs of which are similar at 0.6 to 0.75: the signature alone passes most of them."""
    rnd = random.Random(8)
    base, texts = [f"v{i}" for i in range(500)], []
    for v in range(300):
        w = list(base)
        for i in rnd.sample(range(100), 9):
            w[5 * i] = f"x{v}.{i}"
        texts.append(" ".join(w))
    docs = make_docs(texts).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = docs.mapInArrow(partial(neardup._features, percent=80), neardup._FEATURES)
    odd = [F.col("parity")[j].alias(f"d{j}") for j in range(neardup.PARITY // 64)]
    rows = feats.select(F.lit(0).alias("bucket"), F.col("doc_id").alias("comp"), F.lit(-1).alias("main"), F.col("n_shingles").alias("n"), "s0", "s1", "s2", "s3", F.array().cast("array<long>").alias("head"), *odd)
    p, q = rows.alias("p"), rows.alias("q")
    below = p.join(q, F.col("p.comp") < F.col("q.comp"))
    assert below.filter(neardup._may_link("p", "q", 80)).count() > 0.8 * 300 * 299 / 2
    assert p.join(q, neardup._may_meet("p", "q", 80)).count() < 0.05 * 300 * 299 / 2


def test_a_worker_drops_the_encoder_that_an_earlier_task_left(vocab):
    """Spark uses a worker again for other operators; one that had encoded kept a vocabulary beside the shingle sets."""
    import pyarrow as pa

    from tesselon.llm.bpe import transducer

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], ["doc_id", "text"])
    for made in (lambda: neardup._features([batch], 80), lambda: neardup._hash_sets([batch]), lambda: neardup._hash_sets([])):
        transducer(vocab)
        assert transducer.cache_info().currsize
        assert sum(b.num_rows for b in made()) <= 1
        assert transducer.cache_info().currsize == 0
