import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tesselon.llm import common, hmm


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_forward_and_counts_match_enumeration():
    rnd = np.random.default_rng(2)
    norm = lambda a, ax: a / a.sum(ax, keepdims=True)
    start, move, emit = norm(rnd.random(3), 0), norm(rnd.random((3, 3)), 1), norm(rnd.random((5, 3)), 0)
    seqs = [np.array(s) for s in ([0, 1, 4, 2], [3], [2, 2, 0], [1, 0, 3, 4, 4])]
    p, moves, emissions = [], np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        paths = {}
        for z in itertools.product(range(3), repeat=len(s)):
            x = start[z[0]] * emit[s[0], z[0]]
            for t in range(1, len(s)):
                x *= move[z[t - 1], z[t]] * emit[s[t], z[t]]
            paths[z] = x
        total = sum(paths.values())
        p.append(math.log10(total))
        for z, x in paths.items():
            for t in range(len(s)):
                emissions[s[t], z[t]] += x / total
                if t:
                    moves[z[t - 1], z[t]] += x / total
    assert np.allclose(hmm.forward(seqs, start, move, emit), p)
    _, m, e, ll = hmm.expected_counts(seqs, start, move, emit)
    assert np.allclose(m, moves) and np.allclose(e, emissions) and abs(ll / math.log(10) - sum(p)) < 1e-9


def corpus():
    rnd = random.Random(8)
    texts = []
    for i in range(400):
        voc = [f"{'xy'[i % 2]}{j}" for j in range(60)]
        texts.append(" ".join(rnd.choice(voc) if rnd.random() < 0.9 else f"Rare{rnd.randint(0, 300)}{'qz'[i % 2]}" for _ in range(rnd.randint(5, 60))))
    return texts


def test_base_scores_probability_and_gain(make_docs, odd_texts, monkeypatch):
    texts = corpus() + odd_texts
    ids = [*range(len(texts) - 1), None]
    monkeypatch.setattr(common, "PIECE", 40)
    monkeypatch.setattr(common.pieces, "__defaults__", (40,))
    for top, symbols in ((50, 20), (131072, 8192)):
        monkeypatch.setattr(hmm, "TOP_WORDS", top)
        monkeypatch.setattr(hmm, "SYMBOLS", symbols)
        rows = hmm.language_scores(make_docs(texts, ids=ids), states=3, rounds=6).collect()
        assert len(rows) == len(texts)
        toks = {i: (t or "").encode().lower().split() for i, t in zip(ids, texts, strict=True)}
        c = Counter(w for i in ids if not held(i) for w in [*toks[i], None])
        n, v = sum(c.values()), len(c)
        gain = 0.0
        for r in rows:
            w = [*toks[r.doc_id], None]
            want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
            assert abs(r.base_score - want) < 1e-6 and r.score < 0
            gain += (r.score - r.base_score) * r.held_out
        assert gain > 0


def test_score_against_a_plain_computation(make_docs, monkeypatch):
    """The chain over symbols in plain probabilities, and each other word's smoothed share of its class."""
    monkeypatch.setattr(hmm, "TOP_WORDS", 40)
    monkeypatch.setattr(hmm, "SYMBOLS", 15)
    seen, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: seen.append(train(*a)) or seen[0])
    texts = [" ".join(t.split()[:12]) for t in corpus()[:150]] + ["never seen words", "", None]
    rows = hmm.language_scores(make_docs(texts), 2, 3).collect()
    (start, move, emit), _ = seen[0]
    toks = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    c = Counter(w for i in toks if not held(i) for w in toks[i])
    top = sorted(c, key=lambda w: (-c[w], w))[:15]
    # The table of frequent words is cut at a step of counts; the symbols are its most frequent.
    classes = {k: [w for w in c if w not in top and hmm.word_class(w) == k] for k in range(hmm.CLASSES)}
    for r in rows:
        syms, words = [], 0.0
        for w in toks[r.doc_id]:
            if w in top:
                syms.append(top.index(w))
            else:
                k = hmm.word_class(w)
                syms.append(15 + k)
                words += math.log10((c[w] + 0.5) / (sum(c[x] + 0.5 for x in classes[k]) + 0.5))
        syms.append(15 + hmm.CLASSES)
        p = 0.0
        if len(syms) <= 13:
            for path in itertools.product(range(2), repeat=len(syms)):
                x = start[path[0]] * emit[syms[0], path[0]]
                for t in range(1, len(syms)):
                    x *= move[path[t - 1], path[t]] * emit[syms[t], path[t]]
                p += x
            assert abs(r.score - (math.log10(p) + words)) < 1e-6


def test_likelihood_rises_and_reruns_agree(make_docs, spark):
    docs = make_docs(corpus()[:120])
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in hmm.language_scores(docs, 2, 2).collect()) for _ in range(2))
    assert a == b
    enc = spark.createDataFrame([(bytearray(np.array([i % 4, (i + 1) % 4, i % 3], np.uint16).tobytes()),) for i in range(60)], "sym binary")
    _, trace = hmm.train(enc, 4, np.full(4, 0.25), 2, 6)
    assert trace[-1] > trace[0]


def test_empty_table(make_docs):
    assert hmm.language_scores(make_docs(["x"]).filter("doc_id < 0"), 2, 1).count() == 0


def test_words_of_whole_batches(make_docs, odd_texts, monkeypatch):
    """Words of many rows at once, and of long texts in pieces, are those of each text alone; scores do not depend on the cut."""
    texts = [*odd_texts, None, "", " \x0b\x0c ", "\x1c a\u2003B\x85 \tÉ\r\n", *corpus()[:60]]
    want = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in hmm.language_scores(make_docs(texts), 2, 1).collect())
    for run in (1 << 22, 200, 30):
        monkeypatch.setattr(hmm, "RUN", run)
        monkeypatch.setattr(common.pieces, "__defaults__", (20,))
        got: list = [[] for _ in texts]
        for rows, words in hmm.words_of(pa.array(texts, pa.string())):
            for i, w in zip(rows.tolist(), words.to_pylist(), strict=True):
                got[i].append(w)
        assert got == [(t or "").encode().lower().split() for t in texts]
    col = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    counted = Counter()
    for b in hmm._count(iter([col, col])):
        counted.update(dict(zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True)))
    assert counted == Counter(w for t in texts + texts for w in (t or "").encode().lower().split())
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in hmm.language_scores(make_docs(texts), 2, 1).collect()) == want


def test_workers_keep_nothing_between_tasks(make_docs, vocab, monkeypatch):
    """Spark uses a worker again; one that counted or encoded kept its memory beside the executor's heap while it was idle."""
    import re
    from pathlib import Path

    from tesselon.llm.bpe import transducer

    taken = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    frame = type(make_docs(["x"]))
    ran, plain = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: ran.append(f) or plain(self, f, *a, **b))
    assert hmm.language_scores(make_docs(corpus()[:40]), 2, 2).count() == 40
    assert len(ran) == 5
    for f in ran:
        transducer(vocab)
        assert sum(b.num_rows for b in f(iter([]))) == 0
        assert transducer.cache_info().currsize == 0

    def batches():
        for i in range(12):
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}x{k}y{j}" for j in range(100)) for k in range(1000)], pa.string())], ["text"])

    before = taken()
    assert sum(b.num_rows for b in ran[0](batches())) == 1_200_000
    assert taken() - before < 30


def test_counts_come_in_parts(monkeypatch):
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i % 70}" for i in range(k, k + 50)) for k in range(40)], pa.string())], ["text"])
    for part, flush in ((7, 300_000), (7, 20), (1000, 20)):
        monkeypatch.setattr(hmm, "PART", part)
        monkeypatch.setattr(hmm, "FLUSH", flush)
        got = Counter()
        for b in hmm._count(iter([texts, texts])):
            assert len(b) <= part and b.column("cls").to_pylist() == [hmm.word_class(w) for w in b.column("word").to_pylist()]
            for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True):
                got[w] += c
        assert got == Counter(w.encode() for t in texts.column("text").to_pylist() * 2 for w in t.split())
