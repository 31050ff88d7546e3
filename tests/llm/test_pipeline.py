import random

import corpus_pipeline as P


def test_stages_on_a_small_corpus(spark, tmp_path, vocab):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    clean = lambda n: " ".join(rnd.choice([*words, "the", "of", "and"] + ["in"] * 50) for _ in range(n))
    texts = [clean(80) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", "short", None, " ".join(["x%%%"] * 80), clean(60) + " mail me@x.org now"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, names = {}, [n for n, _ in P.STAGES]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept["quality"]} == set(range(42)) | {45}
    assert {r.doc_id for r in kept["near_duplicates"]} == set(range(40)) | {45}
    assert [r.text for r in kept["personal_data"] if r.doc_id == 45] == [texts[45].replace("me@x.org", "[EMAIL]")]
    assert {r.doc_id for r in kept["mixing"]} <= {r.doc_id for r in kept["personal_data"]}
    assert sorted(r.doc_id for r in kept["encoding"]) == sorted(r.doc_id for r in kept["mixing"])
    assert P.run(spark, str(tmp_path)).count() == len(kept["encoding"])


def shaped(rnd, n, words):
    return " ".join(rnd.choice([*words, *["the", "of", "and"] * 20]) for _ in range(n))


def test_each_stage_against_brute_force(spark, tmp_path, vocab):
    """Every stage on what its predecessor kept, against the rules one document at a time."""
    import hashlib
    import re

    import duckdb
    from test_mixing import capped_targets, plain_copies
    from test_neardup import brute
    from tokenizers import Tokenizer

    from tesselon.llm.queries import oracle_sql

    rnd = random.Random(13)
    words = [f"w{i}" for i in range(700)]
    texts = [shaped(rnd, rnd.randint(30, 220), words) for _ in range(120)]
    for k in range(30):
        w = texts[k].split()
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [shaped(rnd, 90, words) + f" mail me{k}@x.org or +1 620 555 84{k:02d} now" for k in range(12)]
    texts += [None, "", " ".join(["x%%%"] * 80), texts[3], "same line\n" * 60, shaped(rnd, 40_000, words)]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "clash", i) for i, t in enumerate(texts)]
    rows.append(rows[5])
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_id string, size long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(r[0] for r in con.sql(f"select doc_id from ({oracle_sql()['op3_quality_rules']}) where kept").fetchall())
    assert sorted(r.doc_id for r in kept["quality"]) == want

    ids = sorted(set(want))
    comp, _ = brute([texts[i] for i in ids], 80)
    want = {ids[c] for c in comp}
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(want)

    plain = lambda t: re.sub(r"\+1 620 555 84\d\d", "[PHONE]", re.sub(r"me\d+@x\.org", "[EMAIL]", t))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept["personal_data"]} == {i: (plain(texts[i]), len(plain(texts[i]))) for i in want}

    sources = {}
    for r in kept["personal_data"]:
        sources.setdefault(r.source, []).append(len(r.text.split()))
    key = lambda s: (s is None, s or "")
    targets = capped_targets({key(s): sum(v) for s, v in sources.items()})
    for s, sizes in sources.items():
        copies = {}
        for r in kept["mixing"]:
            if r.source == s:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        got = {}
        for r in kept["personal_data"]:
            if r.source == s:
                got.setdefault(len(r.text.split()), []).append(copies.get(r.doc_id, 0))
        target = float(targets[key(s)])
        assert {k: sorted(v) for k, v in got.items()} == plain_copies(sizes, target, round(target / sum(sizes), 12))

    tok = Tokenizer.from_file(vocab)
    want = []
    for r in kept["mixing"]:
        ids = tok.encode(r.text, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept["encoding"]) == sorted(want)


def test_every_stage_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, docs, "").count() == 0, name
