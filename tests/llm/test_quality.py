import re
from collections import Counter

import pytest

from tesselon.llm.quality import quality_filter, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(w), len(hit)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, n < 50 or 100 * rep > 50 * n


TEXTS = [
    "a b c a b c d",
    "x x x x x",
    "one\ntwo\none\n \n \none \n",
    "# * <b> 100% &&",
    " ".join(f"w{i % 40}" for i in range(200)),
    " ".join(f"the w{i} of" for i in range(60)),
    "a b c d a b c e b c d",
]


def test_counts_match_brute_force(make_docs, odd_texts):
    texts = TEXTS + odd_texts
    rows = quality_rules(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_filter_keeps_columns_and_clean_text(make_docs):
    clean = " ".join(f"the w{i} of" for i in range(60))
    docs = make_docs([clean, clean.upper(), " ".join(f"w{i}%%% the" for i in range(60)), None])
    kept = quality_filter(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [0]


def test_empty_table_and_plan(make_docs):
    docs = make_docs(["x"]).filter("doc_id < 0")
    assert quality_rules(docs).count() == 0
    plan = quality_rules(make_docs(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("n", [60000])
def test_very_long_text(make_docs, n):
    text = " ".join(f"w{i % 50000}" for i in range(n))
    r = quality_rules(make_docs([text])).collect()[0]
    assert (r.n_words, r.n_repeat_words) == brute(text)[::4][:2]
