import random
import re

import pytest

from tesselon.llm.licenses import FAMILIES, TEMPLATES, scan_licenses


def words(t):
    return [m[0].lower() for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "")]


def shingles(w):
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(text, template):
    """Whether some stretch of twice the template's words holds 80 % of its shingles."""
    t, w = shingles(words(template)), words(text)
    n = len(words(template)) + 2
    return any(100 * len(t & shingles(w[i : i + n])) >= 80 * len(t) for i in range(max(1, len(w))))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    filler = [f"w{i}" for i in range(200)] + ["license", "under", "the", "version", "é"]
    out = []
    for k, t in enumerate([*TEMPLATES.values()] * 6):
        w = [rnd.choice(filler) for _ in range(rnd.randint(0, 300))]
        place = rnd.randint(0, len(w))
        text = t.upper() if k % 3 == 0 else t.replace(" ", "  \n") if k % 3 == 1 else t
        out.append(" ".join(w[:place] + [text] + w[place:]))
    return out + [" ".join(rnd.choice(filler) for _ in range(400)) for _ in range(20)]


def test_matches_agree_with_brute_force(make_docs, odd_texts, texts):
    data = texts + odd_texts
    rows = scan_licenses(make_docs(data)).collect()
    assert len(rows) == len(data)
    for r in rows:
        got = {m.license for m in r.matches}
        want = {n for n, t in TEMPLATES.items() if brute(data[r.doc_id], t)}
        # Of a family one is enough.
        assert {FAMILIES.get(n, n) for n in want} <= {FAMILIES.get(n, n) for n in got}, (r.doc_id, want - got)
        for m in r.matches:
            part = words(data[r.doc_id][m.start : m.end])
            t = shingles(words(TEMPLATES[m.license]))
            assert 100 * len(t & shingles(part)) >= 80 * len(t) and m.containment >= 0.8


def test_positions_and_repeats(make_docs):
    t = "é " + TEMPLATES["mit"] + " x" * 40 + " 🙂 " + TEMPLATES["mit"]
    r = scan_licenses(make_docs([t])).collect()[0]
    assert [(m.license, t[m.start : m.end]) for m in r.matches] == [("mit", TEMPLATES["mit"][:-1])] * 2
    assert scan_licenses(make_docs(["x"]).filter("doc_id < 0")).count() == 0


def test_occurrences_side_by_side_are_counted_apart(make_docs):
    cases = {"mit": [1, 2, 3, 7], "gpl-3.0-notice": [1, 2, 3, 5], "apache-2.0-notice": [2, 4]}
    texts, want = [], []
    for name, counts in cases.items():
        for n in counts:
            for gap in (" ", " x y z ", " lorem ipsum dolor sit amet consectetur adipiscing "):
                for before in ("", "one two three "):
                    t = before + gap.join([TEMPLATES[name]] * n)
                    size, step = len(TEMPLATES[name].rstrip(".")), len(TEMPLATES[name]) + len(gap)
                    texts.append(t)
                    want.append((name, [(len(before) + k * step, len(before) + k * step + size) for k in range(n)]))
    for r in scan_licenses(make_docs(texts)).collect():
        name, spans = want[r.doc_id]
        assert [(m.start, m.end) for m in r.matches if m.license == name] == spans, texts[r.doc_id]


def test_each_template_is_told_from_its_relatives(make_docs):
    names = sorted(TEMPLATES)
    for r in scan_licenses(make_docs([f"é {TEMPLATES[n]} 🙂" for n in names])).collect():
        name = names[r.doc_id]
        got = {m.license for m in r.matches}
        assert name in got and (name not in FAMILIES or not (got - {name}) & set(FAMILIES))


def test_a_very_long_text_with_many_matches(make_docs):
    t = ("é " * 40 + TEMPLATES["isc"] + " ") * 2_000
    r = scan_licenses(make_docs([t])).collect()[0]
    assert len(r.matches) == 2_000 and all(t[m.start : m.end] == TEMPLATES["isc"][:-1] for m in r.matches)
