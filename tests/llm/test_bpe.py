import hashlib
import random

import pytest

from tesselon.llm import bpe
from tesselon.llm.bpe import Transducer, decode_documents, encode_documents, roundtrip_digests, sufficient_lookahead, transducer


@pytest.fixture(scope="module")
def library(vocab):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab)


def texts():
    rnd = random.Random(5)
    out = ["a" * 5000, "'s" * 3000, "!'s" * 2000, "'" * 4000, " " * 3000 + "x", "é" * 3000, "🙂" * 1500, "\n \n  x" * 700, "<|endoftext|>" * 300, "=-" * 3000, "0123456789" * 400]
    for alphabet in ("ab", "abc ", "the and 'll ing", "é🙂 a'", " \n\tx", "!?.'s t", "<|endoftxt>"):
        out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4000))) for _ in range(6)]
    return out


def test_small_blocks_give_the_library_ids(vocab, library):
    tr = Transducer(vocab, block=64)
    for t in texts():
        ids = tr.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t[:60]
        assert tr.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_memory_is_bounded(vocab):
    tr = Transducer(vocab, block=256)
    seen = []
    inner = tr._encode
    tr._encode = lambda parts: seen.append(max(map(len, parts))) or inner(parts)
    tr.encode("ab" * 100_000)
    assert max(seen) <= 3 * 256 + tr.lookahead


def test_lookahead_by_hand():
    # "ab" then "xab": a following b pulls a away from x, one step of 1; then x-ab moves by 1 more.
    assert sufficient_lookahead([(b"a", b"b"), (b"x", b"ab")]) == 2
    assert sufficient_lookahead([(b"a", b"b"), (b"c", b"d")]) == 1
    with pytest.raises(ValueError):
        sufficient_lookahead([(b"ab", b"c")])


def test_partial_ids_decode_as_the_library(vocab, library):
    tr = transducer(vocab)
    ids = tr.encode("é🙂ß")
    for k in range(len(ids)):
        for part in (ids[k:], ids[:k]):
            assert tr.decode(part) == library.decode(part, skip_special_tokens=False)


def test_queries_round_trip(make_docs, odd_texts, vocab, library):
    data = odd_texts + ["word " * 9000, "x" * 30_000]
    docs = make_docs(data)
    got = {r.doc_id: r for r in roundtrip_digests(docs, vocab, 512).collect()}
    back = {r.doc_id: r.text for r in decode_documents(encode_documents(docs, vocab, 512), vocab).collect()}
    for i, t in enumerate(data):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert back[i] == (t or "")
    assert roundtrip_digests(docs.filter("doc_id < 0"), vocab).count() == 0


def test_short_texts_go_through_the_library_in_bounded_groups(vocab, monkeypatch):
    tr = Transducer(vocab)
    texts = [f"text {i} " * (i % 50) for i in range(400)]
    want, sizes, encode = [tr.encode(t) for t in texts], [], tr._encode
    monkeypatch.setattr(bpe, "AT_ONCE", 5000)
    monkeypatch.setattr(tr, "_encode", lambda part: sizes.append(sum(map(len, part))) or encode(part))
    assert list(tr.blocks(texts)) == want
    assert len(sizes) > 1 and max(sizes) < 5000 + max(map(len, texts))
