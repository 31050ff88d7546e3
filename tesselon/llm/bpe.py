"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

Encoding.  Text is fed in blocks.  A token of the buffered text is final once no continuation can
change it; how far back from the buffer's end a continuation can reach is computed from the merge list.

*Sufficient lookahead.*  Merges are applied in list order (a list is *proper* when both parts of each
merge are bytes or results of earlier merges; then lowest rank first and list order agree).  Take two
continuations of one buffer and let ``s`` be the first position at which their current segmentations
differ; at first ``s`` is the buffer's end.  ``s`` moves left only when a merge ``(u, v)`` joins the
last common token ``u`` to ``v`` in one of the two, and then moves by ``|u|``.  The token at ``s`` now
starts with ``u``: the next merge ``(x, y)`` that moves ``s`` has a ``y`` whose chain of left parts
holds ``u``, and it comes later in the list.  So the reach is the heaviest chain of merges
``(u1, v1), (u2, y2), ...`` with rising rank and ``u_i`` on the left spine of ``y_{i+1}``, weighed by
the lengths of the left parts, which one pass over the list finds.

To this the pre-tokenizer adds three characters (an apostrophe suffix, or the white space that joins
the next word), and an added token its own length.  A buffer thus holds a block and the lookahead,
however long the text or its longest word is.

Decoding.  Each id gives bytes; an incremental UTF-8 decoder turns them into text and holds at most
three bytes between tokens.  Invalid bytes become U+FFFD, as in the library.

Defined results.  Null reads as empty; an empty text has no ids and decodes to the empty text.  Texts of
any length are encoded whole, through a buffer of bounded size.  Repeated rows each get a row, rows with
a null id too.  An empty table gives an empty result.  Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import bounded_batches, kept

#: Characters buffered before stable tokens are emitted.
BLOCK = 8192
#: Characters of short texts encoded at once: the library holds over a hundred bytes a token until they are done.
AT_ONCE = 1 << 17
#: Characters the pre-tokenizer may still regroup at the end of a buffer, at four bytes each.
SPLIT_BYTES = 3 * 4


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before a buffer's end that a continuation can still regroup."""
    left: dict[bytes, bytes] = {}
    best: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        for part in (u, v):
            if len(part) > 1 and part not in left:
                raise ValueError(f"the merge list is not proper: {part!r} is used before it is made")
        reach, y = 0, v
        while True:
            reach = max(reach, best.get(y, 0))
            if y not in left:
                break
            y = left[y]
        reach += len(u)
        best[u] = max(best.get(u, 0), reach)
        left.setdefault(u + v, u)
        most = max(most, reach)
    return most


class Transducer:
    """One vocabulary: its lookahead, block kernel, and id-to-bytes table."""

    def __init__(self, path: str, block: int = BLOCK):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without a prefix space is needed")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        added = {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
        self.merge_lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.lookahead = self.merge_lookahead + SPLIT_BYTES + max([0, *(len(x.encode()) for x in added.values())])
        size = 1 + max([*model["vocab"].values(), *added])
        self.pieces: list[bytes] = [b""] * size
        for s, i in model["vocab"].items():
            self.pieces[i] = s.encode() if i in added else raw(s)
        for i, s in added.items():
            self.pieces[i] = s.encode()
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.names = [str(i) for i in range(size)]
        self.block = block
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self._encode = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def blocks(self, texts: list[str]):
        """Yields the ids of texts that fit the buffer: each ends within it, so all its tokens are final."""
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and held < AT_ONCE:
                held += len(texts[j])
                j += 1
            yield from self._encode(texts[i:j])
            i = j

    def stream(self, chunks):
        """Yields lists of final ids for a text given in chunks."""
        import numpy as np

        held = ""
        want = self.block
        for chunk in chunks:
            held += chunk
            while len(held) > want + self.lookahead:
                # All tokens that end a lookahead before the buffer's end are final.
                part = held[: want + self.lookahead]
                data = part.encode()
                ids = self._encode([part])[0]
                ends = np.cumsum(self.lengths[ids])
                k = int(np.searchsorted(ends, len(data) - self.lookahead, side="right"))
                while k and not self._splits(data, int(ends[k - 1])):
                    k -= 1
                if not k:  # no place to cut yet: take in another block
                    want += self.block
                    continue
                yield ids[:k]
                held = data[int(ends[k - 1]) :].decode() + held[len(part) :]
                want = self.block
        if held:
            yield self._encode([held])[0]

    @staticmethod
    def _splits(data: bytes, at: int) -> bool:
        """Whether the rest from ``at`` on encodes alone as it does behind what comes before it.

        It must start a character, and must not turn the end of a punctuation run into an apostrophe suffix.
        """
        if data[at] & 0xC0 == 0x80:
            return False
        return not (data[at] == 0x27 and data[at + 1 : at + 2] in (b"s", b"t", b"r", b"v", b"m", b"l", b"d") and not data[at - 1 : at].isalnum())

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text[k : k + self.block] for k in range(0, len(text), self.block)) for i in ids]

    def decode_stream(self, id_lists):
        """Yields text for lists of ids; the state between them is an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.pieces.__getitem__
        for ids in id_lists:
            yield machine.decode(b"".join(map(get, ids)))
        yield machine.decode(b"", True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_stream([ids]))

    def digests(self, id_lists) -> tuple[int, str, str]:
        """Count, digest of the joined ids and digest of the decoded text, in constant memory."""
        n, h, t = 0, hashlib.sha256(), hashlib.sha256()
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        piece, name = self.pieces.__getitem__, self.names.__getitem__
        for ids in id_lists:
            if ids:
                h.update(((b"," if n else b"") + ",".join(map(name, ids)).encode()))
                t.update(machine.decode(b"".join(map(piece, ids))).encode())
                n += len(ids)
        t.update(machine.decode(b"", True).encode())
        return n, h.hexdigest(), t.hexdigest()


@kept
@lru_cache(maxsize=2)
def transducer(path: str, block: int = BLOCK) -> Transducer:
    return Transducer(path, block)


def _chunks(text: str, block: int):
    return (text[k : k + block] for k in range(0, len(text), block))


def encode_documents(docs: DataFrame, tokenizer_path: str, block: int = BLOCK) -> DataFrame:
    """doc_id and the ids of each whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        tr = transducer(tokenizer_path, block)
        for b in batches:
            ids = [[i for part in tr.stream(_chunks(x.as_py() or "", block)) for i in part] for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of each list of ids; null ids give the empty text."""
    bounded_batches(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        tr = transducer(tokenizer_path)
        for b in batches:
            texts = ["".join(tr.decode_stream([x.as_py() or []])) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def roundtrip_digests(docs: DataFrame, tokenizer_path: str, block: int = BLOCK) -> DataFrame:
    """Encodes each whole text, decodes the ids again, and keeps count and digests: no shuffle, nothing held but a block."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        tr = transducer(tokenizer_path, block)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column("text")]
            short = [i for i, x in enumerate(texts) if len(x) <= block]
            out: list = [None] * len(texts)
            for i, ids in zip(short, tr.blocks([texts[i] for i in short]), strict=True):
                out[i] = tr.digests([ids])
            for i, x in enumerate(texts):
                if out[i] is None:
                    out[i] = tr.digests(tr.stream(_chunks(x, block)))
            n, a, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
