"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes says so, hence at the same
places wherever the same passage stands.  Each chunk gives a body that is encoded
once and kept for every later document of the partition with that body (copies,
shared passages), and two ragged edges.  At every join the edges of both chunks
are put together again and re-encoded.

Exactness: the tokenizer's pattern never matches across the place where a
non-space is followed by a space, whatever surrounds it, and merges stay inside
a match.  Such a place is therefore a token boundary of the whole text and of
any part that holds both characters.  Bodies start and end at such places; a
chunk with none is all edge, and the join grows over it until both sides agree
on a boundary.

The reuse table is per partition and bounded (``reuse_bytes``): sharing bodies
between partitions would shuffle texts and ids (several times the input) to
save encoding that costs less.  Encoding uses ranks of the same vocabulary; the
special token's string is cut out first, as the tokenizer's file says.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from itemscope.llm.common import BYTE_VALUES, text_bytes, with_arrow_columns

#: Average chunk: one cut in 2^CUT_BITS bytes.
CUT_BITS = 10
#: Bytes that the rolling hash covers.
ROLL = 32
REUSE_BYTES = 48 << 20
_EDGE = re.compile(r"(?<=[^\s\x00]) ")

NEW = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
       T.StructField("decoded", T.StringType())]
DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
          T.StructField("decoded_sha256", T.StringType())]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_vocabulary(path: str) -> dict:
    """Ranks, special tokens and byte strings of a byte-level BPE file of the tokenizers library.

    Only the form this operator encodes exactly is accepted: byte-level
    pre-tokenizer with its pattern, no prefix space, no normalizer, merges in
    the order of the ids.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if (spec["model"]["type"], pre["type"], pre["use_regex"], pre["add_prefix_space"], spec["normalizer"]) != (
            "BPE", "ByteLevel", True, False, None):
        raise ValueError(f"{path}: not a byte-level BPE file without normalizer")
    # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(char[c] for c in word): i for word, i in spec["model"]["vocab"].items()
             if all(c in char for c in word)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for t in special:
        ranks.pop(t.encode(), None)
    return {"ranks": ranks, "special": special}


def pack_vocabulary(vocabulary: dict) -> bytes:
    return json.dumps({"ranks": {base64.b64encode(k).decode(): v for k, v in vocabulary["ranks"].items()},
                       "special": vocabulary["special"]}).encode()


#: The pattern of the byte-level pre-tokenizer (a fixed value of the public format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, packed: bytes):
        import tiktoken

        spec = json.loads(packed)
        ranks = {base64.b64decode(k): v for k, v in spec["ranks"].items()}
        self.special = spec["special"]
        self.inner = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = set(self.special)
        self.names = [str(i) for i in range(max([*ranks.values(), *self.special.values()]) + 1)]
        self.reuse: dict[str, tuple[int, str, bytes, list[int]]] = {}
        self.held = 0
        self.reused = self.encoded = 0

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text, allowed_special=self.allowed, disallowed_special=())

    def part(self, text: str, keep: bool, limit: int, want_ids: bool):
        """(number of ids, ids as text, decoded bytes, ids or None) of a stretch between token boundaries."""
        got = self.reuse.get(text) if keep else None
        if got is not None:
            self.reused += 1
            return got
        ids = self.encode(text)
        names = self.names
        got = (len(ids), ",".join([names[i] for i in ids]), self.inner.decode_bytes(ids), ids if want_ids else None)
        self.encoded += 1
        if keep:
            if self.held > limit:
                self.reuse.clear()
                self.held = 0
            self.reuse[text] = got
            self.held += 2 * len(text) + len(got[1]) + len(got[2]) + 8 * got[0] * want_ids + 300
        return got


def cut_points(data: np.ndarray, off: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Byte positions (sorted) where a text of the slice may be cut: chosen by the ROLL bytes before."""
    n = len(data)
    if n <= ROLL:
        return np.zeros(0, np.int64)
    value = (BYTE_VALUES[data] >> np.uint64(20)).astype(np.int64)
    # a rolling sum with the weights 1..ROLL, by two prefix sums
    s = np.concatenate([[0], np.cumsum(value)])
    t = np.concatenate([[0], np.cumsum(s[1:])])
    roll = ROLL * s[ROLL:] - (t[ROLL:] - t[:-ROLL])
    with np.errstate(over="ignore"):
        mixed = (roll.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    at = np.flatnonzero(mixed == 0) + ROLL
    at = at[at < n]
    at = at[data[at] & 0xC0 != 0x80]  # never inside a character
    doc = np.searchsorted(off, at, "right") - 1
    return at[at - off[doc] >= ROLL]


def encode_text(codec: Codec, chunks: list[str], limit: int, want_ids: bool = False):
    """Parts of the whole text's encoding from its chunks (in order)."""
    parts, seam = [], ""
    for i, chunk in enumerate(chunks):
        first = _EDGE.search(chunk)
        if first is None:
            seam += chunk
            continue
        head, last = first.start(), chunk.rfind(" ")
        while last > head and (chunk[last - 1].isspace() or chunk[last - 1] == "\x00"):
            last = chunk.rfind(" ", 0, last)
        seam += chunk[:head]
        if seam:
            parts.append(codec.part(seam, False, limit, want_ids))
        if last > head:
            parts.append(codec.part(chunk[head:last], True, limit, want_ids))
        else:
            last = head
        seam = chunk[last:]
    if seam:
        parts.append(codec.part(seam, False, limit, want_ids))
    return parts


_codecs: dict[int, Codec] = {}


def _codec(packed) -> Codec:
    if packed.id not in _codecs:
        _codecs.clear()
        _codecs[packed.id] = Codec(packed.value)
    return _codecs[packed.id]


class _Packed:
    """A broadcast with a key that a worker can keep its codec under."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast.id if hasattr(broadcast, "id") else id(broadcast)

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _make(packed, bits: int, limit: int, digest: bool):
    def make(part: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(packed)
        data, off = text_bytes(part.column("text"))
        at = cut_points(data, off, bits)
        edge = np.searchsorted(at, off)
        raw = data.tobytes()
        n, a, b = [], [], []
        for i in range(len(off) - 1):
            ends = [off[i], *at[edge[i]:edge[i + 1]], off[i + 1]]
            chunks = [raw[p:q].decode("utf-8") for p, q in zip(ends, ends[1:]) if q > p]
            parts = encode_text(codec, chunks, limit, not digest)
            n.append(sum(p[0] for p in parts))
            plain = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
            if digest:
                a.append(hashlib.sha256(",".join([p[1] for p in parts if p[0]]).encode()).hexdigest())
                b.append(hashlib.sha256(plain.encode()).hexdigest())
            else:
                a.append([x for p in parts for x in p[3]])
                b.append(plain)
        return [pa.array(n, pa.int64()), pa.array(a, pa.string() if digest else pa.list_(pa.int32())),
                pa.array(b, pa.string())]
    return make


def encode_documents(docs: DataFrame, path: str | None = None, digest: bool = False, cut_bits: int = CUT_BITS,
                     reuse_bytes: int = REUSE_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``(n_tokens, ids, decoded)`` of its whole text.

    ``digest`` gives ``(n_tokens, ids_sha256, decoded_sha256)`` instead: of the
    decimal ids joined by commas and of the decoded text.  A null or empty text
    has no ids and decodes to the empty text.  Equal texts get equal ids.  Own
    columns with those names are dropped; an empty table gives an empty table.
    """
    vocabulary = load_vocabulary(path or vocabulary_path())
    packed = _Packed(docs.sparkSession.sparkContext.broadcast(pack_vocabulary(vocabulary)))
    return with_arrow_columns(docs, ["text"], _make(packed, cut_bits, reuse_bytes, digest),
                              DIGEST if digest else NEW)
