"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both encodings of a text cover the same bytes (a space and the text), so a token
is its end offset.  Where the k-th end of one equals the (k + shift)-th end of the
other the tokens run side by side: the two end arrays are compared at the current
shift in stretches that double in length, and a whole one-to-one stretch is jumped
at once.  At a mismatch the irregular group is resolved locally (the next end that
both have, from small windows of both arrays), the shift is updated, and probing
starts again.  Many places are walked side by side: a slice of documents is cut
into lanes at ends that both arrays share, every lane has its own shift.

A link is an A and a B token that end together.  How often a pair of ids is linked
in the corpus is counted by Spark: a block of documents sends each of its distinct
pairs once, the sums come back to the block by a join on the pair, so nothing of
the corpus is broadcast or collected.

Texts are encoded in stretches of about 64 kB, cut before a space that follows a
non-space.  No token of either vocabulary crosses such a place: A's pattern never
matches across it, and B has no piece with a space after another character (both
are checked when the vocabularies are loaded), so the ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemscope.llm.bpe import Codec, load_vocabulary, pack_vocabulary, vocabulary_path
from itemscope.llm.common import numbered, slices, stash

#: Bytes of a text that are encoded at once.
STRETCH = 1 << 16
#: Text of a block (the unit that looks up pair counts).
BLOCK_BYTES = 2 << 20
#: Tokens of a lane, and of each side of a window that is searched for the end of an irregular group.
LANE, WINDOW = 64, 8
_CUT = re.compile(r"(?<=[^\s\x00]) (?=[^\s\x00])")

DOC = [T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
       T.StructField("n_links", T.LongType()), T.StructField("groups_sha256", T.StringType())]


class Aligner:
    """Encoders, byte lengths and names of both vocabularies in one Python worker."""

    def __init__(self, packed: bytes, model: bytes):
        import sentencepiece

        self.a = Codec(packed).inner
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_bytes = piece_bytes(self.b)
        n = self.a.n_vocab
        self.a_len = np.zeros(n, np.int64)
        for token in self.a.token_byte_values():
            self.a_len[self.a.encode_single_token(token)] = len(token)
        self.b_len = np.array([len(p) for p in self.b_bytes], np.int64)
        # every token with the sign that may follow it; a comma inside a side, a bar after A, a semicolon after B
        texts = [f"{i}{sign}".encode() for size, last in ((n, "|"), (len(self.b_len), ";")) for sign in (",", last)
                 for i in range(size)]
        self.names = np.array(texts, object)
        self.sides = (0, n, 2 * n, 2 * n + len(self.b_len))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides, both empty if a side's bytes are not those of a space and the text."""
        a: list[int] = []
        b: list[int] = []
        for part in stretches(text):
            a += self.a.encode_ordinary(" " + part)
            b += self.b.encode(part)
        plain = b" " + text.encode()
        if b"".join([self.b_bytes[i] for i in b]) != plain or self.a.decode_bytes(a) != plain:
            return [], []
        return a, b


def piece_bytes(processor) -> list[bytes]:
    """Bytes of every piece; refuses a vocabulary that stretches cannot be cut for."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            out.append(b"")
        else:
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} has a space after another character")
            out.append(piece.replace("▁", " ").encode())
    return out


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text cut at single spaces between non-spaces; the cutting spaces are left out."""
    out, lo = [], 0
    while len(text) - lo > size:
        cut = _CUT.search(text, lo + size)
        if cut is None:
            break
        out.append(text[lo:cut.start()])
        lo = cut.end()
    return [*out, text[lo:]]


def shared_ends(a: np.ndarray, b: np.ndarray, lane: int = LANE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``a`` and in ``b`` (strictly increasing, same last value) of the values that both have."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lanes start after every lane-th end of a that b has too
    cut = np.arange(lane - 1, len(a) - 1, lane)
    there = np.searchsorted(b, a[cut])
    same = b[there] == a[cut]
    i = np.concatenate([[0], cut[same] + 1])
    j = np.concatenate([[0], there[same] + 1])
    i_end, j_end = np.append(i[1:], len(a)), np.append(j[1:], len(b))
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    # beyond the last ends: two different values, so that windows may reach over
    a = np.concatenate([a, np.full(2 * lane + window, -1)])
    b = np.concatenate([b, np.full(2 * lane + window, -2)])
    live = np.arange(len(i))
    stretch = 4
    while len(live):
        p, q = i[live], j[live]
        room = np.minimum(i_end[live] - p, j_end[live] - q)
        # diagonal run: equal ends at the current shift, probed in stretches that double
        run = np.zeros(len(live), np.int64)
        open_, length = np.arange(len(live)), stretch
        while len(open_):
            step = np.arange(length)
            at_a, at_b = p[open_] + run[open_], q[open_] + run[open_]
            equal = a[at_a[:, None] + step] == b[at_b[:, None] + step]
            equal &= step < (room - run)[open_][:, None]
            got = np.where(equal.all(1), length, equal.argmin(1))
            run[open_] += got
            open_ = open_[(got == length) & (run[open_] < room[open_])]
            length = min(2 * length, lane)
        for start, into in ((p, in_a), (q, in_b)):
            total = int(run.sum())
            first = np.repeat(start - (np.cumsum(run) - run), run)
            into[first + np.arange(total)] = True
        p, q = p + run, q + run
        going = (p < i_end[live]) & (q < j_end[live])
        live, p, q = live[going], p[going], q[going]
        # irregular group: the smallest end that both windows have, or else both windows' common part is passed
        step = np.arange(window)
        wa, wb = a[p[:, None] + step], b[q[:, None] + step]
        wa = np.where(p[:, None] + step < i_end[live][:, None], wa, np.iinfo(np.int64).max - 1)
        wb = np.where(q[:, None] + step < j_end[live][:, None], wb, np.iinfo(np.int64).max)
        hit = wa[:, :, None] == wb[:, None, :]
        of_a = hit.any(2)
        found = of_a.any(1)
        x = of_a.argmax(1)
        y = hit[np.arange(len(live)), x].argmax(1)
        in_a[(p + x)[found]] = True
        in_b[(q + y)[found]] = True
        reach = np.minimum(wa[:, -1], wb[:, -1])[:, None]
        i[live] = p + np.where(found, x + 1, (wa <= reach).sum(1))
        j[live] = q + np.where(found, y + 1, (wb <= reach).sum(1))
        live = live[(i[live] < i_end[live]) & (j[live] < j_end[live])]
    return np.flatnonzero(in_a), np.flatnonzero(in_b)


def align_slice(aligner: Aligner, texts: list[str | None]):
    """Per document: ids of A and B, and the indices (within the document) of the tokens that end together."""
    ids = [aligner.encode(t) if t else ([], []) for t in texts]
    sizes = np.array([[len(x), len(y)] for x, y in ids], np.int64).reshape(-1, 2)
    a = np.array([k for x, _ in ids for k in x], np.int64)
    b = np.array([k for _, y in ids for k in y], np.int64)
    # one running end over all documents: both sides of a document have the same bytes
    end_a, end_b = shared_ends(np.cumsum(aligner.a_len[a]), np.cumsum(aligner.b_len[b]))
    off = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(sizes, 0)])
    return a, b, end_a, end_b, off, np.searchsorted(end_a, off[:, 0])


def group_text(aligner: Aligner, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of one document, from its ids and the (local) indices of the groups' last tokens."""
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[end_a] = True
    last_b[end_b] = True
    a_comma, a_bar, b_comma, b_semicolon = aligner.sides
    code = np.empty(len(a) + len(b), np.int64)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    code[np.arange(len(a)) + np.concatenate([[0], end_b + 1])[group_a]] = a + np.where(last_a, a_bar, a_comma)
    code[np.arange(len(b)) + (end_a + 1)[group_b]] = b + np.where(last_b, b_semicolon, b_comma)
    return b"".join(aligner.names[code].tolist())[:-1]


def narrow(values: np.ndarray) -> bytes:
    """The values in the fewest bytes each that hold them all."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


_aligners: dict[int, Aligner] = {}


def _aligner(key: int, packed, model) -> Aligner:
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(packed.value, model.value)
    return _aligners[key]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for part in slices(batches, "text"):
        held.append(part)
        size += part.column("text").nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _aligned(docs: DataFrame, n_own: int, a_path: str, b_path: str, block_bytes: int, groups: bool) -> DataFrame:
    """Rows of two kinds: a document with its packed links, and a block's pairs (``pairs``, ``counts``)."""
    context = docs.sparkSession.sparkContext
    packed = context.broadcast(pack_vocabulary(load_vocabulary(a_path)))
    with open(b_path, "rb") as f:
        model = context.broadcast(f.read())
    key = hash((a_path, b_path, packed.id if hasattr(packed, "id") else id(packed)))
    owns = [docs.schema[f"own{i}"] for i in range(n_own)]
    group_type = T.ArrayType(T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())),
                                           T.StructField("b", T.ArrayType(T.IntegerType()))]))
    extra = [T.StructField("groups", group_type)] if groups else []
    schema = T.StructType([*owns, *DOC, *extra, T.StructField("block", T.LongType()), T.StructField("n_distinct", T.IntegerType()),
                           T.StructField("used", T.BinaryType()), T.StructField("times", T.BinaryType()),
                           T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches):
        from pyspark import TaskContext

        aligner = _aligner(key, packed, model)
        base = TaskContext.get().partitionId() << 32
        for number, parts in enumerate(_blocks(batches, block_bytes)):
            per_doc, columns = [], {f.name: [] for f in [*DOC, *extra]}
            for part in parts:
                a, b, end_a, end_b, off, edge = align_slice(aligner, part.column("text").to_pylist())
                pair = a[end_a] << 32 | b[end_b]
                for d in range(part.num_rows):
                    (pa_, pb), (qa, qb), lo, hi = off[d], off[d + 1], edge[d], edge[d + 1]
                    ends = end_a[lo:hi] - pa_, end_b[lo:hi] - pb
                    text = group_text(aligner, a[pa_:qa], b[pb:qb], *ends) if qa > pa_ else None
                    digest = hashlib.sha256(text).hexdigest() if text else ""
                    for name, value in zip(columns, (qa - pa_, qb - pb, hi - lo, hi - lo, digest)):
                        columns[name].append(value)
                    if groups:
                        cuts = [np.split(ids, e[:-1] + 1) if len(e) else [] for ids, e in
                                ((a[pa_:qa], ends[0]), (b[pb:qb], ends[1]))]
                        columns["groups"].append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(*cuts)])
                    per_doc.append(np.unique(pair[lo:hi], return_counts=True))
            flat = np.concatenate([p for p, _ in per_doc])
            known, place = np.unique(flat, return_inverse=True)
            times = np.concatenate([c for _, c in per_doc])
            totals = np.bincount(place, times, len(known)).astype(np.int64)
            at = np.cumsum([0, *[len(p) for p, _ in per_doc]])
            n = len(per_doc)
            arrays = [pa.concat_arrays([p.column(i) for p in parts]) for i in range(n_own)]
            arrays += [pa.array(columns[f.name], pa.string() if f.name == "groups_sha256" else pa.int64()) for f in DOC]
            if groups:
                arrays.append(pa.array(columns["groups"], pa.list_(pa.struct(
                    [("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))))
            arrays += [pa.array([base + number] * n, pa.int64()), pa.array(np.diff(at), pa.int32()),
                       pa.array([narrow(place[x:y]) for x, y in zip(at, at[1:])], pa.binary()),
                       pa.array([narrow(times[x:y]) for x, y in zip(at, at[1:])], pa.binary()),
                       pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            sums = [pa.nulls(1, x.type) for x in arrays[:-6]] + [
                pa.array([base + number], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
                pa.nulls(1, pa.binary()), pa.array([known.tolist()], pa.list_(pa.int64())),
                pa.array([totals.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(sums, names=schema.names)
    return docs.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(block, i, pair, count, best)`` of the pairs of every block: corpus-wide count, and 1 where it is the highest of its B id."""
    each = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("i", "z"))
    each = each.select("block", "i", F.col("z.pairs").alias("pair"), F.col("z.counts").alias("c"))
    counts = each.groupBy("pair").agg(F.sum("c").alias("count"))
    # the window of a B id holds one row for each A id at most
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = F.max("count").over(Window.partitionBy("__b"))
    counts = counts.withColumn("__b", b_id).withColumn("best", (F.col("count") == highest).cast("int")).drop("__b")
    return each.join(stash(counts), "pair").select("block", "i", "pair", "count", "best")


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    A encodes a space and the text (byte-level BPE file of the tokenizers library),
    B the text (a sentencepiece model, which adds the space).  ``groups`` adds the
    groups themselves, a list of (ids of A, ids of B).  A text that is null or
    empty, or that either side does not give back byte for byte, has no tokens:
    zeros, no groups and an empty digest.  Equal texts get equal results, repeated
    rows count as often as they stand there.  Ties for the highest count of a B id
    are all best.  Own columns with the new names are replaced; an empty table
    gives an empty table.
    """
    new = [f.name for f in DOC] + ["n_best", "count_sum"] + ["groups"] * groups
    own = [c for c in docs.columns if c not in new]
    held = numbered(docs.select(*[F.col(f"`{c}`") for c in own]), ["text"] if "text" in own else [])
    n_own = len(own)
    made = stash(_aligned(held, n_own, a_path or vocabulary_path(), b_path or vocabulary_path("piece_bpe_32k.model"),
                          block_bytes, groups))
    names = [f"own{i}" for i in range(n_own)] + [f.name for f in DOC] + ["groups"] * groups
    rows = made.where("pairs is null").select(*names, "block", "n_distinct", "used", "times")
    counts = pair_counts(made).select(F.col("block").alias("in_block"), "i", "count", "best")
    schema = T.StructType([made.schema[n] for n in names] + [T.StructField("n_best", T.LongType()),
                                                             T.StructField("count_sum", T.LongType())])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        i = right["i"].to_numpy()
        count[i], best[i] = right["count"].to_numpy(), right["best"].to_numpy()
        sums, bests = [], []
        for n, used, times in zip(*(left[c].to_pylist() for c in ("n_distinct", "used", "times"))):
            at, k = widen(used, n), widen(times, n)
            sums.append(int((k * count[at]).sum()))
            bests.append(int((k * best[at]).sum()))
        return pa.table([left[n] for n in names] + [pa.array(bests, pa.int64()), pa.array(sums, pa.int64())],
                        names=schema.names)
    out = rows.groupBy("block").cogroup(counts.groupBy("in_block")).applyInArrow(add, schema)
    return out.toDF(*own, *schema.names[n_own:])
