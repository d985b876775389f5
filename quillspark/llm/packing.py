"""Token ids in packed rows: best-fit-decreasing by a segment tree over capacities, overlong documents split losslessly."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Split pattern of the rank files: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that are packed together; bounds a worker's memory. The rest of a task is packed as it is.
PACK_TOKENS = 4 << 20
#: Documents that are written into one Arrow batch of rows.
ROWS_OUT = 256


class Capacities:
    """Segment tree over the capacities 0 to ``most``: finds the least one, not under a need, that some open bin has."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.any = bytearray(2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        at = self.width + capacity
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the best fit, which is taken out; None if there is none."""
        at = self.width + need
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.width
        found = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return capacity, found


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Indices of the pieces (each 1 to ``length``) of every bin; longest first, each into the bin it fits best."""
    tree, bins = Capacities(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = tree.take(size)
        if fit is None:
            bins.append([i])
            left, at = length - size, len(bins) - 1
        else:
            left, at = fit[0] - size, fit[1]
            bins[at].append(i)
        if left:
            tree.add(left, at)
    return bins


#: Characters that are encoded at once by the pattern above, whose matcher fails on far longer runs of white space.
ENCODE_CHARS = 1 << 16
#: Texts, and characters, whose ids are lists at once (one text, or part of a long one, at least).
SLICE_TEXTS, SLICE_CHARS = 64, 1 << 20


def encodable(text: str, most: int = ENCODE_CHARS) -> list[str]:
    """``text`` in parts of at most ``most`` characters, cut before white space where some other character stands before.

    No token of PATTERN crosses such a place, so the parts' tokens are those of the text. A part without one, such as a
    run of millions of spaces, is cut anyhow: its tokens then still spell the text, byte for byte.
    """
    parts, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = max(text.rfind(" ", at, cut), text.rfind("\n", at, cut))
            if cut <= at or not text[cut - 1].isspace():
                break
        cut = cut if cut > at else at + most
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def encoded(encode, texts: pa.Array, parted: bool):
    """Yields (first row, id arrays) for runs of texts of at most SLICE_TEXTS rows and SLICE_CHARS characters.

    Ids are 4 bytes each once a run is done, so several very long texts in a row cost no more than one. A text that is longer
    is encoded in parts where the tokenizer allows it (``parted``): no token crosses where ``encodable`` cuts.
    """
    chars = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
    ends, lo = np.cumsum(chars), 0
    while lo < len(texts):
        hi = max(lo + 1, min(lo + SLICE_TEXTS, int(np.searchsorted(ends, ends[lo] - chars[lo] + SLICE_CHARS, "right"))))
        run = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        if parted and chars[lo] > SLICE_CHARS:
            yield lo, [np.concatenate([np.array(encode([part])[0], np.uint32) for part in encodable(run[0], SLICE_CHARS)])]
        else:
            yield lo, [np.array(t, np.uint32) for t in encode(run)]
        lo = hi


def load_tokenizer(name: str, content: bytes):
    """Function from a list of texts to lists of ids; ``name``'s ending tells the kind of file that ``content`` is."""
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [[i for part in encodable(t) for i in coder.encode_ordinary(part)] for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(content.decode())
        whole.encode_special_tokens = True
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: pieces.encode(texts, num_threads=1)
    raise ValueError(f"no tokenizer for {name}")


def position_ids(cu_seqlens: np.ndarray, length: int) -> np.ndarray:
    """Place of each token in its segment; 0 again where a segment begins, and on padding."""
    out = np.arange(length)
    starts = np.asarray(cu_seqlens[:-1])
    of = np.searchsorted(starts, out, "right") - 1
    return np.where(out < cu_seqlens[-1], out - starts[of], 0)


def pack_tokens(docs: DataFrame, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", length: int = 2048, end_id: int | None = 50256, pad_id: int = 50256, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of ``length`` tokens of all texts.

    (part, row): place of the packed row, unique; n_tokens: tokens in it, the rest is padding; input_ids and
    position_ids: ``length`` little-endian unsigned 16-bit numbers (32-bit where an id needs it, see ``id_bytes``), so
    the rows of a file stand as an id matrix; cu_seqlens: cumulative segment lengths from 0; doc_ids and doc_starts: of
    each segment the document and the place in its tokens, from which documents are put together again.

    Each document is its tokens and ``end_id`` (None: without). Documents over ``length`` are cut into pieces of
    ``length`` and a rest. Pieces are packed where they are read, longest first, each into the open row with the least
    room that holds it, PACK_TOKENS at a time: no text or token is shuffled. The vocabulary file, of bounded size, is
    read on the driver and sent to the workers. Null and empty texts have no tokens and no segment; repeated rows are
    packed as often as they come.
    """
    if not 0 < length < 1 << 16:
        raise ValueError("length must be between 1 and 65535")
    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    read = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t"))
    new = StructType.fromDDL("part int, row long, n_tokens int, id_bytes int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_starts array<long>").fields
    schema = StructType([*new, StructField("doc_ids", ArrayType(read.schema["__id"].dataType))])

    def run(batches):
        encode, part, row = load_tokenizer(tokenizer, sent.value), TaskContext.get().partitionId(), 0

        def packed(ids, tokens):
            nonlocal row
            sizes = np.array([len(t) for t in tokens])
            pieces = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(sizes[doc] - start, length)
            bins = best_fit_decreasing(size, length)
            for lo in range(0, len(bins), ROWS_OUT):
                some = bins[lo : lo + ROWS_OUT]
                out: dict[str, list] = {f.name: [] for f in schema.fields}
                picked = []
                for b in some:
                    cu = np.concatenate([[0], np.cumsum(size[b])])
                    whole = np.full(length, pad_id, np.uint32)
                    whole[: cu[-1]] = np.concatenate([tokens[doc[i]][start[i] : start[i] + size[i]] for i in b])
                    kind = "<u2" if int(whole.max()) < 1 << 16 else "<u4"
                    values = (part, row, int(cu[-1]), int(kind[-1]), whole.astype(kind).tobytes(), position_ids(cu, length).astype(kind).tobytes(), cu.astype(np.int32), start[b])
                    for f, v in zip(new, values):
                        out[f.name].append(v)
                    picked.append(doc[b])
                    row += 1
                arrays = [pa.array(out[f.name], t) for f, t in zip(new, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())))]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in picked])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(np.concatenate(picked)))))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        held_ids, held, number = [], [], 0
        for batch in batches:
            for lo, made in encoded(encode, batch.column(1), tokenizer.endswith(".tiktoken")):
                some = [i for i, t in enumerate(made) if len(t)]
                held_ids.append(batch.column(0).slice(lo, len(made)).take(pa.array(some, pa.int64())))
                held += [made[i] if end_id is None else np.append(made[i], np.uint32(end_id)) for i in some]
                number += sum(len(made[i]) for i in some)
                if number >= PACK_TOKENS:
                    yield from packed(pa.concat_arrays(held_ids), held)
                    held_ids, held, number = [], [], 0
        if held:
            yield from packed(pa.concat_arrays(held_ids), held)

    return read.mapInArrow(run, schema)
