"""Token ids of a byte-level BPE vocabulary, by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be merged over, so text may be cut between such bytes. Cuts are
made where, besides, the pre-splitting pattern can't tell the difference: between two characters of any script that aren't white space, or before an ASCII space that follows one, away from
apostrophes. The fragments of a batch are cut out of its buffer without copying, made distinct, encoded once each, and the ids are gathered back. So the cost
follows the distinct fragments, and no fragment grows with the document unless the text has no certain cut at all.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary lies on each executor, and the published pattern that splits text before the merges.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text handled at once, most fragments remembered between batches, the longest that is remembered.
SLICE, MEMO, LONGEST = 4 << 20, 300_000, 64


def certain_cuts(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes (first * 256 + second) whether a cut between them changes nothing, if neither belongs to white space beyond ASCII (:func:`wide_space`).

    The second byte begins a character. Between characters of one class the pattern goes on, between classes it splits anyway, and so do fragments; only an apostrophe looks further.
    """
    inside = np.zeros((256, 256), bool)
    for token in tokens:
        b = np.frombuffer(token, np.uint8)
        inside[b[:-1], b[1:]] = True
    letter = np.zeros(256, bool)
    letter[ord("A") : ord("Z") + 1] = letter[ord("a") : ord("z") + 1] = True
    digit = np.zeros(256, bool)
    digit[ord("0") : ord("9") + 1] = True
    shown = np.zeros(256, bool)
    shown[0x21:0x7F] = True
    sign = shown & ~letter & ~digit
    quote = np.zeros(256, bool)
    quote[ord("'")] = True
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    later, lead = np.zeros(256, bool), np.zeros(256, bool)  # last bytes and first bytes of characters beyond ASCII
    later[0x80:0xC0], lead[0xC2:0xF5] = True, True
    # after an apostrophe a letter may belong to a contraction; an apostrophe that begins a fragment may begin one
    safe = (shown | later)[:, None] & (shown | lead | space) & ~(quote[:, None] & (letter | lead)) & ~((sign | later)[:, None] & quote)
    return (safe & ~inside).reshape(-1)


#: White space beyond ASCII, as the pattern sees it.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def wide_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space beyond ASCII."""
    out = np.zeros(len(data), bool)
    for first in {w[0] for w in WIDE_SPACES}:
        at = np.flatnonzero(data == first)
        for w in (w for w in WIDE_SPACES if w[0] == first):
            hit = at[at + len(w) <= len(data)]
            for i, byte in enumerate(w[1:], 1):
                hit = hit[data[hit + i] == byte]
            for i in range(len(w)):
                out[hit + i] = True
    return out


class Encoder:
    """Ids of texts; ``path`` is a rank file (base64 token, rank)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.cuts = certain_cuts(list(ranks))
        self.memo: dict[bytes, bytes] = {}
        core = self.bpe._core_bpe
        buffer = getattr(core, "encode_to_tiktoken_buffer", None)
        none: frozenset[str] = frozenset()
        self.raw = (lambda s: bytes(buffer(s, none))) if buffer else (lambda s: self.bpe.encode_to_numpy(s).astype("<u4").tobytes())

    def fragment(self, text: bytes) -> bytes:
        """The ids as little-endian int32."""
        s = text.decode()
        try:
            return self.raw(s)
        except ValueError:  # white space too long for the library's pattern engine
            ids = [i for piece in self.pattern.findall(s) for i in self.bpe._encode_single_piece(piece)]
            return np.asarray(ids, "<i4").tobytes()

    def distinct(self, fragments: list[bytes]) -> list[bytes]:
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for f in fragments:
            ids = memo.get(f)
            if ids is None:
                ids = self.fragment(f)
                if len(f) <= LONGEST:
                    memo[f] = ids
            out.append(ids)
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at ``starts`` in the bytes ``data``, and how many each text has. ``starts[0]`` is 0."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        pairs = data[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= data[1:]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = self.cuts[pairs]
        wide = wide_space(data)
        if wide.any():
            cut[1:n] &= ~(wide[:-1] | wide[1:])
        cut[starts] = True
        cut[n] = True
        at = np.flatnonzero(cut)
        frags = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = frags.indices.to_numpy()
        ids = self.distinct(frags.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<i4")
        begin = np.cumsum(size) - size
        length = size[which]
        total = np.cumsum(length)
        flat = pool[np.repeat(begin[which] - (total - length), length) + np.arange(total[-1])]
        upto = np.append(0, total)[np.searchsorted(at, np.append(starts, n))]
        return flat, np.diff(upto)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def _encoded(texts: pa.Array, path: str, pattern: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch: first row, rows, ids, ids per row. Null texts have none."""
    enc = encoder(path, pattern)
    texts = texts.fill_null("").cast(pa.large_binary())
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE, "right")) - 1)
        yield row, to - row, *enc.encode(data[offs[row] : offs[to]], offs[row:to] - offs[row])
        row = to


def _run(df: DataFrame, keys: list[str], text: str, out: T.StructField, make: Callable, path: str, pattern: str) -> DataFrame:
    schema = T.StructType([*(df.schema[k] for k in keys), out])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for row, rows, ids, counts in _encoded(b.column(n), path, pattern):
                    yield pa.RecordBatch.from_arrays([*(c.slice(row, rows) for c in b.columns[:n]), make(ids, counts)], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)


def token_ids(df: DataFrame, keys: list[str], text: str, out: str = "ids", path: str = BYTE_BPE_50K, pattern: str = PATTERN) -> DataFrame:
    """``keys..., out ARRAY<INT>``: the ids of each row's text without special tokens.

    Strings that look like special tokens are ordinary text. An empty and a null text give an empty list. Texts of any length are taken whole; repeated rows stay;
    an empty table gives no rows; columns other than keys and text are not read, and no key may be named like ``out``. No shuffle.
    """
    make = lambda ids, counts: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
    return _run(df, keys, text, T.StructField(out, T.ArrayType(T.IntegerType())), make, path, pattern)


def token_counts(df: DataFrame, keys: list[str], text: str, out: str = "n_tokens", path: str = BYTE_BPE_50K, pattern: str = PATTERN) -> DataFrame:
    """``keys..., out BIGINT``: how many ids :func:`token_ids` gives."""
    return _run(df, keys, text, T.StructField(out, T.LongType()), lambda ids, counts: pa.array(counts), path, pattern)
