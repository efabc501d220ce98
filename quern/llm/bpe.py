"""Byte-level BPE encoding and decoding, as a monoid of encoded pieces that are joined up a tree.

Every text longer than ``LEAF`` characters is cut in halves until the pieces are that short; a piece keeps its matches
of the pattern and the token ids of each. Two encoded neighbours are joined by encoding a window around their border
again. The window starts at a match of the left piece that cannot have looked at the border (it is not among the left
piece's last matches) and ends where a match of the window begins at the place of a match of the right piece: the
pattern scans from left to right and each match is encoded alone, so that from there on both scans see the same text
from the same place, and the tokens outside are proven stable. If the window holds no such place it doubles, to both
whole pieces at most, so that any text ends. Decoding halves the ids alike and concatenates bytes up the tree.

The pattern must cover every text, may look ahead by one character beyond a match, not behind it, and look ahead over
``WINDOW`` matches at most. Null is encoded like the empty text: no tokens. Texts may be of any length, repeated rows
get the same ids, an empty table gives no rows, and no row depends on another, so that there are no ties. Further
columns pass through; columns that carry the names of results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import per_worker, structs, values, with_fields

#: Characters (or ids) that are encoded (or decoded) at once; matches at a border that are encoded again at first.
LEAF, WINDOW = 256, 4
#: A vocabulary is sent to the executors only if its file is no larger.
MOST_BYTES = 64 << 20
#: Matches whose ids a worker keeps, of at most so many characters each.
KEPT, KEPT_CHARS = 100_000, 32

#: An encoded stretch of text: its matches in order, and the ids of each.
Piece = tuple[list[str], list[tuple[int, ...]]]


class _Known(dict):
    """The ids of matches, each encoded alone."""

    def __init__(self, encoder: tiktoken.Encoding) -> None:
        super().__init__()
        self.encode = encoder._encode_single_piece  # merges only, without the pattern

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = tuple(self.encode(match.encode()))
        if len(match) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[match] = ids
        return ids


class Codec:
    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        pairs = (line.split() for line in ranks_file.splitlines() if line)
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.encoder)
        find = regex.compile(pattern)
        self.matches = (lambda t: [m[0] for m in find.finditer(t)]) if find.groups else find.findall
        self.tokens = {i: b for b, i in ranks.items()}

    def _leaf(self, text: str) -> Piece:
        matches = self.matches(text)
        if sum(map(len, matches)) != len(text):
            raise ValueError("the pattern leaves characters out")
        return matches, list(map(self.known.__getitem__, matches))

    def _join(self, a: Piece, b: Piece) -> Piece:
        (a_matches, a_ids), (b_matches, b_ids) = a, b
        if not a_matches or not b_matches:
            return a if a_matches else b
        window = WINDOW
        while True:
            left, right = a_matches[-window:], b_matches[:window]
            whole = len(right) == len(b_matches)
            begins, at = {}, sum(map(len, left))
            for j, x in enumerate(right):
                begins[at] = j
                at += len(x)
            middle, at, same = self.matches("".join(left) + "".join(right)), 0, None
            # a match looks one character ahead, so unless the text ends there the window's last matches are not used
            for k, x in enumerate(middle if whole else middle[:-2]):
                if at in begins:
                    same = k, begins[at]
                    break
                at += len(x)
            if same or whole:
                break
            window *= 2
        k, j = same or (len(middle), len(b_matches))
        kept = len(a_matches) - len(left)
        new = middle[:k]
        return a_matches[:kept] + new + b_matches[j:], a_ids[:kept] + list(map(self.known.__getitem__, new)) + b_ids[j:]

    def _tree(self, text: str, start: int, end: int, leaf: int) -> Piece:
        if end - start <= leaf:
            return self._leaf(text[start:end])
        half = (start + end) // 2
        return self._join(self._tree(text, start, half, leaf), self._tree(text, half, end, leaf))

    def encode(self, text: str | None, leaf: int = LEAF) -> np.ndarray:
        text = text or ""
        return np.fromiter(chain.from_iterable(self._tree(text, 0, len(text), leaf)[1]), np.uint32)

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def read_ranks(path: str) -> bytes:
    """A vocabulary file, which the driver reads; its size is checked as it will be broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


def _sent(docs: DataFrame, path: str, pattern: str):
    """What gives a worker its codec, made once and kept."""
    ranks = read_ranks(path)
    name = ("bpe", hashlib.sha256(ranks).digest(), pattern)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    return lambda: per_worker(name, lambda: Codec(sent.value, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the token ids of every text as an array."""
    codec_of = _sent(docs, path, pattern)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of()
        for part in values(batches):
            yield pa.array([codec.encode(x).astype(np.int32) for x in part], pa.list_(pa.int32()))

    return docs.withColumn(to, ids(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that the token ids stand for; null ids give no bytes."""
    codec_of = _sent(docs, path, pattern)

    @F.arrow_udf("binary")
    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of()
        for part in values(batches):
            yield pa.array([codec.decode(np.asarray(x or [], np.int64)) for x in part], pa.binary())

    return docs.withColumn(to, back(F.col(ids)))


DIGEST = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass: adds n_tokens, ids_sha256 and decoded_sha256, and the ids if they get a name."""
    codec_of = _sent(docs, path, pattern)
    fields = [*DIGEST, *([(ids, pa.list_(pa.int32()))] if ids else [])]

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + (f", `{ids}` array<int>" if ids else ""))
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of()
        for part in values(batches):
            rows = []
            for x in part:
                found = codec.encode(x)
                row = (len(found), hashlib.sha256(found.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(found)).hexdigest())
                rows.append((*row, found.astype(np.int32)) if ids else row)
            yield structs(rows, fields)

    return with_fields(docs, digest(F.col(text)), [n for n, _ in fields])
