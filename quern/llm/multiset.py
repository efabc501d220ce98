"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A fingerprint is the sum of wide vectors, one for each paragraph of the text (its lines), modulo powers of two, so that
the order of paragraphs does not matter and a paragraph is inserted or deleted by adding or subtracting its vector.
The vector of a paragraph has two parts. The first, ``EQUAL`` lanes modulo 2**64, is a keyless hash of the whole
paragraph and tells different multisets apart. The second, ``NEAR`` lanes modulo 2**32, is itself the sum of
vectors of +1 and -1 hashed from the paragraph's phrases; the cosine of two such parts estimates how alike the texts
are (0 to 1, standard error about 1 / sqrt(NEAR)). A phrase ends with punctuation; a long phrase is cut after words
whose hash says so, so that an insertion moves no cut but near it.

Null and empty texts have no paragraph: all lanes are 0, they are alike to each other (1) and unlike others (0).
Empty lines count as paragraphs of texts that have other characters, so that equal fingerprints mean equal lines up
to their order. Repeated rows get the same fingerprint. A paragraph of any length is hashed whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quern.llm.common import values
from quern.llm.ordered import with_next

EQUAL, NEAR = 8, 128
PHRASE = re.compile(r"[^\w\s]+|\n")
LONG, CUT = 16, 8


def _phrases(paragraph: str) -> Iterator[str]:
    for x in PHRASE.split(paragraph):
        words = x.split()
        if len(words) <= LONG:
            if words:
                yield " ".join(words)
            continue
        at = 0
        for i, w in enumerate(words):
            if zlib.crc32(w.encode("utf-8", "surrogatepass")) % CUT == 0 or i == len(words) - 1:
                yield " ".join(words[at : i + 1])
                at = i + 1


def near_part(paragraphs: Iterable[str]) -> np.ndarray:
    """Sum of the sign vectors of all phrases, modulo 2**32: a text of 2 GB has too few phrases to wrap."""
    digests = b"".join(xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for x in paragraphs for p in _phrases(x))
    n = len(digests) // 16
    ones = np.zeros(NEAR, np.int64)
    for i in range(0, n, 65536):
        part = np.frombuffer(digests, np.uint8)[i * 16 : (i + 65536) * 16].reshape(-1, 16)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return (2 * ones - n).astype(np.uint32)


def equal_part(paragraphs: Iterable[str]) -> np.ndarray:
    """Sum of the hashes of all paragraphs, each lane modulo 2**64."""
    digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * EQUAL).digest() for p in paragraphs)
    return np.frombuffer(digests, np.uint64).reshape(-1, EQUAL).sum(axis=0, dtype=np.uint64)


class Fingerprint:
    """The two parts, and the group operation on them."""

    __slots__ = ("equal", "near")

    def __init__(self, equal: np.ndarray, near: np.ndarray) -> None:
        self.equal, self.near = equal, near

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        paragraphs = (text or "").split("\n") if text else []
        return cls(equal_part(paragraphs), near_part(paragraphs))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.near + other.near)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.near - other.near)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.equal == other.equal).all() and (self.near == other.near).all())

    def __hash__(self) -> int:
        return hash(self.equal.tobytes())

    def hex(self) -> str:
        return (self.equal.astype("<u8").tobytes() + self.near.astype("<u4").tobytes()).hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the near parts, not below 0 and not quite 1."""
        if self == other:
            return 1.0
        a, b = self.near.view(np.int32).astype(float), other.near.view(np.int32).astype(float)
        size = float(a @ a) * float(b @ b)
        return min(max(float(a @ b) / size**0.5, 0.0), 0.9999) if size > 0 else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the first of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULTS = (
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside its next one; both are fingerprinted once."""
    fields = [("_id", pa.int64()), *RESULTS]
    held, ended = None, None
    for batch in batches:
        out = []
        keys, where, peeks = (batch.column(n).to_pylist() for n in ("_id", "_range", "_peek"))
        texts = (x for part in values([batch.column("_text")]) for x in part)
        for key, text, at, peek in zip(keys, texts, where, peeks, strict=True):
            if peek and at == ended:
                continue  # the range has had its next row
            fp = Fingerprint.of(text)
            if held is not None:
                out.append(_row(*held, text, fp))
            held = (key, text, fp)
            if peek:
                held, ended = None, at
        columns = list(zip(*out, strict=True)) or [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
    if held is not None:
        raise RuntimeError("a range without its next row")


def _row(key, text: str, fp: Fingerprint, following: str, other: Fingerprint) -> tuple:
    new = edited(text, following)
    changed = Fingerprint.of(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, fp.hex(), changed.hex(), fp.likeness(changed), fp.likeness(other)


def compare_edited(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """For every row its fingerprint, that of its edited text and how like it is to that and to the next row's.

    Returns the id and the six results only, whatever other columns there are.
    """
    rows = with_next(docs, text, id).drop("_hash")
    found = rows.mapInArrow(_pairs, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("_id", id)
