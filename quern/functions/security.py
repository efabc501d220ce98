"""Checks, hashes and encryption of strings."""

from __future__ import annotations

import hashlib
import hmac as _hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of an e-mail address.
EMAIL = r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"


def is_valid_email(x: Column) -> Column:
    return x.rlike(EMAIL)


def is_strong_password(x: Column) -> Column:
    """Eight bytes or more, with upper and lower case, a digit and ASCII punctuation."""
    kinds = ("[A-Z]", "[a-z]", "[0-9]", r"[!-/:-@\[-`{-~]")
    out = F.octet_length(x) >= 8
    for k in kinds:
        out = out & x.rlike(k)
    return out


def sanitize_input(x: Column) -> Column:
    """Printable ASCII without < > & and quotes."""
    return F.regexp_replace(x, "[^\\x20-\\x7E]|[<>&\"']", "")


def secure_compare(a: Column, b: Column) -> Column:
    return F.when(a == b, "true").otherwise("false")


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def hash_password(password: Column, salt: Column) -> Column:
    return F.sha2(F.concat(salt, password), 256)


def verify_password(password: Column, salt: Column, stored: Column) -> Column:
    return hash_password(password, salt) == stored


def derive_key(password: Column, salt: Column) -> Column:
    return F.unhex(hash_password(password, salt))


def hmac_sha256(key: bytes, x: Column) -> Column:
    """No built-in function has it."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if s is None else _hmac.new(key, s.encode(), hashlib.sha256).hexdigest() for s in b.to_pylist()], pa.string())

    return run(x)


def encrypt(x: Column, key: Column) -> Column:
    """AES-256-CBC with a random initial vector before the text, padded, so that ``decrypt`` gives it back."""
    return F.base64(F.aes_encrypt(x, key, F.lit("CBC"), F.lit("PKCS")))


def decrypt(x: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(x), key, F.lit("CBC"), F.lit("PKCS")).cast("string")


def random_string(n: int) -> Column:
    return F.randstr(n)


def csrf_token() -> Column:
    return random_string(32)


def is_csrf_token(x: Column) -> Column:
    return F.coalesce(F.octet_length(x) >= 16, F.lit(False))


def new_id(prefix: str = "id") -> Column:
    return F.concat(F.lit(prefix + "_"), F.uuid())


def bearer(header: Column) -> Column:
    return F.regexp_extract(header, r"\ABearer (.*)\z", 1)


def is_public(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out
