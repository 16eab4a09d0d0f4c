"""Vector and hash functions."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones or zero ones."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (both == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(both, F.lit(0.0)))


def l2_normalize(a: Column) -> Column:
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n)))
    return scaled[0]  # a list of one holds the norm, so that it is made once


def embedding_broken(a: Column, dim: int) -> Column:
    """Empty, of another length, with a value that is not finite, or all zero; null is not broken."""
    bad = F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(a.isNull(), F.lit(False)).otherwise((F.size(a) != dim) | bad | F.forall(a, lambda x: x == 0))


def fnv1a_32(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes, as a long."""
    raw = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw), F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)) % F.lit(4294967296))


def fnv1a_32_of(words: pa.Array) -> np.ndarray:
    """``fnv1a_32`` of the strings of an Arrow array: all of them a byte further at each step, the longest first."""
    raw = [w.encode() for w in words.to_pylist()]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    sizes = np.array([len(raw[i]) for i in order], np.int64)
    data, starts = np.frombuffer(b"".join(raw[i] for i in order), np.uint8), np.cumsum(sizes) - sizes
    hashes = np.full(len(raw), 2166136261, np.uint64)
    n = len(raw)
    for place in range(int(sizes.max(initial=0))):
        while sizes[n - 1] <= place:
            n -= 1
        hashes[:n] = ((hashes[:n] ^ data[starts[:n] + place]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(raw), np.uint64)
    out[order] = hashes
    return out


def fnv1a_64(text: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hexadecimal digits."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        h = 0xCBF29CE484222325
        for b in value.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def hmac_sha256(key: str) -> Column:
    """A scalar function of the text, for this key."""

    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest())

    return sign


def signature_ok(key: str) -> Column:
    """A function of a text and its signature: whether the signature is the text's for this key, compared in constant time."""

    @F.pandas_udf("boolean")
    def check(text: pd.Series, signature: pd.Series) -> pd.Series:
        made = (hmac.new(key.encode(), (t or "").encode(), hashlib.sha256).hexdigest() for t in text)
        return pd.Series([hmac.compare_digest(m.encode(), (s or "").encode()) for m, s in zip(made, signature, strict=True)], dtype=bool)

    return check


def bucket_and_sign(hashed: Column, dim: int) -> tuple[Column, Column]:
    """Which component a token adds to, and with which sign (its top bit)."""
    return hashed % dim, F.when(hashed >= 2**31, -1).otherwise(1)
