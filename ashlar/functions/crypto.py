"""Hashing and encryption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ashlar.functions.strings import password  # noqa: F401


def folded_key(key: str, size: int = 16) -> bytes:
    """A key of any length laid over ``size`` bytes by exclusive or."""
    out = bytearray(size)
    for i, b in enumerate(key.encode()):
        out[i % size] ^= b
    return bytes(out)


def aes_encrypt(text: Column, key: str) -> Column:
    """AES-128 in electronic codebook mode, NULL for NULL."""
    return F.aes_encrypt(text.cast("binary"), F.lit(folded_key(key)), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(data: Column, key: str) -> Column:
    """NULL where the data or the key is wrong."""
    return F.try_aes_decrypt(data, F.lit(folded_key(key)), F.lit("ECB"), F.lit("PKCS"))


def md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def sha1(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))
