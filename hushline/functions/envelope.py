"""Sealing of columns with AES-256-GCM in built-in expressions; keys come as columns, from a secure source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONCE_BYTES, TAG_BYTES = 12, 16


def seal(plain: Column, key: Column, aad: Column) -> Column:
    """Nonce, ciphertext and tag, end to end, of a binary column; null plaintexts stay null.

    An empty nonce makes the engine draw one from its secure random source for each row, so write
    the result before it is read twice.
    """
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def parts(sealed: Column) -> dict[str, Column]:
    """nonce, ciphertext and tag of a sealed column."""
    n = F.length(sealed)
    return {"nonce": F.substring(sealed, 1, NONCE_BYTES), "ciphertext": sealed.substr(F.lit(NONCE_BYTES + 1), n - NONCE_BYTES - TAG_BYTES), "tag": sealed.substr(n - TAG_BYTES + 1, F.lit(TAG_BYTES))}


def opened(sealed: Column, key: Column, aad: Column) -> Column:
    """The plaintext; null where key, aad or any sealed byte was changed."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)
