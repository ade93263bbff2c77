"""Sealing: AES-256-GCM under a password's key, bound to the document's id. Keys are made on the driver and passed as literals of a column."""

from __future__ import annotations

import hashlib
import secrets
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS, MIN_PASSWORD = 600_000, 6
MAGIC = b"FLV1"  # Fixed value: mark of a sealed value.


def check_password(password: str) -> str | None:
    return None if len(password) >= MIN_PASSWORD else f"at least {MIN_PASSWORD} characters"


def derive_key(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", unicodedata.normalize("NFC", password).encode(), salt, iterations)


def new_salt() -> bytes:
    return secrets.token_bytes(16)


def seal(data: Column, key: bytes, doc_id: Column) -> Column:
    """Mark, initial vector, cipher text and tag; null stays null."""
    body = F.aes_encrypt(data.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), doc_id.cast("string"))
    return F.when(data.isNotNull(), F.concat(F.lit(MAGIC), body))


def is_sealed(data: Column) -> Column:
    return F.coalesce((F.substring(data, 1, 4) == F.lit(MAGIC)) & (F.octet_length(data) >= 4 + 12 + 16), F.lit(False))


def unseal(data: Column, key: bytes, doc_id: Column) -> Column:
    """The plain bytes; null for a wrong password, another document's value, or anything changed."""
    body = F.substring(data, 5, 2_147_483_647)
    return F.when(is_sealed(data), F.try_aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), doc_id.cast("string")))


def seal_json(value: Column, key: bytes, doc_id: Column) -> Column:
    return F.base64(seal(F.to_json(value), key, doc_id))


def unseal_json(text: Column, key: bytes, doc_id: Column, schema: str) -> Column:
    return F.from_json(unseal(F.unbase64(text), key, doc_id).cast("string"), schema)


class VaultSession:
    """Passwords of documents opened for a time; they live in the driver's memory only."""

    def __init__(self) -> None:
        self._keys: dict[str, bytes] = {}

    def open(self, doc_id: str, key: bytes) -> None:
        self._keys[doc_id] = key

    def relock(self, doc_id: str) -> bytes | None:
        return self._keys.pop(doc_id, None)

    def relock_all(self) -> list[str]:
        ids = sorted(self._keys)
        self._keys.clear()
        return ids
