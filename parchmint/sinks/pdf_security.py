"""Password protection of PDF files: the standard handler of revision 6 (AES-256), with the JVM's cipher.

Runs on the driver, for single exports: keys are made there and never reach a task.
"""

from __future__ import annotations

import hashlib
import secrets
import unicodedata
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Fixed value: bits (from 1) of what is allowed: print, modify, copy, annotate, fill, extract, assemble, print well.
ALLOWED = (3, 4, 5, 6, 9, 10, 11, 12)


class Cbc:
    """AES in CBC mode by ``javax.crypto``."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm

    def run(self, key: bytes, iv: bytes, data: bytes, padded: bool = False, decrypt: bool = False) -> bytes:
        c = self.jvm.javax.crypto.Cipher.getInstance("AES/CBC/PKCS5Padding" if padded else "AES/CBC/NoPadding")
        spec = self.jvm.javax.crypto.spec
        c.init(2 if decrypt else 1, spec.SecretKeySpec(bytearray(key), "AES"), spec.IvParameterSpec(bytearray(iv)))
        return bytes(c.doFinal(bytearray(data)))


def permissions() -> int:
    """The allowed bits with the reserved ones set, as a signed number of 32 bits."""
    p = 0xFFFFF000 | 0b11000000
    for bit in ALLOWED:
        p |= 1 << (bit - 1)
    return p - (1 << 32)


def prepared(password: str) -> bytes:
    return unicodedata.normalize("NFKC", password).encode()[:127]


def hardened(aes: Cbc, password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The iterated hash: at least 64 rounds, and on until the last byte of a round's cipher text is small enough."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = aes.run(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[int.from_bytes(e[:16], "big") % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


@dataclass
class Protection:
    key: bytes
    dictionary: str
    aes: Cbc

    def encrypt(self, data: bytes) -> bytes:
        iv = secrets.token_bytes(16)
        return iv + self.aes.run(self.key, iv, data, padded=True)


def protect(spark: SparkSession, password: str, owner: str = "") -> Protection:
    """A fresh file key under a user's and an owner's password (the same, if none is given)."""
    aes, key = Cbc(spark), secrets.token_bytes(32)
    zero = bytes(16)

    def entry(pw: bytes, extra: bytes) -> tuple[bytes, bytes]:
        check, own = secrets.token_bytes(8), secrets.token_bytes(8)
        return hardened(aes, pw, check, extra) + check + own, aes.run(hardened(aes, pw, own, extra), zero, key)

    u, ue = entry(prepared(password), b"")
    o, oe = entry(prepared(owner or password), u)
    p = permissions()
    perms = aes.run(key, zero, p.to_bytes(4, "little", signed=True) + b"\xff" * 4 + b"Tadb" + secrets.token_bytes(4))
    h = lambda b: f"<{b.hex()}>"
    return Protection(key, f"<< /Filter /Standard /V 5 /R 6 /Length 256 /P {p} /EncryptMetadata true /CF << /StdCF << /AuthEvent /DocOpen /CFM /AESV3 /Length 32 >> >> /StmF /StdCF /StrF /StdCF /O {h(o)} /U {h(u)} /OE {h(oe)} /UE {h(ue)} /Perms {h(perms)} >>", aes)


def file_key(spark: SparkSession, password: str, u: bytes, ue: bytes) -> bytes | None:
    """The file key by the user's password and the U and UE entries; None for a wrong password."""
    aes, pw = Cbc(spark), prepared(password)
    if hardened(aes, pw, u[32:40]) != u[:32]:
        return None
    return aes.run(hardened(aes, pw, u[40:48]), bytes(16), ue, decrypt=True)
