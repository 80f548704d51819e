"""Hashes, pseudonyms, signatures and tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
# Default domain of feature commitments (a parameter everywhere), rounds of the password hash.
COMMIT_DOMAIN = "feature-commit-v1"
PASSWORD_ROUNDS = 100_000


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as binary, made of built-in hashes."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.to_binary(message, F.lit("utf-8"))), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def pseudonym(salt: str, value: Column, prefix: str = "asset_") -> Column:
    """Prefix and the first 8 bytes of the keyed hash in URL-safe base64; empty and null stay null."""
    short = F.unhex(F.substring(F.hex(hmac_sha256(salt.encode(), value)), 1, 16))
    code = F.translate(F.base64(short), "+/=", "-_")
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), code))


def bounded_hash(x: Column, bits: int = 28) -> Column:
    """Low bits of the md5 as a number."""
    return (F.conv(F.substring(F.md5(x), 25, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1))).cast("long")


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def password_hash(password: str, salt: bytes) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, PASSWORD_ROUNDS).hex()


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def issue_token(subject: str, role: str, secret: bytes, issuer: str, ttl: int, now: int | None = None) -> str:
    """A signed token (HS256)."""
    now = int(time.time()) if now is None else now
    parts = [_b64(canonical_json(x).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, {"iss": issuer, "sub": subject, "role": role, "iat": now, "exp": now + ttl})]
    body = ".".join(parts)
    return f"{body}.{_b64(hmac.new(secret, body.encode(), hashlib.sha256).digest())}"


def verify_token(token: str, secret: bytes, issuer: str, now: int | None = None) -> dict | None:
    """The claims of a token, or None if its form, signature, issuer or time is not right."""
    now = int(time.time()) if now is None else now
    try:
        head, claims, signature = token.split(".")
        good = hmac.new(secret, f"{head}.{claims}".encode(), hashlib.sha256).digest()
        if not hmac.compare_digest(good, _unb64(signature)):
            return None
        found = json.loads(_unb64(claims))
    except ValueError:
        return None
    return found if found.get("iss") == issuer and now < found.get("exp", 0) else None
