"""HMAC-SHA256 of message bodies from the built-in digest, without a UDF."""

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "hmac-sha256="
BLOCK = 64


def hmac_sha256_header(body: Column, secret_base64: str) -> Column:
    """Header value a genuine sender puts on ``body`` (string or binary)."""
    key = base64.b64decode(secret_base64)
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, body.cast("binary")), 256))
    return F.concat(F.lit(PREFIX), F.sha2(F.concat(outer_pad, inner), 256))


def is_authentic(body: Column, header: Column, secret_base64: str | None) -> Column:
    """False, never null, when the secret, the header or the body is missing."""
    if not secret_base64:
        return F.lit(False)
    genuine = (F.octet_length(body) > 0) & (header == hmac_sha256_header(body, secret_base64))
    return F.coalesce(genuine, F.lit(False))
