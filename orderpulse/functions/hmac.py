"""HMAC-SHA256 from built-in expressions only (``sha2``, ``hex``, ``unhex``, XOR).

HMAC(k, m) = SHA256((k' ^ opad) || SHA256((k' ^ ipad) || m)), where k' is
the key padded with zero bytes to the 64-byte block (keys longer than the
block are hashed first).  Spark has no byte-wise XOR on binary values, so the
padded key is XOR-ed as sixteen 32-bit words taken from its hex text.  The
pads depend only on the secret: compute them once per endpoint
(:func:`key_pads`) and join them to the payloads, so each payload row costs
two ``sha2`` calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # SHA-256 block size in bytes
# The HMAC inner and outer pad bytes.
IPAD, OPAD = 0x36, 0x5C


def _block_key_hex(secret: Column) -> Column:
    kb = F.encode(secret, "UTF-8")
    k = F.when(F.octet_length(kb) > BLOCK, F.unhex(F.sha2(kb, 256))).otherwise(kb)
    return F.rpad(F.hex(k), BLOCK * 2, "0")


def _xor_pad(key_hex: Column, pad_byte: int) -> Column:
    mask = int(f"{pad_byte:02x}" * 4, 16)
    words = []
    for i in range(BLOCK // 4):
        word = F.conv(F.substring(key_hex, i * 8 + 1, 8), 16, 10).cast("bigint")
        words.append(F.lpad(F.hex(word.bitwiseXOR(F.lit(mask))), 8, "0"))
    return F.unhex(F.concat(*words))


def key_pads(secret: Column) -> tuple[Column, Column]:
    """(inner pad key, outer pad key) as binary columns."""
    kh = _block_key_hex(secret)
    return _xor_pad(kh, IPAD), _xor_pad(kh, OPAD)


def hmac_sha256_hex(ipad: Column, opad: Column, payload: Column) -> Column:
    """Lower-case hex HMAC given precomputed pads."""
    inner = F.unhex(F.sha2(F.concat(ipad, F.encode(payload, "UTF-8")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def hmac_sha256(secret: Column, payload: Column) -> Column:
    ipad, opad = key_pads(secret)
    return hmac_sha256_hex(ipad, opad, payload)


def signature_header(secret: Column, payload: Column) -> Column:
    """The signature header value: ``sha256=<hex>``."""
    return F.concat(F.lit("sha256="), hmac_sha256(secret, payload))
