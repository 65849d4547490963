"""deterministic identifiers.

The reference draws random UUIDs for payments and API keys.  Reruns of a
Spark job must give equal ids (a retried task must not mint new ones), so
ids are a hash of their natural key instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deterministic_id(*parts: Column, length: int = 32) -> Column:
    """Hex id from SHA-256 of the ':'-joined parts (32 hex chars = a dash-free UUID size)."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def api_key(tenant_id: Column, salt: str = "api-key") -> Column:
    """An API key as the reference shapes it: 32 hex characters, no dashes."""
    return deterministic_id(F.lit(salt), tenant_id)
