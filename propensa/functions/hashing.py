"""Reproducible randomness: every choice is a function of the row key, never of task order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def digest(key: str | Column, salt: str | Column, seed: int = SEED) -> Column:
    """md5 of ``key:salt:seed``; sorts rows in a random but repeatable order."""
    if isinstance(key, str) and isinstance(salt, str):
        return F.expr(f"md5(concat_ws(':', CAST(`{key}` AS STRING), '{salt}', '{seed}'))")
    key = F.col(key) if isinstance(key, str) else key
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.md5(F.concat_ws(":", key.cast("string"), salt, F.lit(str(seed))))


def uniform(key: str | Column, salt: str | Column, seed: int = SEED, digits: int = 13) -> Column:
    """Repeatable uniform number in [0, 1) with 16^digits steps; 13 digits are what a double holds."""
    head = F.substring(digest(key, salt, seed), 1, digits)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**digits))


def uniforms(key: str, salts: dict[str, str], seed: int = SEED) -> list[Column]:
    """One uniform column per entry (name → salt) over the key column."""
    text = (
        "CAST(conv(substr(md5(concat_ws(':', CAST(`{k}` AS STRING), '{s}', '{seed}')), 1, 4), 16, 10)"
        " AS DOUBLE) / 65536D AS `{n}`"
    )
    return [F.expr(text.format(k=key, s=s, seed=seed, n=n)) for n, s in salts.items()]
