"""Seeded keys that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(*parts: Column | str | int) -> Column:
    """Uniform 32-bit integer from the md5 of the parts joined by a vertical bar."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hex_mod10(digest: Column) -> Column:
    """A 64-digit hexadecimal number modulo 10.

    Every power of 16 from the first on is 6 modulo 10, so eight 8-digit words w0
    (lowest) .. w7 give (w0 + 6 * (w1 + .. + w7)) mod 10.
    """
    words = [F.conv(F.substring(digest, 57 - 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    return ((words[0] + 6 * sum(words[1:], F.lit(0))) % 10).cast("int")


def split_code(source: Column, bucket: Column, training_source: str = "train") -> Column:
    """0 = training source, 1 = development, 2 = validation, 3 = final, from a mod-10 content bucket."""
    return (
        F.when(source == training_source, 0)
        .when(bucket <= 3, 1)
        .when(bucket <= 5, 2)
        .otherwise(3)
    )
