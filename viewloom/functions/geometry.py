"""Frame geometry: scaling, crops and flips as plain arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(height: Column, width: Column, short: Column) -> Column:
    """(height, width) with the short side brought to ``short``, the long one in proportion, rounded down."""
    tall = height > width
    return F.struct(
        F.when(tall, F.floor(height / width * short)).otherwise(short).cast("int").alias("height"),
        F.when(tall, short).otherwise(F.floor(width / height * short)).cast("int").alias("width"),
    )


def uniform_crop(height: Column, width: Column, size: int, place: Column) -> Column:
    """(y, x) of crop 0, 1 or 2 along the long side: its start, middle and end; centred on the short side."""
    y, x = F.ceil((height - size) / 2), F.ceil((width - size) / 2)
    along = lambda full, middle: F.when(place == 0, F.lit(0)).when(place == 2, full - size).otherwise(middle)
    tall = height > width
    return F.struct(F.when(tall, along(height, y)).otherwise(y).cast("int").alias("y"), F.when(tall, x).otherwise(along(width, x)).cast("int").alias("x"))


def drawn_crop(height: Column, width: Column, size: int, key: Column, seed: int) -> Column:
    """(y, x) of a crop placed by a hash of the row's key."""
    at = lambda room, salt: F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.greatest(room + 1, F.lit(1))).cast("int")
    return F.struct(at(height - size, "y").alias("y"), at(width - size, "x").alias("x"))


def flipped(key: Column, seed: int) -> Column:
    """Whether a row is mirrored: half of them, by a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit("flip")), F.lit(2)) == 1


def color_normalized(pixels: Column, mean: list[float], deviation: list[float]) -> Column:
    """Channel by channel less its mean, over its deviation; ``pixels`` has one array per channel."""
    of = lambda values, c: F.get(F.array(*map(F.lit, map(float, values))), c)
    return F.transform(pixels, lambda channel, c: F.transform(channel, lambda x: (x - of(mean, c)) / of(deviation, c)))
