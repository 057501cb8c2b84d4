"""Line deduplication by overlapping three-line windows.

Every run of three consecutive lines with text is hashed. A window that occurs more than once in the
corpus keeps its first occurrence, by (doc_id, place); the lines of all later ones are removed, from
the first line to the last of the merged windows, blank lines between them included.

Lines are compared without the white space at their ends. Documents of fewer than three lines with
text have no window and stay as they are.

Defined results: null text stays null with no lines; repeated rows of one document count as one and get
equal results; extra columns are kept by ``dedup`` whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, held, materialize
from .spans import covered_places, identified, later_occurrences, merged

WINDOW = 3


def _solid(lines: Column) -> Column:
    """Lines with text: trimmed, with their place among all lines."""
    trimmed = F.transform(lines, lambda x, i: F.struct(F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "").alias("t"), i.alias("i")))
    return F.filter(trimmed, lambda s: s.t != "")


def windows(named: DataFrame, text: str = "text") -> DataFrame:
    """One row per window: two hashes, document, place among the lines with text. Hashed once and written."""
    solid = named.select("id", "tx", _solid(F.split(F.col("row")[text], "\n")).alias("s"))

    def both(i):
        said = [F.get(F.col("s"), i + k).getField("t") for k in range(WINDOW)]
        return F.struct(F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit(1), *reversed(said)).alias("h2"))

    found = F.when(F.size("s") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("s") - WINDOW), both))
    cut = materialize(solid.select("id", "tx", found.alias("found")), "windows")
    return cut.select("id", "tx", F.posexplode("found").alias("pos", "h")).select("h.h1", "h.h2", "id", "tx", "pos")


def _deduped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, new, n_lines, n_removed) of each row; ``new`` is its text without the removed lines.

    Two shuffles of window hashes find what to remove; the texts are shuffled once, to meet it.
    """
    named = identified(docs, key, text)
    places = covered_places(later_occurrences(windows(named, text)))
    old = F.col("row")[text]
    out = named.join(places, ["id", "tx"], "left").select("row", "places", F.split(old, "\n").alias("lines"))
    # intervals among the lines with text, then among all lines
    solid = F.when(F.col("places").isNotNull(), F.transform(_solid(F.col("lines")), lambda s: s.i))
    out = out.select("row", "lines", solid.alias("solid"), merged(F.col("places"), WINDOW).alias("gone"))
    at = lambda i: F.get(F.col("solid"), i)
    out = out.select("row", "lines", F.transform("gone", lambda g: F.struct(at(g.first).alias("a"), at(g.last).alias("b"))).alias("gone"))
    # what lies before each interval, and after the last
    begin = lambda j: F.coalesce(F.get(F.col("gone"), j - 1).getField("b") + 1, F.lit(0))
    before = F.transform("gone", lambda g, j: F.slice("lines", begin(j) + 1, g.a - begin(j)))
    tail = begin(F.size("gone"))
    rest = F.slice("lines", tail + 1, F.greatest(F.size("lines") - tail, F.lit(0)))
    out = out.select("row", "lines", held(F.when(F.col("gone").isNotNull(), F.concat(F.flatten(before), rest))).alias("kept"))
    return out.select(
        "row", F.coalesce(F.array_join("kept", "\n"), old).alias("new"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text deduplicated, ``n_lines`` and ``n_removed``, which replace columns of these names."""
    kept = [F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _deduped(docs, key, text).select(*kept, "n_lines", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"))


def keep_rest(docs: DataFrame) -> DataFrame:
    """``docs`` with deduplicated texts, ``n_chars`` brought up to date; a document that the removal
    leaves without a word goes."""
    out = _deduped(docs)
    cut = F.col("n_removed") > 0
    empty = cut & ~F.coalesce(F.col("new"), F.lit("")).rlike(f"[^{SPACE}]")
    out = out.where(~empty)
    fresh = {"text": F.col("new"), "n_chars": F.when(cut, F.length("new")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
