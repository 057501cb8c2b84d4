"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Of every file's whole text these units are compared with the templates: each run of one to RUN neighbouring
lines with terms, so that wrapped notices count; each paragraph, which is what stands between lines
without terms, so that file headers count; and of license files the whole text. A unit and a template are
sparse TF-IDF vectors with document frequencies over all files; terms that no template has weigh as the
rarest one. A file's own license is that of its best unit if its cosine reaches the threshold.
A directory has the license of a license file that lies in it; a file without one of its own inherits
from its nearest ancestor.

Only units with one of a template's heaviest terms are scored: without all of them no unit can reach the
threshold. Templates are a parameter of bounded size and become one literal of the plan; the path joins are
on distinct directories, and files meet them by an equi-join.

Defined results: null or empty text has no license of its own, and ``own_score`` is null where no unit
reaches the threshold; of equal scores the template that sorts first wins; of several license files in a
directory the highest score, then the largest name, wins; null paths inherit nothing; repeated rows get equal
results; extra columns are kept but for those that are added here; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, materialize
from .license_texts import TEMPLATES

#: Templates may have this many terms in all.
VOCABULARY_LIMIT = 10_000
THRESHOLD = 0.8
#: Neighbouring lines that are compared together, at most.
RUN = 3
#: Names of files that license their directory, matched against the path's last part.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([-._][a-z0-9._-]+)?$"
_SPLIT = r"[^0-9a-z]+"
#: Between paragraphs: a line without terms at least.
_GAP = r"\n[^0-9a-z]*\n"

Texts = dict[str, tuple[str, ...]]


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def vocabulary(templates: Texts) -> list[tuple[str, Counter]]:
    """(license, terms) of each template, by name."""
    out = [(n, Counter(t for t in re.split(_SPLIT, text.lower()) if t)) for n, texts in sorted(templates.items()) for text in texts]
    if sum(len(tf) for _, tf in out) > VOCABULARY_LIMIT:
        raise ValueError(f"templates of over {VOCABULARY_LIMIT} terms; split them into several scans")
    return out


def frequencies(files: DataFrame, vocab: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Files in all and files with each template term; the result is as large as the vocabulary."""
    words = F.from_json(F.lit(json.dumps(vocab)), "array<string>")
    each = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms(F.col(text)), words))).alias("t"))
    counts = {r["t"]: r["n"] for r in each.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), {v: counts.get(v, 0) for v in vocab}


def needed(tf: Counter, idf: dict[str, float], threshold: float) -> list[str]:
    """The template's heaviest terms of which any unit that reaches the threshold has at least one.

    Without all of them the cosine is at most the root of what share of the squared length is left.
    """
    squares = sorted((((n * idf[v]) ** 2, v) for v, n in tf.items()), reverse=True)
    total, out, held = sum(x for x, _ in squares), [], 0.0
    for x, v in squares:
        out.append(v)
        held += x
        if 1 - held / total < threshold**2 - 1e-9:
            break
    return out


def _any_of(marks: list[str]) -> str:
    """A pattern that finds any of the terms, by first letter so that few are tried."""
    by: dict[str, list[str]] = {}
    for m in sorted(marks):
        by.setdefault(m[0], []).append(m[1:])
    return f"(?<![0-9a-z])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in by.items())})(?![0-9a-z])"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _units(low: Column, whole: Column, found: Callable[[Column], Column]) -> Column:
    """The distinct units of a lower-case text that ``found`` finds; the text itself where ``whole``."""
    solid = F.filter(F.split(low, "\n"), lambda x: x.rlike("[0-9a-z]"))

    def runs(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - 1)
        marked = F.filter(starts, lambda i: found(F.get(lines, i)))
        # the runs that hold a marked line begin at most RUN - 1 lines before it
        begins = F.array_distinct(F.flatten(F.transform(marked, lambda i: F.sequence(F.greatest(i - (RUN - 1), F.lit(0)), i))))
        each = F.flatten(F.transform(begins, lambda i: F.array(*[F.array_join(F.slice(lines, i + 1, F.lit(k)), " ") for k in range(1, RUN + 1)])))
        return F.when(F.size(lines) > 0, each).otherwise(F.array().cast("array<string>"))

    several = F.filter(F.split(low, _GAP), lambda x: x.contains("\n"))
    none = F.array().cast("array<string>")
    every = F.concat(_let(solid, runs), several, F.when(whole, F.array(low)).otherwise(none))
    return F.filter(F.array_distinct(every), found)


def own_license(files: DataFrame, templates: Texts = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", path: str = "path") -> DataFrame:
    """``files`` with ``own_license`` and ``own_score``, the best cosine of their units. No shuffle of texts."""
    kinds = vocabulary(templates)
    vocab = sorted({v for _, tf in kinds for v in tf})
    n, df = frequencies(files, vocab, text)
    idf = {v: math.log((1 + n) / (1 + df[v])) + 1.0 for v in vocab}
    pattern = _any_of(sorted({v for _, tf in kinds for v in needed(tf, idf, threshold)}))
    # TF-IDF of each template at length 1, by term; a JSON text folds to one literal, however many terms there are
    length = [math.sqrt(sum((k * idf[v]) ** 2 for v, k in tf.items())) for _, tf in kinds]
    table = {v: {"idf": idf[v], "w": [{"i": i, "x": tf[v] * idf[v] / length[i]} for i, (_, tf) in enumerate(kinds) if v in tf]} for v in vocab}
    weights = F.from_json(F.lit(json.dumps(table)), "map<string, struct<idf: double, w: array<struct<i: int, x: double>>>>")
    rarest = max(idf.values())
    names = F.array(*[F.lit(name) for name, _ in kinds])

    def scored(unit: Column) -> Column:
        """(score, i): the best template, of equals the first."""

        def counted(t: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
            return _let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.try_element_at(weights, F.get(t, i)).alias("e"), (F.coalesce(F.get(at, j + 1), F.size(t)) - i).alias("n"))))

        def cosines(q: Column) -> Column:
            norm = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, s: a + F.pow(s.n * F.coalesce(s.e.idf, F.lit(rarest)), F.lit(2.0))))
            parts = F.flatten(F.transform(F.filter(q, lambda s: s.e.isNotNull()), lambda s: F.transform(s.e.w, lambda w: F.struct(w.i.alias("i"), (s.n * s.e.idf * w.x).alias("x")))))
            dot = lambda p, i: F.aggregate(F.filter(p, lambda w: w.i == i), F.lit(0.0), lambda a, w: a + w.x)
            each = lambda p: _let(norm, lambda length: F.transform(F.array_distinct(F.transform(p, lambda w: w.i)), lambda i: F.struct(F.round(dot(p, i) / length, 6).alias("score"), (-i).alias("i"))))
            return F.array_max(_let(parts, each))

        return _let(F.array_sort(terms(unit)), lambda t: _let(counted(t), cosines))

    low = F.lower(F.coalesce(F.col("row")[text], F.lit("")))
    whole = F.regexp_extract(F.coalesce(F.col("row")[path], F.lit("")), r"([^/]*)$", 1).rlike(LICENSE_FILE)
    best = F.when(low.rlike(pattern), F.array_max(F.transform(_units(low, whole, lambda x: x.rlike(pattern)), scored)))
    kept = [F.col("row")[c].alias(c) for c in files.columns if c not in ("own_license", "own_score")]
    out = files.select(F.struct(*files.columns).alias("row")).select("row", held(best).alias("best"))
    good = F.col("best.score") >= threshold
    return out.select(*kept, F.when(good, F.get(names, -F.col("best.i"))).alias("own_license"), F.when(good, F.col("best.score")).alias("own_score"))


def directory(path: Column) -> Column:
    """All before the last slash; of a name alone the root ''."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``license`` and ``license_from``: a file's own, or that of the nearest directory above.

    Directories are few beside files: ancestors are listed per distinct directory, joined to the
    licensed ones, and the deepest kept. The join back is split by adaptive execution where one directory holds
    many files.
    """
    named = files.select(F.struct(*files.columns).alias("row"), directory(F.col(path)).alias("dir"))
    own, name = F.col("row.own_license"), F.regexp_extract(F.col("row")[path], r"([^/]*)$", 1)
    source = named.where(name.rlike(LICENSE_FILE) & own.isNotNull())
    licensed = source.groupBy(F.col("dir").alias("above")).agg(F.max_by(own, F.struct("row.own_score", own)).alias("l"))
    dirs = named.select("dir").where(F.col("dir").isNotNull()).distinct()
    parts = F.split("dir", "/")
    chain = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    above = dirs.select("dir", F.explode(F.array_distinct(chain)).alias("above")).join(licensed, "above")
    near = materialize(above.groupBy("dir").agg(F.max_by(F.struct("l", "above"), F.length("above")).alias("near")), "near")
    out = named.join(near, "dir", "left")
    kept = [F.col("row")[c].alias(c) for c in files.columns if c not in ("license", "license_from")]
    return out.select(*kept, F.coalesce(own, F.col("near.l")).alias("license"), F.when(own.isNotNull(), F.lit("own")).when(F.col("near.l").isNotNull(), F.col("near.above")).alias("license_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / hundred / name.

    Every 25th document stands for the license file of its directory, every 50th for that of the one above.
    """
    n = F.col("doc_id")
    name = F.when(n % 25 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), n.cast("string")))
    hundred = F.when(n % 50 != 0, F.concat(F.lit("d"), F.floor(n / 100).cast("string")))  # null parts are left out
    return docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", hundred, name).alias("path"))


def report(docs: DataFrame) -> DataFrame:
    found = materialize(own_license(document_paths(docs)).drop("text"), "own_licenses")
    return inherit(found).select("doc_id", "path", "own_license", "own_score", "license", "license_from")
