"""Names of clips, shards and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 11


def file_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or the empty string."""
    return F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1)


def url_id(url: Column) -> Column:
    """The video id: the last eleven characters."""
    return F.right(url, F.lit(ID_LENGTH))


def clip_id(name: Column) -> Column:
    """The video id of a clip's file name: the first eleven characters."""
    return F.substring(name, 1, ID_LENGTH)


def clip_start(name: Column, skip: int = ID_LENGTH + 1) -> Column:
    """The start second in a clip's stem, after the id and a separator; null if there is none."""
    return F.substring(stem(name), skip + 1, 9).try_cast("int")


def clip_name(video: Column, start: Column, digits: int = 3) -> Column:
    return F.format_string(f"%s_%0{digits}d.mp4", video, start)


def run_id(host: Column, pid: Column, stamp: Column) -> Column:
    return F.concat_ws("_", host, pid.cast("string"), stamp.cast("string"))


def brace_form(values: Column) -> Column:
    """An array as one glob alternative."""
    return F.concat(F.lit("{"), F.concat_ws(",", values), F.lit("}"))


def view_of(key: Column) -> Column:
    return F.substring_index(key, "_", 1)


def layer_of(key: Column) -> Column:
    """What follows the first underscore."""
    return F.regexp_extract(key, r"^[^_]*_(.*)$", 1)


def segment_text(segment: Column) -> Column:
    """A [start, end] pair as the selection file writes it."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(segment, lambda x: x.cast("string"))), F.lit("]"))
