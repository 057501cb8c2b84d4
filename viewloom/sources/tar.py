"""A data source for archives: one row per member, in batches and as a stream.

Filters reach the source: those on ``shard_name`` leave archives unopened, those on ``name`` and ``size`` leave
content unread. A large archive is cut into ranges of bytes, each a task, which reads the members whose headers lie
in its range; on the way there it reads headers alone and jumps over what they announce.
"""

from __future__ import annotations

import tarfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

#: Bytes of an archive that one task reads.
SPLIT_BYTES = 256 << 20
SCHEMA = "shard_name string, name string, size long, content binary"


class TarSource(DataSource):
    """``spark.read.format("tarshard").option("paths", "a.tar;b-{00..09}.tar").load()``, or ``readStream`` with ``folder``.

    Options: ``paths`` (brace patterns allowed) or, of a stream, ``folder``: its archives in the order of their names, of which
    new ones must come last; ``content`` (false: names alone); ``skip`` (names to leave out) and ``skip_table``: a Parquet
    table (shard_name, stem) of samples to leave out; ``split_bytes``; ``nodes`` and ``node``, ``workers`` and ``worker``: every
    so manyth archive from that number on. Paths are opened with pyarrow, so any store it reaches will do. Archives that do not exist
    give no rows; members of any size are read whole; members that are no files are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "tarshard"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)

    def streamReader(self, schema) -> TarStreamReader:
        return TarStreamReader(self.options)


@dataclass
class Part(InputPartition):
    """The members of an archive whose headers begin in these bytes."""

    path: str
    begin: int
    end: int

    @property
    def shard(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Test:
    """A pushed filter: whether a column's value, which is never null here, is kept."""

    column: str
    kind: type
    value: object
    negated: bool = False

    @staticmethod
    def of(f: Filter) -> Test | None:
        inner = f.child if isinstance(f, Not) else f
        if type(inner) not in TESTS or len(inner.attribute) != 1 or inner.attribute[0] == "content":
            return None
        value = inner.value
        if value is None or isinstance(inner, In) and None in value:
            return None
        return Test(inner.attribute[0], type(inner), tuple(value) if isinstance(inner, In) else value, isinstance(f, Not))

    def keeps(self, value: object) -> bool:
        return TESTS[self.kind](value, self.value) != self.negated


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Archives:
    """What the batch and the stream reader share."""

    def __init__(self, options):
        self.content = options.get("content", "true").lower() != "false"
        self.skip = set(filter(None, options.get("skip", "").split(",")))
        self.skip_table = options.get("skip_table")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[Test] = []

    def parts(self, paths: list[str]) -> list[Part]:
        shards = [t for t in self.tests if t.column == "shard_name"]
        out = []
        for p in paths:
            if all(t.keeps(Part(p, 0, 0).shard) for t in shards):
                store, at = _store(p)
                size = store.get_file_info(at).size or 0  # nothing of an absent file
                out += [Part(p, lo, min(lo + self.split, size)) for lo in range(0, size, self.split)]
        return out

    def _skipped(self, shard: str) -> set[str]:
        """The samples of one archive to leave out: of the table only its row groups of that shard are read."""
        if not self.skip_table:
            return set()
        import pyarrow.dataset as ds

        store, at = _store(self.skip_table)
        return set(ds.dataset(at, filesystem=store).to_table(["stem"], filter=ds.field("shard_name") == shard)["stem"].to_pylist())

    def read(self, partition: Part) -> Iterator[tuple]:
        store, path = _store(partition.path)
        shard, skipped = partition.shard, self._skipped(partition.shard)
        tests = [t for t in self.tests if t.column in ("name", "size")]
        with store.open_input_file(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            while (m := tar.next()) is not None and m.offset < partition.end:
                tar.members = []  # else all headers are kept
                if m.offset < partition.begin or not m.isfile() or m.name in self.skip or m.name.rsplit("/", 1)[-1].split(".", 1)[0] in skipped:
                    continue
                if all(t.keeps(m.name if t.column == "name" else m.size) for t in tests):
                    yield shard, m.name, m.size, tar.extractfile(m).read() if self.content else None


class TarReader(_Archives, DataSourceReader):
    def __init__(self, options):
        from .files import expand

        super().__init__(options)
        self.paths = [p for pattern in options.get("paths", options.get("path", "")).split(";") for p in expand(pattern) if p]
        for many, which in (("nodes", "node"), ("workers", "worker")):
            self.paths = self.paths[int(options.get(which, 0)) :: int(options.get(many, 1))]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if test := Test.of(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[Part]:
        return self.parts(self.paths)


class TarStreamReader(_Archives, DataSourceStreamReader):
    """Archives of a folder in the order of their names; an offset is the last name read."""

    def __init__(self, options):
        super().__init__(options)
        self.folder = options["folder"]

    def _names(self) -> list[str]:
        from pyarrow import fs

        store, at = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(x.base_name for x in found if x.is_file and x.base_name.endswith(".tar"))

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts([f"{self.folder.rstrip('/')}/{n}" for n in self._names() if start["last"] < n <= end["last"]])

    def commit(self, end: dict) -> None:
        pass


def register(spark) -> None:
    """Makes the format known to the session, and lets filters reach Python sources, without which Spark refuses this one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarSource)
