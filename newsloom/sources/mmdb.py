"""Networks of a MaxMind DB file as rows, after its public format description.

The file's search tree is cut into subtrees, which tasks walk; what they need of the file is broadcast while it is no larger
than BROADCAST_BYTES, beyond it one task walks all (the format's pointers allow files of 4 GB).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 << 20
#: Subtrees that the tree is cut into, about.
SUBTREES = 256
MARK = b"\xab\xcd\xefMaxMind.com"
SCHEMA = "hi long, lo long, length int, record string"


class Mmdb:
    """The tree and the records of a file's bytes."""

    def __init__(self, content: bytes):
        self.raw = content
        at = content.rfind(MARK)
        if at < 0:
            raise ValueError("no MaxMind DB: its mark is missing")
        self.meta, _ = self._value(at + len(MARK), at + len(MARK))
        self.nodes, self.bits = self.meta["node_count"], self.meta["record_size"]
        if self.bits not in (24, 28, 32):
            raise ValueError(f"records of {self.bits} bits")
        self.v6 = self.meta["ip_version"] == 6
        self.data = self.nodes * self.bits // 4 + 16
        self.records: dict[int, str] = {}

    def children(self, node: int) -> tuple[int, int]:
        size = self.bits // 4
        b = self.raw[node * size : (node + 1) * size]
        if self.bits == 28:
            return (b[3] >> 4) << 24 | int.from_bytes(b[:3], "big"), (b[3] & 15) << 24 | int.from_bytes(b[4:], "big")
        return int.from_bytes(b[: size // 2], "big"), int.from_bytes(b[size // 2 :], "big")

    def record(self, pointer: int) -> str:
        """JSON of a leaf's record; bytes in hexadecimal."""
        if pointer not in self.records:
            value, _ = self._value(pointer - self.nodes - 16 + self.data, self.data)
            self.records[pointer] = json.dumps(value, ensure_ascii=False, default=lambda b: b.hex())
        return self.records[pointer]

    def _value(self, at: int, base: int):
        """A value and the place after it; pointers count from base."""
        control = self.raw[at]
        kind, size, at = control >> 5, control & 31, at + 1
        if kind == 1:
            extra = (size >> 3) + 1
            low = int.from_bytes(self.raw[at : at + extra], "big")
            if extra < 4:
                low = ((size & 7) << 8 * extra | low) + (0, 2048, 526336)[extra - 1]
            return self._value(base + low, base)[0], at + extra
        if kind == 0:
            kind, at = 7 + self.raw[at], at + 1
        if size > 28:
            extra = size - 28
            size = (29, 285, 65821)[extra - 1] + int.from_bytes(self.raw[at : at + extra], "big")
            at += extra
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self._value(at, base)
                out[key], at = self._value(at, base)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self._value(at, base)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw = self.raw[at : at + size]
        if kind == 2:
            return raw.decode(), at + size
        if kind in (3, 15):
            return struct.unpack(">d" if kind == 3 else ">f", raw)[0], at + size
        if kind == 4:
            return raw, at + size
        return int.from_bytes(raw, "big", signed=kind == 8 and size == 4), at + size

    def v4_root(self) -> int:
        """The node (or leaf) of ::/96, below which IPv4 networks are; other places that lead to it repeat them."""
        node = 0
        for _ in range(96):
            if node >= self.nodes:
                break
            node = self.children(node)[0]
        return node


@dataclass(frozen=True)
class Subtree:
    node: int
    bits: int  #: the path from the root, as a number of 128 bits
    depth: int


def _open(db: Mmdb, of: Subtree, v4: int) -> Iterator[Subtree]:
    """The two subtrees below a node, but for those that repeat IPv4."""
    for bit, child in enumerate(db.children(of.node)):
        below = Subtree(child, of.bits | bit << 127 - of.depth, of.depth + 1)
        if not (db.v6 and child == v4 < db.nodes and (below.depth != 96 or below.bits)):
            yield below


def _networks(db: Mmdb, start: Subtree, v4: int) -> Iterator[tuple[int, int, int]]:
    """(bits, length, pointer) of the leaves with records under a node."""
    todo = [start]
    while todo:
        at = todo.pop()
        if at.node < db.nodes:
            todo.extend(_open(db, at, v4))
        elif at.node > db.nodes:
            # a tree of IPv4 alone begins at the 97th bit
            yield (at.bits, at.depth, at.node) if db.v6 else (at.bits >> 96, at.depth + 96, at.node)


def _batches(db: Mmdb, starts: list[Subtree], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    v4, rows = db.v4_root(), []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["hi", "lo", "length", "record"])

    for start in starts:
        for bits, length, pointer in _networks(db, start, v4):
            rows.append((signed(bits >> 64), signed(bits & (1 << 64) - 1), length, db.record(pointer)))
            if len(rows) == size:
                yield batch()
                rows = []
    if rows:
        yield batch()


def read_mmdb(spark: SparkSession, path: str) -> DataFrame:
    """hi, lo, length, record (JSON) of every network of one file; see functions.addresses for the numbers."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.max("length")).first()[0]
    if size is None:
        return spark.createDataFrame([], SCHEMA)
    if size > BROADCAST_BYTES:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column(0):
                    yield from _batches(Mmdb(content.as_py()), [Subtree(0, 0, 0)])

        return files.select("content").mapInArrow(whole, SCHEMA)
    content = files.select("content").first()[0]
    db = Mmdb(bytes(content))
    v4, leaves, inner = db.v4_root(), [], [Subtree(0, 0, 0)]
    while inner and len(inner) < SUBTREES:
        opened = [x for at in inner for x in _open(db, at, v4)]
        leaves += [x for x in opened if x.node >= db.nodes]
        inner = [x for x in opened if x.node < db.nodes]
    shared = spark.sparkContext.broadcast(bytes(content))
    starts = [(x.node, f"{x.bits:032x}", x.depth) for x in [*inner, *leaves]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Subtree(r["node"], int(r["bits"], 16), r["depth"]) for b in batches for r in b.to_pylist()]
        if own:
            yield from _batches(Mmdb(shared.value), own)

    rows = spark.createDataFrame(starts, "node long, bits string, depth int")
    return rows.repartition(max(1, min(len(starts), spark.sparkContext.defaultParallelism * 4))).mapInArrow(walk, SCHEMA)


def countries(networks: DataFrame) -> DataFrame:
    """code, name of the countries of read_mmdb's rows: of a network's country, else of the one where it is registered; the
    English name, else the code. By name, then code."""
    get = lambda path: F.coalesce(F.get_json_object("record", f"$.country.{path}"), F.when(F.get_json_object("record", "$.country").isNull(), F.get_json_object("record", f"$.registered_country.{path}")))
    rows = networks.select(get("iso_code").alias("code"), get("names.en").alias("name")).where("code IS NOT NULL AND code <> ''")
    return rows.groupBy("code").agg(F.coalesce(F.min("name"), F.col("code")).alias("name")).orderBy("name", "code")
