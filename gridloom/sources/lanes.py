"""Lane stores: typed arrays chunked along a slow axis.

Two forms. A table: Parquet partitioned by lane and sorted by slab, whose windows are partition and row-group pruning; this is the
one to compute on. A file: one memory-mapped binary with a sealed layout, for exchange; its slabs are filled in any order and
a reader accepts it only once it is sealed.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, IoFailure, NotFound, ParseFailure

MAGIC, SEAL, ALIGN = b"GLL\x01", b"GLLZ", 64
DTYPES = {"f32": np.dtype("<f4"), "f64": np.dtype("<f8"), "u16": np.dtype("<u2"), "u32": np.dtype("<u4")}
SPARK_TYPES = {"f32": "float", "f64": "double", "u16": "int", "u32": "long"}


@dataclass(frozen=True)
class Lane:
    """elems: numbers in a slab, or in all if the lane is flat (the same for every slab)."""

    name: str
    dtype: str
    elems: int
    flat: bool = False

    def shape(self, nslabs: int) -> tuple[int, ...]:
        return (self.elems,) if self.flat else (nslabs, self.elems)


@dataclass(frozen=True)
class StoreSchema:
    nslabs: int
    lanes: tuple[Lane, ...]
    app: object = None

    def __post_init__(self):
        names = [x.name for x in self.lanes]
        if self.nslabs < 1 or not names or len({*names}) < len(names) or "" in names:
            raise InvalidArgument("a store needs slabs and lanes with different names")
        for x in self.lanes:
            if x.dtype not in DTYPES or x.elems < 1:
                raise InvalidArgument(f"lane {x.name}: unknown type or no elements")

    def lane(self, name: str, dtype: str | None = None, flat: bool | None = None) -> Lane:
        found = next((x for x in self.lanes if x.name == name), None)
        if found is None:
            raise NotFound(f"no lane {name!r}")
        if dtype is not None and dtype != found.dtype:
            raise InvalidArgument(f"lane {name} is {found.dtype}, not {dtype}")
        if flat is not None and flat != found.flat:
            raise InvalidArgument(f"lane {name} is {'flat' if found.flat else 'in slabs'}")
        return found

    def header(self) -> bytes:
        return json.dumps({"nslabs": self.nslabs, "lanes": [asdict(x) for x in self.lanes], "app": self.app}, sort_keys=True).encode()

    def layout(self) -> tuple[dict[str, int], int, int]:
        """Where each lane begins, where data ends and where the seal is; recomputed by every reader."""
        up = lambda x, a: -(-x // a) * a
        at, out = up(8 + len(self.header()), ALIGN), {}
        for x in self.lanes:
            at = up(at, ALIGN)
            out[x.name] = at
            at += int(np.prod(x.shape(self.nslabs))) * DTYPES[x.dtype].itemsize
        return out, at, up(at, 8)


class StoreWriter:
    """Slabs are written where they belong; finalize() seals. flush_behind drops each slab's pages once it is written."""

    def __init__(self, path: str, schema: StoreSchema, flush_behind: bool = False):
        self.path, self.schema, self.flush_behind = path, schema, flush_behind
        self.at, self.end, self.seal = schema.layout()
        head = schema.header()
        with open(path, "wb") as f:
            f.write(MAGIC + len(head).to_bytes(4, "little") + head)
            f.truncate(self.seal + 20)
        self.map = np.memmap(path, np.uint8, "r+")

    def _view(self, lane: Lane) -> np.ndarray:
        n = int(np.prod(lane.shape(self.schema.nslabs)))
        return self.map[self.at[lane.name] : self.at[lane.name] + n * DTYPES[lane.dtype].itemsize].view(DTYPES[lane.dtype]).reshape(lane.shape(self.schema.nslabs))

    def slab(self, name: str, k: int) -> np.ndarray:
        """A writable view of one slab."""
        lane = self.schema.lane(name, flat=False)
        if not 0 <= k < self.schema.nslabs:
            raise InvalidArgument(f"slab {k} is out of range")
        return self._view(lane)[k]

    def write_slab(self, name: str, k: int, values) -> None:
        view = self.slab(name, k)
        if len(values) != len(view):
            raise InvalidArgument(f"a slab of {name} has {len(view)} elements, not {len(values)}")
        view[:] = values
        if self.flush_behind:
            self.map.flush()
            self.map = np.memmap(self.path, np.uint8, "r+")

    def write_flat(self, name: str, values) -> None:
        view = self._view(self.schema.lane(name, flat=True))
        if len(values) != len(view):
            raise InvalidArgument(f"{name} has {len(view)} elements, not {len(values)}")
        view[:] = values

    def flush(self) -> None:
        self.map.flush()

    def finalize(self) -> None:
        self.map[self.seal : self.seal + 20] = np.frombuffer(SEAL + self.schema.nslabs.to_bytes(8, "little") + self.end.to_bytes(8, "little"), np.uint8)
        self.flush()


class StoreReader:
    def __init__(self, path: str):
        if not os.path.exists(path):
            raise IoFailure(f"{path} is missing")
        self.map = np.memmap(path, np.uint8, "r")
        if len(self.map) < 8 or bytes(self.map[:4]) != MAGIC:
            raise ParseFailure(f"{path} is no lane store of this version")
        size = int.from_bytes(bytes(self.map[4:8]), "little")
        try:
            head = json.loads(bytes(self.map[8 : 8 + size]))
            self.schema = StoreSchema(head["nslabs"], tuple(Lane(**x) for x in head["lanes"]), head["app"])
        except (ValueError, KeyError, TypeError) as e:
            raise ParseFailure(f"{path} has a broken header") from e
        self.at, end, seal = self.schema.layout()
        if len(self.map) < seal + 20 or bytes(self.map[seal : seal + 4]) != SEAL:
            raise ParseFailure(f"{path} was not finished")
        if bytes(self.map[seal + 4 : seal + 20]) != self.schema.nslabs.to_bytes(8, "little") + end.to_bytes(8, "little"):
            raise ParseFailure(f"{path}'s seal does not fit its header")

    @property
    def nslabs(self) -> int:
        return self.schema.nslabs

    def window(self, name: str, start: int, stop: int, dtype: str | None = None) -> np.ndarray:
        """Slabs start to stop - 1 as one (slabs, elems) view, without a copy."""
        lane = self.schema.lane(name, dtype, flat=False)
        if not 0 <= start <= stop <= self.nslabs:
            raise InvalidArgument(f"window {start}:{stop} is out of range")
        size = lane.elems * DTYPES[lane.dtype].itemsize
        at = self.at[name]
        return self.map[at + start * size : at + stop * size].view(DTYPES[lane.dtype]).reshape(stop - start, lane.elems)

    def slab(self, name: str, k: int, dtype: str | None = None) -> np.ndarray:
        return self.window(name, k, k + 1, dtype)[0]

    def lane(self, name: str) -> np.ndarray:
        return self.window(name, 0, self.nslabs)

    def flat(self, name: str, dtype: str | None = None) -> np.ndarray:
        lane = self.schema.lane(name, dtype, flat=True)
        at = self.at[name]
        return self.map[at : at + lane.elems * DTYPES[lane.dtype].itemsize].view(DTYPES[lane.dtype])


def write_store(df: DataFrame, path: str) -> None:
    """df (lane, slab, values array) -> a table partitioned by lane, each file sorted by slab. Rows stream; nothing is collected."""
    df.repartition("lane", F.floor(F.col("slab") / 256)).sortWithinPartitions("lane", "slab").write.mode("overwrite").partitionBy("lane").parquet(path)


def read_window(spark: SparkSession, path: str, lane: str, start: int, stop: int) -> DataFrame:
    """(slab, values) of a lane's slabs start to stop - 1: one partition, and its row groups by slab."""
    return spark.read.parquet(path).where((F.col("lane") == lane) & (F.col("slab") >= start) & (F.col("slab") < stop)).select("slab", "values")


def store_to_file(df: DataFrame, path: str, schema: StoreSchema) -> None:
    """df (lane, slab, values) -> a sealed file, slab by slab in one pass."""
    writer = StoreWriter(path, schema)
    for r in df.toLocalIterator():
        (writer.write_flat(r["lane"], r["values"]) if schema.lane(r["lane"]).flat else writer.write_slab(r["lane"], r["slab"], r["values"]))
    writer.finalize()


def file_to_rows(spark: SparkSession, path: str, lane: str) -> DataFrame:
    """A file's lane as (slab, values): tasks map the file and read their slabs. The file must be where executors see it."""
    schema = StoreReader(path).schema
    spec = schema.lane(lane, flat=False)
    kind = SPARK_TYPES[spec.dtype]

    def read(parts):
        import pandas as pd

        reader = StoreReader(path)
        for part in parts:
            yield pd.DataFrame({"slab": part["id"], "values": [reader.slab(lane, int(k)).tolist() for k in part["id"]]})

    return spark.range(schema.nslabs).mapInPandas(read, f"slab long, values array<{kind}>")
