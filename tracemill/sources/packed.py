"""Encoded documents on disk as a data source: 16-bit tokens laid end to end, and where each document begins.

    spark.dataSource.register(PackedDocuments)
    write_packed(df, ["doc_id"], path)                   # df: tokens array<int> and what orders it
    spark.read.format("packed").option("tokens_per_partition", 1 << 24).load(path)

Each task writes one part: a file of tokens and one of offsets, and tells how many it has. The driver's commit lays
the parts end to end by adding up these counts (the manifest has two numbers a part), so no token passes through one
machine. A reader splits the documents into ranges of about as many tokens, across parts, and each task reads its own
bytes alone. A write that fails deletes its parts; without a manifest there is no data set.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, MANIFEST, BATCH = 1, "packing.json", 250_000


def _files(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "/" + path.split(":", 1)[-1].lstrip("/"))
    return system, at.rstrip("/")


def manifest(path: str) -> dict:
    system, at = _files(path)
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        out = json.loads(f.read())
    if out.get("format_version") != FORMAT:
        raise ValueError(f"unknown format of packed documents in {path}")
    return out


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    tokens: int


@dataclass
class _Range(InputPartition):
    """Documents ``first`` to ``last`` (not included) of one part, and what all parts before it hold."""

    name: str
    first: int
    last: int
    documents_before: int
    tokens_before: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, at = _files(path)
        if not overwrite and system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"packed documents exist in {path}")
        system.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        system, at = _files(self.path)
        name, documents, total = uuid.uuid4().hex, 0, 0
        with system.open_output_stream(f"{at}/{name}.tokens") as tokens, system.open_output_stream(f"{at}/{name}.offsets") as offsets:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for b in iterator:
                column = b.column(b.schema.get_field_index("tokens"))
                values = column.flatten()
                flat = values.to_numpy(zero_copy_only=False)
                if column.null_count or values.null_count or (len(flat) and (flat.min() < 0 or flat.max() > 65535)):
                    raise ValueError("tokens are ids of 16 bits, without nulls")
                tokens.write(flat.astype("<u2").tobytes())
                ends = total + np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype("<i8"))
                offsets.write(ends.astype("<i8").tobytes())
                documents += b.num_rows
                total = int(ends[-1]) if len(ends) else total
        return _Part(TaskContext.get().partitionId(), name, documents, total)

    def commit(self, messages) -> None:
        system, at = _files(self.path)
        old = {p["name"] for p in manifest(self.path)["parts"]} if self.overwrite and system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound else set()
        parts, documents, tokens = [], 0, 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            if m.documents:
                parts.append({"name": m.name, "documents": m.documents, "tokens": m.tokens, "documents_before": documents, "tokens_before": tokens})
                documents, tokens = documents + m.documents, tokens + m.tokens
            else:
                self._drop(m.name)
        with system.open_output_stream(f"{at}/{MANIFEST}.new") as f:
            f.write(json.dumps({"format_version": FORMAT, "documents": documents, "tokens": tokens, "parts": parts}).encode())
        system.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        for name in old:
            self._drop(name)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                self._drop(m.name)

    def _drop(self, name: str) -> None:
        system, at = _files(self.path)
        for kind in ("tokens", "offsets"):
            system.delete_file(f"{at}/{name}.{kind}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        system, at = _files(self.path)
        out = []
        for p in manifest(self.path)["parts"]:
            pieces = max(1, -(-p["tokens"] // self.size))
            step = -(-p["documents"] // pieces)
            out += [_Range(p["name"], k, min(k + step, p["documents"]), p["documents_before"], p["tokens_before"]) for k in range(0, p["documents"], step)]
        return out or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        system, at = _files(self.path)
        with system.open_input_file(f"{at}/{partition.name}.offsets") as f:
            f.seek(8 * partition.first)
            offsets = np.frombuffer(f.read(8 * (partition.last - partition.first + 1)), "<i8")
        with system.open_input_file(f"{at}/{partition.name}.tokens") as f:
            k = 0
            while k < len(offsets) - 1:
                past = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BATCH, side="right")) - 1)
                f.seek(2 * int(offsets[k]))
                tokens = np.frombuffer(f.read(2 * int(offsets[past] - offsets[k])), "<u2").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array((offsets[k : past + 1] - offsets[k]).astype(np.int32)), pa.array(tokens))
                place = partition.documents_before + partition.first + np.arange(k, past)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(partition.tokens_before + offsets[k:past]), lists], names=["place", "start", "tokens"])
                k = past


class PackedDocuments(DataSource):
    """Format "packed": place, start and tokens of each document."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "place long, start long, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("tokens_per_partition", 1 << 24)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write_packed(df: DataFrame, order: list[str | Column], path: str, tokens: str = "tokens", mode: str = "append") -> None:
    """Write ``df``'s ``tokens`` in the given order; the parts are ranges of it."""
    df.sparkSession.dataSource.register(PackedDocuments)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(df[tokens].alias("tokens")).write.format("packed").mode(mode).save(path)


def read_packed(spark, path: str, tokens_per_partition: int = 1 << 24) -> DataFrame:
    spark.dataSource.register(PackedDocuments)
    return spark.read.format("packed").option("tokens_per_partition", tokens_per_partition).load(path)
