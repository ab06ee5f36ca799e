"""Embedding streams as a Spark data source: ``spark.read.format("speaker_embeddings").load(path)``.

Binary files begin with a magic and a version, which may come again inside the file where it was appended to; records
are length-prefixed ids with typed vectors, little endian. Text files hold ``id v1 v2 ...`` a line. Every file is one
partition; malformed input is an error.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the binary format: magic, version, type codes, greatest length of an id.
MAGIC, VERSION = b"SPKEMB01", 1
TYPES = {b"f": np.dtype("<f4"), b"h": np.dtype("<f2"), b"d": np.dtype("<f8")}
MAX_ID = 1 << 20


class EmbeddingFormatError(ValueError):
    """A stream that breaks the format."""


def parse_binary(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Records of a binary stream."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise EmbeddingFormatError("unexpected end of stream")
        at += n
        return data[at - n : at]

    def version() -> None:
        (v,) = struct.unpack("<I", take(4))
        if v != VERSION:
            raise EmbeddingFormatError(f"unsupported version {v}")

    at = 0
    if take(8) != MAGIC:
        raise EmbeddingFormatError("wrong magic")
    version()
    while at < len(data):
        if data.startswith(MAGIC, at):
            at += 8
            version()
            continue
        (n,) = struct.unpack("<I", take(4))
        if n > MAX_ID:
            raise EmbeddingFormatError(f"id of {n} bytes")
        utt_id = take(n).decode("utf-8")
        kind = TYPES.get(code := take(1))
        if kind is None:
            raise EmbeddingFormatError(f"unknown type {code!r}")
        (dim,) = struct.unpack("<I", take(4))
        if dim <= 0:
            raise EmbeddingFormatError(f"dimension {dim}")
        yield utt_id, np.frombuffer(take(dim * kind.itemsize), kind)


def parse_text(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Records of a text stream."""
    for line in data.decode("utf-8").splitlines():
        parts = line.split()
        if not parts:
            continue
        if len(parts) == 1 or len(parts[0].encode()) > MAX_ID:
            raise EmbeddingFormatError(f"no vector for {parts[0][:80]!r}")
        try:
            yield parts[0], np.array([float(x) for x in parts[1:]])
        except ValueError as e:
            raise EmbeddingFormatError(f"no vector for {parts[0][:80]!r}: {e}") from e


def record(utt_id: str, vector, code: bytes = b"f") -> bytes:
    """One binary record."""
    raw = utt_id.encode("utf-8")
    v = np.asarray(vector, dtype=TYPES[code])
    return struct.pack("<I", len(raw)) + raw + code + struct.pack("<I", len(v)) + v.tobytes()


def header() -> bytes:
    return MAGIC + struct.pack("<I", VERSION)


def parse_spec(spec: str) -> tuple[bool, str]:
    """(binary, path) of a source specification ``pkl[,t]:path``. Commands and standard streams are refused: a cluster
    job reads files."""
    head, sep, target = spec.partition(":")
    target = target.strip()
    if head not in ("pkl", "pkl,t") or not sep or not target:
        raise ValueError(f"bad source specification: {spec!r}")
    if target == "-" or target.endswith("|"):
        raise ValueError("only files can be read")
    return head == "pkl", target


class _Reader(DataSourceReader):
    def __init__(self, path: str, binary: bool):
        self.path, self.binary = path, binary

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [InputPartition(f) for f in files if os.path.isfile(f) and not os.path.basename(f).startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        data = Path(partition.value).read_bytes()
        for utt_id, v in (parse_binary if self.binary else parse_text)(data):
            yield utt_id, [float(x) for x in v]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, binary: bool, overwrite: bool):
        self.path, self.binary = path.removeprefix("file://"), binary
        if overwrite and os.path.isdir(self.path):
            for f in glob.glob(os.path.join(self.path, "part-*")):
                os.remove(f)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        name = os.path.join(self.path, f"part-{context.partitionId():05d}-{context.taskAttemptId()}.{'spk' if self.binary else 'txt'}")
        with open(name + ".tmp", "wb") as f:
            if self.binary:
                f.write(header())
            for row in iterator:
                if self.binary:
                    f.write(record(row["utt_id"], row["v"]))
                else:
                    f.write((row["utt_id"] + " " + " ".join(f"{np.float32(x):.8g}" for x in row["v"]) + "\n").encode())
        os.replace(name + ".tmp", name)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        Path(self.path, "_SUCCESS").touch()

    def abort(self, messages) -> None:
        for f in glob.glob(os.path.join(self.path, "*.tmp")):
            os.remove(f)


class SpeakerEmbeddings(DataSource):
    """Options: ``path`` or ``spec`` (``pkl[,t]:path``), ``kind`` (``binary`` or ``text``)."""

    @classmethod
    def name(cls) -> str:
        return "speaker_embeddings"

    def schema(self) -> str:
        return "utt_id string, v array<double>"

    def _target(self) -> tuple[bool, str]:
        if "spec" in self.options:
            return parse_spec(self.options["spec"])
        return self.options.get("kind", "binary") == "binary", self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        binary, path = self._target()
        return _Reader(path, binary)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        binary, path = self._target()
        return _Writer(path, binary, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SpeakerEmbeddings)
