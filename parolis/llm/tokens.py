"""Sizes of texts in tokens of a public tokenizer; its vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import SparkSession

#: Default vocabulary: byte-level BPE for many languages, as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: The public pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def tokenizer(content: bytes) -> tiktoken.Encoding:
    """The tokenizer of the content of a file of ranks."""
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(spark: SparkSession, path: str):
    """Arrow mapper: replaces the column ``text`` by ``n_tokens``; null text has 0 tokens. Only the driver reads the file;
    its content (below a megabyte) is broadcast."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(shared.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            names = [x for x in b.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(n, pa.int64())], [*names, "n_tokens"])

    return run
