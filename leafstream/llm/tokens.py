"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstream.llm.values import once
from leafstream.sources.shared import settle

#: A vocabulary file of ranks, one "base64 rank" a line; the same path on all executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this vocabulary parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a vocabulary file, made once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int32())],
                names=["doc_id", "source", "n_tokens"],
            )

    return count


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), written once to the shared folder: each text is read and cut a single time.

    A null or empty text has no tokens. Rows without doc_id are left out; of repeated rows one counts.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    sized = rows.mapInArrow(_counter(vocabulary), "doc_id bigint, source string, n_tokens int")
    return settle(once(sized, "doc_id"), "tokens")
