"""Sizes of texts in tokens of a public tokenizer.

A byte-pair tokenizer cuts a text into pre-tokens before it merges anything, and
every run of non-blank characters with its leading blank is a whole number of
pre-tokens. Such runs repeat, so their sizes are remembered per worker.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siltstone.runtime import spread

#: Where the vocabulary files lie; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space as the pattern's \s knows it.
_W = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUNS = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: Remembered runs per worker, and the longest run that is remembered.
_MOST, _LONGEST = 300_000, 40


class _Sizes(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> int:
        n = len(self.encode(run))
        if len(run) <= _LONGEST:
            if len(self) >= _MOST:
                self.clear()
            self[run] = n
        return n


_counters: dict[str, _Sizes] = {}


def _sizes(path: str) -> _Sizes:
    if path not in _counters:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _counters[path] = _Sizes(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
    return _counters[path]


def count_tokens(text: str | None, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> int:
    """Tokens of one text; 0 for null."""
    return sum(map(_sizes(path).__getitem__, _RUNS.findall(text))) if text else 0


def with_tokens(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without its text, with ``tokens bigint`` (0 for null and empty texts)."""
    path = f"{folder}/{vocabulary}"
    keep = [c for c in docs.columns if c not in (text, "tokens")]
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in keep), StructField("tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _sizes(path).__getitem__
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            n = [sum(map(get, _RUNS.findall(t))) if t else 0 for t in pc.fill_null(col, "").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(n, pa.int64())], [*keep, "tokens"])

    return spread(docs.select(*keep, text)).mapInArrow(run, schema)
