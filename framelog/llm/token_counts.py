"""Token counts by pre-token.

A text's tokens are those of its pre-tokens, and pre-tokens repeat, so each batch is turned into per-document pre-token
frequencies, the pieces of every pre-token that is new to the worker are counted, and the two are joined on the pre-token and summed. No
list of ids of a text is ever made. The join runs inside the map task on whole documents: shuffling one row per (document,
distinct pre-token) to a global vocabulary would move several times the input.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level BPE splits a text before its merges (fixed value of the vocabulary files).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers; beyond that it starts afresh.
KNOWN = 300_000
#: Above this length (code points) pre-tokens are streamed and not listed.
LONG = 1 << 20


def check_covered(file: dict, path: str) -> None:
    """Refuse a vocabulary file whose texts don't split as here, so that it gives no wrong counts."""
    split = file.get("pre_tokenizer") or {}
    wrong = [
        what
        for what, bad in (
            ("a model other than byte-level BPE", (file.get("model") or {}).get("type") != "BPE"),
            ("a normalizer", bool(file.get("normalizer"))),
            ("another pre-tokenizer", split.get("type") != "ByteLevel" or not split.get("use_regex", True)),
            ("a prefix space", bool(split.get("add_prefix_space"))),
            ("merges ignored for whole words", bool((file.get("model") or {}).get("ignore_merges"))),
            ("added tokens that take blanks or whole words", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file.get("added_tokens") or ())),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} has {', '.join(wrong)}; its pre-tokens can't be counted one by one")


class PieceCounter:
    """Counts of the tokens of texts under one byte-level BPE file without normalizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_covered(json.load(f), path)
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(SPLIT)
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of a text with their frequencies, and how many added tokens it spells out."""
        parts = self.added.split(text) if self.added and self.added.search(text) else [text]
        found: Counter = Counter()
        for part in parts:
            found.update(self.split.findall(part) if len(part) <= LONG else (m.group() for m in self.split.finditer(part)))
        return found, len(parts) - 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        found, specials = self.frequencies(text)
        if len(self.pieces) > KNOWN:
            self.pieces.clear()
        new = [t for t in found if t not in self.pieces]
        for t, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.pieces[t] = len(e)
        pieces = self.pieces
        return specials + sum(pieces[t] * n for t, n in found.items())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, *, tokenizer_path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    ``tokenizer_path`` is a byte-level BPE ``tokenizers`` file that every executor has; by default the installed public one. A file that splits
    texts otherwise is an error.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are rows like any other; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_path or default_path())
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
