"""6. Cost-balanced packing of token sequences.

Each document becomes byte-level BPE ids and an end id. Whole sequences are cut off the front of long
documents; what is left of each document (under one sequence) is gathered block by block. A block has as
many sequences as its tokens fill: full ones, and for the last part sequences whose lengths are powers of
two, which need no padding. Documents go in descending length to the sequence of lowest attention cost
(linear + quadratic in each piece's length) that still has room for them; one that fits nowhere whole is
cut at the sequence with most room. So every sequence is filled exactly and padding is zero. Costs are
balanced among the sequences of a block; whole sequences of long documents are one piece each, the dearest
there is, and take no part. A block leaves at most eleven sequences under full length, one for each power of
two. BLOCK_TOKENS and BLOCK_DOCS bound a task's memory and so what is balanced together.

Packing runs where the text is read: no shuffle, and a task holds one block at a time. A lost task is run
again on the same input split and gives the same pieces; sequence ids hold the partition number.

Defined results: null text is empty and gives the end id alone. Documents of one length go in the order in which
they are read; of sequences of one cost the first is taken. Repeated rows are packed each on its own.
Very long texts are taken whole. Ids keep their type. Only id and text are read, whatever other columns there
are. Empty tables give no rows.

Ids equal those of ``tokenizers``; texts of common scripts are encoded by ``tiktoken`` with ranks read
from the same vocabulary file (about four times as fast), all others by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.plans.ship import ship

LENGTH, END_ID = 2048, 1
#: Tokens and documents that a block holds at most before it is packed.
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 4_096
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512

PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: The vocabulary's split pattern where white space never repeats, and where it may.
_SINGLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_ANY = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN, _BEYOND = re.compile(r"\s\s"), re.compile("[^\t\n\r -~\u00a1-\u024f\u0400-\u04ff\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Text to ids of a byte-level BPE vocabulary in the JSON format of ``tokenizers``."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = self._bytes_of_characters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        joined = [model["vocab"]["".join(p)] for p in pairs]
        plain = model["type"] == "BPE" and joined == sorted(joined) and len(ranks) == 256 + len(joined) and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = [tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("single", _SINGLE), ("any", _ANY))] if plain else None

    @staticmethod
    def _bytes_of_characters() -> dict[str, int]:
        """The byte alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for 256 onwards."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not _BEYOND.search(text) and not any(s in text for s in self.special):
            return np.array(self.fast[bool(_RUN.search(text))].encode_ordinary(text), dtype="<u4")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def balance(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Pack lengths (each under ``length``) so that all sequences are filled: (document, start, n, sequence)."""
    total = sum(lengths)
    room = np.array([length] * (total // length) + _powers(total % length), dtype=np.int64)
    cost = np.zeros(len(room))
    pieces = []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, n = 0, lengths[d]
        while n:
            fits = np.flatnonzero(room >= n)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            k = min(n, int(room[s]))
            pieces.append((d, at, k, s))
            room[s] -= k
            cost[s] += LINEAR * k + QUADRATIC * k * k
            at, n = at + k, n - k
    return pieces


class _Packer:
    """Packs one partition; sequence ids count up from the partition's own base."""

    def __init__(self, base: int, length: int):
        self.next, self.length, self.rows, self.block, self.tokens = base, length, [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.length
        for at in range(0, whole, self.length):
            self._piece(doc_id, ids[at : at + self.length], at, n, self.next, 0)
            self.next += 1
        if n > whole:
            self.block.append((doc_id, ids[whole:].copy(), whole, n))
            self.tokens += n - whole
        if self.tokens >= BLOCK_TOKENS or len(self.block) >= BLOCK_DOCS:
            self.flush()

    def flush(self) -> None:
        filled: dict[int, int] = {}
        for d, at, k, s in balance([len(ids) for _, ids, _, _ in self.block], self.length):
            doc_id, ids, base, n = self.block[d]
            self._piece(doc_id, ids[at : at + k], base + at, n, self.next + s, filled.get(s, 0))
            filled[s] = filled.get(s, 0) + k
        self.next += len(filled)
        self.block, self.tokens = [], 0

    def _piece(self, doc_id, ids, start, n, sequence, offset) -> None:
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset))

    def taken(self, id_type):
        import pyarrow as pa

        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(1 + len(PIECE))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else id_type) for i, c in enumerate(columns)], names=["doc_id", *PIECE])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary file that every executor has.
    """

    def run(batches: Iterator) -> Iterator:
        encode = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 40, length)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4"))
            yield packer.taken(id_type)
        packer.flush()
        if id_type:
            yield packer.taken(id_type)

    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType(), False) for c in PIECE]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
