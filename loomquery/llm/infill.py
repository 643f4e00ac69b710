"""13. Fill-in-the-middle by run-length classes.

A text is stored as its maximal runs of characters of one class: white space, or other characters of one width in
bytes; with the numbers of characters and of units up to each run's end. A unit is a token (other characters with the
white space before them; white space at the end of a text is one of its own) or a character. A cut after u units
is found by binary search of the run in whose units it falls; as a run's characters have one width, the offset is
the run's end less what is missing, by arithmetic. No token or character is ever listed.

Both cuts of a document, whether it is transformed and in which order its parts go come from a digest of seed and
id alone, so reruns and copies in other tables agree. ``restore`` rebuilds the text from output and form; texts that contain a
sentinel stay plain, and none arises where a part meets a sentinel, as no sentinel's rest starts with ``<``.

Offsets count UTF-8 bytes, lengths in results code points. Rows are transformed where they are read: no shuffle, memory a few times a text's size.

Defined results: null text is empty; empty texts are plain. A null id is digested as the seed alone. Repeated rows
get equal results; there are no ties. Very long texts are taken whole. Other columns are not read, so they may have any
name. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomquery.plans.ship import ship

SEED, RATE, SPM_RATE = 42, 50, 80
#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: A byte's class: 0 for white space, else its character's width in bytes; 9 inside a character.
_CLASS = np.ones(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 9, 2, 3, 4


class Runs:
    """The runs of a text (UTF-8): their ends in bytes, and bytes a character, characters and units up to each end."""

    def __init__(self, raw: bytes, unit: str = "token"):
        kind = _CLASS[np.frombuffer(raw, np.uint8)]
        for _ in range(3):  # a character's later bytes are of its first one's class
            inner = np.flatnonzero(kind == 9)
            if not len(inner):
                break
            kind[inner] = kind[np.maximum(inner - 1, 0)]
        self.ends = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)] * bool(len(kind))).astype(np.int64)
        white = kind[self.ends - 1] == 0
        self.width, self.unit = np.maximum(kind[self.ends - 1], 1).astype(np.int64), unit
        self.chars = np.cumsum(np.diff(self.ends, prepend=0) // self.width)
        # a token ends before white space and at the end
        self.upto = np.cumsum(~white & np.append(white[1:], True) | np.append(np.zeros(max(len(white) - 1, 0), bool), white[-1:])) if unit == "token" else self.chars
        self.n = int(self.upto[-1]) if len(self.upto) else 0

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters before the cut after so many units."""
        if not units:
            return 0, 0
        run = int(np.searchsorted(self.upto, units))
        missing = 0 if self.unit == "token" else int(self.upto[run]) - units
        return int(self.ends[run]) - missing * int(self.width[run]), int(self.chars[run]) - missing


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4]) for i in range(0, 16, 4))


def transform(doc_id, raw: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "token") -> tuple[int, str, bytes, int | None, int | None]:
    """(units, form, output, prefix and middle in code points)."""
    runs = Runs(raw, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= rate or any(x in raw for x in (PREFIX, SUFFIX, MIDDLE)):
        return runs.n, "plain", raw, None, None
    (a, before), (b, upto) = (runs.cut(u) for u in sorted((h1 % (runs.n + 1), h2 % (runs.n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form = "spm" if h4 % 100 < spm_rate else "psm"
    parts = (SUFFIX, suffix, PREFIX, prefix) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix)
    return runs.n, form, b"".join((*parts, MIDDLE, middle)), before, upto - before


def restore(output: bytes, form: str) -> bytes:
    """The text of a transformed one."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output.removeprefix(first).split(MIDDLE, 1)
    one, two = head.split(second, 1)
    return two + middle + one if form == "spm" else one + middle + two


def infill(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "token", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (units), form, prefix_chars, middle_chars, output (text), restored (text, rebuilt from output and form).

    ``rate`` of a hundred texts are transformed, ``spm_rate`` of a hundred of these with the suffix first. ``unit``: token or char.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType())]
        + [T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("restored", T.StringType())]
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            done = [transform(i, t.as_buffer().to_pybytes() if t.is_valid else b"", seed, rate, spm_rate, unit) for i, t in zip(ids.to_pylist(), batch.column(1), strict=True)]
            n, form, output, prefix, middle = zip(*done, strict=True) if done else ((),) * 5
            back = [restore(o, f) for o, f in zip(output, form, strict=True)]
            text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), text(output), text(back)], names=schema.names)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
