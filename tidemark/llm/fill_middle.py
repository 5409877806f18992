"""Fill-in-the-middle: texts cut at unit boundaries and rearranged with sentinels.

A unit is a run of ASCII letters or any other single code point. Counting the units of a text
leaves a sparse index: the byte and code-point offset of every CHECKPOINT-th unit. A cut is then
found by binary search in that index and a short rescan from the checkpoint below it, so that
neither a list of units nor one of offsets is ever held for a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm._common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values
CHECKPOINT = 256
SLICE = 1 << 16


def _starts(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit and which begin a code point; inside: a letter came before data."""
    letter = ((data | 0x20) - np.uint8(97)) < 26
    points = (data & 0xC0) != 0x80
    goes_on = np.empty(len(data), dtype=bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[0] = letter[0] and inside
    return points & ~goes_on, points


def _is_letter(byte: np.uint8) -> bool:
    return 97 <= int(byte) | 0x20 <= 122


@dataclass
class UnitIndex:
    """The sparse index of one text: unit, byte and code-point number of each checkpoint, and the totals."""

    data: np.ndarray
    units: np.ndarray
    at_byte: np.ndarray
    at_point: np.ndarray
    n_units: int
    n_points: int

    @classmethod
    def of(cls, data: np.ndarray, every: int = CHECKPOINT, width: int = SLICE) -> UnitIndex:
        units, at_byte, at_point = [], [], []
        n = points = 0
        for a in range(0, len(data), width):
            part = data[a : a + width]
            start, point = _starts(part, a > 0 and _is_letter(data[a - 1]))
            begun = np.flatnonzero(start)
            marked = begun[-n % every :: every]
            if len(marked):
                units.append(n + np.arange(-n % every, len(begun), every))
                at_byte.append(a + marked)
                at_point.append(points + np.cumsum(point)[marked] - 1)
            n += len(begun)
            points += int(np.count_nonzero(point))
        joined = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (units, at_byte, at_point)]
        return cls(data, *joined, n, points)

    def point_of(self, unit: int, width: int = 4096) -> int:
        """The code point at which a unit begins; the end of the text for n_units."""
        if unit >= self.n_units:
            return self.n_points
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        left, a, point = unit - int(self.units[k]), int(self.at_byte[k]), int(self.at_point[k])
        inside = False  # a checkpoint begins a unit
        while True:
            part = self.data[a : a + width]
            start, begins = _starts(part, inside)
            begun = np.flatnonzero(start)
            if left < len(begun):
                return point + int(np.count_nonzero(begins[: begun[left]]))
            left -= len(begun)
            point += int(np.count_nonzero(begins))
            inside, a = _is_letter(part[-1]), a + len(part)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column, in place."""
    sizes = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], dtype=sizes)[column.offset : column.offset + len(column) + 1] if len(column) else []
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    for i in range(len(column)):
        yield data[bounds[i] : bounds[i + 1]]


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("n", "first", "second")]))
def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text and the code points of the lower and the upper of two cuts, each a number modulo units + 1."""
    out = np.zeros((3, len(text)), dtype=np.int64)
    for i, (data, a, b) in enumerate(zip(_texts(text), one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))):
        index = UnitIndex.of(data)
        low, high = sorted((int(a) % (index.n_units + 1), int(b) % (index.n_units + 1)))
        out[:, i] = index.n_units, index.point_of(low), index.point_of(high)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second"])


def _draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of sha256 over seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, seed: int = 1, rate: int = 90, swapped: int = 20) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars and output of every row.

    rate per cent of the documents are rearranged: swapped per cent of these as suffix, prefix,
    middle (spm), the others as prefix, suffix, middle (psm). The rest stay as they are (plain), and so
    do texts that hold a sentinel, which could not be taken apart again, and empty ones.
    The draws depend on seed and doc_id alone, so rows with one doc_id (and rows without one,
    whose id counts as the empty text) share them; repeated rows give repeated rows. A null text
    is empty. Very long texts cost their own length and an index of a few bytes a thousand; an
    empty table gives an empty result. Columns besides doc_id and text are not read, whatever
    their names. No row meets another, so nothing is shuffled.
    """
    h1, h2, h3, h4 = _draws(seed)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    cut = rows.withColumn("cut", _cuts("text", h1, h2))
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < swapped, "spm").otherwise("psm")
    formed = cut.select("doc_id", "text", "cut.*", form.alias("form"))
    prefix = F.substring("text", F.lit(1), F.col("first").cast("int"))
    middle = F.substring("text", (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substring("text", (F.col("second") + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    turned = F.col("form") != "plain"
    return formed.select(
        "doc_id", "text", "n", "form", F.when(turned, F.col("first")).alias("prefix_chars"), F.when(turned, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text of an output, taken apart at its sentinels; each occurs once in a rearranged output."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
