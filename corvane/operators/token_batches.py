"""The tokens of many texts at once, found in the bytes of an Arrow batch; the same as those of ``functions.text.tokens``."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes that a word can have: ASCII letters, digits and underscores, and all bytes of other characters.
_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() or chr(b) == "_" for b in range(256)])


@functools.cache
def word_characters(spark: SparkSession) -> np.ndarray:
    """For each code point whether Spark's patterns take it for a word character, as the borders of ``TOKEN`` do. They are asked once for all of Unicode, so that both sides agree; ASCII is left out."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    known = spark.range(0x80, 0x110000).where("id < 55296 or id > 57343").where(char.rlike(r"(?U)^\w$"))  # surrogates are no characters
    out = np.zeros(0x110000, bool)
    out[known.toArrow().column(0).to_numpy()] = True
    return out


def found(texts: pa.Array, word: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The text's place and the token, for every token of lower-cased ``texts``, in order. Null texts have none. ``word`` as ``word_characters`` gives it.

    A token is a run of word characters that are all ASCII.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _INSIDE[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = np.uint8(2) + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int32) & (0x7F >> size)
        for n in (1, 2, 3):
            more = size > n
            code[more] = code[more] << 6 | data[lead[more] + n] & 0x3F
        apart, size = lead[~word[code]], size[~word[code]]
        for n in range(4):
            inside[apart[size > n] + n] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    first[begin], last[end] = inside[begin], inside[end]  # no run goes on into the next text
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    rows, held = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets))), data[inside]
    if len(lead):
        ascii_ = np.ones(len(starts), bool)
        ascii_[(np.cumsum(first, dtype=np.int32) - 1)[lead[inside[lead]]]] = False
        rows, held, sizes = rows[ascii_], held[np.repeat(ascii_, sizes)], sizes[ascii_]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return rows, pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(held))
