"""Fill-in-the-middle: texts cut into prefix, middle and suffix and written in the order a model learns to fill from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import columns_of, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many stay as they are, and so many of the others have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT, SEED = 10, 20, 1
#: Bytes of text whose units are held as lists at a time; longer texts are cut and joined again.
WINDOW = 1 << 20


def _units(data: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """The code points of ``data`` as a list for each text; text i lies between ``bounds`` i and i + 1."""
    lead = (data & 0xC0) != 0x80
    lead[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(lead).astype(np.int32)
    ends = np.append(starts, np.int32(len(data)))
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), flat)


def _roles(units: pa.ListArray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each list. ``first``: ordinal of each list's first unit in its text."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    at = pa.array(units.offsets.to_numpy()[:-1] - first)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(at, parent))
    after_low = pc.greater_equal(ordinal, pc.take(pa.array(low), parent))
    after_high = pc.greater_equal(ordinal, pc.take(pa.array(high), parent))
    out = []
    for mine in (pc.invert(after_low), pc.and_not(after_low, after_high), after_high):
        owners = pc.filter(parent, mine).to_numpy()
        offsets = np.searchsorted(owners, np.arange(len(units) + 1)).astype(np.int32)  # owners ascend
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pc.filter(flat, mine)), b""))
    return out


def _cut(text: pa.Array, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text, whole texts in windows of bounded size."""
    text = pc.fill_null(text, "").cast(pa.binary())
    bounds = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if body else np.empty(0, np.uint8)
    bounds -= bounds[0]
    owners, pieces, at, seen = [], [[], [], []], 0, 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # to the end of a code point
            end += 1
        one, last = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, end, "left")
        units = _units(data[at:end], np.clip(bounds[one : last + 1], at, end) - at)
        first = np.zeros(last - one, np.int64)
        first[0] = seen
        for got, role in zip(pieces, _roles(units, first, low[one:last], high[one:last])):
            got.append(role)
        owners.append(np.arange(one, last))
        seen = first[-1] + len(units[-1]) if end < bounds[last] else 0
        at = end
    # windows of one text follow each other
    of = np.concatenate(owners) if owners else np.empty(0, np.int64)
    lists = pa.array(np.searchsorted(of, np.arange(len(text) + 1)).astype(np.int32))
    return [pc.binary_join(pa.ListArray.from_arrays(lists, pa.concat_arrays([pa.array([], pa.binary()), *got])), b"") for got in pieces]


def _infill(markers: tuple[str, str, str]):
    p, s, m = (x.encode() for x in markers)

    @arrow_udf("string")
    def infill(text: pa.Array, low: pa.Array, high: pa.Array, form: pa.Array) -> pa.Array:
        prefix, middle, suffix = _cut(text, low.to_numpy(zero_copy_only=False), high.to_numpy(zero_copy_only=False))
        join = lambda *parts: pc.binary_join_element_wise(*parts, b"")  # noqa: E731  the last is what stands between
        made = pc.if_else(pc.equal(form, "spm"), join(s, suffix, p, prefix, m, middle), join(p, prefix, s, suffix, m, middle))
        return pc.if_else(pc.equal(form, "plain"), pc.fill_null(text, "").cast(pa.binary()), made).cast(pa.string())

    return infill


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of. No cut text holds a marker, so each marker is found where it was put."""
    p, s, m = markers
    after = lambda x, mark: F.substring(x, F.instr(x, mark) + len(mark), F.char_length(x))
    before = lambda x, mark: F.substring(x, F.lit(1), F.instr(x, mark) - 1)
    middle = after(output, m)
    psm = F.concat(before(after(output, p), s), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output`` added.

    Each text (null: empty) is cut at two of its ``n`` + 1 code point bounds, drawn from a SHA-256 of ``seed`` and
    doc_id (null: as an empty id), so that lost tasks and reruns draw the same. ``output`` joins the pieces behind
    their markers: psm as prefix, suffix, middle; spm as suffix, prefix, middle. Texts that are empty, hold a
    marker or are among ``plain_percent`` of 100 stay as they are (plain; the two counts are null). Repeated rows
    of one doc_id and text are cut alike. Other columns are carried along whatever their names, but for columns of
    the five names above, which are replaced. An empty table gives none. Texts of any length are cut in windows of
    ``WINDOW`` bytes.
    """
    p, s, m = markers
    rest = columns_of(docs, ("n", "form", "prefix_chars", "middle_chars", "output"))
    hashed, low, high = unused([*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"], "hashed", "low", "high")
    text = F.coalesce("text", F.lit(""))
    draw = lambda k: F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")
    a, b = draw(0) % (F.col("n") + 1), draw(1) % (F.col("n") + 1)
    marked = F.contains(text, F.lit(p)) | F.contains(text, F.lit(s)) | F.contains(text, F.lit(m))
    plain = (F.col("n") == 0) | marked | (draw(2) % 100 >= 100 - plain_percent)
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cuts = (
        docs.select(*rest, F.sha2(seeded, 256).alias(hashed), F.char_length(text).cast("long").alias("n"))
        .withColumns({
            low: F.least(a, b), high: F.greatest(a, b),
            "form": F.when(plain, "plain").when(draw(3) % 100 < suffix_first_percent, "spm").otherwise("psm"),
        })
    )
    counted = lambda c: F.when(F.col("form") != "plain", c)
    return cuts.select(
        *rest, "n", "form", counted(F.col(low)).alias("prefix_chars"), counted(F.col(high) - F.col(low)).alias("middle_chars"),
        _infill(markers)(text, low, high, "form").alias("output"),
    )
