"""Fill-in-middle transformation by indexable skip lists (operator 12).

A text is a run of units (code points, or whatever a pattern matches).  Its
skip list has every unit on the lowest lane, and every ``FAN`` links of a lane
make one link of the next; each express link carries its width in units and in
code points.  A cut rank is reached by descending from the topmost lane: links
are passed while their unit widths fit, and the code-point widths passed add
up to the place of the cut, exactly, whatever the units' lengths.

The cuts come from sha256 of the seed and doc_id, so reruns agree and no row
depends on another: nothing is shuffled, and a lost task is simply run again.

Defined results: a null text is empty and plain.  A text that holds one of the
marks is plain, since it couldn't be told from them.  A null doc_id counts as
the empty string in the hash.  A text without any unit is plain.  Texts of any
length are held whole, one Arrow batch (bounded in bytes) at a time; the lanes
of a text take under two numbers a unit.  Ties of the two cuts leave an empty
middle.  Repeated rows get the same cuts.  An empty table gives no rows.
Other columns are kept; the operator's own start with ``fim_`` and replace
columns of these names, with letters of either case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Links of a lane that one express link passes.
FAN = 32


class SkipList:
    """Lanes of links over a text's units, each link with its unit width and its code-point width."""

    def __init__(self, lengths: np.ndarray) -> None:
        """``lengths``: code points of each unit, in order."""
        units, points = np.ones(len(lengths), np.int64), np.asarray(lengths, np.int64)
        self.n_units, self.n_points = len(lengths), int(points.sum())
        self.lanes = [(units, points)]
        while len(units) > FAN:
            starts = np.arange(0, len(units), FAN)
            units, points = np.add.reduceat(units, starts), np.add.reduceat(points, starts)
            self.lanes.append((units, points))

    def place(self, rank: int) -> int:
        """Code points before unit ``rank`` (0 to the number of units)."""
        if not 0 <= rank <= self.n_units:
            raise IndexError(rank)
        left, passed, link = rank, 0, 0
        for units, points in reversed(self.lanes):
            # At most FAN links of a lane lie under the link of the lane above that was not passed.
            under = np.cumsum(units[link : link + FAN])
            over = int(np.searchsorted(under, left, side="right"))
            if over:
                left -= int(under[over - 1])
                passed += int(points[link : link + over].sum())
            link = (link + over) * FAN
        return passed


def cut_points(text: str, unit: re.Pattern | None, draws: tuple[int, int]) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle), the ends in code points, from two draws."""
    if unit is None:
        lanes = SkipList(np.ones(len(text), np.int64))
    else:
        ends = [m.end() for m in unit.finditer(text)]
        if ends:
            ends[-1] = len(text)  # what no unit holds belongs to the unit before it, or to the first
        lanes = SkipList(np.diff([0, *ends]))
    low, high = sorted(d % (lanes.n_units + 1) for d in draws)
    return lanes.n_units, lanes.place(low), lanes.place(high)


def _transform(unit: str | None, keep_percent: int, spm_percent: int):
    pattern = re.compile(unit) if unit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"fim_n_units": [], "fim_form": [], "fim_prefix_chars": [], "fim_middle_chars": [], "fim_output": []}
            for text, draws in zip(batch.column("fim_text").to_pylist(), zip(*(batch.column(f"fim_h{k}").to_pylist() for k in range(1, 5)))):
                n, low, high = cut_points(text, pattern, draws[:2])
                form = "plain" if not n or PREFIX in text or SUFFIX in text or MIDDLE in text or draws[2] % 100 >= keep_percent else "spm" if draws[3] % 100 < spm_percent else "psm"
                prefix, middle, suffix = text[:low], text[low:high], text[high:]
                out["fim_n_units"].append(n)
                out["fim_form"].append(form)
                out["fim_prefix_chars"].append(None if form == "plain" else low)
                out["fim_middle_chars"].append(None if form == "plain" else high - low)
                out["fim_output"].append(text if form == "plain" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm" else SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
            yield pa.RecordBatch.from_arrays([batch.column("fim_row"), batch.column("fim_null"), *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())))], names=["fim_row", "fim_null", *out])

    return run


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: str = "1", transformed_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` (doc_id, text) with fim_n_units, fim_form, fim_prefix_chars, fim_middle_chars and fim_output.

    ``unit`` is a pattern of units, by default single code points.
    """
    kept = [c for c in docs.columns if not c.lower().startswith("fim_")]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    row = F.struct(*[F.col(f"`{c}`") for c in kept if c.lower() != "text"])
    ready = docs.select(row.alias("fim_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("fim_text"), *[F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long").alias(f"fim_h{k}") for k in range(1, 5)], F.col("text").isNull().alias("fim_null"))
    schema = ready.select("fim_row").schema.simpleString()[len("struct<fim_row:") : -1]
    made = ready.mapInArrow(_transform(unit, transformed_percent, spm_percent), f"fim_row {schema}, fim_null boolean, fim_n_units long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_output string")
    own = ("fim_n_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")
    return made.select(*[F.col(f"fim_row.`{c}`") if c.lower() != "text" else F.when(~F.col("fim_null"), restored(F.col("fim_output"), F.col("fim_form"))).alias(c) for c in kept], *own)


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.substring(text, F.length(F.substring_index(text, mark, 1)) + len(mark) + 1, F.length(text))


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from output and form: marks occur once each in a transformed output."""
    psm_tail, spm_tail = _after(output, SUFFIX), _after(output, PREFIX)
    psm = F.concat(F.substring_index(_after(output, PREFIX), SUFFIX, 1), _after(psm_tail, MIDDLE), F.substring_index(psm_tail, MIDDLE, 1))
    spm = F.concat(F.substring_index(spm_tail, MIDDLE, 1), _after(spm_tail, MIDDLE), F.substring_index(_after(output, SUFFIX), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("doc_id", F.col("fim_n_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"))
