"""Main text of web pages: a recurrent labeller keeps or drops every block.

The reader (``html_blocks``) cuts a page into blocks, the labeller
(``block_labeller``) gives each the chance to be main text, and blocks of at least
one half are joined in page order by line ends. Nothing is dropped or cut
otherwise. Each page is done in full in the task that reads it; nothing is
shuffled, so copies and hot hosts cost no more than their own pages.

Null and empty html, and pages without a main block, give an empty text. Rows with
equal or null ids are done one by one. Columns besides the three that are named
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_labeller import features, scores, trained
from .common import ship
from .html_blocks import blocks

THRESHOLD = 0.5
SLICE_BYTES = 2 << 20


def main_texts(pages: list[str | None]) -> list[tuple[str, int, int]]:
    """(text, blocks, kept blocks) of each page."""
    found = [blocks(p or "") for p in pages]
    counts = np.array([len(f) for f in found], np.int64)
    chance = scores(trained(), features(found), counts)
    out, at = [], 0
    for f in found:
        kept = [b.text for b, c in zip(f, chance[at : at + len(f)].tolist(), strict=True) if c >= THRESHOLD]
        at += len(f)
        out.append(("\n".join(kept), len(f), len(kept)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(2)
        at = 0
        while at < len(batch):
            held, size, begin = [], 0, at
            while at < len(batch) and (not held or size < SLICE_BYTES):
                held.append(column[at].as_py())
                size += len(held[-1] or "")
                at += 1
            out = main_texts(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, at - begin), batch.column(1).slice(begin, at - begin), pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2))],
                ["page_id", "url", "text", "n_blocks", "n_main_blocks"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_blocks, n_main_blocks`` for each row of ``pages``."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_blocks long, n_main_blocks long")
