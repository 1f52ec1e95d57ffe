"""Arrow batches of long texts in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text of a piece. As Python strings a piece takes a few times these bytes.
ROWS, BYTES = 256, 4 << 20


def pieces(batches: Iterable[pa.RecordBatch], text: int | None = None, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of at most ``rows`` rows and, by column ``text``, about ``BYTES``; a longer row is a piece."""
    for b in batches:
        if not b.num_rows:
            continue
        cuts = np.arange(0, b.num_rows, rows)
        if text is not None:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.union1d(cuts, np.flatnonzero(np.diff(ends // BYTES)) + 1)
        for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
            yield b.slice(at, end - at)
