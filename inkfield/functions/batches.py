"""Arrow batches in pieces: what a Python worker holds besides a batch does not grow with it."""

from __future__ import annotations

from collections.abc import Iterator

PIECE_BYTES = 4 << 20


def pieces(batch, most: int = PIECE_BYTES) -> Iterator:
    """An Arrow array or record batch in slices of about ``most`` bytes and at least one row; nothing is copied."""
    rows = max(1, len(batch) * most // max(1, batch.nbytes))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)
