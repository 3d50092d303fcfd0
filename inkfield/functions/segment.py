"""Cutting a token stream into pieces for delivery."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np

from inkfield import config

_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")
_STOPS = re.compile(r"[.!?\n]")


def limits(chunk_chars: int, soft_chars: int) -> tuple[int, int]:
    return max(config.SEGMENT_CHARS_MIN, chunk_chars), max(config.SEGMENT_SOFT_CHARS_MIN, soft_chars)


def cut_at(buffer: str, chunk_chars: int, soft_chars: int) -> int:
    """Length of the piece that is ready at the head of the buffer, 0 when none is.

    In this order: a full piece; up to the first separator *of the list* that occurs; for long enough
    buffers, up to a line end, then up to a sentence end.
    """
    if len(buffer) >= chunk_chars:
        return chunk_chars
    for s in config.SEGMENT_SEPARATORS:
        at = buffer.find(s)
        if at >= 0:
            return at + len(s)
    if len(buffer) < soft_chars:
        return 0
    end = buffer.find("\n") + 1
    if end and (end >= soft_chars or end == len(buffer)):
        return end
    m = _SENTENCE_END.search(buffer)
    return m.end() if m and m.end() >= soft_chars else 0


def feed(buffer: str, token: str, chunk_chars: int, soft_chars: int) -> tuple[list[str], str]:
    """Pieces that a token completes, and what stays in the buffer.

    Between two tokens nothing is ready; a token without a stop, behind none, makes nothing ready either.
    """
    held, buffer = buffer, buffer + token
    if len(buffer) < chunk_chars and not _STOPS.search(token) and held[-1:] not in (".", "!", "?"):
        return [], buffer
    pieces = []
    while n := cut_at(buffer, chunk_chars, soft_chars):
        pieces.append(buffer[:n])
        buffer = buffer[n:]
    return pieces, buffer


class Pieces:
    """``feed`` over many tokens at a time, taken as rows of tokens that follow each other, rows by their first place.

    Of the tokens only those are looked at that ``feed`` would not pass over: with a stop, behind one, or filling the buffer.
    """

    def __init__(self, start: int, chunk_chars: int, soft_chars: int):
        self.at, self.sizes = start, (chunk_chars, soft_chars)
        self.buffer = ""
        self.seq, self.text, self.lengths = None, "", None  # the last row, of which the next one may hold some places too

    def take(self, seq: int | None, text: str, lengths: np.ndarray) -> list[tuple[int, str]]:
        """Pieces (start, piece) that the rows before this one complete."""
        if seq is None:  # before all others
            return self._fed(text, lengths)
        out, places = [], seq + np.arange(len(lengths))
        if self.lengths is not None:
            if self.seq[-1] < seq:
                out = self._fed(self.text, self.lengths)
            else:
                sure = int(np.searchsorted(self.seq, seq))
                cut = int(self.lengths[:sure].sum())
                out = self._fed(self.text[:cut], self.lengths[:sure])
                places = np.concatenate([self.seq[sure:], places])
                lengths, text = np.concatenate([self.lengths[sure:], lengths]), self.text[cut:] + text
                order, ends = np.argsort(places, kind="stable"), np.cumsum(lengths)
                text = "".join([text[ends[k] - lengths[k] : ends[k]] for k in order])
                places, lengths = places[order], lengths[order]
        self.seq, self.text, self.lengths = places, text, lengths
        return out

    def last(self) -> list[tuple[int, str]]:
        """What is left."""
        out = self._fed(self.text, self.lengths) if self.lengths is not None else []
        return [*out, (self.at, self.buffer)] if self.buffer else out

    def _fed(self, text: str, lengths: np.ndarray) -> list[tuple[int, str]]:
        if not len(lengths):
            return []
        chunk_chars, held = self.sizes[0], len(self.buffer)
        text, ends = self.buffer + text, np.cumsum(lengths) + held
        stops = np.array([m.start() for m in _STOPS.finditer(text)], np.int64)
        of = np.searchsorted(ends, stops, side="right")  # the token that holds the stop
        behind = of + 1  # a stop that ends a token counts for the next one
        looked = np.union1d(np.union1d(of, behind[ends[of] == stops + 1]), [0])
        if len(looked) and looked[-1] == len(ends):
            looked = looked[:-1]
        out, p, ends = [], 0, ends.tolist()
        todo = looked.tolist()
        k = 0
        while True:
            full = bisect_left(ends, p + chunk_chars, 0)
            now = min(todo[k] if k < len(todo) else len(ends), full)
            if now >= len(ends):
                break
            end = ends[now]
            k += k < len(todo) and todo[k] == now
            buffer, done = text[p:end], 0
            while n := cut_at(buffer, *self.sizes):
                out.append((self.at, buffer[:n]))
                self.at += n
                buffer, done = buffer[n:], done + n
            p += done
        self.buffer = text[p:]
        return out
