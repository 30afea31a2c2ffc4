"""Reading binary records: a cursor that raises when a record is cut short."""

from __future__ import annotations


class Short(Exception):
    """The data end before the record does, or the record is not what it should be."""


class Cursor:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def sub(self, n: int) -> Cursor:
        """A cursor over the next n bytes."""
        start = self.at
        self.take(n)
        return Cursor(self.data, start, self.at)

    def need(self, ok: bool) -> None:
        if not ok:
            raise Short
