"""Units: stretches of a text that byte-level and piece tokenizers cut alike wherever they stand.

A text is cut before every space that follows a character which is surely no white space. The pattern of a byte-level
tokenizer ends a match there and looks ahead over white space only, and a piece vocabulary without white space inside a
piece ends one there as well. So a unit's ids are found once while a task remembers it, and new units are encoded side by
side in longer strings, whose ids are dealt back by their byte lengths.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from .blocks import spans

CHUNK = 200  # units encoded side by side
REMEMBERED = 300_000  # units
BLANKS = frozenset((9, 10, 11, 12, 13, 32))


def spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space put before each: (bytes, offsets)."""
    n = len(at) - 1
    out = np.full(len(raw) + n, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at[:-1] + np.arange(n)] = False
    out[keep] = raw
    return out, at + np.arange(n + 1)


LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
MARK = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"])


def cut_units(raw: np.ndarray, at: np.ndarray, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(start of every unit, how it ends: 2 with an ASCII letter, 1 with another character that is surely no white space, else 0).
    Empty texts have no unit.

    After a character of two or more bytes that could be Unicode white space by its first byte no cut is made. ``fine`` also cuts between an
    ASCII letter and a mark (not an apostrophe), and before any ASCII white space: a byte-level pattern ends a match there too.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    solid = (raw > 32) & (raw != 127)
    high = raw >= 128
    two, three = np.zeros(n, bool), np.zeros(n, bool)
    two[1:] = raw[:-1] == 0xC2
    three[2:] = (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3)
    solid &= ~(high & (two | three))
    letter = LETTER[raw]
    head = np.zeros(n + 1, bool)
    head[1:n] = (raw[1:] == 32) & solid[:-1]
    if fine:
        head[1:n] |= (raw[1:] >= 9) & (raw[1:] <= 13) & solid[:-1] | MARK[raw[1:]] & letter[:-1]
    head[at] = True
    start = np.flatnonzero(head[:n])
    last = np.r_[start[1:], n] - 1
    return start, solid[last].astype(np.int8) + letter[last]


class UnitIds:
    """Ids of units under one or more encoders; old units are forgotten by age beyond ``limit``.

    An encoder takes a list of strings and gives (ids of all strings in a row, ids a string); ``width`` gives each id's bytes.
    An id row whose bytes do not add up to the strings' is encoded string by string, and then cut after each.
    """

    def __init__(self, encoders: list[Callable], widths: list[np.ndarray], limit: int = REMEMBERED):
        self.encoders, self.widths, self.limit = encoders, widths, limit
        self.number: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int32) for _ in encoders]
        self.at = [np.zeros(1, np.int64) for _ in encoders]

    def chunks(self, fresh: list[bytes], solid: np.ndarray) -> list[list[bytes]]:
        out: list[list[bytes]] = []
        before = 0  # how the unit before ends
        for unit, end in zip(fresh, solid.tolist(), strict=True):
            first = unit[0]
            if (before and first in BLANKS or before == 2 and MARK[first]) and len(out[-1]) < CHUNK:
                out[-1].append(unit)
            else:
                out.append([unit])
            before = end
        return out

    def learn(self, fresh: list[bytes], solid: np.ndarray) -> None:
        chunks = self.chunks(fresh, solid)
        text = [b"".join(c).decode() for c in chunks]
        size = np.array([len(u) for u in fresh], np.int64)
        for k, (encode, width) in enumerate(zip(self.encoders, self.widths, strict=True)):
            ids, count = encode(text)
            end = np.cumsum(width[ids])
            wanted = np.cumsum(size)
            place = np.searchsorted(end, wanted, "left") + 1
            # every unit must end where an id ends, else the bytes differ from the text's
            if len(end) and (end[-1] != wanted[-1] or (end[np.minimum(place, len(end)) - 1] != wanted).any()):
                ids, count = encode([u.decode() for u in fresh])
                place = np.cumsum(count)
            self.ids[k] = np.concatenate([self.ids[k], ids])
            self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + place])
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))

    def forget(self) -> None:
        """Half of the units, those met first."""
        gone = len(self.number) // 2
        self.number = {u: i - gone for u, i in self.number.items() if i >= gone}
        for k, at in enumerate(self.at):
            self.ids[k] = self.ids[k][at[gone]:]
            self.at[k] = at[gone:] - at[gone]

    def __call__(self, raw: np.ndarray, start: np.ndarray, solid: np.ndarray) -> np.ndarray:
        """The number of every unit in ``ids`` and ``at``, until the next call."""
        if len(self.number) > self.limit:
            self.forget()
        end = np.r_[start[1:], len(raw)].astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, end[-1:]].astype(np.int64)), pa.py_buffer(raw)])
        coded = column.dictionary_encode()
        bytes_, unit_at = spans(coded.dictionary)
        text, edge = bytes_.tobytes(), unit_at.tolist()
        units, index = [text[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], coded.indices.to_numpy()
        ends_well = np.zeros(len(units), np.int8)
        ends_well[index] = solid
        known, get = len(self.number), self.number.get
        number = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(number < 0)
        if len(new):
            self.learn([units[i] for i in new.tolist()], ends_well[new])
            number[new] = known + np.arange(len(new))
        return number[index]


def counted(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as (all ids, ids a list)."""
    count = np.array([len(r) for r in rows], np.int64)
    return np.fromiter(chain.from_iterable(rows), np.int32, int(count.sum())), count
