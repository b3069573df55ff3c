"""Texts cut where tokenizers never join bytes, each distinct piece named once in a batch.

A piece begins at the start of a text and at every blank (U+0020) that follows a character other than
white space. The splitting pattern of byte-level BPE lets a blank only open a match and lets no match that
holds another character run on into white space, so the tokens of a text are those of its pieces, one after
another. The same holds for subword models whose vocabulary has the blank mark only in front.

A text repeats few pieces many times: tokenizers see each distinct one once a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabstrata.llm.common import text_buffer

#: Bytes looked at together; the masks take a few bytes for each of them.
WINDOW = 1 << 20

# White space of one, two and three bytes in UTF-8 (fixed values): the last byte of each, by lead.
_ONE = np.zeros(256, bool)
_ONE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_C2 = np.zeros(256, bool)
_C2[[0x85, 0xA0]] = True
_E2_80 = np.zeros(256, bool)
_E2_80[[*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Positions of the blanks in UTF-8 bytes that follow a character other than white space."""
    found = []
    for low in range(1, len(data), WINDOW):
        high = min(low + WINDOW, len(data))
        at = low + np.flatnonzero(data[low:high] == 32)
        last, before = data[at - 1], data[np.maximum(at - 2, 0)]
        lead = data[np.maximum(at - 3, 0)]
        space = _ONE[last] | ((before == 0xC2) & _C2[last])
        space |= (lead == 0xE2) & (((before == 0x80) & _E2_80[last]) | ((before == 0x81) & (last == 0x9F)))
        space |= (lead == 0xE2) & (before == 0x96) & (last == 0x81)  # the blank mark of subword models
        space |= (lead == 0xE1) & (before == 0x9A) & (last == 0x80)
        space |= (lead == 0xE3) & (before == 0x80) & (last == 0x80)
        found.append(at[~space])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Pieces:
    """``distinct`` strings of the pieces of a string column; text i is codes[at[i] : at[i + 1]]."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        low, base = int(offsets[0]), offsets - offsets[0]
        data = data[low : int(offsets[-1])]
        filled = base[:-1][base[1:] > base[:-1]]  # starts of texts that aren't empty
        starts = np.sort(np.concatenate([piece_starts(data), filled]), kind="stable")
        starts = starts[np.concatenate([[True], starts[1:] != starts[:-1]])] if len(starts) else starts
        self.at = np.searchsorted(starts, base)
        bounds = np.append(starts, len(data)).astype(np.int64)
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        named = pc.dictionary_encode(cut)
        self.codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: list[str] = named.dictionary.to_pylist()

    def __len__(self) -> int:
        return len(self.at) - 1

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sum over the pieces of each text of a value given for each distinct piece."""
        total = np.concatenate([[0], np.cumsum(values[self.codes], dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]


def by_bytes(texts: list[str], size: int):
    """Runs of ``texts`` of about ``size`` characters; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > size:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run
