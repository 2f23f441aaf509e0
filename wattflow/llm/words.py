"""Words of whole texts as 64-bit fingerprints, without a Python object for each word.

A text column's bytes are taken as they lie in an Arrow array. A table of 256 bytes says which bytes are parts of words
and how they are written (lower case); a word's fingerprint is a polynomial over its bytes modulo 2^64, mixed. Equal
words have equal fingerprints; different ones collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .memory import give_back

#: Bytes handled at once; longer stretches are cut between words.
STRETCH = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def lower_except(separators: bytes) -> np.ndarray:
    """The byte table of words between separators, A-Z in lower case."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
BLANK_SEPARATED = lower_except(b" \t\n\x0b\x0c\r")
BLANK_SEPARATED[0] = 255  # a byte that no text has stands for NUL, as 0 means a separator
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
ALPHANUMERIC = lower_except(bytes(x for x in range(128) if not chr(x).isalnum()))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, STRETCH + 1), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 places where its texts begin and end; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    places = np.frombuffer(places, kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), places


class Words:
    """All words of a batch: fingerprints, byte places, and where each text's words begin (n + 1 places)."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.prints, self.starts, self.ends, self.bounds = prints, starts, ends, bounds

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(data: np.ndarray, places: np.ndarray, table: np.ndarray) -> Words:
    """The words of each text; a word never spans two texts."""
    prints, starts, ends = [], [], []
    at, stop = int(places[0]), int(places[-1])
    inner = places[1:-1]
    while at < stop:
        to = min(stop, at + STRETCH)
        if to < stop:  # back to a separator or the beginning of a text, or else on to the next
            cut = np.flatnonzero(table[data[at:to]] == 0)
            text = np.searchsorted(places, to, "right") - 1
            back = max(at + int(cut[-1]) + 1 if len(cut) else at, int(places[text]))
            if back > at:
                to = back
            else:
                to = int(places[text + 1])
                for ahead in range(at + STRETCH, to, STRETCH):
                    cut = np.flatnonzero(table[data[ahead : min(to, ahead + STRETCH)]] == 0)
                    if len(cut):
                        to = ahead + int(cut[0]) + 1
                        break
        part = table[data[at:to]]
        full = np.concatenate([np.zeros(1, bool), part != 0, np.zeros(1, bool)])
        new = np.zeros(to - at + 1, bool)
        new[inner[(inner >= at) & (inner <= to)] - at] = True
        s = np.flatnonzero(full[1:-1] & (~full[:-2] | new[:-1]))
        e = np.flatnonzero(full[1:-1] & (~full[2:] | new[1:])) + 1
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(part.astype(np.uint64) * _power(_BASE, to - at), out=sums[1:])
        prints.append(mix((sums[e] - sums[s]) * _power(_INVERSE, to - at + 1)[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    joined = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((prints, np.uint64), (starts, np.int64), (ends, np.int64))]
    return Words(*joined, np.searchsorted(joined[1], places))


def windows(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of n consecutive words, and where each text's begin (n + 1 places). A text of fewer words, but not none, has one of all its words."""
    w, size = found.prints, np.diff(found.bounds)
    total = len(w)
    rolled = np.zeros(total, np.uint64)
    for k in range(min(n, total)):
        rolled[: total - k] += w[k:] * _power(_BASE, n + 1)[k + 1]
    rolled = mix(rolled + np.uint64(n))
    inside = np.arange(total) - np.repeat(found.bounds[:-1], size) <= np.repeat(size, size) - n
    short = np.flatnonzero((size > 0) & (size < n))
    for i in short:  # a sum over fewer words, told from the others by its length
        own = w[found.bounds[i] : found.bounds[i + 1]]
        at = found.bounds[i]
        inside[at] = True
        rolled[at] = mix(np.array([(own * _power(_BASE, n + 1)[1 : len(own) + 1]).sum() + np.uint64(len(own))], np.uint64))[0]
    counts = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    return rolled[inside], np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def pieces(batch: pa.RecordBatch, column: str, most: int = 1_000_000):
    """Slices of a batch whose texts have together at most so many bytes (or one text). Behind the last, free memory is given back."""
    data = batch.column(batch.schema.get_field_index(column))
    places = column_bytes(data)[1]
    at = 0
    while at < len(data):
        to = max(at + 1, int(np.searchsorted(places, places[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()
