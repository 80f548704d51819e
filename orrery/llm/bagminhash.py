"""Word shingles of whole texts and their BagMinHash signatures, in numpy.

A text's bag holds its runs of SHINGLE words, each as often as it occurs; a text with
fewer words has one shingle, and one without words has none. The signature estimates
the weighted Jaccard similarity, sum of least counts over sum of greatest.

Weights are discretised at the integers. For each shingle there is a hierarchy of Poisson
processes: one for the weight interval [0, 1) and one for each [2^(j-1), 2^j), with the
interval's length as rate; every point carries a time, a signature position and a level
within the interval, all hashed from shingle, interval and number. A shingle of weight w
takes the points below level w, and each position keeps the earliest time. Points come in
order of time, so a process is left as soon as it is later than the latest position.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Signature positions: BANDS bands of ROWS.
BANDS, ROWS = 24, 4
POSITIONS = BANDS * ROWS

_rng = np.random.default_rng(20_001)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_PLACE = _rng.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)
_WORD = _rng.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
_ROW = _rng.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in bytes that begin and end between words."""
    white = _WHITE[data]
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    values = _BYTE[data] * _PLACE[place & 4095]
    values[white] = 0
    return mixed(np.add.reduceat(values, starts)), starts


#: Bytes whose words are hashed at a time; a longer text is cut between words, so it needs no more memory for this.
AT_ONCE = 1_000_000


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and where each text's words begin (one more entry at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.r_[0, np.cumsum([len(r) + 1 for r in raw])]
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + AT_ONCE)
        if stop < len(data):
            while stop < len(data) and not _WHITE[data[stop - 1]]:
                ends = np.flatnonzero(_WHITE[data[stop : stop + AT_ONCE]])
                stop = stop + int(ends[0]) + 1 if len(ends) else min(len(data), stop + AT_ONCE)
        h, s = _hashed(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the distinct shingle hashes in order, and their counts."""
    words, bounds = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(rolled) else 0):
        rolled += words[k : k + len(rolled)] * _WORD[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE:
            s = np.sort(rolled[a : b - SHINGLE + 1])
        elif b > a:
            s = mixed((words[a:b] * _WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            s = np.zeros(0, np.uint64)
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        out.append((s[new], np.diff(np.r_[new, len(s)])))
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sum of least and of greatest counts of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def signatures(found: list[tuple[np.ndarray, np.ndarray]], positions: int = POSITIONS) -> np.ndarray:
    """One row of earliest times for each bag, as 64-bit patterns; an empty bag's are all ones."""
    h = np.full((len(found), positions), np.inf)
    if sum(len(s) for s, _ in found):
        bag = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
        key, weight = np.concatenate([s for s, _ in found]), np.concatenate([c for _, c in found])
        parts = [(bag, key, weight, 0, 1)]
        low = 1
        while (more := weight > low).any():  # the intervals [low, 2 low)
            bag, key, weight = bag[more], key[more], weight[more]
            parts.append((bag, mixed(key + np.uint64(low)), weight, low, low))
            low *= 2
        for bag, key, weight, base, length in parts:
            flat, at, step = h.ravel(), np.arange(len(key)), 0
            time = np.zeros(len(key))
            while len(at):
                step += 1
                r = mixed(key[at] + np.uint64(step * 0x9E3779B97F4A7C15 & 2**64 - 1))
                time[at] -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / length
                r = mixed(r + np.uint64(0x632BE59BD9B4E019))
                position = ((r >> np.uint64(32)) * np.uint64(positions)) >> np.uint64(32)
                target = bag[at] * positions + position.astype(np.int64)
                if length > 1 or base:
                    level = base + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(length)) >> np.uint64(32)).astype(np.int64)
                    fits = level < weight[at]
                    np.minimum.at(flat, target[fits], time[at[fits]])
                else:
                    np.minimum.at(flat, target, time[at])
                latest = h.max(axis=1)
                at = at[time[at] < latest[bag[at]]]
    return h.view(np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys for each row of signatures; equal keys of different bands differ."""
    grouped = mixed(sig).reshape(len(sig), -1, ROWS)
    keys = (grouped * _ROW).sum(axis=2)
    return mixed(keys + np.arange(keys.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def codes(sig: np.ndarray) -> np.ndarray:
    """One byte for each position: enough to estimate similarity."""
    return (mixed(sig) >> np.uint64(56)).astype(np.uint8)
