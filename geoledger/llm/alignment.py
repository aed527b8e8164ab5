"""Banded edit distances between word sequences, many pairs at a time."""

from __future__ import annotations

import numpy as np

CELLS = 1_000_000  # cells of a group of pairs in memory; only a single longer pair takes more
NARROW = 12
MANY = 64  # pairs from which on bit vectors are faster than a band
WIDE = 128  # limit up to which they are
FAR = 1 << 28


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences without their common beginning and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[:len(a) - tail], b[:len(b) - tail]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection."""
    values, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    return int(np.minimum(np.bincount(codes[:len(a)], minlength=len(values)), np.bincount(codes[len(a):], minlength=len(values))).sum())


def _group(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distance of each pair along paths that stay within ``width`` of the diagonal (an upper bound of the true one)."""
    rows = max(len(a) for a, _ in pairs)
    far = np.int32(FAR)
    left = np.zeros((len(pairs), rows), dtype=np.int64)
    right = np.full((len(pairs), rows + 2 * width + 1), -1, dtype=np.int64)
    for p, (a, b) in enumerate(pairs):
        left[p, :len(a)] = a
        part = b[:rows + width]
        right[p, width:width + len(part)] = part
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    band = np.arange(2 * width + 1, dtype=np.int32)
    now = np.broadcast_to(np.where(band >= width, band - width, far), (len(pairs), 2 * width + 1)).astype(np.int32)
    ends = m - n + width
    out = np.where(n == 0, m, far).astype(np.int64)
    for i in range(1, rows + 1):
        best = now + (left[:, i - 1:i] != right[:, i - 1:i + 2 * width])  # column j = i + k - width stands at i - 1 + k in right
        best[:, :-1] = np.minimum(best[:, :-1], now[:, 1:] + 1)
        if i <= width:
            best[:, :width - i] = far
            best[:, width - i] = i
        now = np.minimum.accumulate(best - band, axis=1) + band
        done = n == i
        if done.any():
            out[done] = now[done, ends[done]]
    return out


def _bits(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """As ``_group``, with 64 rows of a pair's column in one word: bit vectors hold where the values of a column rise and fall by one.

    Blocks of rows enter when the band reaches them and leave when it has passed; at its rims values are those of a path along
    the rim, so a distance within ``width`` is exact and a larger one is not too small."""
    n, m = (np.array([len(pair[k]) for pair in pairs]) for k in (0, 1))
    blocks, one = -(-int(m.max()) // 64), np.uint64(1)
    left = np.zeros((len(pairs), int(n.max())), dtype=np.uint32)
    right = np.zeros((len(pairs), 64 * blocks), dtype=np.uint32)
    for p, (a, b) in enumerate(pairs):
        left[p, :len(a)], right[p, :len(b)] = a, b
    rise, fall = np.full((blocks, len(pairs)), ~np.uint64(0)), np.zeros((blocks, len(pairs)), dtype=np.uint64)
    above = 64 * np.arange(blocks)[:, None]
    beyond = (~np.uint64(0) << np.clip(m - above, 0, 63).astype(np.uint64)) * (m - above < 64)  # rows after the last word of ``b``
    high = min(blocks - 1, width // 64)
    bottom = np.full(len(pairs), 64 * (high + 1), dtype=np.int64)
    out = np.where(n == 0, m, FAR).astype(np.int64)
    finish = {int(size): np.flatnonzero(n == size) for size in np.unique(n)}
    for i in range(1, left.shape[1] + 1):
        while high < min(blocks - 1, (i + width - 1) // 64):
            high += 1
            bottom += 64
        low = min(max(0, i - width - 1) // 64, high)
        equal = np.packbits(right[:, 64 * low:64 * (high + 1)] == left[:, i - 1:i], axis=1, bitorder="little").view("<u8")
        up, down = one, np.uint64(0)
        for k in range(low, high + 1):
            e, pv, mv = equal[:, k - low], rise[k], fall[k]
            xv = e | mv
            e = e | down
            xh = (((e & pv) + pv) ^ pv) | e
            ph, mh = mv | ~(xh | pv), pv & xh
            next_up, next_down = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << one) | up, (mh << one) | down
            rise[k], fall[k] = mh | ~(xv | ph), ph & xv
            up, down = next_up, next_down
        bottom += up.astype(np.int64)
        bottom -= down.astype(np.int64)
        if i in finish:
            p = finish[i]
            over = beyond[:high + 1, p]
            out[p] = (bottom[p] - np.bitwise_count(rise[:high + 1, p] & over).sum(axis=0, dtype=np.int64)
                      + np.bitwise_count(fall[:high + 1, p] & over).sum(axis=0, dtype=np.int64))
    return out


def bounds(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> np.ndarray:
    """For each pair a number that its edit distance does not exceed, at most its limit; ``FAR`` where the distance is above the limit."""
    result = np.full(len(pairs), FAR, dtype=np.int64)
    fit, few, low = [], [], 0
    for k, ((a, b), limit) in enumerate(zip(pairs, limits)):
        n, apart = min(len(a), len(b)), abs(len(a) - len(b))
        if apart > limit:
            continue
        distance = apart + int(np.count_nonzero(a[:n] != b[:n]))
        if apart and distance > limit:
            distance = apart + int(np.count_nonzero(a[len(a) - n:] != b[len(b) - n:]))
        if distance <= limit:
            result[k] = distance
        else:
            (fit if limit <= WIDE else few).append(k)
    fit.sort(key=lambda k: (limits[k] // 16, len(pairs[k][0])))
    while low < len(fit):  # many pairs of like size
        high, size = low, (0, 0, 0)
        while high < len(fit):
            (a, b), limit = pairs[fit[high]], limits[fit[high]]
            now = max(size[0], len(a)), max(size[1], len(b)), max(size[2], limit)
            if high > low and (high + 1 - low) * (now[0] + 2 * now[1]) > CELLS:
                break
            size, high = now, high + 1
        part = fit[low:high]
        if len(part) >= MANY:
            distances = _bits([pairs[k] for k in part], size[2])
            result[part] = np.where(distances <= np.array([limits[k] for k in part]), distances, FAR)
        else:
            few += part
        low = high
    waiting: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for k in few:
        (a, b), limit = pairs[k], limits[k]
        a, b = _trimmed(a, b)
        if len(a) == 0 or len(b) == 0:
            result[k] = max(len(a), len(b))
        elif max(len(a), len(b)) - _common(a, b) <= limit:
            waiting.append((k, a, b, limit))
    for final in (False, True):  # a narrow band settles most pairs; a band as wide as the limit settles the others exactly
        waiting.sort(key=lambda w: (w[3] if final else abs(len(w[1]) - len(w[2])), len(w[1])))
        rest, low = [], 0
        while low < len(waiting):
            high, longest, width = low, 0, 0
            while high < len(waiting):
                _, a, b, limit = waiting[high]
                wide = max(width, limit if final else min(limit, abs(len(a) - len(b)) + NARROW))
                rows = max(longest, len(a))
                if high > low and (high + 1 - low) * (2 * rows + 6 * wide) > CELLS:
                    break
                longest, width, high = rows, wide, high + 1
            part = waiting[low:high]
            for item, distance in zip(part, _group([(a, b) for _, a, b, _ in part], width)):
                if distance <= item[3]:
                    result[item[0]] = distance
                elif not final:
                    rest.append(item)
            low = high
        waiting = rest
    return result


def within(pairs: list[tuple[np.ndarray, np.ndarray]], share: float) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``share`` of the longer sequence."""
    return bounds(pairs, [int(share * max(len(a), len(b)) + 1e-9) for a, b in pairs]) < FAR
