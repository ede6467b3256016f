"""Shape of a highlight: its border, what it encloses, and how few lines explain it."""

from __future__ import annotations

import math

import numpy as np

Point = tuple[int, int]

#: The eight neighbours in clockwise order, from the left one on.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def parts(mask: np.ndarray) -> list[Point]:
    """The first pixel, in reading order, of each part that hangs together over edges or corners."""
    left, starts = mask.copy(), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not left[y, x]:
            continue
        starts.append((int(y), int(x)))
        left[y, x] = False
        todo = [(int(y), int(x))]
        while todo:
            cy, cx = todo.pop()
            for dy, dx in AROUND:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and left[ny, nx]:
                    left[ny, nx] = False
                    todo.append((ny, nx))
    return starts


def border(mask: np.ndarray, start: Point) -> list[Point]:
    """The outer border of the part whose first pixel is ``start``, walked once around; pixels of thin lines come twice."""

    def step(at: Point, came: int) -> tuple[Point, int] | None:
        """The next border pixel clockwise after direction ``came``, and the direction back from it."""
        for k in range(1, 9):
            d = (came + k) % 8
            y, x = at[0] + AROUND[d][0], at[1] + AROUND[d][1]
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]:
                # Looking on from the last empty neighbour.
                empty = AROUND[(d - 1) % 8]
                gap = (at[0] + empty[0] - y, at[1] + empty[1] - x)
                return (y, x), AROUND.index(gap) if gap in AROUND else (d + 4) % 8
        return None

    first = step(start, 0)
    if first is None:
        return [start]
    walk, (at, came) = [start], first
    while True:
        following = step(at, came)
        if at == start and following[0] == first[0]:
            return walk
        walk.append(at)
        at, came = following


def enclosed(points: list[Point]) -> float:
    """Area of the polygon through the points."""
    y, x = np.array(points, dtype=float).T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def around(points: list[Point]) -> float:
    """Length of the closed line through the points."""
    p = np.array(points, dtype=float)
    return float(np.hypot(*(p - np.roll(p, -1, axis=0)).T).sum())


def corners(points: list[Point], tolerance: float) -> list[Point]:
    """The closed line with as few points as leave no other farther off than ``tolerance`` (Douglas-Peucker from two far points)."""
    p = np.array(points, dtype=float)
    far = lambda k: int(np.argmax(np.hypot(*(p - p[k]).T)))
    a = far(0)
    b = far(a)
    if a == b:
        return points[:1]
    a, b = sorted((a, b))
    kept = {a, b}
    todo = [(a, b), (b, a + len(p))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        inner = p[np.arange(i + 1, j) % len(p)]
        start, end = p[i % len(p)], p[j % len(p)]
        line = end - start
        long = math.hypot(*line)
        off = np.abs(line[0] * (inner[:, 1] - start[1]) - line[1] * (inner[:, 0] - start[0])) / long if long else np.hypot(*(inner - start).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            kept.add((i + 1 + k) % len(p))
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [points[k] for k in sorted(kept)]


def highlight_shape(target: np.ndarray) -> tuple[float, float]:
    """(compactness, straightness), 0 to 1, of the largest part brighter than the mean.

    Compactness is 4 pi area / length squared of its border, straightness how
    few corners the border needs for its number of pixels.
    """
    grey = np.floor(np.clip(target, 0.0, 1.0) * 255)
    mask = grey > max(int(grey.mean()) + 1, 1)
    borders = [border(mask, start) for start in parts(mask)]
    if not borders:
        return 0.0, 0.0
    walk = max(borders, key=lambda w: (enclosed(w), len(w)))
    length = around(walk)
    if length <= 1e-6:
        return 0.0, 0.0
    compact = min(4 * math.pi * enclosed(walk) / (length * length), 1.0)
    straight = 1 - len(corners(walk, 0.02 * length)) / max(len(walk) / 4, 1.0)
    return compact, min(max(straight, 0.0), 1.0)


def gradient_energy(image: np.ndarray) -> float | None:
    """Mean length of the Sobel gradient, mirrored at the edges; None for fewer than nine pixels."""
    if image.size < 9:
        return None
    wide = np.pad(image, 1, mode="reflect") if min(image.shape) > 1 else np.pad(image, 1, mode="edge")
    down = wide[2:] - wide[:-2]
    side = wide[:, 2:] - wide[:, :-2]
    return float(np.hypot(down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:], side[:-2] + 2 * side[1:-1] + side[2:]).mean())
