"""The stated semantics of the features in plain NumPy, for comparison."""

import numpy as np


def signal(values, bins=4):
    v = np.asarray(values, float)
    x = np.linspace(0, 1, len(v))
    slope = 0.0
    if len(v) > 1:
        slope = ((x - x.mean()) * (v - v.mean())).sum() / ((x - x.mean()) ** 2).sum()
    out = [v.mean(), v.std(), v.min(), v.max(), *np.quantile(v, (0.25, 0.5, 0.75)), np.sqrt((v**2).mean()),
           np.abs(np.diff(v)).mean() if len(v) > 1 else 0.0, slope]
    w = v if len(v) >= bins else np.interp(np.linspace(0, len(v) - 1, bins), np.arange(len(v)), v)
    for part in np.array_split(w, bins):
        out += [part.mean(), part.std()]
    return np.array(out)


def filled(values):
    v = np.array([np.nan if x is None else x for x in values], float)
    ok = np.isfinite(v)
    return np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok])


def resampled(values, length):
    v = np.asarray(values, float)
    if len(v) == 1:
        return np.full(length, v[0])
    return np.interp(np.linspace(0, 1, length), np.linspace(0, 1, len(v)), v)


def circular(degrees, bins=4):
    rad = np.deg2rad(filled(degrees))
    un = np.unwrap(rad)
    s, c = np.sin(rad), np.cos(rad)
    out = [s.mean(), c.mean(), np.hypot(s.mean(), c.mean()), un.std() / np.pi, np.ptp(un) / (2 * np.pi)]
    if len(rad) < bins:
        pick = np.linspace(0, len(rad) - 1, bins).round().astype(int)
        s, c = s[pick], c[pick]
    for a, b in zip(np.array_split(s, bins), np.array_split(c, bins)):
        out += [a.mean(), b.mean()]
    return np.array(out)


def rotation(quaternions):
    q = np.array(quaternions, float)
    q = q / np.maximum(np.linalg.norm(q, axis=1), 1e-8)[:, None]
    for i in range(1, len(q)):
        if q[i - 1] @ q[i] < 0:
            q[i] = -q[i]
    w2, x2, y2, z2 = q[0] * (1, -1, -1, -1)
    w, x, y, z = q.T
    relative = np.column_stack((
        w * w2 - x * x2 - y * y2 - z * z2, w * x2 + x * w2 + y * z2 - z * y2,
        w * y2 - x * z2 + y * w2 + z * x2, w * z2 + x * y2 - y * x2 + z * w2,
    ))
    step = np.zeros(len(q))
    step[1:] = 2 * np.arccos(np.clip(np.abs((q[1:] * q[:-1]).sum(axis=1)), 0, 1))
    return relative, step


def person_choice(frames):
    """Index of the chosen person per frame; frames are lists of (points, scores)."""
    last, chosen = None, []
    for people in frames:
        if not people:
            chosen.append(None)
            continue
        centers = [np.mean(p, axis=0) for p, _ in people]
        if last is None:
            ranks = [(np.mean(s), np.linalg.norm(np.ptp(np.array(p), axis=0))) for p, s in people]
            pick = max(range(len(people)), key=lambda i: ranks[i])
        else:
            pick = min(range(len(people)), key=lambda i: np.linalg.norm(centers[i] - last))
        last = centers[pick]
        chosen.append(pick)
    return chosen


def hog_slow(image, orientations, cell, block):
    h, w = image.shape
    hist = np.zeros((h // cell, w // cell, orientations))
    for y in range(h):
        for x in range(w):
            gx = image[y, min(x + 1, w - 1)] - image[y, max(x - 1, 0)]
            gy = image[min(y + 1, h - 1), x] - image[max(y - 1, 0), x]
            place = (np.arctan2(gy, gx) % np.pi) * orientations / np.pi
            low = int(np.floor(place))
            share = place - low
            hist[y // cell, x // cell, low % orientations] += np.hypot(gx, gy) * (1 - share)
            hist[y // cell, x // cell, (low + 1) % orientations] += np.hypot(gx, gy) * share
    out = []
    for y in range(hist.shape[0] - block + 1):
        for x in range(hist.shape[1] - block + 1):
            b = hist[y : y + block, x : x + block].ravel()
            b = np.minimum(b / np.sqrt(b @ b + 1e-10), 0.2)
            out.append(b / np.sqrt(b @ b + 1e-10))
    return np.concatenate(out)
