"""The predictor transform against values worked out by hand from the format's text, channel by channel."""

import time

import numpy as np
import pytest

from crawlspan.llm import media

# Neighbours of one pixel: left, top, top left, top right; four channels each.
L, T, TL, TR = (10, 200, 30, 255), (50, 100, 250, 0), (20, 180, 60, 128), (90, 40, 5, 7)
#: What each mode predicts from them.
BY_HAND = {
    0: (0, 0, 0, 255), 1: L, 2: T, 3: TR, 4: TL,
    5: (50, 110, 133, 65),  # average of (average of L and TR) and T: 50, 120, 17, 131 with T
    6: (15, 190, 45, 191), 7: (30, 150, 140, 127), 8: (35, 140, 155, 64), 9: (70, 70, 127, 3),
    10: (42, 130, 86, 97),  # averages of 6 and 9
    11: T,  # T lies 187 from L + T - TL, L lies 428 from it
    12: (40, 120, 220, 127), 13: (35, 135, 180, 127),  # 13: mode 7 plus half of its way from TL, cut toward zero
}
MORE = [
    (11, (50, 100, 250, 0), (10, 200, 30, 255), TL, TR, (50, 100, 250, 0)),  # the other way round: left is nearer
    (11, (5, 5, 5, 5), (7, 7, 7, 7), (6, 6, 6, 6), TR, (7, 7, 7, 7)),  # as near: top
    (12, (250, 3, 0, 255), (250, 2, 0, 255), (10, 90, 0, 0), TR, (255, 0, 0, 255)),  # clamped at both ends
    (13, (255, 0, 1, 9), (255, 0, 2, 9), (0, 255, 2, 4), TR, (255, 0, 1, 11)),  # 1 - 2 halves to 0
    (5, (255, 1, 0, 0), (255, 1, 1, 0), TL, (255, 0, 1, 1), (255, 0, 0, 0)),  # averages round down, twice
]


def undo(mode, left, top, top_left, top_right, residual=(0, 0, 0, 0)):
    """A picture of 3 x 2 whose middle pixel below has these neighbours, through the transform itself."""
    want = np.array([[top_left, top, top_right], [left, (0, 0, 0, 0), (0, 0, 0, 0)]], int)
    res = np.zeros((2, 3, 4), int)
    res[0, 0] = want[0, 0] - (0, 0, 0, 255)
    res[0, 1:] = want[0, 1:] - want[0, :-1]
    res[1, 0] = want[1, 0] - want[0, 0]
    res[1, 1] = residual
    words = np.ascontiguousarray(res % 256, np.uint8).view("<u4").reshape(2, 3)
    out = media._channels(media._undo_predictor(words, np.full((1, 1), mode << 8, np.uint32), 2))
    assert (out[0] == want[0]).all() and (out[1, 0] == want[1, 0]).all()
    return tuple(out[1, 1].tolist())


@pytest.mark.parametrize("mode", BY_HAND)
def test_modes_by_hand(mode):
    assert undo(mode, L, T, TL, TR) == BY_HAND[mode]
    assert undo(mode, L, T, TL, TR, (1, 250, 255, 3)) == tuple((a + b) % 256 for a, b in zip(BY_HAND[mode], (1, 250, 255, 3), strict=True))


@pytest.mark.parametrize("case", MORE, ids=str)
def test_edges_by_hand(case):
    mode, left, top, top_left, top_right, want = case
    assert undo(mode, left, top, top_left, top_right) == want


def by_the_text(res, modes, block):
    """The transform pixel by pixel as the format describes it, in plain integers."""
    h, w, _ = res.shape
    out = np.zeros_like(res)
    for y in range(h):
        for x in range(w):
            if (x, y) == (0, 0):
                p = (0, 0, 0, 255)
            elif y == 0:
                p = out[y, x - 1]
            elif x == 0:
                p = out[y - 1, x]
            else:
                left, top, tl = (list(map(int, v)) for v in (out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]))
                tr = list(map(int, out[y - 1, x + 1] if x + 1 < w else out[y, 0]))
                m, p = modes[y >> block, x >> block], []
                near_left = sum(abs((a + b - c) - a) for a, b, c in zip(left, top, tl)) < sum(abs((a + b - c) - b) for a, b, c in zip(left, top, tl))
                for k, (a, b, c, d) in enumerate(zip(left, top, tl, tr)):
                    gap = (a + b) // 2 - c
                    p.append((
                        255 if k == 3 else 0, a, b, d, c, ((a + d) // 2 + b) // 2, (a + c) // 2, (a + b) // 2, (c + b) // 2, (b + d) // 2, ((a + c) // 2 + (b + d) // 2) // 2,
                        a if near_left else b, min(255, max(0, a + b - c)), min(255, max(0, (a + b) // 2 + (abs(gap) // 2) * (1 if gap > 0 else -1))), 255 if k == 3 else 0, 255 if k == 3 else 0,
                    )[m])
            out[y, x] = (res[y, x] + np.array(p)) % 256
    return out


@pytest.mark.parametrize(("h", "w", "block"), [(1, 1, 2), (1, 9, 2), (9, 1, 2), (17, 23, 2), (20, 33, 3)])
def test_pictures_of_all_modes(h, w, block):
    rng = np.random.default_rng(h * w)
    res = rng.integers(0, 256, (h, w, 4))
    modes = rng.integers(0, 16, ((h + (1 << block) - 1) >> block, (w + (1 << block) - 1) >> block))
    words = np.ascontiguousarray(res, np.uint8).view("<u4").reshape(h, w)
    got = media._channels(media._undo_predictor(words, (modes << 8).astype(np.uint32), block))
    assert (got == by_the_text(res, modes, block)).all()


def test_a_real_size():
    """A picture of 1024 x 1024 with the modes that encoders use most goes by arrays."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, (1024, 1024), np.uint32)
    modes = (rng.choice([0, 1, 2, 3, 4, 8, 9], (64, 64)) << 8).astype(np.uint32)
    began = time.process_time()
    media._undo_predictor(words, modes, 4)
    assert time.process_time() - began < 8
