import math
import random

import pytest

from plinth.functions import planar as pl


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_iou_is_symmetric_and_one_on_itself():
    a, b = [square(0, 0, 2)], [square(1, 1, 2)]
    assert pl.iou(a, b) == pytest.approx(1 / 7) == pl.iou(b, a)
    assert pl.iou(a, a) == pytest.approx(1)
    assert pl.iou(a, [square(5, 5, 1)]) == 0


def test_overlap_against_sampling():
    rng = random.Random(3)
    for _ in range(20):
        a, b = (pl.hull([(rng.random() * 10, rng.random() * 10) for _ in range(7)]) for _ in range(2))
        both, either = pl.overlap_areas([a], [b])
        assert both + either == pytest.approx(abs(pl.area(a)) + abs(pl.area(b)))
        n = 4000
        hits = sum(pl.contains(a, p) and pl.contains(b, p) for p in ((rng.random() * 10, rng.random() * 10) for _ in range(n)))
        assert both == pytest.approx(hits / n * 100, abs=4)


def test_region_with_a_void():
    ring = [square(x, y, 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    r = pl.Region(ring)
    assert (r.area, r.voids, r.parts) == (pytest.approx(8), pytest.approx(1), 1)
    assert sum(pl.dist(a, b) for a, b in r.shell) == pytest.approx(12)
    assert r.to_shell((1.5, 1.5)) == pytest.approx(1.5)
    assert pl.Region([square(0, 0, 1), square(5, 0, 1)]).parts == 2


def test_faces_ignore_what_dangles():
    box = pl.edges(square(0, 0, 2))
    assert len(pl.faces([*box, ((1, -1), (1, 3)), ((5, 5), (6, 6))], 0.1)) == 2
    assert pl.faces([((0, 0), (1, 0)), ((1, 0), (1, 1)), ((3, 3), (4, 4))]) == []


def test_simple_rings():
    assert pl.is_simple(square(0, 0, 1))
    assert not pl.is_simple([(0, 0), (1, 1), (1, 0), (0, 1)])


@pytest.mark.parametrize("bend", [1.0, 0.5, -0.3])
def test_curves_reach_their_apex(bend):
    line = pl.curve((0, 0), (2, 0), bend)
    assert line[12] == (pytest.approx(1), pytest.approx(bend))
    assert line[0] == pytest.approx((0, 0)) and line[-1] == pytest.approx((2, 0))


def test_cover_and_boxes():
    assert pl.covered((0, 0), (10, 0), [((2, 1), (4, 1))], 1.5) == pytest.approx(2 + 2 * math.sqrt(1.25), abs=1e-6)
    assert pl.tight_box([(0, 0), (2, 2), (1, 3), (-1, 1)]) == (pytest.approx(2 * math.sqrt(2)), pytest.approx(math.sqrt(2)))
    assert pl.along_line([(0, 0), (10, 0)], -3) == (7, 0) and pl.along_line([(0, 0), (10, 0)], 99) == (10, 0)
