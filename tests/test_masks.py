"""Contours against a plain border walk, run lengths of polygons against a test of every point."""

import random

from quadrat.operators import masks

STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]  # left, down-left, down, ...


def walk(grid):
    """Outer borders of 8-connected parts outside all holes, by Moore's walk; the background outside is 4-connected."""
    h, w = len(grid), len(grid[0])
    on = lambda x, y: 0 <= x < w and 0 <= y < h and grid[y][x]
    outside, stack = set(), [(-1, -1)]
    while stack:
        x, y = stack.pop()
        if (x, y) in outside or not (-1 <= x <= w and -1 <= y <= h) or on(x, y):
            continue
        outside.add((x, y))
        stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    seen, out = set(), {}
    for y in range(h):
        for x in range(w):
            if on(x, y) and (x, y) not in seen:
                part, stack = set(), [(x, y)]
                while stack:
                    p = stack.pop()
                    if p in part or not on(*p):
                        continue
                    part.add(p)
                    stack += [(p[0] + a, p[1] + b) for a, b in STEPS]
                seen |= part
                if (x - 1, y) not in outside:
                    continue
                chain, at, came = [(x, y)], (x, y), 0  # came: index of the background pixel looked at last
                start = None
                while True:
                    for k in range(1, 9):
                        i = (came + k) % 8
                        q = (at[0] + STEPS[i][0], at[1] + STEPS[i][1])
                        if q in part:
                            break
                    else:
                        break
                    if start == (at, q):
                        chain.pop()
                        break
                    start = start or (at, q)
                    back = (at[0] + STEPS[(i - 1) % 8][0], at[1] + STEPS[(i - 1) % 8][1])
                    came = next(j for j in range(8) if (q[0] + STEPS[j][0], q[1] + STEPS[j][1]) == back)
                    at = q
                    chain.append(q)
                n = len(chain)
                keep = [
                    p for i, p in enumerate(chain)
                    if n < 2 or (p[0] - chain[i - 1][0], p[1] - chain[i - 1][1]) != (chain[(i + 1) % n][0] - p[0], chain[(i + 1) % n][1] - p[1])
                ]
                out[(y, x)] = [c for p in keep for c in p]
    return out


def runs_of(bits):
    out, last = [0], 0
    for b in bits:
        if b != last:
            out.append(0)
            last = b
        out[-1] += 1
    return out


GRIDS = [
    ["111", "111", "111"], ["1"], ["101", "010", "101"], ["11111", "10001", "10101", "10001", "11111"], ["110", "011"], ["0000", "0110", "0100"],
    ["1111111", "1000001", "1011101", "1010101", "1011101", "1000001", "1111111"], ["1010101", "1010101", "1111111"], ["00"],
]


def test_contours(spark):
    rng = random.Random(9)
    grids = [[[int(c) for c in row] for row in g] for g in GRIDS]
    grids += [[[int(rng.random() < p) for _ in range(w)] for _ in range(h)] for p in (0.3, 0.5, 0.7, 0.9) for w, h in ((9, 7), (16, 16), (1, 12))]
    rows = [(i, runs_of([b for row in g for b in row]), len(g[0])) for i, g in enumerate(grids)]
    df = spark.createDataFrame(rows, "id long, runs array<int>, width int")
    for least in (1, 3):
        found = {(r.id, r.y, r.x): r.points for r in masks.contours(df, "id", "runs", "width", least).collect()}
        want = {(i, y, x): p for i, g in enumerate(grids) for (y, x), p in walk(g).items() if len(p) >= 2 * least}
        assert found == want


def test_polygon_runs(spark):
    rng = random.Random(10)
    polygons = [[0, 0, 4, 0, 4, 3, 0, 3], [0, 0, 6, 6, 0, 6], [2, 2], [1, 1, 5, 1], [0, 0, 6, 6, 6, 0, 0, 6], [0, 0, 8, 0, 8, 6, 6, 6, 6, 2, 2, 2, 2, 6, 0, 6]]
    polygons += [[rng.randint(-5, 15) for _ in range(2 * n)] for n in (3, 4, 5, 7, 12) for _ in range(8)]

    def inside(p, x, y):
        points = list(zip(p[::2], p[1::2]))
        odd = False
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and (x - ax) * abs(by - ay) < (bx - ax) * (y - ay) * (1 if by > ay else -1):
                odd = not odd
        return odd

    want = {}
    for i, p in enumerate(polygons):
        left, top, right, bottom = min(p[::2]), min(p[1::2]), max(p[::2]), max(p[1::2])
        bits = [int(inside(p, x, y)) for y in range(top, bottom + 1) for x in range(left, right + 1)]
        want[i] = (left, top, right - left + 1, bottom - top + 1, runs_of(bits))
    df = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(polygons)] + [(99, [])], "id long, coords array<double>")
    found = {r.id: (r.left, r.top, r.width, r.height, r.runs) for r in masks.polygon_runs(df, "id", "coords").collect()}
    assert found == want
