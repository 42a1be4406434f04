from __future__ import annotations

import itertools
import json
import math
import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tileframe import model
from tileframe.functions import geo, scalar, text
from tileframe.operators import calibrate, graph, grid, masks, registration, stats, vectors, votes
from tileframe.operators.scorer import linear_scorer, orientations, predict_tiles
from tileframe.plans.detect import detect
from tileframe.sources import files, imagery, sinks, tiff


def mask_of(spark, picture):
    return spark.createDataFrame([(y, x) for y, row in enumerate(picture) for x, c in enumerate(row) if c == "#"], "y int, x int")


def picture_of(mask, h, w):
    got = {(r.y, r.x) for r in mask.collect()}
    return ["".join("#" if (y, x) in got else "." for x in range(w)) for y in range(h)]


def parts(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r["label"], set()).add((r.y, r.x))
    return sorted(map(sorted, out.values()))


def plain_parts(cells):
    cells, out = set(cells), []
    while cells:
        work, part = [cells.pop()], []
        while work:
            y, x = work.pop()
            part.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in cells:
                    cells.remove(n)
                    work.append(n)
        out.append(sorted(part))
    return sorted(out)


@pytest.mark.parametrize("picture", [
    ["##......", "##......", "..##....", "..##...."],
    ["#.#", "#.#", "###"],
    ["#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######"],
    ["###", "...", "###"],
])
def test_components(spark, picture):
    cells = [(y, x) for y, row in enumerate(picture) for x, c in enumerate(row) if c == "#"]
    assert parts(graph.label(mask_of(spark, picture))) == plain_parts(cells)


def test_components_of_noise_and_shuffled_input(spark):
    rng = np.random.default_rng(3)
    cells = [(int(y), int(x)) for y, x in zip(*np.nonzero(rng.random((24, 24)) < 0.58), strict=True)]
    df = spark.createDataFrame(cells, "y int, x int")
    assert parts(graph.label(df)) == parts(graph.label(df.repartition(7))) == plain_parts(cells)


def test_components_of_nothing(spark):
    assert graph.label(spark.createDataFrame([], "y int, x int")).count() == 0


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in graph.components(e).collect()} == {0}


def test_erosion_keeps_a_scene_that_would_vanish(spark):
    bar = ["........", ".######.", "........"]
    assert picture_of(masks.eroded_or_kept(mask_of(spark, bar)), 3, 8) == bar
    assert picture_of(masks.eroded_or_kept(mask_of(spark, ["#####"] * 4)), 4, 5) == [".....", ".###.", ".###.", "....."]


def test_open_and_close(spark):
    assert picture_of(masks.opened(mask_of(spark, ["###..", "###.#", "###.."]), 3, 5), 3, 5) == [".#...", "###..", ".#..."]
    assert picture_of(masks.closed(mask_of(spark, ["##.##", "##.##", "##.##"]), 3, 5), 3, 5) == ["#####"] * 3
    assert masks.closed(spark.createDataFrame([], "y int, x int"), 3, 5).count() == 0


def test_smoothing_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random((9, 11))
    k = np.array(masks.kernel(1.0))
    pad = np.pad(a, 4, mode="symmetric")
    want = sum(k[i] * pad[i : i + 9, :] for i in range(9))
    want = sum(k[i] * want[:, i : i + 11] for i in range(9))
    px = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(9) for x in range(11)], "y int, x int, v double")
    for r in masks.smoothed(px, "v", 9, 11).collect():
        assert abs(r.v - want[r.y, r.x]) < 1e-12


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(2)
    on = rng.random((2, 14, 17)) < 0.93
    on[1, 3:13, 2:15] = True
    px = spark.createDataFrame([(int(k), int(y), int(x), 14, 17) for k, y, x in zip(*np.nonzero(on), strict=True)], "scene int, y int, x int, h int, w int")
    got = masks.distances(px, "h", "w", ("scene",)).collect()
    assert len(got) == on.sum()
    for r in got:
        off = np.argwhere(~on[r.scene])
        assert abs(r.distance - math.sqrt(((off - (r.y, r.x)) ** 2).sum(1).min())) < 1e-12
    assert masks.distances(spark.createDataFrame([(y, x) for y in range(3) for x in range(3)], "y int, x int"), 3, 3).where("distance is not null").isEmpty()


def test_unmarked_component_vanishes_or_stays(spark):
    surface = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (0, 2, 1.0), (3, 0, 1.0)], "y int, x int, s double")
    marks = spark.createDataFrame([(0, 0, 1), (0, 2, 2)], "y int, x int, mark long")
    got = {(r.y, r.x): r["label"] for r in masks.watershed(surface, marks).collect()}
    assert got[0, 0] == 1 and got[0, 2] == 2 and got[0, 1] in (1, 2) and got[3, 0] == 0
    assert {(r.y, r.x): r["label"] for r in masks.watershed(surface, marks, keep_unmarked=True).collect()}[3, 0] > 0


def test_two_squares_with_a_bridge_are_split(spark):
    p = {(y, x): 0.95 for y in range(3, 10) for x in [*range(3, 10), *range(13, 20)]} | {(6, x): 0.95 for x in range(10, 13)}
    df = spark.createDataFrame([(y, x, p.get((y, x), 0.05)) for y in range(14) for x in range(24)], "y int, x int, p double")
    assert masks.split_touching(df, 14, 24, 3).where("label > 0").select("label").distinct().count() == 2


def test_minimum_size_boundary(spark):
    rows = [(n, i, n) for n in (29, 30, 31) for i in range(n)]
    got = masks.at_least(spark.createDataFrame(rows, "y int, x int, label int"), model.Options().min_pixels)
    assert {r["label"] for r in got.collect()} == {30, 31}


def test_vote_ties_and_rules_in_order(spark):
    rows = [(1, 2.0, 2.0, 0.0, 0.0), (2, 0.0, 0.0, 1.0, 0.45), (3, 0.0, 0.0, 1.0, 0.44), (4, 0.0, 1.0, 0.9, 0.5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "label int, s1 double, s2 double, s3 double, s4 double, pixels long")
    got = {r["label"]: r.damage_class for r in votes.vote(df, [(2, 3, 0.5), (3, 4, 0.45), (9, 4, 0.1), (1,)]).collect()}
    assert got == {1: 1, 2: 4, 3: 3, 4: 4}


def test_blend_of_identical_tiles_is_identity(spark):
    px = spark.createDataFrame([(y, x, float(y * 10 + x)) for y in range(20) for x in range(20)], "y int, x int, v double")
    for r in grid.blend(grid.cover(px, 20, 20, 8, 3), F.col("v"), 8).collect():
        assert abs(r.p - (r.y * 10 + r.x)) < 1e-9


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 200), st.integers(2, 64), st.data())
def test_tiles_leave_no_gap(spark, n, tile, data):
    overlap = data.draw(st.integers(0, tile - 1))
    got = spark.range(1).select(grid.axis_origins(F.lit(n), tile, overlap)).first()[0]
    assert set(range(n)) <= {o + i for o in got for i in range(tile)}
    assert got[-1] == max(n - tile, 0)


def test_orientations_and_their_inverses():
    a = np.arange(24.0).reshape(1, 4, 6)
    seen = set()
    for there, back in orientations(8):
        assert (back(there(a)) == a).all()
        seen.add(there(a).tobytes() + bytes(there(a).shape))
    assert len(seen) == 8


def test_orient_columns(spark):
    df = spark.createDataFrame([(y, x) for y in range(3) for x in range(3)], "y int, x int")
    for k in range(8):
        a, b = scalar.orient(k, F.col("y"), F.col("x"), 3)
        c, d = scalar.disorient(k, F.col("a"), F.col("b"), 3)
        assert df.withColumns({"a": a, "b": b}).where((c != F.col("y")) | (d != F.col("x"))).count() == 0


def test_scorer_is_the_same_in_all_orientations(spark):
    rng = np.random.default_rng(0)
    t = [(i, rng.random(25).tolist(), rng.random(25).tolist()) for i in range(3)]
    df = spark.createDataFrame(t, "k int, pre array<double>, post array<double>")
    one, eight = ({(r.k, r.y, r.x): r.p for r in predict_tiles(df, 5, linear_scorer, tta=n, multiple=4).collect()} for n in (1, 8))
    assert one.keys() == eight.keys() and len(one) == 75
    for k in one:
        assert np.allclose(one[k], eight[k]) and abs(sum(one[k]) - 1) < 1e-9


def test_scored_batches_are_bounded(spark):
    def make():
        score = linear_scorer()

        def checked(pre, post):
            assert pre.size <= 1 << 20, pre.shape
            return score(pre, post)

        return checked

    df = spark.range(0, 3000, 1, 1).selectExpr("cast(id as int) as k", "transform(sequence(0, 63), i -> (id * 64 + i) % 97 / 97D) as pre", "transform(sequence(0, 63), i -> (id + i) % 89 / 89D) as post")
    got = {(r.k, r.y, r.x): r.p for r in predict_tiles(df, 8, make, tta=4).where("k % 500 = 7").collect()}
    assert len(got) == 6 * 64
    loc, members = linear_scorer()(*(np.array([[[(k * 64 + i) % 97 / 97, (k + i) % 89 / 89] for i in range(64)] for k in range(3000)])[:, None, :, c] for c in (0, 1)))
    for (k, y, x), p in got.items():
        i, a = y * 8 + x, 1 / (1 + np.exp(-loc[k, 0, y * 8 + x]))
        e = [np.exp(m[k, :, 0, i]) for m in members]
        assert np.allclose(p, [1 - a, *(a * sum(v / v.sum() for v in e) / 2)])


def plain_detect(pre, post, o):
    """A run over one scene in NumPy, without overlap effects of registration: scores, blend, labels, votes."""
    h, w = pre.shape
    t, step = (o.tile, o.tile - o.overlap) if min(h, w) >= o.tile else (max(h, w), 1)
    origins = lambda n: sorted({*range(0, max(n - t, 0) + 1, step), max(n - t, 0)}) if min(h, w) >= o.tile else [0]
    total, sums = np.zeros((h, w)), np.zeros((5, h, w))
    hann = np.hanning(t + 2)[1:-1]
    for y0 in origins(h):
        for x0 in origins(w):
            a, b = (np.zeros((t, t)) for _ in "ab")
            part = pre[y0 : y0 + t, x0 : x0 + t]
            a[: part.shape[0], : part.shape[1]], b[: part.shape[0], : part.shape[1]] = part, post[y0 : y0 + t, x0 : x0 + t]
            loc, members = linear_scorer()(a[None], b[None])
            p = 1 / (1 + np.exp(-loc[0]))
            soft = [np.exp(m[0]) / np.exp(m[0]).sum(0) for m in members]
            wt = np.outer(hann, hann)[: part.shape[0], : part.shape[1]]
            each = np.concatenate([[1 - p], p * np.mean(soft, 0)])[:, : part.shape[0], : part.shape[1]]
            sums[:, y0 : y0 + t, x0 : x0 + t] += each * wt
            total[y0 : y0 + t, x0 : x0 + t] += wt
    p = sums / np.maximum(total, 1e-6)
    out = []
    for cells in plain_parts([(int(y), int(x)) for y, x in np.argwhere(1 - p[0] > o.loc_threshold)]):
        if len(cells) >= o.min_pixels:
            s = np.array([p[k][tuple(zip(*cells, strict=True))].sum() for k in range(1, 5)])
            c = int(s.argmax()) + 1
            if c == 3 and s[3] / max(s[2], 1e-6) >= 0.45:
                c = 4
            out.append((c, len(cells), round(float(s[c - 1] / (s.sum() + 1e-6)), 4)))
    return sorted(out)


def two_scenes(spark, sizes):
    """Squares apart from each other, in scenes of several sizes; some are darker in the second image."""
    rows, dims, images = [], [], {}
    for k, (h, w) in enumerate(sizes):
        pre, post = np.zeros((h, w)), np.zeros((h, w))
        for n, (y, x) in enumerate((y, x) for y in range(3, h - 8, 11) for x in range(3, w - 8, 11)):
            pre[y : y + 6, x : x + 6] = 0.9
            post[y : y + 6, x : x + 6] = (0.9, 0.3, 0.75)[(n + k) % 3]
        rows += [(f"s{k}", y, x, float(pre[y, x]), float(post[y, x])) for y in range(h) for x in range(w)]
        dims.append((f"s{k}", h, w, 100.0, 500.0, 0.5, 0.5))
        images[f"s{k}"] = (pre, post)
    return spark.createDataFrame(rows, "scene string, y int, x int, pre double, post double"), spark.createDataFrame(dims, "scene string, h int, w int, xmin double, ymax double, px_w double, px_h double"), images


@pytest.mark.parametrize("watershed", [True, False])
def test_detection_of_many_scenes_against_numpy(spark, watershed):
    o = model.Options(tile=16, overlap=4, sensitivity=60, min_distance=2, register=False, watershed=watershed)
    px, dims, images = two_scenes(spark, [(30, 41), (12, 30), (27, 19)])
    got = {}
    for r in detect(px, dims, o).collect():
        got.setdefault(r.scene, []).append((r.damage_class, r.pixels, round(r.confidence, 4)))
        assert r.area == r.pixels * 0.25 and r.intensity == r.damage_class / 4 and r.damage_name == model.CLASS_NAMES[r.damage_class]
        assert all(100 <= p.x <= 100 + 41 / 2 and 500 - 30 / 2 <= p.y <= 500 for p in r.ring)
    for k, (pre, post) in images.items():
        assert sorted(got[k]) == plain_detect(pre, post, o), k
    one = detect(px.where("scene = 's0'"), dims.where("scene = 's0'"), o).collect()
    assert sorted((r.damage_class, r.pixels, round(r.confidence, 4)) for r in one) == sorted(got["s0"])


def test_detection_takes_back_shifts(spark):
    rng = np.random.default_rng(3)
    base = np.zeros((90, 90))
    for y, x in rng.integers(6, 76, (14, 2)):
        base[y : y + 8, x : x + 8] = 0.9
    post = np.roll(base, (3, -5), (0, 1))
    dims = spark.createDataFrame([(1, 90, 90, 0.0, 90.0, 1.0, 1.0)], "scene int, h int, w int, xmin double, ymax double, px_w double, px_h double")
    px = spark.createDataFrame([(1, y, x, float(base[y, x]), float(post[y, x])) for y in range(90) for x in range(90)], "scene int, y int, x int, pre double, post double")
    share = lambda o: (lambda rs: sum(r.pixels for r in rs if r.damage_class == 1) / sum(r.pixels for r in rs))(detect(px, dims, o).collect())
    o = dict(tile=48, overlap=8, min_distance=3)
    assert share(model.Options(**o)) > 0.9 > share(model.Options(**o, register=False))


def test_a_large_tile_is_scored_quickly(spark):
    import time

    px = spark.range(512 * 512).selectExpr("0 scene", "cast(id div 512 as int) y", "cast(id % 512 as int) x", "if(id % 512 between 100 and 140 and id div 512 between 100 and 150, 0.9D, 0D) pre", "0D post")
    dims = spark.createDataFrame([(0, 512, 512, 0.0, 512.0, 1.0, 1.0)], "scene int, h int, w int, xmin double, ymax double, px_w double, px_h double")
    from tileframe.operators.scorer import score_windows
    from tileframe.plans.detect import windows

    began = time.perf_counter()
    tiles = windows(px.withColumn("scene", F.col("scene").cast("int")), dims, model.Options(), None, 0)
    assert score_windows(tiles, ["scene"], linear_scorer, 0).agg(F.count("*")).first()[0] == 512 * 512
    assert time.perf_counter() - began < 20


def test_scoring_goes_on_when_memory_fails():
    from tileframe.operators.scorer import scored

    def scarce(pre, post):
        if len(pre) > 1:
            raise RuntimeError("failed to ALLOCate memory")
        return linear_scorer()(pre, post)

    rng = np.random.default_rng(1)
    pre, post = rng.random((3, 8, 8)), rng.random((3, 8, 8))
    assert np.allclose(scored(scarce, pre, post, 8, multiple=4), scored(linear_scorer(), pre, post, 8, multiple=4))
    with pytest.raises(ValueError):
        scored(lambda a, b: (_ for _ in ()).throw(ValueError("wrong shape")), pre, post)


def test_instances_are_outlined_with_their_holes(spark):
    ring = [(y, x) for y in range(12) for x in range(12) if not (4 <= y < 8 and 4 <= x < 8)]
    rows = [(y, x, 7, 2, 0.5) for y, x in ring] + [(5, 5, 9, 4, 1.0)] + [(20, x, 8, 1, 0.5) for x in range(40)]
    r = vectors.instance_polygons(spark.createDataFrame(rows, "y int, x int, label long, damage_class int, confidence double"), 30).collect()
    assert [(x["label"], x.pixels, x.area_px) for x in r if x["label"] == 7] == [(7, 144, 144.0)]
    assert abs(r[0].confidence - (128 * 0.5 + 1.0) / 144) < 1e-12
    assert vectors.is_simple([(0, 0), (4, 0), (4, 4), (0, 4)]) and not vectors.is_simple([(0, 0), (4, 4), (4, 0), (0, 4)])


def test_areas_clip_by_scene(spark):
    box = lambda x, y, n=1.0: [{"x": x, "y": y}, {"x": x + n, "y": y}, {"x": x + n, "y": y + n}, {"x": x, "y": y + n}]
    f = spark.createDataFrame([(1, 1, box(0.0, 0.0)), (1, 2, box(5.0, 5.0)), (1, 3, box(9.0, 9.0)), (2, 4, box(5.0, 5.0))], "scene int, id int, ring array<struct<x:double,y:double>>")
    areas = spark.createDataFrame([(1, box(0.5, 0.5)), (1, box(5.2, 5.2, 0.1)), (1, None), (3, box(0.0, 0.0))], "scene int, ring array<struct<x:double,y:double>>")
    assert sorted(r.id for r in vectors.within_areas(f, areas, ["scene"]).collect()) == [1, 2, 4]


def test_softmax_and_sigmoid(spark):
    r = spark.range(1).select(scalar.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))).alias("s"), scalar.sigmoid(F.lit(-800.0)).alias("a"), scalar.sigmoid(F.lit(800.0)).alias("b")).first()
    assert r.s == [0.5, 0.5, 0.0] and r.a == 0.0 and r.b == 1.0


def test_temperature_fit_is_no_worse_than_one(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(4)), [(rng.normal(size=4) * 6).tolist(), (rng.normal(size=4) * 6).tolist()]) for _ in range(200)]
    df = spark.createDataFrame(rows, "y_true int, z array<array<double>>").cache()
    t = calibrate.fit(df)
    assert 0.25 <= t <= 4 and calibrate.nll(df, t) <= calibrate.nll(df, 1.0) + 1e-6
    e = calibrate.ece(df.withColumn("p", scalar.softmax(F.element_at("z", 1))), F.col("p")).first()[0]
    assert 0 <= e <= 1


def test_severity_grows_with_both_shares(spark):
    grid_ = [(float(d), float(a)) for d in range(0, 101, 5) for a in range(0, 101, 5)]
    df = spark.createDataFrame(grid_, "d double, a double")
    _, index = model.severity(F.col("d"), F.col("a"))
    got = {(r.d, r.a): r.i for r in df.select("d", "a", index.alias("i")).collect()}
    for (d, a), i in got.items():
        assert got.get((d + 5, a), 4) >= i and got.get((d, a + 5), 4) >= i


def test_statistics_of_nothing_are_zeros(spark):
    df = spark.createDataFrame([], "damage_class int, area double, confidence double")
    r = df.agg(*stats.assessment_columns()).first()
    assert all(v == 0 for v in r)


def test_form_values():
    assert [model.separation_to_distance(v) for v in (0, 50, 100)] == [24, 14, 4]
    assert model.Options(sensitivity=100).min_pixels == 20
    assert model.Options(tta="8").orientations == 8 and model.Options(tta="8", fast=True).orientations == 1
    with pytest.raises(ValueError):
        model.Options(tta="5")


def test_contours_rings_and_hulls(spark):
    square = np.array([(y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)])
    (ring,) = vectors.contour(square[:, 0], square[:, 1])
    assert vectors.area(ring) == 9  # holes are left out
    assert len(vectors.simplified(ring, 0.1)) == 4
    two = np.array([(0, 0), (1, 1)])
    assert len(vectors.contour(two[:, 0], two[:, 1])) == 2
    assert vectors.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    p = vectors.polygons(spark.createDataFrame([(7, y, x) for y in range(6) for x in range(5)], "label long, y int, x int"), 30)
    r = p.select(geo.wkt(F.col("ring")).alias("w"), F.abs(geo.shoelace(F.col("ring"))).alias("a"), "area_px").first()
    assert r.a == r.area_px == 30 and r.w.startswith("POLYGON ((")


def test_phase_correlation_finds_a_shift():
    rng = np.random.default_rng(4)
    a = rng.random((32, 32))
    a = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1)) / 3
    dy, dx, response = registration.phase_shift(a, np.roll(a, (3, -2), (0, 1)))
    assert round(dy) == -3 and round(dx) == 2 and response > 0.05


def test_translation_resamples(spark):
    px = spark.createDataFrame([(y, x, float(x)) for y in range(3) for x in range(5)], "y int, x int, v double")
    got = {(r.y, r.x): r.v for r in grid.translated(px, "v", 0.0, 0.5, 3, 5).collect()}
    assert got[1, 2] == 1.5 and got[1, 0] == 0.0


def markdown_plain(source):
    import re

    out, inside = [], False
    for line in source.split("\n"):
        s = line.strip(" ")
        if s.startswith("- "):
            if not inside:
                out.append("<ul>")
            inside = True
            out.append(f"<li>{s[2:]}</li>")
            continue
        if inside:
            out.append("</ul>")
            inside = False
        for mark, tag in (("### ", "h4"), ("## ", "h3"), ("# ", "h2")):
            if s.startswith(mark):
                out.append(f"<{tag}>{s[len(mark):]}</{tag}>")
                break
        else:
            out.append(f"<p>{s}</p>" if s else "<br>")
    if inside:
        out.append("</ul>")
    html = re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", "\n".join(out))
    return re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<i>\1</i>", html)


def test_markdown(spark, sf):
    cases = ["# A\n## B\n### C\n\n- one\n- **two**\ntext *it*\n- last", "- only", "", "\n\n"]
    cases += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    for r in df.select("i", text.markdown_html(F.col("t")).alias("h")).collect():
        assert r.h == markdown_plain(cases[r.i])


def test_markdown_keeps_digits_and_trims_all_spaces(spark):
    cases = {"0120": "<p>0120</p>", "a\n171\n  2\n3": "<p>a</p>\n<p>171</p>\n<p>2</p>\n<p>3</p>", "\u00a0 a\u3000b \u2003": "<p>a\u3000b</p>", "a \r": "<p>a \r</p>", "**a\r\u2028b**": "<p><b>a\r\u2028b</b></p>", " \n- 1\n - 2 ": "<br>\n<ul>\n<li>1</li>\n<li>2</li>\n</ul>"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.h for r in df.select("t", text.markdown_html(F.col("t")).alias("h")).collect()} == cases


def test_names(spark):
    cases = {"/a/b/x_post_disaster.tif|layer=1": "x", "c:\\d\\y-post.png": "y", "z_post": "z", "plain.tar.gz": "plain.tar"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", text.stem(F.col("s")).alias("n")).collect()} == cases
    r = spark.range(1).select(text.sanitize(F.lit('a<b>:"c\n')).alias("a"), text.sanitize(F.lit("  ")).alias("b")).first()
    assert r.a == "a_b___c_" and r.b == "damage_assessment"


def test_grids_alike_without_a_crs(spark):
    s = "struct<crs:string,xmin:double,ymin:double,xmax:double,ymax:double,width:int,height:int>"
    one = ("E", 0.0, 0.0, 10.0, 10.0, 10, 10)
    rows = [(one, one), (one, (None, 5.0, 0.0, 15.0, 10.0, 10, 10)), (one, ("E", 0.6, 0.0, 10.6, 10.0, 10, 10)), (one, ("E", 0.4, 0.0, 10.4, 10.0, 10, 10)), (one, ("F", *one[1:]))]
    df = spark.createDataFrame(rows, f"a {s}, b {s}")
    assert [r[0] for r in df.select(registration.grids_alike("a", "b")).collect()] == [True, True, False, True, False]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b', 2.5), (2, None, 3.0)], "id int, name string, area double")
    sinks.write_csv(rows, str(tmp_path / "csv"), ["made by a test", "second line"])
    lines = "\n".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))).split("\n")
    assert "# made by a test" in lines and "id,name,area" in lines and '1,"a ""q"", b",2.5' in lines and "2,,3.0" in lines
    path = str(tmp_path / "out.gpkg")
    for _ in range(2):
        sinks.write_gpkg(rows, path)
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*) FROM damage_buildings").fetchone() == (2,)
    done = sinks.export_all({"good": lambda: None, "bad": lambda: 1 / 0})
    assert done["good"] == "ok" and "division" in done["bad"]
    assert json.loads(sinks.mask_metadata())["classes"]["4"] == "Destroyed"
    sinks.write_layer(rows, str(tmp_path / "layer"), "damage_view")
    assert spark.table("damage_view").count() == 2


def test_calibration_file_is_read_within_bounds(spark, tmp_path):
    for i, (t, want) in enumerate(((1.7, 1.7), (11.0, 1.0), ("x", 1.0))):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps({"cls_temperature": t, "other": 1}, indent=1))
        assert files.read_temperature(spark, str(p)) == want


def test_rasters_listing_and_digests(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# c\n3 2\n255\n" + bytes(range(6)))
    (tmp_path / "b.ppm").write_bytes(b"P6 2 1 255\n" + bytes([1, 2, 3, 4, 5, 6]))
    got = {(r.path[-5:], r.band, r.y, r.x): r.v for r in files.read_pgm(spark, str(tmp_path)).collect()}
    assert len(got) == 24 and got["a.pgm", 2, 1, 2] == 5 and got["b.ppm", 2, 0, 1] == 6
    assert files.listing(spark, str(tmp_path), "*.pgm").count() == 1
    f = spark.createDataFrame([("n", bytearray(b"abc"))], "name string, content binary")
    d = spark.createDataFrame([("n", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD")], "name string, sha256 string")
    assert files.checked(f, d).first().ok


def test_tiles_wrap_and_stay_in_the_world(spark):
    r = spark.createDataFrame([(1, 1, 80.0, 179.0, 1024, 1024)], "request_id int, zoom int, lat double, lon double, width int, height int")
    got = imagery.request_grid(r, "streets").collect()
    assert all(0 <= g.tx < 2 and 0 <= g.ty < 2 for g in got) and any(g.url.endswith(".png") for g in got)
    lines = imagery.with_world_file(r).first().world_file.split("\n")
    assert len(lines) == 6 and float(lines[0]) == -float(lines[3])


def test_aoi_semi_join_keeps_whole_features(spark):
    f = spark.createDataFrame([(i, float(i), 0.0, i + 1.0, 1.0) for i in range(10)], "id int, xmin double, ymin double, xmax double, ymax double")
    a = spark.createDataFrame([(2.5, 0.0, 3.5, 1.0), (3.0, 0.0, 3.2, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    assert sorted(r.id for r in vectors.aoi_filter(f, a).collect()) == [2, 3]
    assert vectors.aoi_filter(f, a.limit(0)).count() == 10


def test_first_local_maxima_tie(spark):
    px = spark.createDataFrame([(0, x, v) for x, v in enumerate((1.0, 3.0, 3.0, 0.0, 2.0))], "y int, x int, v double")
    assert sorted(r.x for r in masks.local_maxima(px, "v", 1).collect()) == [1, 2, 4]


def test_all_products_of_padding(spark):
    for n, i in itertools.product((3, 5), range(-2, 7)):
        got = spark.range(1).select(scalar.reflect(F.lit(i), n)).first()[0]
        assert got == (-i if i < 0 else 2 * (n - 1) - i if i >= n else i)


def test_png_round_trip_and_filters(spark, tmp_path):
    import struct
    import zlib

    from tileframe.sources import png

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        a = rng.integers(0, 256, (5, 7, n), np.uint8)
        assert (png.decode(png.encode(a)) == a).all()
    a = rng.integers(0, 256, (6, 4, 3), np.uint8)
    flat = a.reshape(6, 12).astype(int)
    lines = []
    for y in range(6):  # every filter, made by the formulas
        up, row, kind = (flat[y - 1] if y else flat[y] * 0), flat[y], y % 5
        left = np.r_[np.zeros(3, int), row[:-3]]
        corner = np.r_[np.zeros(3, int), up[:-3]]
        p = left + up - corner
        paeth = [min((abs(q - i), 0, i), (abs(q - j), 1, j), (abs(q - k), 2, k))[2] for q, i, j, k in zip(p, left, up, corner, strict=True)]
        guess = (0 * row, left, up, (left + up) // 2, np.array(paeth))[kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    whole = png.encode(a)
    at = whole.index(b"IDAT") - 4
    size = struct.unpack(">I", whole[at : at + 4])[0]
    body = zlib.compress(b"".join(lines))
    forged = whole[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + whole[at + 12 + size :]
    assert (png.decode(forged) == a).all()
    (tmp_path / "a.png").write_bytes(forged)
    got = {(r.band, r.y, r.x): r.v for r in png.read_png(spark, str(tmp_path)).collect()}
    assert got == {(k, y, x): int(a[y, x, k]) for k in range(3) for y in range(6) for x in range(4)}
    t = spark.createDataFrame([(0, 1, list(range(16)))], "ty int, tx int, values array<int>")
    assert png.decode(png.tiles_as_png(t, 4).first().png).ravel().tolist() == list(range(16))
    with pytest.raises(ValueError):
        png.decode(b"no")


def test_distances_in_a_scene_with_gaps(spark):
    rng = np.random.default_rng(4)
    kind = rng.choice(3, (9, 12), p=[0.2, 0.1, 0.7])  # a gap, background, mask
    kind[8, 3:] = 0
    frame = lambda k: spark.createDataFrame([(int(y), int(x)) for y, x in np.argwhere(kind == k)], "y int, x int")
    got, off = masks.distances(frame(2), 9, 12, background=frame(1)).collect(), np.argwhere(kind == 1)
    assert sorted((r.y, r.x) for r in got) == sorted(map(tuple, np.argwhere(kind == 2).tolist()))
    for r in got:
        assert abs(r.distance - math.sqrt(((off - (r.y, r.x)) ** 2).sum(1).min())) < 1e-12


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    """A scene of 45 chips, so its last row of chips has gaps, with every other chip below the threshold in part."""
    folder = tmp_path_factory.mktemp("ragged")
    rng = np.random.default_rng(8)
    chips = [(i, rng.normal(0.1, 0.3, 64).tolist()) for i in range(45)]
    chips[21] = (21, [None if k == 9 else 1.0 if k // 8 in (0, 7) or k % 8 in (0, 7) else -1.0 for k in range(64)])
    spark.createDataFrame(chips, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["distance_transform", "fill_holes"])
def test_scenes_with_gaps_against_sql(spark, ragged, name):
    import duckdb

    from tileframe import catalog

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{ragged}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.queries()[name](spark, ragged).collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_filled_holes(spark):
    closed, open_ = ["#####", "#...#", "#.#.#", "#...#", "#####"], ["#####", "#...#", "#.#.#", "#...#", "###.#"]
    assert picture_of(masks.filled(mask_of(spark, closed), 5, 5), 5, 5) == ["#####"] * 5
    assert picture_of(masks.filled(mask_of(spark, open_), 5, 5), 5, 5) == open_


def test_ring_predicates(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = ring((0, 0), (4, 0), (4, 4), (0, 4))
    cases = [(ring((1, 1), (2, 1), (2, 2)), True), (ring((3, 3), (6, 3), (6, 6)), True), (ring((5, 5), (6, 5), (6, 6)), False), (ring((4, 0), (8, 0), (8, 4)), True), (ring((-9, -9), (20, -9), (20, 20), (-9, 20)), True), (ring((5, -1), (9, 3), (9, -1)), False)]
    t = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, square, r) for i, (r, _) in enumerate(cases)], f"i int, a {t}, b {t}")
    for r in df.select("i", geo.rings_intersect(F.col("a"), F.col("b")).alias("m"), geo.rings_intersect(F.col("b"), F.col("a")).alias("n")).collect():
        assert r.m == r.n == cases[r.i][1], r.i


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(-170.0, -80.0), (0.0, 0.0), (12.5, 47.25)], "lon double, lat double")
    x, y = geo.from_lonlat(F.col("lon"), F.col("lat"))
    df = df.withColumns({"x": x, "y": y})
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.lon - r.a) < 1e-9 and abs(r.lat - r.b) < 1e-9


def test_sql_names(spark, sf):
    from tileframe.plans.sql import register

    register(spark, sf)
    assert spark.sql("SELECT count(*) FROM tile_origins(200, 160, 64, 8)").first()[0] == 12
    assert spark.sql("SELECT max(damage_class) FROM buildings JOIN damage_classes USING (damage_class)").first()[0] == 4


def test_a_run_can_be_cancelled(spark):
    import time

    from tileframe.streaming.control import Cancelled, cancellable

    assert cancellable(spark, lambda: spark.range(5).count(), lambda: False) == 5
    began = time.time()
    slow = lambda: spark.range(400).repartition(400).mapInPandas(lambda it: (time.sleep(1) or f for f in it), "id long").count()
    with pytest.raises(Cancelled):
        cancellable(spark, slow, lambda: time.time() - began > 3)
    assert time.time() - began < 60


@pytest.mark.parametrize("shape", [(5, 7, 1), (300, 260, 3), (256, 512, 1)])
def test_tiff_round_trip(shape):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 255, shape).astype(np.uint8)
    raw = tiff.encode(px, 500.0, 900.0, 0.5, 0.25, 32610, 0, {"CLASS_1": "No Damage"})
    got, where = tiff.decode(raw)
    assert (got == px).all() and where == {"xmin": 500.0, "ymax": 900.0, "px_w": 0.5, "px_h": 0.25, "epsg": 32610}
    assert b"CLASS_1" in raw and tiff.tags_of(raw)[1][tiff.NODATA] == ("0",)
    assert tiff.decode(tiff.encode(px))[1]["xmin"] is None


def lzw(data):
    """Codes of a fresh table each 200 bytes, so only 9 bits are needed."""
    codes = []
    for i in range(0, len(data), 200):
        codes += [256, *data[i : i + 200]]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_tiff_of_other_writers():
    import struct

    px = np.arange(600, dtype=">u2").reshape(20, 30)
    body = lzw(px.tobytes())
    fields = [(256, 3, 30), (257, 3, 20), (258, 3, 16), (259, 3, 5), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 20), (279, 4, len(body))]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0" * 4
    got, _ = tiff.decode(struct.pack(">2sHI", b"MM", 42, 8 + len(body)) + body + ifd)
    assert (got[:, :, 0] == px).all()
    repeated = b"abababababab" * 30
    assert tiff.unlzw(lzw(repeated)) == repeated
    with pytest.raises(ValueError):
        tiff.decode(b"no raster at all")


def test_rasters_to_masks_end_to_end(spark, tmp_path):
    pre, post = np.zeros((40, 50, 1), np.uint8), np.zeros((40, 50, 1), np.uint8)
    pre[4:14, 6:16], post[4:14, 6:16] = 230, 230
    pre[20:32, 30:44] = 230
    for name, px in (("pre", pre), ("post", post)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.tif").write_bytes(tiff.encode(px, 100.0, 200.0, 0.5, 0.5, 32610))
    read = lambda name: tiff.read_tiff(spark, str(tmp_path / name)).where("band = 0").select(F.lit("a").alias("scene"), "y", "x", (F.col("v") / 255).alias(name))
    scenes = tiff.scenes_of(spark, str(tmp_path / "pre")).withColumn("scene", F.lit("a"))
    found = detect(read("pre").join(read("post"), ["scene", "y", "x"]), scenes, model.Options(tile=32, overlap=8, sensitivity=60, register=False)).collect()
    assert sorted((r.damage_class, r.area) for r in found) == [(1, 25.0), (4, 42.0)]
    painted = spark.createDataFrame([("a", y, x, 4) for y in range(20, 32) for x in range(30, 44)], "scene string, y int, x int, damage_class int")
    mask, where = tiff.decode(bytes(tiff.masks_as_tiff(painted, scenes).first().tiff))
    assert mask[:, :, 0].sum() == 4 * 12 * 14 and (mask[20:32, 30:44] == 4).all() and where["epsg"] == 32610
    assert list(tiff.read_tiff(spark, str(tmp_path / "pre")).groupBy("band").count().orderBy("band").toPandas()["count"]) == [2000] * 3


def test_percentiles_stretch_each_scene(spark):
    from tileframe.plans.detect import stretched

    rows = [(s, 0, x, float(x * (1 + s)), float(x)) for s in (0, 1) for x in range(101)]
    got = {(r.scene, r.x): r.pre for r in stretched(spark.createDataFrame(rows, "scene int, y int, x int, pre double, post double")).collect()}
    for s in (0, 1):
        assert got[s, 0] == 0 and got[s, 100] == 255 and got[s, 50] == int((50 - 2) / 96 * 255 - 1e-4)


def test_geopackage_has_geometry(spark, tmp_path):
    import sqlite3
    import struct

    ring = [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 2.0}, {"x": 3.0, "y": 5.0}]
    path = str(tmp_path / "g.gpkg")
    sinks.write_gpkg(spark.createDataFrame([(7, "Minor Damage", ring)], "id int, damage_name string, ring array<struct<x:double,y:double>>"), path, 32610)
    with sqlite3.connect(path) as db:
        geom, n, name = db.execute("SELECT geom, id, damage_name FROM damage_buildings").fetchone()
        assert geom[:4] == b"GP\0\x03" and struct.unpack("<idddd", geom[4:40]) == (32610, 1.0, 3.0, 2.0, 5.0) and (n, name) == (7, "Minor Damage")
        assert struct.unpack("<BIII", geom[40:53]) == (1, 3, 1, 4) and struct.unpack("<8d", geom[53:]) == (1.0, 2.0, 3.0, 2.0, 3.0, 5.0, 1.0, 2.0)
        assert db.execute("SELECT data_type, min_x, max_y, srs_id FROM gpkg_contents").fetchone() == ("features", 1.0, 5.0, 32610)
        assert db.execute("SELECT column_name, geometry_type_name FROM gpkg_geometry_columns").fetchone() == ("geom", "POLYGON")
        assert {r[0] for r in db.execute("SELECT srs_id FROM gpkg_spatial_ref_sys")} == {-1, 0, 4326, 32610}


def test_reports_are_written(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("<html>\n</html>",)], "report string"), "report", str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_pdf_and_output_paths(tmp_path):
    sinks.write_pdf("A title (draft)\n" + "word " * 2000 + "\nend", str(tmp_path / "r.pdf"), lines=20)
    raw = (tmp_path / "r.pdf").read_bytes()
    assert raw.startswith(b"%PDF-1.4") and rb"A title \(draft\)" in raw and raw.count(b"/Type /Page ") > 3
    at = int(raw.rsplit(b"startxref\n", 1)[1].split()[0])
    assert raw[at : at + 4] == b"xref" and all(raw[int(line.split()[0]) :].split(b" ")[0] == b"%d" % (k + 1) for k, line in enumerate(raw[at:].split(b"\n")[3 : 3 + raw.count(b" obj\n")]))
    got = sinks.output_paths(str(tmp_path / "out"), "a/b:c", {"csv": ".csv", "mask": "_mask.tif"})
    assert got == {"csv": str(tmp_path / "out" / "a_b_c.csv"), "mask": str(tmp_path / "out" / "a_b_c_mask.tif")}
    (tmp_path / "file").write_text("")
    assert sinks.output_paths(str(tmp_path / "file" / "x"), "", {"csv": ".csv"}, str(tmp_path))["csv"] == str(tmp_path / "damage_assessment.csv")


def test_download_is_whole_or_not_there(tmp_path):
    import hashlib
    import io

    data, told = bytes(range(256)) * 4000, []
    path = str(tmp_path / "model.onnx")
    with pytest.raises(ValueError):
        files.download(io.BytesIO(data), path, "0" * 64)
    assert not list(tmp_path.iterdir())
    files.download(io.BytesIO(data), path, hashlib.sha256(data).hexdigest().upper(), len(data), told.append, piece=50_000)
    assert told == list(range(10, 101, 10)) and (tmp_path / "model.onnx").read_bytes() == data and len(list(tmp_path.iterdir())) == 1


def test_signals_and_memory():
    from tileframe.streaming.control import MemoryMeter, Signals

    seen = []
    s = Signals(*(lambda v, n=n: seen.append((n, v)) for n in ("progress", "log", "finished", "error")))
    assert s.run([("a", lambda: 1), ("b", lambda: 2)]) == 2
    assert seen == [("log", "a"), ("progress", 50), ("log", "b"), ("progress", 100), ("finished", 2)]
    assert s.run([("c", lambda: 1 / 0), ("d", lambda: 2)]) is None and seen[-1] == ("error", "c: division by zero")
    at = iter([100.0, 130.0, 80.0])
    m = MemoryMeter(lambda: next(at))
    assert (m.added_mb(), m.added_mb()) == (30.0, 0.0) and MemoryMeter().added_mb() >= 0


def test_areas_are_reprojected(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 50.0), (11.0, 50.0), (11.0, 51.0))))
    r = spark.range(1).select(geo.reprojected(ring, F.lit("EPSG:4326"), F.lit("EPSG:3857")).alias("m"), geo.reprojected(ring, F.lit("EPSG:1"), F.lit("EPSG:3857")).alias("n"), geo.reprojected(ring, F.lit("EPSG:1"), F.lit("EPSG:1")).alias("s"))
    got = r.withColumn("back", geo.reprojected(F.col("m"), F.lit("EPSG:3857"), F.lit("EPSG:4326"))).first()
    assert abs(got.m[0].x - 1113194.9) < 1 and got.n is None and got.s[0].x == 10.0 and abs(got.back[2].y - 51.0) < 1e-6


def test_options_from_text():
    o = model.Options.of({"tile": "256", "tta": " 8 ", "fast": "no", "register": "off", "temperature": "99", "loc_threshold": -1, "upgrade_rules": ((2, 3, 0.5),)})
    assert (o.tile, o.orientations, o.fast, o.register, o.temperature, o.loc_threshold, o.upgrade_rules) == (256, 8, False, False, 10.0, 0.0, ((2, 3, 0.5),))
    with pytest.raises(ValueError):
        model.Options.of({"no_such": 1})


def test_algorithms_by_id_follow_each_other(spark):
    from tileframe.plans.sql import run_algorithm

    px, dims, _ = two_scenes(spark, [(30, 41)])
    px.createOrReplaceTempView("some_pixels")
    dims.createOrReplaceTempView("some_scenes")
    run_algorithm(spark, "tileframe:detect", {"pixels": "some_pixels", "scenes": "some_scenes", "tile": "32", "overlap": "8", "sensitivity": 60, "min_distance": 2, "register": "off"}, "found")
    got = run_algorithm(spark, "tileframe:assess", {"buildings": "found", "by": ["scene"]}).first()
    assert got.total_buildings == spark.table("found").count() == 6 and got.severity in [t[0] for t in model.TIERS]
    with pytest.raises(ValueError):
        run_algorithm(spark, "tileframe:nothing", {})


def test_areas_and_layers_are_read_by_name(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": None}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    got = files.read_areas(spark, str(tmp_path / "a.geojson")).collect()
    assert [(r.area, r.crs, [(p.x, p.y) for p in r.ring]) for r in got] == [(0, "EPSG:3857", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])]
    sinks.write_layer(spark.createDataFrame([(1, 2, 3.0)], "id int, damage_class int, area_m2 double"), str(tmp_path / "l"), "damage_1")
    assert sinks.read_layer(spark, "damage_1").count() == 1
    spark.range(1).createOrReplaceTempView("other")
    with pytest.raises(ValueError):
        sinks.read_layer(spark, "other")


def tiny_onnx(weight, bias):
    """A network of one 1 x 1 convolution from `input` to `logits`, as the bytes of an ONNX file."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, value):
        return varint(k << 3) + varint(value) if isinstance(value, int) else varint(k << 3 | 2) + varint(len(value)) + value

    def tensor(name, a):
        return b"".join(field(1, n) for n in a.shape) + field(2, 1) + field(8, name) + field(9, a.astype("<f4").tobytes())

    def value(name, channels):
        dims = [field(2, b"n"), field(1, channels), field(2, b"h"), field(2, b"w")]
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, b"".join(field(1, d) for d in dims))))

    node = field(1, b"input") + field(1, b"w") + field(1, b"b") + field(2, b"logits") + field(4, b"Conv")
    graph = field(1, node) + field(2, b"g") + field(5, tensor(b"w", weight)) + field(5, tensor(b"b", bias)) + field(11, value(b"input", weight.shape[1])) + field(12, value(b"logits", weight.shape[0]))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_onnx_sessions_are_run(spark, tmp_path):
    from tileframe.operators.scorer import onnx_scorer

    pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(6)
    shapes = [(1, 3), (4, 6), (4, 6)]
    weights = [(rng.normal(size=(*s, 1, 1)), rng.normal(size=s[0])) for s in shapes]
    paths = []
    for k, (w, b) in enumerate(weights):
        (tmp_path / f"{k}.onnx").write_bytes(tiny_onnx(w, b))
        paths.append(str(tmp_path / f"{k}.onnx"))
    pre, post = rng.random((2, 8, 8)) * 255, rng.random((2, 8, 8)) * 255
    loc, members = onnx_scorer(paths)()(pre, post)
    mean, std = (np.array(v)[:, None, None] for v in (model.IMAGENET_MEAN, model.IMAGENET_STD))
    x, y = ((np.repeat(v[:, None], 3, 1) / 255 - mean) / std for v in (pre, post))
    through = lambda k, v: np.einsum("oi,nihw->nohw", weights[k][0][:, :, 0, 0], v) + weights[k][1][:, None, None]
    assert np.allclose(loc, through(0, x)[:, 0], atol=1e-4)
    assert all(np.allclose(m, through(1 + k, np.concatenate([x, y], 1)), atol=1e-4) for k, m in enumerate(members))
    tiles = spark.createDataFrame([(1, pre[0].ravel().tolist(), post[0].ravel().tolist())], "k int, pre array<double>, post array<double>")
    got = {(r.y, r.x): r.p for r in predict_tiles(tiles, 8, onnx_scorer(paths), multiple=4).collect()}
    assert len(got) == 64 and abs(got[0, 0][0] - 1 / (1 + math.exp(float(loc[0, 0, 0])))) < 1e-6


def test_intermediate_tables_can_be_given_back(spark, monkeypatch):
    import os

    from tileframe import storage

    monkeypatch.setattr(storage, "MADE", [])
    assert graph.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3
    (folder,) = storage.MADE
    assert os.path.isdir(folder) and storage.release(spark) == 1 and not os.path.isdir(folder) and not storage.MADE
