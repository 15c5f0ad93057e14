"""Operators, kernels and sources against brute force and known cases."""

import io
import math
import random
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxmill.operators import graph, grid, kernels, labels, learned, metrics, skeleton
from voxmill.operators import agglomerate as A
from voxmill.operators import neighbours as N
from voxmill.sources import blocks, codecs
from voxmill.streaming import ingest


def volume(spark, cube, name="label"):
    rows = [(int(x), int(y), int(z), int(cube[z, y, x])) for z, y, x in np.argwhere(np.ones(cube.shape, bool))]
    return spark.createDataFrame(rows, f"x long, y long, z long, {name} long")


def cube_of(df, shape, name="label"):
    out = np.zeros(shape, np.int64)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


def test_path_length_known_case(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 1, 1), (0, 1, 1, 1, 3), (0, 2, 1, 2, 1)], "tree long, node long, x int, y int, z int")
    edges = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "tree long, src long, dst long")
    cube = np.ones((5, 5, 5), int)
    cube[:, 1:, :] = 2
    placed = skeleton.node_labels(nodes, volume(spark, cube), (1, 1, 1), (5, 5, 5))
    assert skeleton.path_length(skeleton.labelled_edges(placed, edges)).first().eftpl == pytest.approx(2 / 3)


def test_path_length_keeps_trees_apart(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 1, 1), (0, 1, 1, 1, 2), (1, 0, 2, 1, 1), (1, 1, 3, 1, 1), (1, 2, 30, 1, 1)], "tree long, node long, x int, y int, z int")
    edges = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 1, 2)], "tree long, src long, dst long")
    placed = skeleton.node_labels(nodes, volume(spark, np.ones((5, 5, 5), int)), (1, 1, 1), (5, 5, 5))
    made = skeleton.labelled_edges(placed, edges)
    assert made.count() == 2 and skeleton.path_length(made).first().eftpl == 0.0


@pytest.mark.parametrize("per_task", [5, 10**6])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", per_task)
    rng = random.Random(per_task)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7000, 7000)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges + [(None, 3)], "src long, dst long")).collect()}
    up = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([6, 18, 26]))
def test_kernel_components_match_flood_fill(seed, connectivity):
    cube = np.random.default_rng(seed).random((4, 5, 6)) < 0.4
    got, seen, count = kernels.components(cube, connectivity), np.zeros(cube.shape, int), 0
    for at in map(tuple, np.argwhere(cube)):
        if not seen[at]:
            count += 1
            stack = [at]
            while stack:
                p = stack.pop()
                if all(0 <= c < n for c, n in zip(p, cube.shape)) and cube[p] and not seen[p]:
                    seen[p] = count
                    stack += [tuple(a + b for a, b in zip(p, d)) for d in N.offsets(connectivity, False)]
    assert (got == seen).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_kernel_nearest_fill(seed):
    cube = np.random.default_rng(seed).integers(0, 12, (4, 5, 3))
    cube[cube > 3] = 0
    scale = (3.0, 1.0, 1.0)
    got, fore = kernels.nearest_fill(cube, scale), np.argwhere(cube)
    for at in np.argwhere(np.ones(cube.shape, bool)):
        if cube[tuple(at)] == 0 and len(fore):
            d = (((fore - at) * scale) ** 2).sum(1)
            assert got[tuple(at)] == min(cube[tuple(f)] for f in fore[d == d.min()])


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_warp_keeps_topology(seed):
    rng = np.random.default_rng(seed)
    image, target = np.zeros((6, 6, 6), bool), np.zeros((6, 6, 6), bool)
    image[2:4, 2:4, 2:4] = True
    target[1:5, 1:5, 1:5] = rng.random((4, 4, 4)) < 0.8
    out = kernels.warp(image, target)
    assert kernels.components(out, 26).max() == 1 and kernels.components(~np.pad(out, 1), 6).max() == 1
    assert (out != target).sum() <= (image != target).sum()
    assert kernels.warping_error(target, target) == (0.0, 0, 0)


def test_simple_points():
    assert not kernels.is_simple(0) and not kernels.is_simple((1 << 27) - 1)
    alone = 1 << 13
    assert not kernels.is_simple(alone) and kernels.is_simple(alone | 1 << 14)
    assert not kernels.is_simple(1 << 12 | 1 << 14)  # would join two objects


def test_fill_cavities_and_smoothing():
    shell = np.ones((9, 9, 9), int)
    shell[0], shell[:, 0], shell[:, :, 0], shell[-1], shell[:, -1], shell[:, :, -1] = (0,) * 6
    shell[3:6, 3:6, 3:6] = 0
    filled = kernels.fill_cavities(shell)
    assert filled[4, 4, 4] == 1 and filled[4, 0, 0] == 0
    assert kernels.smoothed_labels(filled, 0.8)[4, 4, 4] == 1


def test_filters():
    rng = np.random.default_rng(0)
    v = rng.random((3, 12, 12))
    assert kernels.gaussian(np.ones((4, 4, 4)), 1.0) == pytest.approx(np.ones((4, 4, 4)))
    assert kernels.kuwahara(np.full((2, 6, 6), 3.0)) == pytest.approx(np.full((2, 6, 6), 3.0))
    t = v[0][3:7, 2:6]
    made = kernels.normalised_correlation(v[0], t)
    assert made.shape == (9, 9) and made[3, 2] == pytest.approx(1.0) and np.abs(made).max() <= 1 + 1e-9
    w = v[0][1:5, 5:9]
    want = ((w - w.mean()) * (t - t.mean())).sum() / math.sqrt(((w - w.mean()) ** 2).sum() * ((t - t.mean()) ** 2).sum())
    assert made[1, 5] == pytest.approx(want)
    cost = np.ones((1, 5, 5))
    cost[0, 2, 1:4] = 50
    assert kernels.geodesic_overlay(cost, (0, 0, 2), (0, 4, 2))[0, 2, 0]
    colours = kernels.greedy_colours([(1, 2), (2, 3), (1, 3), (3, 4)], [1, 2, 3, 4, 5])
    assert len({colours[1], colours[2], colours[3]}) == 3 and colours[4] != colours[3]


def test_block_components_far_blocks_stay_apart(spark):
    rows = [(x, y, z, 1) for x in (0, 4 * 8192) for y in (0, -4 * 8192) for z in (0, 4 * 8192, 4 * 65536)]
    df = spark.createDataFrame(rows, "x int, y int, z int, label int")
    got = {(r.x, r.y, r.z): r.component for r in kernels.block_components(df, 4).collect()}
    assert got == {(x, y, z): (z * 32769 + y + 32768) * 32769 + x + 1 for x, y, z, _ in rows}
    assert kernels.block_components(df.where("label = 0"), 4).count() == 0


def test_block_components_match_whole(spark):
    cube = np.random.default_rng(5).integers(0, 3, (7, 9, 8))
    got = {(r.z, r.y, r.x): r.component for r in kernels.block_components(volume(spark, cube), 4).collect()}
    whole = kernels.components(cube != 0, 6, cube)
    assert len(got) == (cube != 0).sum()
    names = {}
    for at, name in got.items():
        assert names.setdefault(name, whole[at]) == whole[at]
    assert len(names) == whole.max()


def test_over_blocks_matches_whole(spark):
    cube = np.random.default_rng(6).integers(0, 9, (6, 7, 9))
    got = cube_of(kernels.over_blocks(volume(spark, cube, "v"), lambda c: np.where(c > 4, c, 0), 4, 1, "v"), cube.shape, "v")
    assert (got == np.where(cube > 4, cube, 0)).all()


def test_cut_steps_separate_labels(spark):
    cube = np.random.default_rng(7).integers(0, 3, (5, 5, 5))
    out = cube_of(N.adjacency_removed(volume(spark, cube)), cube.shape)
    assert len(N.CUT_STEPS) == 17
    for d in N.offsets(26):
        a, b = kernels._views(out, d)
        assert not ((a != 0) & (b != 0) & (a != b)).any()


def test_majority_and_overlap_ties(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 2, 6), (2, 9, 7), (3, 1, 0)], "label long, type int, other long")
    assert {r.label: r.major_type for r in labels.majority_type(rows, 3).collect()} == {1: 2, 2: 2, 3: 1}
    assert {r.label: r.best for r in labels.best_overlap(rows, "label", "other").collect()} == {1: 5, 2: 7, 3: -1}


def test_relabel_is_idempotent(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 9, 9, 70000, 3, 200000, 0])], "i long, label long")
    once = labels.sequential_relabel(df)
    assert {r.i: r.label for r in once.collect()} == {0: 0, 1: 2, 2: 2, 3: 3, 4: 1, 5: 4, 6: 0}
    assert sorted(map(tuple, labels.sequential_relabel(once).collect())) == sorted(map(tuple, once.collect()))


def test_identical_labellings_have_no_error(spark):
    df = spark.createDataFrame([(i % 7, i % 7) for i in range(70)], "a long, b long")
    r = metrics.rand_metrics(metrics.contingency(df, "a", "b")).first()
    assert r.are == pytest.approx(0) and r.rand_index == pytest.approx(1) and r.adjusted_rand == pytest.approx(1)


def test_superchunk_checks(spark):
    with pytest.raises(ValueError):
        grid.superchunks(spark, (0, 0, 0), (3, 2, 2), (2, 1, 1))
    made = grid.superchunks(spark, (0, 0, 0), (2, 2, 2), (1, 1, 1), left=(10, 0, 0), right=(0, 5, 0))
    assert made.count() == 3 * 3 * 2
    line = grid.commands(grid.with_modulators(made, (2, 2, 2)), "run {suffix} --chunk {chunk}").orderBy("ix", "iy", "iz").first().command
    assert line.startswith("run _x") and "--chunk -1 0 0" in line


def test_stitched_equals_whole(spark):
    vox = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (3, None), (None, 8), (0, 9), (4, 0)], "first long, second long")
    got = {(r.volume, r.old): r.new for r in A.stitched(vox).collect()}
    assert got[(1, 1)] == got[(2, 5)] == got[(1, 2)] == 1 and got[(1, 3)] == 3 and got[(1, 4)] == 4 and len({got[(2, 8)], got[(2, 9)]}) == 2


def test_appended_labels(spark):
    mapping = spark.createDataFrame([(5, 1), (6, 1)], "old long, new long")
    labels_ = spark.createDataFrame([(5,), (9,), (7,), (0,)], "label long")
    assert sorted(map(tuple, A.appended(mapping, labels_).collect())) == [(5, 1), (6, 1), (7, 2), (9, 3)]


def test_block_store(spark, tmp_path):
    path = str(tmp_path)
    cube = np.random.default_rng(1).integers(0, 200, (5, 6, 9))
    vox = volume(spark, cube, "v")
    blocks.write_dataset(blocks.to_blocks(vox, "v", "uint8", 4), path, "raw")
    blocks.write_meta(spark, path, "raw", {"scale": [1, 1, 3], "note": "n"})
    back = blocks.to_voxels(blocks.read_dataset(spark, path, "raw", chunk=4), 4, "v", out="long").join(vox.select("x", "y", "z"), ["x", "y", "z"], "left_semi")
    assert (cube_of(back, cube.shape, "v") == cube).all()
    assert blocks.read_dataset(spark, path, "raw", low=(0, 0, 0), high=(4, 4, 4), chunk=4).count() == 1
    blocks.upsert(spark, path, "raw", spark.createDataFrame([(1, 2, 3, 250)], "x long, y long, z long, v long"), "v", "uint8", 1, chunk=4)
    again = cube_of(blocks.to_voxels(blocks.read_dataset(spark, path, "raw", chunk=4), 4, "v", out="long").join(vox.select("x", "y", "z"), ["x", "y", "z"], "left_semi"), cube.shape, "v")
    assert again[3, 2, 1] == 250 and (again != cube).sum() == 1
    assert blocks.read_meta(spark, path, "raw")["scale"] == [1, 1, 3] and blocks.read_meta(spark, path, "other")["scale"] == [1, 1, 3]
    assert blocks.listing(spark, path).first().n_blocks == 12
    with pytest.raises(Exception, match="hold"):
        blocks.to_blocks(vox.withColumn("v", F.lit(300)), "v", "uint8", 4).count()
    swapped = blocks.resliced(blocks.resliced(vox, "xzy"), "xzy")
    assert sorted(map(tuple, swapped.collect())) == sorted(map(tuple, vox.collect()))


def test_stream_of_blocks(spark, tmp_path):
    cube = np.arange(27).reshape(3, 3, 3)
    made = blocks.to_blocks(volume(spark, cube, "v"), "v", "int16", 2)
    made.write.parquet(f"{tmp_path}/in")
    ingest.watch(spark, f"{tmp_path}/in", f"{tmp_path}/store", "raw", f"{tmp_path}/ck").awaitTermination()
    assert blocks.read_dataset(spark, f"{tmp_path}/store", "raw", chunk=2).count() == 8


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int16, np.float32])
def test_volume_codecs(kind):
    cube = np.random.default_rng(2).integers(0, 100, (3, 4, 5)).astype(kind)
    assert (codecs.read_nrrd(codecs.write_nrrd(cube)) == cube).all() and (codecs.read_gipl(codecs.write_gipl(cube)) == cube).all()
    for big in (False, True):
        assert (codecs.read_raw(codecs.write_raw(cube, big), (5, 4, 3), np.dtype(kind).name, big) == cube).all()


def test_export_transforms():
    cube = np.arange(27, dtype=np.uint16).reshape(3, 3, 3)
    assert codecs.exported(cube * 0) is None and codecs.exported(cube, pad=1).shape == (5, 5, 5)
    assert codecs.exported(cube, zero_corners=True)[2, 2, 2] == 0 and codecs.exported(cube, colours=5).max() == 5
    assert codecs.exported(cube, equal=4).sum() == 1 and codecs.exported(cube, above=20, fill=26).sum() == 5
    assert codecs.exported(cube, gray_to="uint8").max() == 255 and codecs.write_png(cube[0])[:4] == b"\x89PNG"


def test_nml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 4, 2, 1, 1), (1, 5, 3, 1, 1), (2, 4, 9, 8, 7)], "tree long, node long, x int, y int, z int")
    edges = spark.createDataFrame([(1, 4, 5)], "tree long, src long, dst long")
    text = codecs.nml_frame([r.value for r in codecs.write_nml(nodes, edges).collect()], (1.0, 1.0, 3.0))
    (tmp_path / "a.nml").write_text(text)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a.nml")
    n, e, p = codecs.read_nml(files)
    assert sorted(map(tuple, n.drop("file").collect())) == sorted(map(tuple, nodes.collect()))
    assert [tuple(r) for r in e.drop("file").collect()] == [(1, 4, 5)] and {(r.attribute, r.value) for r in p.collect()} == {("x", "1.0"), ("y", "1.0"), ("z", "3.0")}
    kept, _ = skeleton.cleaned(nodes, edges)
    assert {(r.tree, r.node) for r in kept.collect()} == {(1, 4), (1, 5)}


def test_merge_lists(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("mergelist.txt", "7 0 0 11 1 2 3 0 12 1 2 4 0\nnote\n\n8 0 0 13 1 2 3 0\n")
    (tmp_path / "m.zip").write_bytes(held.getvalue())
    made = codecs.read_merge_lists(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(map(tuple, made.collect())) == [(7, 11, 1, 2, 3, 0), (7, 12, 1, 2, 4, 0), (8, 13, 1, 2, 3, 0)]
    assert codecs.members_by_superchunk(made, spark.createDataFrame([(1, 2, 3, 0)], "scx long, scy long, scz long, level long")).count() == 2


def test_meshes(spark):
    cube = np.zeros((4, 4, 4), int)
    cube[1:3, 1:3, 0:4] = 6
    made = codecs.merge_meshes(codecs.label_meshes(blocks.to_blocks(volume(spark, cube, "v"), "v", "uint8", 4), 4)).first()
    assert made.label == 6 and made.n_vox == 16 and made.area == pytest.approx(2 * 4 + 4 * 8) and made.max_x == 4
    v, f = kernels.surface(cube == 6)
    volume_ = sum(np.dot(v[a], np.cross(v[b], v[c])) for a, b, c in f) / 6
    assert abs(volume_) == pytest.approx(16) and codecs.write_ply(v, f).startswith(b"ply")


def test_raw_tree_and_conf(spark):
    files = spark.createDataFrame([("/d/s_x0001_y0002_z0003.raw",), ("/d/t_x0001_y0002_z0003.raw",), ("/d/none",)], "path string")
    assert [tuple(r) for r in blocks.chunk_mask(files).collect()] == [(1, 2, 3)]
    conf = spark.createDataFrame([('experiment name "sample7";',), ("scale x 9.5;",), ("",)], "value string")
    assert sorted(map(tuple, blocks.read_conf(conf).collect())) == [("experiment name", "sample7"), ("scale x", "9.5")]


def test_learning(spark):
    rng = random.Random(0)
    rows = [(i, i + 1000, float(rng.randrange(1, 50)), float(v := rng.randrange(100)), 10.0, 20.0 + i % 3, 0.3, int(v > 50)) for i in range(300)]
    edges = spark.createDataFrame(rows, "a long, b long, n_pairs double, mean_value double, n_small double, n_large double, log_ratio double, target int")
    for name in ("rf", "lr", "nb", "dc", "ada"):
        out = learned.predicted(learned.fit(edges, learned.MergeConfig(name, "plain-small", trees=8, depth=4)), edges)
        assert learned.diagnostics(out, 0.5).first().f_score > 0.8, name
    w = learned.linear_discriminant(edges, ["n_pairs", "mean_value"])
    assert w[1] > 0 and learned.balanced(edges, 20).groupBy("target").count().count() == 2
    with pytest.raises(ValueError):
        learned.MergeConfig("svm")


def test_iterated_merging(spark):
    rng = np.random.default_rng(3)
    cube = np.kron(rng.integers(1, 30, (3, 3, 3)), np.ones((2, 2, 2), int))
    vox = volume(spark, cube).withColumn("v", (F.col("label") % 2) * 100)
    features = lambda v: A.edge_features(v, 6)
    target = features(vox).withColumn("target", (F.col("mean_value") > 60).cast("int"))
    config = learned.MergeConfig("lr", "plain-small", iterations=2)
    out = learned.iterate(vox, features, learned.fit(target, config), config)
    assert out.count() == cube.size and out.select("label").distinct().count() < len(np.unique(cube))


def test_block_adjacency_matches_the_voxel_join(spark):
    cube = np.kron(np.random.default_rng(8).integers(0, 9, (3, 3, 3)), np.ones((3, 2, 3), int))
    vox = volume(spark, cube)
    want = {(r.a, r.b): r.n_pairs for r in N.adjacency_graph(vox).collect()}
    got = {(r.a, r.b): r.n_pairs for r in kernels.block_adjacency(blocks.to_blocks(vox, "label", "uint16", 4), 4).collect()}
    assert got == want


def test_value_at(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.5, 1e-300, 3.0]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "p double").coalesce(2)
    for place in (0, 17, 150, 299):
        assert A.value_at(df, "p", place) == sorted(values, reverse=True)[place]
    assert A.value_at(df, "p", 300) is None


def test_gipl_codes_of_the_format():
    """Bytes made by hand: 15 is a signed and 16 an unsigned short, 7 a signed byte."""
    import struct

    for code, kind, values in ((15, ">i2", [-2, 300]), (16, ">u2", [65000, 1]), (7, ">i1", [-3, 4]), (1, ">u1", [1, 0])):
        head = bytearray(256)
        struct.pack_into(">4HH4f", head, 0, 2, 1, 1, 1, code, 1.0, 1.0, 1.0, 1.0)
        struct.pack_into(">I", head, 252, 4026526128)
        cube = codecs.read_gipl(bytes(head) + np.array(values, kind).tobytes())
        assert cube.astype(int).ravel().tolist() == values and cube.shape == (1, 1, 2)
        assert struct.unpack_from(">H", codecs.write_gipl(cube), 8)[0] == code
    assert codecs.read_gipl(codecs.write_gipl(np.array([[[-1, 2]]], np.int8))).tolist() == [[[-1, 2]]]


def test_halo_wider_than_a_block(spark):
    df = grid.with_halo(spark.createDataFrame([(10, 0, 0)], "x long, y long, z long"), 4, 9)
    assert sorted(r.bx for r in df.select("bx").distinct().collect()) == [0, 1, 2, 3, 4]


def test_many_lists_and_clashing_names(spark):
    lists = spark.createDataFrame([(k, 700 * (k % 3)) for k in range(30)], "k int, w long")
    rows = grid.addressed(spark.range(0, 25_000, 97).withColumnRenamed("id", "idx"), grid.chunk_ranges(lists, "k", "w")).collect()
    assert all(r.lo <= r.idx < r.hi and r.place == r.idx - r.lo for r in rows) and len(rows) == len([i for i in range(0, 25_000, 97) if i < 21_000])
    vox = spark.createDataFrame([(5, 1, 2), (0, 3, 4)], "label long, old long, new long")
    assert sorted(map(tuple, labels.sequential_relabel(vox).collect())) == [(0, 3, 4), (1, 1, 2)]


def test_stitched_beyond_any_shift(spark):
    big = 1 << 45
    vox = spark.createDataFrame([(big, 3), (big, 3), (7, big + 1)], "first long, second long")
    got = {(r.volume, r.old): r.new for r in A.stitched(vox).collect()}
    assert got[1, big] == got[2, 3] and got[1, 7] == got[2, big + 1] and got[1, big] != got[1, 7]
    with pytest.raises(ValueError):
        A.stitched(vox, shift=1 << 40)


def test_models_by_round_and_samples(spark, tmp_path):
    rows = [(x, y, z, 1 + (x // 3) + 3 * (y // 3), 1 + x // 6) for x in range(12) for y in range(9) for z in range(3)]
    vox = spark.createDataFrame([(*r, 10 * (r[0] % 6 == 5)) for r in rows], "x long, y long, z long, label long, truth long, v long")
    config = learned.MergeConfig("dc", "plain-small", iterations=2, depth=5)
    features = lambda v: A.edge_features(v, 6)
    out, models = learned.iterate_trained(vox, features, config, path=f"{tmp_path}/m")
    assert 1 <= len(models) <= 2 and out.select("label").distinct().count() < 12
    again = learned.iterate_with(vox, features, [learned.loaded(f"{tmp_path}/m/round-{k}") for k in range(len(models))], config)
    key = lambda df: sorted((r.x, r.y, r.z, r.label) for r in df.collect())
    assert key(out) == key(again)
    sample = learned.uniform_sample(vox, "truth", 10)
    assert {r.truth: r["count"] for r in sample.groupBy("truth").count().collect()} == {1: 10, 2: 10}


def test_feature_sets():
    from voxmill.operators import features

    assert [len(features.feature_names(x)) for x in ("all", "standard", "medium", "reduced", "small", "minimal")] == [81, 36, 21, 21, 15, 6]
    assert len(features.feature_names("medium", ecs=True)) == 23 and features.feature_names("all")[:4] == ["size_small", "size_large", "size_overlap", "mean_grayscale"]
    v = np.random.default_rng(0).normal(size=(3, 9, 11))
    assert all(features.filtered(v, f).shape == v.shape and np.isfinite(features.filtered(v, f)).all() for f in features._FILTERS)
    assert features.filtered(np.ones((2, 6, 6)), "var").max() == 0 and features.filtered(np.ones((2, 6, 6)), "blur15") == pytest.approx(np.ones((2, 6, 6)))


def test_edge_table_of_two_boxes(spark):
    """Two boxes that share a plane: every feature by hand; all sets run, whatever the block."""
    from voxmill.operators import features

    rows = [(x, y, z, 1 if x < 4 else 2, 10.0 * x, 0.5, 0.25) for x in range(10) for y in range(6) for z in range(5)]
    vox = spark.createDataFrame(rows, "x long, y long, z long, label long, grayscale double, prob_MEM double, prob_ICS double")
    made = [features.edge_table(vox, "small", block).collect() for block in (3, 16)]
    r = made[0][0]
    assert len(made[0]) == len(made[1]) == 1 and [round(v, 9) for v in made[0][0]] == [round(v, 9) for v in made[1][0]]
    assert (r.size_small, r.size_large, r.size_overlap) == pytest.approx((math.log10(120), math.log10(180), math.log10(60)))
    assert (r.mean_grayscale, r.mean_prob_MEM, r.dist_cntr_small, r.dist_cntr_large, r.ang_cntr) == pytest.approx((35.0, 0.5, 0.5, 0.5, math.pi))
    assert (r.conv_overlap, r.labeled_ovlp) == pytest.approx((1.0, 1.0)) and r.rad_std_ovlp > 0 and r.ang_std_ovlp > 0
    full = features.edge_table(vox, "standard", 16).first()
    assert len(full) == 38 and full.pca_angle0 == pytest.approx(0, abs=1e-6)
    assert features.edge_table(vox.limit(0), "minimal", 8).count() == 0
    stored = blocks.to_blocks(vox, "label", "uint8", 8)
    b = features.block_borders(stored, 8).first()
    assert (b.a, b.b, b.n, b.n_a, b.x, b.low_x, b.high_x, b.high_y) == (1, 2, 60, 30, 3.5, 3, 4, 5)


def test_more_codecs(spark):
    rng = np.random.default_rng(1)
    for kind in ("u1", "u2", "i2", "u4", "f4"):
        cube = rng.integers(0, 100, (3, 5, 7)).astype(f"<{kind}")
        assert (codecs.read_tiff(codecs.write_tiff(cube)) == cube).all() and codecs.read_tiff(codecs.write_tiff(cube)).dtype == cube.dtype
    cube = rng.integers(0, 9, (4, 4, 4)).astype("<u2")
    assert (codecs.read_zip(codecs.write_zip(cube), (4, 4, 4), "uint16") == cube).all()
    assert codecs.constant((2, 3, 4), 7, "uint8").shape == (4, 3, 2) and codecs.constant((2, 3, 4), 7, "uint8").min() == 7
    vox = spark.createDataFrame([(x, 0, 0, x + 1) for x in range(6)], "x long, y long, z long, label long")
    stored = blocks.to_blocks(vox, "label", "uint8", 4)
    files = {r.name: r.content for r in codecs.exported_blocks(stored, "tiff").collect()}
    assert set(files) == {"x0000_y0000_z0000.tiff", "x0001_y0000_z0000.tiff"} and codecs.read_tiff(bytes(files["x0001_y0000_z0000.tiff"]))[0, 0].tolist() == [5, 6, 0, 0]
    assert codecs.mask_bytes(stored, (3, 1, 1)) == bytes([1, 1, 0])
    assert {r.cx for r in blocks.copied(stored, (2, 0, 0)).collect()} == {2, 3}


def test_lists_of_thresholds_and_places(spark):
    from voxmill.functions import expressions as X

    assert X.threshold_list([0.1], (0.3, 0.5, 0.1), [0.99], [0.99]) == ([0.1, 0.3, 0.4, 0.99], [False, False, False, True])
    for bad in ([1.0], [0.0]):
        with pytest.raises(ValueError):
            X.threshold_list(bad, None, [])
    assert X.logit_thresholds(-2, 2, 3) == pytest.approx([1 / (1 + math.e**2), 0.5, 1 / (1 + math.e**-2)])
    at = spark.createDataFrame([(1, 2, 3)], "x long, y long, z long")
    assert at.select(X.voxel_index(F.col("x"), F.col("y"), F.col("z"), (5, 7, 9)).alias("i")).first().i == 1 + 5 * (2 + 7 * 3)
    kinds = kernels.non_simple_kinds(np.array([[[0, 0, 0], [0, 1, 0], [0, 0, 0]]] * 3))
    assert kinds.shape == (3, 3, 3) and kinds[0, 1, 1] == 0
    one = np.zeros((3, 3, 3), int)
    one[1, 1, 1] = 1
    assert kernels.non_simple_kinds(one)[1, 1, 1] == 1
    nodes = spark.createDataFrame([(0, k, 5 * k, 0, 0) for k in range(8)], "tree long, node long, x long, y long, z long")
    assert [r.x for r in skeleton.downsampled(nodes, 2).orderBy("node").collect()] == [0, 2, 5, 7, 10, 12, 15, 17]
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(7)], "tree long, src long, dst long")
    kept = [sorted(map(tuple, skeleton.with_errors(e, 0.5, 3).collect())) for e in (edges, edges.repartition(5))]
    assert kept[0] == kept[1] and skeleton.with_errors(edges, 0.0).count() == 7 and skeleton.with_errors(edges, 1.0).count() == 0
    cube = np.array([[[1, 2, 3]]])
    limited = N.adjacency_limited(volume(spark, cube), spark.createDataFrame([(1,), (2,)], "label long"))
    assert [(r.a, r.b, r.n_pairs) for r in limited.collect()] == [(1, 2, 1)]


def test_near_nodes_never_broadcasts_copies(spark, tmp_path):
    """Counts against all pairs, places between voxels too; the copied side must not go to the driver, however small its file."""
    rng = np.random.default_rng(4)
    cube = rng.integers(0, 4, (9, 9, 9))
    volume(spark, cube).write.parquet(f"{tmp_path}/vox")
    spots = [(k % 3, k, *[float(v) for v in (rng.integers(-4, 40, 3) / 4 if k % 2 else rng.integers(0, 9, 3))]) for k in range(40)]
    spark.createDataFrame(spots, "tree long, node long, x double, y double, z double").write.parquet(f"{tmp_path}/nodes")
    vox, nodes = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("vox", "nodes"))
    for radius, cell in ((2, 4), (3.5, 2)):
        made = skeleton.near_nodes(nodes, vox, radius, cell)
        want = Counter((t, n, int(cube[c, b, a])) for t, n, x, y, z in spots for c, b, a in np.argwhere(cube).tolist() if (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 <= radius**2)
        assert {(r.tree, r.node, r.label): r.n_vox for r in made.collect()} == want
        assert "Broadcast" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["block_adjacency", "block_borders"])
def test_stored_labels_of_any_size(spark, tmp_path, name):
    """User ids beyond 16 and 32 bits, and below 0, are labels as any others."""
    from voxmill.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * REPLACE (CASE event_id % 4 WHEN 0 THEN user_id + 65530 WHEN 1 THEN user_id + 5000000000 WHEN 2 THEN -user_id ELSE 0 END AS user_id) FROM '/root/testdata/sf0.001/events.parquet'")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    made = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({SQL[name]}) ORDER BY a, b").fetchall()
    assert [tuple(r) for r in made.orderBy("a", "b").collect()] == [pytest.approx(w, abs=2e-4) for w in want] and want[0][0] < 0


def test_edge_table_never_broadcasts_edges(spark, tmp_path):
    """Joins on edges are merged, however small the file: a few voxels have many border points."""
    from voxmill.operators import features

    volume(spark, np.random.default_rng(3).integers(0, 20, (4, 4, 4))).selectExpr("*", "0D AS grayscale", "0D AS prob_MEM", "0D AS prob_ICS").write.parquet(f"{tmp_path}/vox")
    made = features.edge_table(spark.read.parquet(f"{tmp_path}/vox"), "small", 4)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString() and made.count()
