"""Recipes and border geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import cube_of, volume
from voxmill.operators import borders, kernels
from voxmill.plans import recipes


def two_blobs():
    p = np.zeros((3, 6, 6, 12))
    p[0] = 0.4
    z, y, x = np.ogrid[:6, :6, :12]
    p[1] = np.maximum(0, 1 - ((z - 2.5) ** 2 + (y - 2.5) ** 2 + (x - 2.5) ** 2) / 9)
    p[2] = np.maximum(0, 1 - ((z - 2.5) ** 2 + (y - 2.5) ** 2 + (x - 8.5) ** 2) / 9)
    return p


@pytest.mark.parametrize("method", recipes.METHODS)
def test_watershed_cube(method):
    made = recipes.watershed_cube(two_blobs(), [0.5, 0.7, 0.9], 3, method=method)
    outside = two_blobs().argmax(0) == 0
    for t in (0.5, 0.7, 0.9):
        own, filled, apart = (made[t][k] for k in ("with_background", "zero_background", "no_adjacencies"))
        assert set(np.unique(own)) == {0, 1, 2} and ((own == 0) == outside).all()  # background stays
        assert (filled > 0).all() and (filled[own > 0] == own[own > 0]).all()  # the nearest label fills it
        assert set(np.unique(apart)) <= {0, 1, 2} and (apart[outside] == 0).all()
        for axis in range(3):
            a, b = np.moveaxis(apart, axis, 0)[:-1], np.moveaxis(apart, axis, 0)[1:]
            assert not ((a != b) & (a > 0) & (b > 0)).any()


def test_watershed_options():
    p = two_blobs()
    many = recipes.watershed_cube(p, [0.5, 0.9], [2, 5], saved=[0.9], fixed={2: 7})
    assert set(many) == {(2, 0.9), (5, 0.9)} and set(np.unique(many[2, 0.9]["with_background"])) == {0, 1, 7}
    types = p.argmax(0)
    types[0, 0, 0] = 1
    for smallest, first in ((0, 1), (5, 0)):
        made = recipes.watershed_cube(recipes.source_classes(types, 3, smallest), [0.5], 1)[0.5]["with_background"]
        assert (made[0, 0, 0] > 0) == first and ((made > 0) == (types > 0))[1:].all()
    ties = recipes.watershed_cube(np.array([[[[0.2, 0.2, 0.2, 0.2, 0.2]]], [[[0.9, 0.3, 0.5, 0.4, 0.9]]]]), [0.8], 1, method="skim-ws")[0.8]
    assert ties["with_background"].tolist() == [[[1, 1, 1, 1, 2]]] and ties["no_adjacencies"].tolist() == [[[1, 1, 1, 0, 2]]]  # the lowest first
    planes = recipes.linked_planes(np.array([[[1, 0, 1]], [[1, 0, 0]], [[0, 0, 0]]], bool), np.ones((3, 1, 3), bool))
    assert planes.tolist() == [[[1, 1, 1]], [[1, 1, 1]], [[0, 0, 0]]]


def test_watershed_blocks(spark):
    p = two_blobs()
    df = volume(spark, np.zeros(p.shape[1:], int), "i")
    for k, c in enumerate("abc"):
        df = df.join(volume(spark, np.round(p[k] * 1000).astype(int), c).withColumn(c, F.col(c) / 1000), ["x", "y", "z"])
    one = recipes.watershed(df, list("abc"), [0.5], 3, 16, 0)
    assert (cube_of(one, p.shape[1:], "with_background") == recipes.watershed_cube(np.round(p, 3), [0.5], 3)[0.5]["with_background"]).all()


def test_label_check_and_scrub(spark):
    cube = np.zeros((8, 8, 8), int)
    cube[1:7, 1:7, 1:7] = 5
    cube[0, 0, 0] = 9
    out = cube_of(recipes.label_check(volume(spark, cube), 5, 8, 0.6), cube.shape)
    assert out[3, 3, 3] == 1 and out[0, 0, 0] == 0
    assert cube_of(recipes.scrub(volume(spark, cube), 5), cube.shape).sum() == 216
    assert (cube_of(recipes.scrub(volume(spark, cube), 5, 8), cube.shape) == 1).all()
    proof = cube_of(recipes.label_proof(volume(spark, cube), (8, 8, 8)), cube.shape)
    assert proof[0, 0, 0] == 0 and proof[3, 3, 3] > 0


def test_cavities_of_any_extent(spark):
    """A hollow over several blocks is a cavity, one open to a side isn't; top and bottom don't count."""
    cube = np.full((6, 20, 20), 3)
    cube[:, 2:18, 2:18] = 0  # through top and bottom
    cube[2:4, 9:11, 9:11] = 8
    out = cube_of(recipes.cavities_filled(volume(spark, cube), 5), cube.shape)
    assert (out > 0).all() and (out == kernels.fill_cavities(cube)).all()
    back = cube_of(recipes.small_cavity_labels_removed(volume(spark, cube), 10, 5), cube.shape)
    assert (back == 1).all()
    cube[3, 5, :3] = 0
    assert (cube_of(recipes.cavities_filled(volume(spark, cube), 5), cube.shape) == cube).all()
    one = np.zeros((5, 7, 7), int)
    one[1:4, 1:6, 1:6] = 4
    one[2, 2:5, 2:5] = 0
    one[2, 3, 3] = 9
    whole = kernels.fill_cavities_labelwise(one)
    assert whole[2, 2, 2] == 4 and whole[2, 3, 3] == 9 and whole[0, 0, 0] == 0
    assert cube_of(recipes.ecs_replaced(volume(spark, one), 5, 50, 10), one.shape)[2, 3, 3] == 50


def test_linked_slices_and_evaluation(spark, tmp_path):
    cube = np.array([[[1, 0], [0, 2]], [[3, 0], [0, 4]]])
    out = cube_of(recipes.linked_slices(volume(spark, cube)), cube.shape)
    assert out.tolist() == [[[1, 0], [0, 2]], [[1, 0], [0, 2]]]
    vox = volume(spark, cube).withColumn("truth", F.col("label"))
    nodes = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 0, 0, 1)], "tree long, node long, x long, y long, z long")
    edges = spark.createDataFrame([(0, 0, 1)], "tree long, src long, dst long")
    made = recipes.evaluation(vox, "truth", nodes, edges)
    assert made["path_length"].first().eftpl == 0.0 and made["information"].first().variation == pytest.approx(0)
    recipes.write_scores(made["path_length"], f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").count() == 1


def test_border_geometry(spark):
    cube = np.ones((4, 4, 10), int)
    cube[:, :, 5:] = 2
    touching = borders.border_voxels(volume(spark, cube))
    r = borders.principal_axes(touching, ["a", "b"]).first()
    assert (r.a, r.b, r.n) == (1, 2, 16) or r.n == 32
    assert abs(r.axis_x) < 1e-6 and r.var1 >= r.var2 >= r.var3 > 0
    assert borders.radial_spread(touching, ["a", "b"]).first().radial_std > 0
    e = {x.label: x for x in borders.ellipsoids(volume(spark, cube)).collect()}
    assert e[1].half_axis1 == pytest.approx(np.sqrt(5 * 2.0 + 5 / 12)) and e[1].diameter > 0
    centres = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 2.5, 0.0, 0.0)], "label long, cx double, cy double, cz double")
    assert sorted(map(tuple, borders.nearest_neighbours(centres, 1, 3.0).collect())) == [(1, 2, 1), (2, 1, 1), (3, 2, 1)]


def test_augmentation_and_tiles(spark):
    cube = np.arange(24).reshape(2, 3, 4)
    vox = volume(spark, cube)
    assert (cube_of(borders.augmented(vox, 5, (4, 3, 2)), cube.shape) == cube[::-1, :, ::-1]).all()
    assert (cube_of(borders.augmented(vox, 8, (4, 3, 2)), (2, 4, 3)) == cube.transpose(0, 2, 1)).all()
    at = borders.tile_index(spark.createDataFrame([(5,)], "idx long"), (4, 4, 4), (2, 2, 2)).first()
    assert (at.begin_x, at.begin_y, at.begin_z) == (2, 0, 2)
    lines = spark.createDataFrame([("f", "epoch 3 cost 0.5"), ("f", "epoch 4 cost 0.25")], "file string, value string").coalesce(1)
    assert borders.run_attributes(lines, {"epoch": r"epoch (\d+)", "other": "x(y)"}).first().epoch == "4"
    j = borders.jackknife(spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "tree long, free double, length double"), "tree", "free").first()
    assert j.mean == pytest.approx(0.5) and j.std_error == pytest.approx(0)
    assert kernels.difference_of_gaussians(np.ones((4, 4, 4)), [(1.0, 2.0)])[0] == pytest.approx(np.zeros((4, 4, 4)))
