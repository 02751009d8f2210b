"""Operators against DuckDB at sf0.001 and against small cases worked by hand."""

import math
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import queries
from driftline.functions.selection import SelectionError, select, select_indices
from driftline.model import Trajectory, from_arrays
from driftline.operators import angles, common, correlation, defects, distances, fluctuation, helices, linear, membrane, radial, series, shape, solvation, transforms
from driftline.plans import analyses, register, run
from driftline.sources import dcd, text, xdr
from driftline.streaming import running

SF = "/root/testdata/sf0.001"


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b




@pytest.mark.parametrize("name", [n for n in ("radius_of_gyration", "radgyr_tensor", "pairwise_distance", "search_neighbors", "rmsf", "image", "msd_multi", "lipid_neighbours", "water_count", "polymer_end_to_end", "drid", "runningavg", "sorient", "spol_shell", "ion_pair_corr", "docking_contacts", "gist_grid", "free_volume", "bundle", "ired_matrix", "gist_direct", "gist_frames", "hydrophobic_defects", "hydrophobic_defect_sites", "decimate_frames", "helix_fixed", "lie")])
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    got = queries.REGISTRY[name].run(spark, SF)
    want = con.sql(queries.REGISTRY[name].sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((isinstance(v, float), round(v, 3) if isinstance(v, float) else str(v)) for v in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=key)
    assert len(a) == len(b) and all(all(map(same, x, y)) for x, y in zip(a, b, strict=True))


def make(spark, frames, box=None, names=None, resids=None, chains=None, bonds=None):
    n = len(frames[0])
    points = [(f, a, *map(float, p)) for f, frame in enumerate(frames) for a, p in enumerate(frame)]
    atoms = [(a, (names or ["CA"] * n)[a], "ALA", (resids or list(range(n)))[a], (chains or ["A"] * n)[a], "C", 1.0, 1.0) for a in range(n)]
    boxes = [(f, float(f), *([box] * 3)) for f in range(len(frames))]
    return Trajectory(
        spark.createDataFrame(points, "frame long, atom long, x double, y double, z double"), spark.createDataFrame(atoms, "atom long, name string, resname string, resid long, chain string, element string, mass double, charge double"),
        spark.createDataFrame(boxes, "frame long, time_ps double, lx double, ly double, lz double"), spark.createDataFrame(bonds, "a long, b long") if bonds else None,
    )


def line(*xs):
    return [(x, 0, 0) for x in xs]


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*df.columns[:2]).collect()]


def test_shapes(spark):
    t = make(spark, [line(0, 2), line(1, 3)])
    assert values(shape.rg(t), "rg") == [(1.0,), (1.0,)]
    assert values(shape.radgyr_tensor(t), "rg", "xx", "yy", "xy")[0] == (1.0, 1.0, 0.0, 0.0)
    assert values(shape.radgyr(t), "rg_x", "rg_y", "rg_z")[0] == (0.0, 1.0, 1.0)
    assert values(shape.check_structure(make(spark, [[(0, 0, 0), (float("nan"), 0, 0)]])), "n_bad") == [(1,)]


def test_distances(spark):
    assert values(distances.hausdorff(make(spark, [line(0, 2, 0)], names=["A", "A", "B"]), "name A", "name B"), "dist") == [(2.0,)]
    t = make(spark, [line(0, 1, 3)], bonds=[(0, 1)])
    assert values(distances.drid(t), "m1")[0][0] == pytest.approx(2 / 3) and values(distances.drid(t), "m2")[1][0] == pytest.approx(0.25)
    assert values(distances.drid(t, exclude_bonds=True), "m1")[0][0] == pytest.approx(1 / 3)
    assert values(distances.hbond(make(spark, [line(0, 1.5)], names=["D", "A"]), "name D", "name A", 2.0), "n") == [(1,)]
    assert values(distances.mindist(t, "name X", "name CA"), "dist") == [(0.0,)]
    assert math.isnan(values(distances.pairdist_extrema(t, "name X", "name CA"), "dist")[0][0])
    assert values(distances.pairwise_distance(make(spark, [line(0.5, 9.5)], box=10.0), "resid 0", "resid 1", True), "dist") == [(1.0,)]


@pytest.mark.parametrize("pbc", [False, True])
@pytest.mark.parametrize("cutoff", [1.0, 2.3, 4.9])
def test_cells_find_all_pairs(spark, pbc, cutoff):
    rng = np.random.default_rng(3)
    p = rng.uniform(-12, 22, (60, 3))
    t = make(spark, [p.tolist()], box=10.0)
    d = p[:, None] - p[None]
    d = d - np.sign(d / 10) * np.floor(np.abs(d / 10) + 0.5) * 10 if pbc else d
    want = {(i, j) for i in range(60) for j in range(60) if i != j and np.linalg.norm(d[i, j]) <= cutoff}
    got = [(r.a, r.b) for r in distances.pairs(t, None, None, pbc=pbc, cutoff=cutoff).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_radial(spark):
    t = make(spark, [line(0, 1)], box=100.0)
    assert [r[0] for r in values(radial.pairdist_histogram(t, "name CA", "name CA", 5, 5.0), "n")] == [0, 2, 0, 0, 0]
    assert values(radial.rdf(t, "all", "all", 5, 5.0), "integral")[1] == (1.0,)


def test_polymers(spark):
    t = make(spark, [line(0, 1, 2) + line(5, 6, 7)], chains=list("AAABBB"), resids=[0, 1, 2] * 2)
    assert values(angles.end_to_end(t), "dist") == values(angles.contour_length(t), "contour") == [(2.0,), (2.0,)]
    assert values(shape.chain_rg(t), "rg")[0][0] == pytest.approx(math.sqrt(2 / 3))


def test_correlations(spark):
    t = make(spark, [line(0), line(1), line(2)], box=100.0)
    got = correlation.vanhove(t, r_bin=1.0, r_max=3.0, max_lag=2)
    assert sorted((r.lag, r.bin, r.g) for r in got.collect()) == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]
    assert values(correlation.msd(make(spark, [line(0, 1), line(1, 2)], box=100.0)), "x", "total") == [(1.0, 1.0)]
    uneven = make(spark, [line(0), line(1), line(2)])
    uneven = Trajectory(uneven.frames, uneven.atoms, uneven.boxes.withColumn("time_ps", F.col("frame") * F.col("frame") * 1.0))
    with pytest.raises(ValueError):
        correlation.msd(uneven)


def test_symmetric_deviation(spark):
    t = make(spark, [line(0, 1, -1), line(0, -1, 1)])
    plain, remapped = values(fluctuation.rmsd(t, None, 0), "rmsd"), values(fluctuation.symmrmsd(t, [[1, 2]], None, 0), "rmsd")
    assert plain[1][0] > 0 and remapped[1][0] == 0.0


def test_alignment_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    t = make(spark, [x.tolist(), (x @ q.T + [1, 2, 3]).tolist()])
    assert values(linear.rmsd_aligned(t, None, 0), "rmsd")[1][0] == pytest.approx(0.0, abs=1e-6)
    back = linear.superpose(t, None, 0).where("frame = 1").orderBy("atom").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in back], x)
    moments = linear.principal_axes(t, None, False).collect()
    assert np.allclose(moments[0].moments, moments[1].moments)
    value = {r.component: r.eigenvalue for r in linear.pca(make(spark, rng.normal(size=(6, 4, 3)).tolist()), 2).collect()}
    assert value[0] >= value[1] > 0


def test_flip_flop(spark):
    series = [-1] * 6 + [0, 0, 1, 0, 0] + [1] * 7 + [0] + [-1] * 6
    df = spark.createDataFrame([(0, f, s) for f, s in enumerate(series)], "resid long, frame long, leaflet long")
    got = [(r.start, r.end, r.leaflet, r.outcome) for r in membrane.flip_flop(df, 1).orderBy("start").collect()]
    assert got == [(5, 8, 1, "Success"), (8, 11, 1, "Fail"), (17, 19, -1, "Success")]


def test_flip_flop_with_a_longer_cutoff():
    assert membrane.crossings([-1, -1, 0, -1, -1, -1], 2) == []
    assert membrane.crossings([-1, -1, 0, 0, -1, -1], 2) == [(1, 4, -1, "Fail")]
    assert membrane.crossings([-1, 0, 0, 1, 1, 1], 2) == [(0, 3, 1, "Success")]
    assert membrane.crossings([1, 0, 0, 0], 2) == [(0, 3, 0, "Ongoing")] and membrane.crossings([], 1) == []


def test_bridges_against_all_pairs():
    """Bridges found from the bonds are those found by looking at every pair."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = 14
        held = {(int(i), int(j)) for i, j in rng.integers(0, n, (50, 2)) if abs(i - j) > 1}
        want = {}
        for i in range(n):
            for j in range(i + 2, n):
                kinds = set()
                if ((i, j) in held and (j, i) in held) or ((i - 1, j + 1) in held and (j - 1, i + 1) in held):
                    kinds.add("anti")
                if ((i - 1, j) in held and (j, i + 1) in held) or ((j - 1, i) in held and (i, j + 1) in held):
                    kinds.add("parallel")
                if kinds:
                    want[i, j] = kinds
        assert linear.bridges(held) == want


def test_secondary_states():
    ca = np.zeros((12, 3))  # nothing is bent
    helix = {(i, i + 4) for i in range(1, 6)}
    assert linear.secondary_states([0] * 12, helix, ca) == [" ", " ", *"HHHHHHH", "T", " ", " "]
    # a chain's end between them: no turn reaches over it
    cut = linear.secondary_states([0] * 6 + [1] * 6, helix, ca)
    assert cut[6:] == [" "] * 6 and "H" not in cut
    assert set(linear.secondary_states([0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1], {(1, 5), (2, 6)}, ca)) == {" "}
    turn = linear.secondary_states([0] * 8, {(1, 4)}, ca[:8])
    assert turn == [" ", " ", "T", "T", "T", " ", " ", " "]
    straight = np.array([[i * 3.0, 0.0, 0.0] for i in range(7)])  # an angle of 180 degrees is above 70
    assert linear.secondary_states([0] * 7, set(), straight) == [" ", " ", "S", "S", "S", " ", " "]
    pair = linear.secondary_states([0] * 12, {(2, 9), (9, 2)}, ca)
    assert [i for i, x in enumerate(pair) if x == "B"] == [2, 9]


def test_residues_of_two_chains_stay_apart(spark):
    """One residue number in two chains is two residues, and no hydrogen is made from the other chain."""
    atoms = [(c, r, n) for c in "AB" for r in (1, 2) for n in ("N", "CA", "C", "O")]
    frames = spark.createDataFrame([(0, i, float(i), float(i * i % 7), float(i % 3)) for i in range(len(atoms))], "frame long, atom long, x double, y double, z double")
    table = spark.createDataFrame([(i, n, "ALA", r, c, n[0], 1.0, 0.0) for i, (c, r, n) in enumerate(atoms)], "atom long, name string, resname string, resid long, chain string, element string, mass double, charge double")
    t = Trajectory(frames, table, spark.createDataFrame([(0, 0.0, 50.0, 50.0, 50.0)], "frame long, time_ps double, lx double, ly double, lz double"))
    got = {(r.chain, r.resid): r for r in linear.backbone(t).collect()}
    assert len(got) == 4 and [got[k].h_x is None for k in (("A", 1), ("A", 2), ("B", 1), ("B", 2))] == [True, False, True, False]
    assert got["B", 1].n_x == 8.0 and got["B", 1].segment != got["A", 2].segment
    assert linear.dssp(t).count() == 4


def test_frames_by_index(spark):
    t = make(spark, [line(i) for i in range(5)])
    got = transforms.pick_frames(t, [3, -1, 3, 9]).orderBy("position").collect()
    assert [(r.position, r.frame) for r in got] == [(0, 3), (1, 4), (2, 3)]
    with pytest.raises(ValueError):
        transforms.select_frames(t, step=0)


def test_selection_language(spark):
    t = make(spark, [line(*range(6))], names=["N", "CA", "C", "O", "CB", "H"], resids=[-2, -1, 3, 4, 5, 9])
    pick = lambda s: [r.atom for r in t.atoms.where(select(s)).orderBy("atom").collect()]
    assert pick("") == pick("ALL") == list(range(6))
    assert pick("name ca CB") == [1, 4] and pick("not (name N or name CA)") == [2, 3, 4, 5]
    assert pick("resid 5-3 9") == [2, 3, 4, 5] and pick("resid -2:-1") == [0, 1] and pick("resid 4 : 9") == [3, 4, 5]
    assert pick("backbone") == [0, 1, 2, 3] and pick("protein and sidechain") == [4, 5]
    for bad in ("name", "resid x", "(name CA", "name CA )", "frob 1"):
        with pytest.raises(SelectionError):
            select(bad)


def test_files(spark, tmp_path):
    t = make(spark, [[(1.5, 2.25, -3.125), (4, 5, 6)]], names=["CA", "N"])
    lines = [r.value for r in text.pdb_lines(t.frames.join(t.atoms, "atom")).orderBy("atom").collect()]
    (tmp_path / "a.pdb").write_text("MODEL        1\n" + "\n".join(lines) + "\nENDMDL\nMODEL        2\n" + "\n".join(lines) + "\nENDMDL\n")
    got = text.read_pdb(spark, str(tmp_path / "a.pdb")).orderBy("frame", "atom").collect()
    assert [(r.frame, r.atom, r.name, r.x, r.y, r.z) for r in got][:2] == [(0, 0, "CA", 1.5, 2.25, -3.125), (0, 1, "N", 4.0, 5.0, 6.0)] and len(got) == 4
    (tmp_path / "a.xyz").write_text("2\nfirst\nC 0 0 1\nO 1 2 3\n2\nsecond\nC 0 0 2\nO 1 2 4\n")
    assert [(r.frame, r.atom, r.element, r.z) for r in text.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("frame", "atom").collect()] == [(0, 0, "C", 1.0), (0, 1, "O", 3.0), (1, 0, "C", 2.0), (1, 1, "O", 4.0)]
    atom = "%5d%-5s%5s%5d%8.3f%8.3f%8.3f\n"
    (tmp_path / "a.gro").write_text("".join(f"water t= {k}.0\n    2\n" + atom % (1, "SOL", "OW", 1, 0.1, 0.2, 0.3) + atom % (1, "SOL", "HW1", 2, 0.4, 0.5, 0.6 + k) + "   1.0   2.0   3.0\n" for k in range(2)))
    got = text.read_gro(spark, str(tmp_path / "a.gro")).orderBy("frame", "atom").collect()
    assert [(r.frame, r.atom, r.name, round(r.z, 6), r.lz, r.time_ps) for r in got] == [(0, 0, "OW", 3.0, 30.0, 0.0), (0, 1, "HW1", 6.0, 30.0, 0.0), (1, 0, "OW", 3.0, 30.0, 1.0), (1, 1, "HW1", 16.0, 30.0, 1.0)]
    x = np.random.default_rng(0).normal(size=(7, 3, 3))
    (tmp_path / "a.dcd").write_bytes(dcd.dcd_bytes(x, np.full((7, 3), 20.0)))
    got = dcd.read_dcd(spark, [str(tmp_path / "a.dcd")], frames_per_task=3).orderBy("frame", "atom").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in got], x.reshape(-1, 3), atol=1e-6) and got[0].lx == 20.0


def test_xyz_comments_may_be_numbers(spark, tmp_path):
    (tmp_path / "b.xyz").write_text("2\n100\nC 0 0 1\nO 1 2 3\n1\n2\nN 0 0 2\n")
    got = [(r.frame, r.atom, r.element, r.z) for r in text.read_xyz(spark, str(tmp_path / "b.xyz")).orderBy("frame", "atom").collect()]
    assert got == [(0, 0, "C", 1.0), (0, 1, "O", 3.0), (1, 0, "N", 2.0)]


@pytest.mark.parametrize("n", [4, 9, 10, 60])
def test_xtc_and_trr(spark, tmp_path, n):
    """Files of our own: pairs that are packed together, few atoms, skewed cells, one file read by several tasks."""
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.normal(size=(11, n, 3)), axis=1) * 3
    x[5] *= 200
    cells = np.array([np.diag([40.0, 50, 60]).reshape(-1) for _ in range(11)])
    cells[3, 3] = 12.0
    times = [2.0 * k for k in range(11)]
    (tmp_path / "a.xtc").write_bytes(xdr.xtc_bytes(x, cells, times))
    read = xdr.read_xtc(spark, [str(tmp_path / "a.xtc")], frames_per_task=2)
    got = read.orderBy("frame", "atom").collect()
    assert len(got) == 11 * n and read.rdd.getNumPartitions() > 1
    assert np.allclose([[r.x, r.y, r.z] for r in got], x.reshape(-1, 3), atol=6e-3, rtol=1e-5)
    assert [r.time_ps for r in got[::n]] == times and (got[0].lx, got[0].ly, got[0].lz, got[0].cell) == pytest.approx((40.0, 50.0, 60.0, None)) and got[3 * n].cell[3] == pytest.approx(12.0)
    for real in (">f4", ">f8"):
        (tmp_path / f"a{real[1:]}.trr").write_bytes(xdr.trr_bytes(x, cells, times, x * 2, real))
        got = xdr.read_trr(spark, [str(tmp_path / f"a{real[1:]}.trr")], frames_per_task=3).orderBy("frame", "atom").collect()
        assert np.allclose([[r.x, r.y, r.z] for r in got], x.reshape(-1, 3), rtol=1e-5, atol=1e-4) and np.allclose([[r.vx, r.vy, r.vz] for r in got], 2 * x.reshape(-1, 3), rtol=1e-5, atol=1e-4)
        assert [r.time_ps for r in got[::n]] == times and got[0].step == 0 and got[-1].step == 10
    (tmp_path / "bad.xtc").write_bytes((tmp_path / "a.xtc").read_bytes()[:-7])
    with pytest.raises(Exception, match="ends within a frame"):
        xdr.read_xtc(spark, [str(tmp_path / "bad.xtc")]).count()


def test_gromos_blocks_and_index_groups(spark, tmp_path):
    frame = "TIMESTEP\n{step} {time}\nEND\nPOSITIONRED\n# two atoms\n 0.1 0.2 0.3\n 0.4 0.5 {z}\nEND\nBOX\n 1 2 3\nEND\n"
    (tmp_path / "a.g96").write_text("TITLE\nwater\nEND\n" + frame.format(step=0, time=0.0, z=0.6) + frame.format(step=5, time=2.5, z=0.7))
    got = text.read_g96(spark, str(tmp_path / "a.g96")).orderBy("frame", "atom").collect()
    assert [(r.frame, r.atom, r.step, r.time_ps, round(r.z, 9), r.ly) for r in got] == [(0, 0, 0, 0.0, 3.0, 20.0), (0, 1, 0, 0.0, 6.0, 20.0), (1, 0, 5, 2.5, 3.0, 20.0), (1, 1, 5, 2.5, 7.0, 20.0)]
    (tmp_path / "b.g96").write_text("TITLE\nx\nEND\nPOSITION\n    1 SOL   OW         1    0.1 0.2 0.3\nEND\n")
    assert [(r.frame, r.atom, round(r.x, 9)) for r in text.read_g96(spark, str(tmp_path / "b.g96")).collect()] == [(0, 0, 1.0)]
    (tmp_path / "a.ndx").write_text("; made by hand\n[ System ]\n1 2 3\n4\n[ Ends ]\n 4 1\n")
    got = text.read_ndx(spark, str(tmp_path / "a.ndx")).orderBy("name", "position").collect()
    assert [(r.name, r.atom) for r in got] == [("Ends", 3), ("Ends", 0), ("System", 0), ("System", 1), ("System", 2), ("System", 3)]


def test_indices_in_order(spark):
    t = make(spark, [line(0, 1, 2)])
    assert [r.atom for r in select_indices(t.atoms, [2, 0, 2]).orderBy("position").collect()] == [2, 0, 2]
    with pytest.raises(Exception, match="no atom 9"):
        select_indices(t.atoms, [9]).collect()


def test_skewed_cells_against_numpy(spark):
    rng = np.random.default_rng(2)
    cell = np.array([[20.0, 0, 0], [6.0, 18, 0], [-4.0, 5, 22]])
    x = rng.uniform(-40, 40, size=(1, 12, 3))
    t = make(spark, x.tolist())
    t = replace(t, boxes=t.boxes.withColumn("cell", F.array(*[F.lit(float(v)) for v in cell.reshape(-1)])))
    inv = np.linalg.inv(cell)
    for r in distances.pairwise_distance(t, None, None, True).collect():
        f = (x[0, r.b] - x[0, r.a]) @ inv
        assert r.dist == pytest.approx(np.linalg.norm((f - np.round(f)) @ cell))
    got = {r.atom: (r.x, r.y, r.z) for r in transforms.image(t).collect()}
    for k in range(12):
        f = x[0, k] @ inv
        assert got[k] == pytest.approx((f - np.floor(f)) @ cell)
    assert values(transforms.volume(t), "volume") == [(pytest.approx(abs(np.linalg.det(cell))),)]


def test_fitted_deviations_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4, 8, 3)) * 5
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    x[1] = x[0] @ (q * np.sign(np.linalg.det(q))).T + 3.0
    t = make(spark, x.tolist())

    def best(a, b):
        a, b = a - a.mean(axis=0), b - b.mean(axis=0)
        u, _, vt = np.linalg.svd(a.T @ b)
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        return a @ r, b

    got = {(r.f1, r.f2): r.rmsd for r in fluctuation.pairwise_rmsd(t, None, "rms").collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = best(x[i], x[j])
            assert got[i, j] == pytest.approx(np.sqrt(((a - b) ** 2).sum(axis=1).mean()), abs=1e-6)
    assert got[0, 1] < 1e-6
    assert all(r.rmsd < 1e-6 for r in fluctuation.rmsd_perres(t, None, 0, align=True).where("frame = 1").collect())
    a, b = best(x[2], x[0])
    want = (((a + x[0].mean(axis=0)) - x[0]) ** 2).sum(axis=1)
    by = {}
    for atom, resid in [(r.atom, r.resid) for r in t.atoms.collect()]:
        by.setdefault(resid, []).append(want[atom])
    for r in fluctuation.rmsd_perres(t, None, 0, align=True).where("frame = 2").collect():
        assert r.rmsd == pytest.approx(np.sqrt(np.mean(by[r.resid])), abs=1e-6)


def test_free_points_one_by_one(spark):
    """Bondi's free volume against draws made one after the other."""
    t = make(spark, [[(1.0, 2.0, 3.0), (9.0, 9.5, 0.5)], [(5.0, 5.0, 5.0), (0.0, 0.0, 0.0)]])
    t = replace(t, boxes=t.boxes.withColumns({c: F.lit(v) for c, v in (("lx", 10.0), ("ly", 11.0), ("lz", 12.0))}))
    mask, step, box = (1 << 64) - 1, 0x9E3779B97F4A7C15, (10.0, 11.0, 12.0)
    where = {(r.frame, r.atom): (r.x, r.y, r.z) for r in t.frames.collect()}
    reach = {r.atom: linear.RADII.get(r.element, linear.OTHER_RADIUS) + 0.5 for r in t.atoms.collect()}
    for r in solvation.bondi_ffv(t, None, probe=0.5, points_per_nm3=300, seed=5).collect():
        state, free, n = 5 ^ (r.frame * step & mask), 0, round(300 * 1.32)
        for _ in range(n):
            p = []
            for length in box:
                state = (state + step) & mask
                z = state
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
                z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
                p.append(((z ^ z >> 31) >> 11) / 2.0**53 * length)
            near = lambda a: sum(min(abs(u - v), length - abs(u - v)) ** 2 for u, v, length in zip(p, where[r.frame, a], box))  # noqa: B023, E731
            free += all(near(a) >= reach[a] ** 2 for a in reach)
        assert r.free_fraction == free / n and r.ffv == pytest.approx(1 - 1.3 * (1 - free / n)) and r.total == pytest.approx(1320.0)


def test_requests(spark):
    t = make(spark, [line(0, 2)])
    assert values(run(t, [{"analysis": "rg", "id": "size"}])["size"], "rg") == [(1.0,)]
    assert len(analyses()) > 100
    for bad in ([{"analysis": "nothing"}], [{"analysis": "rg", "frob": 1}], [{"analysis": "rg"}, {"analysis": "rg"}]):
        with pytest.raises((ValueError, TypeError)):
            run(t, bad)


def test_stream(spark, tmp_path):
    t = make(spark, [line(0, 2), line(1, 3)])
    t.frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.frames.schema).parquet(str(tmp_path / "in"))
    q = running.running_rg(stream).writeStream.outputMode("complete").format("memory").queryName("rg_so_far").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.frame, r.rg, r.n) for r in spark.table("rg_so_far").collect()) == [(0, 1.0, 2), (1, 1.0, 2)]


def run_stream(spark, tmp_path, name, build, parts, schema, mode):
    """Results after each part has been a file of its own, the query being stopped and started again in between."""
    source = tmp_path / f"in-{name}"
    source.mkdir()
    stream = build(spark.readStream.schema(schema).parquet(str(source)))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True)
        if mode == "append":
            writer.format("parquet").start(str(tmp_path / f"out-{name}")).awaitTermination()
        else:
            writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out-{name}"))).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / f"out-{name}"))


POINT = "frame long, atom long, x double, y double, z double"


def test_stream_of_fluctuations(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 3, 3))
    rows = [[(f, a, *map(float, x[f, a])) for f in frames for a in range(3)] for frames in (range(5), range(5, 8))]
    got = {r.atom: r for r in run_stream(spark, tmp_path, "rmsf", running.running_rmsf, rows, POINT, "complete").collect()}
    assert all(got[a].n == 8 and got[a].rmsf == pytest.approx(np.sqrt(x[:, a].var(axis=0).sum())) for a in range(3))


def test_stream_of_lags_over_a_restart(spark, tmp_path):
    """The state holds the last frames between two runs of the query."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(7, 2, 3))
    rows = [[(f, a, *map(float, x[f, a])) for f in frames for a in range(2)] for frames in (range(4), range(4, 7))]
    got = {(r.atom, r.frame, r.lag): r.value for r in run_stream(spark, tmp_path, "ring", lambda p: running.ring_correlation(p, 2), rows, POINT, "append").collect()}
    want = {(a, f, k): float(x[f, a] @ x[f - k, a]) for a in range(2) for f in range(7) for k in range(3) if f - k >= 0}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_stream_of_windows_drops_late_rows(spark, tmp_path):
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string, value double"
    parts = [[(at(1), "a", 1.0), (at(1, 30), "a", 2.0), (at(3), "b", 5.0)], [(at(1, 45), "a", 100.0), (at(9), "a", 1.0)], [(at(20), "c", 1.0)]]
    got = run_stream(spark, tmp_path, "windows", running.windowed_counts, parts, schema, "append").collect()
    assert {(r.window.start.hour, r.event_type): (r.n, r.total) for r in got} == {(1, "a"): (2, 3.0), (3, "b"): (1, 5.0), (9, "a"): (1, 1.0)}


def test_pca_by_features_and_by_frames(spark, monkeypatch):
    """Both ways give numpy's eigenvalues and projections."""
    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (30, 3)):
        x = rng.normal(size=(n, m, 3)) * np.linspace(1, 4, m)[None, :, None]
        t = from_arrays(spark, x, make(spark, [line(*range(m))]).atoms, np.full((n, 3), 50.0))
        flat = x.reshape(n, -1) - x.reshape(n, -1).mean(axis=0)
        want, vectors = np.linalg.eigh(flat.T @ flat / n)
        monkeypatch.setattr(linear, "MOST_FEATURES", 4096)
        assert [r.eigenvalue for r in linear.pca(t, 2).orderBy("component").collect()] == pytest.approx(want[::-1][:2].tolist())
        for most in (4096, max(n, 8) if n < 3 * m else 4096):
            monkeypatch.setattr(linear, "MOST_FEATURES", most)
            got = {(r.frame, r.component): r.value for r in linear.projection(t, 2).collect()}
            for k in range(2):
                v = vectors[:, -1 - k] * np.sign(vectors[np.abs(vectors[:, -1 - k]).argmax(), -1 - k])
                assert [got[f, k] for f in range(n)] == pytest.approx((flat @ v).tolist(), abs=1e-6)
    with pytest.raises(ValueError):
        from_arrays(spark, np.zeros((2, 3)), t.atoms)


def test_multi_tau_lags():
    assert common.multi_tau_lags(4, 3) == [1, 2, 3, 4, 6, 8, 12] and common.multi_tau_lags(16, 1) == list(range(1, 16))


def test_registered_analyses(spark):
    import pandas as pd

    t = make(spark, [line(0, 2), line(1, 5)])
    spread = lambda part: pd.DataFrame({"frame": part["frame"].head(1), "spread": [part["x"].max() - part["x"].min()]})
    register("spread", lambda traj, selection=None: transforms.per_frame(traj, spread, "frame long, spread double", selection))
    assert values(run(t, [{"analysis": "spread"}])["spread"], "spread") == [(2.0,), (4.0,)]
    with pytest.raises(ValueError):
        register("rg", shape.rg)


def test_pucker_phase_against_numpy(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(5, 6, 3)) * (3.0, 2.0, 0.4)
    got = {r.frame: r for r in angles.pucker(make(spark, x.tolist()), None, "amplitude", True).collect()}
    for f in range(5):
        d = x[f] - x[f].mean(axis=0)
        w, v = np.linalg.eigh(d.T @ d / 6)
        n = v[:, 0] * np.sign(v[np.abs(v[:, 0]).argmax(), 0])
        turn = 2 * np.pi * np.arange(6) / 6
        phase = np.degrees(np.arctan2((d @ n * np.sin(turn)).sum(), (d @ n * np.cos(turn)).sum())) % 360
        assert got[f].amplitude == pytest.approx(np.sqrt(w[0]), rel=1e-6) and got[f].phase == pytest.approx(phase, abs=1e-4)


def test_voronoi_cells_fill_the_plane(spark):
    rng = np.random.default_rng(3)
    t = make(spark, [[(*rng.uniform(0, 12, 2), 0.0) for _ in range(15)] for _ in range(2)], box=12.0)
    sheet = t.frames.select("frame", F.col("atom").alias("resid")).withColumn("leaflet", F.when(F.col("resid") < 14, 1).otherwise(0))
    rows = membrane.area(t, None, sheet).collect()
    assert all((r["area"] is None or math.isnan(r["area"])) == (r["resid"] == 14) for r in rows)
    for f in (0, 1):
        cells = {r["resid"]: r["area"] for r in rows if r["frame"] == f and r["resid"] < 14}
        assert math.isclose(sum(cells.values()), 144.0, rel_tol=1e-9)
        seeds = np.array([(r["x"], r["y"]) for r in t.frames.where((F.col("frame") == f) & (F.col("atom") < 14)).orderBy("atom").collect()])
        probe = rng.uniform(0, 12, (40000, 2))
        d = probe[:, None, :] - seeds[None]
        nearest = ((d - np.round(d / 12.0) * 12.0) ** 2).sum(axis=2).argmin(axis=1)
        assert all(abs(cells[i] / 144.0 - (nearest == i).mean()) < 0.01 for i in range(14))


def test_one_lipid_has_the_whole_plane(spark):
    t = make(spark, [[(1, 1, 0)]], box=5.0)
    sheet = spark.createDataFrame([(0, 0, 1)], "frame long, resid long, leaflet long")
    assert values(membrane.area(t, None, sheet), "area") == [(25.0,)]


def test_curved_leaflets_by_contact(spark):
    ring = lambda r, n: [(25 + r * math.cos(2 * math.pi * k / n), 25 + r * math.sin(2 * math.pi * k / n), 25.0) for k in range(n)]
    t = make(spark, [[*ring(12, 40), *ring(6, 20), (25 + 14.5, 25.0, 25.0), (25.0, 25.0, 25.0)]], box=50.0)
    got = dict(values(membrane.curved_leaflets(t, None, 2.2), "resid", "leaflet"))
    assert [got[i] for i in (*range(40), 60)] == [1] * 41 and [got[i] for i in (*range(40, 60), 61)] == [-1] * 21
    flat = make(spark, [line(0, 1, 2)], box=50.0)
    assert {r[0] for r in values(membrane.curved_leaflets(flat, None, 1.5), "leaflet")} == {1}


def test_ions_swap_with_solvent(spark):
    t = make(spark, [line(0, 5, 10, 15), line(1, 6, 11, 16)], box=40.0)
    swap = lambda **k: values(transforms.randomize_ions(t, "resid 0", "resid 1-3", **k), "frame", "atom", "x")
    got = swap(seed=5)
    assert got == swap(seed=5)
    for f, was in ((0, {0, 5, 10, 15}), (1, {1, 6, 11, 16})):
        now = {a: x for g, a, x in got if g == f}
        assert set(now.values()) == was and now[0] != f
    far = swap(seed=5, around="resid 0", by=12.0)
    assert [x for f, a, x in far if a == 0] == [15.0, 16.0]
    with pytest.raises(Exception, match="no residue"):
        swap(around="resid 0", by=30.0)


def test_velocities_are_drawn_alike_everywhere(spark):
    t = make(spark, [[(0, 0, 0)] * 4] * 400)
    a = transforms.set_velocity(t, None, 300.0, 3)
    b = transforms.set_velocity(t.with_frames(t.frames.repartition(7)), None, 300.0, 3)
    assert values(a, "vx", "vy") == values(b, "vx", "vy")
    v = np.array(values(a, "vx", "vy", "vz"))
    assert abs(v.var() - 300.0) < 30.0 and abs(v.mean()) < 1.0 and abs(np.corrcoef(v.T)[0, 1]) < 0.1


def test_bundle_kinks_and_ends_across_the_boundary(spark):
    points = [(9.5, 0, 2), (0.5, 0, 2), (0, 0, 0), (0, 0, -2), (5, 0, 2), (5, 0, 2), (6, 0, 0), (5, 0, -2)]
    t = make(spark, [points], box=10.0, names=["N", "N", "CA", "O"] * 2, chains=["A"] * 4 + ["B"] * 4)
    r = {x["chain"]: x for x in angles.bundle(t, "name N", "name O", "name CA").collect()}
    assert math.isclose(r["B"]["length"], 4.0) and math.isclose(r["B"]["tilt"], 0.0) and math.isclose(r["B"]["kink_angle"], 2 * math.degrees(math.atan(0.5)))
    assert math.isclose(r["A"]["length"], math.hypot(10, 4)) and r["B"]["z_shift"] == 0.0


def test_series_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=30)
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "frame long, v double")
    got = values(series.correlate(s, ["v"], max_lag=5), "corr")
    want = [np.mean(x[: 30 - k] * x[k:]) for k in range(6)]
    assert np.allclose([g[0] for g in got], np.array(want) / want[0])
    m = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (1.0, 5.0)], "lam double, dvdl double")
    assert math.isclose(series.ti(m).collect()[0]["integral"], np.trapezoid([1, 2, 5], [0, 0.5, 1]))
    a, b = (spark.createDataFrame(r, "frame long, resid long, scc double") for r in ([(0, 0, 1.0), (0, 1, 3.0)], [(0, 0, 4.0)]))
    assert values(membrane.scc_weighted(a, b, (1.0, 2.0)), "scc") == [(3.0,), (3.0,)]


def test_solvation_of_empty_selections(spark):
    t = make(spark, [line(0, 1, 2)], box=10.0)
    none, triple = "resname SOL", ("resname SOL and name O", "resname SOL and name N", "resname SOL and name C")
    assert [r["n"] for r in solvation.sorient(t, "resid 0", triple, 3, 1.0).orderBy("bin").collect()] == [0, 0, 0]
    assert solvation.spol_shell(t, "resid 0", none, triple, 0.0, 5.0).collect()[0]["n"] == 0
    assert solvation.ion_pair_corr(t, "resid 0", none, 3.0, 3.0, 2).collect()[0]["ip"] == 1.0
    assert {r["mean"] for r in solvation.free_volume(t, none, "resid 0", 1.0, (2, 2, 2), 1.0).collect()} == {1.0}


def test_all_lags_without_a_parameter(spark):
    s = spark.range(25).select(F.col("id").alias("frame"), F.lit(1.0).alias("v"))
    assert [r.lag for r in series.correlate(s, ["v"]).orderBy("lag").collect()] == list(range(25))
    t = make(spark, [line(i) for i in range(14)], box=100.0)
    assert [r.lag for r in correlation.msd(t).orderBy("lag").collect()] == list(range(1, 14))


def test_defects(spark, tmp_path):
    t = make(spark, [[(0.5, 0.5, 0.5), (2.5, 2.5, 3.0)], [(0.5, 0.5, 0.5), (2.5, 2.5, 1.0)], [(2.5, 2.5, 0.5), (2.5, 2.5, -1.0)]], box=4.0)
    options = {"heights": (0.0, 3.0), "probe": -1.2, "reach": 0.6}
    found = defects.hydrophobic_defects(t, "resid 0", "resid 1", **options)
    assert {tuple(r) for r in found.select("ix", "iy", "iz", "first", "last", "min", "lifetime").collect()} == {(2, 2, 0, 1, 0, 0, 2), (2, 2, 1, 1, 0, 0, 1), (2, 2, 2, 1, 0, 0, 1)}
    frames = defects.hydrophobic_defect_frames(t, "resid 0", "resid 1", **options)
    assert values(frames, "sites", "clusters", "largest", "volume") == [(3, 1, 3, 3.0), (1, 1, 1, 1.0), (0, 0, 0, 0.0)]
    assert sorted(defects.site_clusters({(0, 0, 0), (9, 0, 0), (5, 5, 5), (5, 5, 7)}, 10, 10)) == [1, 1, 2]
    assert defects.height_range(t, "resid 0", "resid 1", 1.0, 1.0) == (-1.5, 5.0)
    points = defects.defect_points(found, 1.0, 0.0, "first")
    defects.write_defect_points(points, str(tmp_path / "xyz"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "xyz")).collect())[0] == "1\t 2.50\t 2.50\t 0.50"
    assert defects.hydrophobic_defects(t.with_frames(t.frames.limit(0)), "resid 0", "resid 1", **options).count() == 0


def test_pair_energies(spark):
    t = make(spark, [line(0, 2, 5)], box=100.0)
    t = replace(t, atoms=t.atoms.withColumns({"sigma": F.lit(1.0), "epsilon": F.lit(0.5)}))
    lj = lambda r, s=1.0, e=0.5: 4 * e * ((s / r) ** 12 - (s / r) ** 6)
    rows = solvation.gist_energies(t, "resid 1 2", "resid 1 2", "resid 0", 4.0).orderBy("resid").collect()
    assert [(r.sw, r.ww) for r in rows] == [(pytest.approx(lj(2) + solvation.COULOMB / 2), pytest.approx((lj(3) + solvation.COULOMB / 3) / 2)), (0.0, pytest.approx((lj(3) + solvation.COULOMB / 3) / 2))]
    own = spark.createDataFrame([(1, 0, 0.0, 3.0, 2.0)], "a long, b long, q double, sigma double, epsilon double")
    rows = solvation.gist_energies(t, "resid 1 2", "resid 1 2", "resid 0", 4.0, exceptions=own).orderBy("resid").collect()
    assert rows[0].sw == pytest.approx(lj(2, 3.0, 2.0))
    r = solvation.interaction_energy(t, "resid 0", exceptions=own).first()
    assert (r.vdw, r.ele) == (pytest.approx(lj(2, 3.0, 2.0) + lj(5)), pytest.approx(solvation.COULOMB / 5))


def test_thin_lags(spark):
    lags = spark.range(41).select(F.col("id").alias("lag"))
    assert [r.lag for r in series.thin_lags(lags, 4, 3, 20, 10).orderBy("lag").collect()] == [0, 1, 2, 3, 4, 6, 9, 12, 15, 18, 30, 40]


def strand(angles_):
    """N, CA, C, O of residues with these phi and psi, by standard lengths and angles."""

    def place(a, b, c, length, angle, turn):
        angle, turn = math.radians(angle), math.radians(turn)
        u = (c - b) / np.linalg.norm(c - b)
        n = np.cross(b - a, u)
        n /= np.linalg.norm(n)
        return c + length * (-math.cos(angle) * u + math.sin(angle) * (math.cos(turn) * np.cross(n, u) + math.sin(turn) * n))

    n, ca = np.zeros(3), np.array([1.458, 0, 0])
    c = ca + 1.525 * np.array([-math.cos(math.radians(111)), math.sin(math.radians(111)), 0])
    out = []
    for k, (_, psi) in enumerate(angles_):
        out += [n, ca, c, place(n, ca, c, 1.231, 120.5, psi + 180)]
        if k + 1 < len(angles_):
            m = place(n, ca, c, 1.329, 116.2, psi)
            a = place(ca, c, m, 1.458, 121.7, 180)
            n, ca, c = m, a, place(c, m, a, 1.525, 111.0, angles_[k + 1][0])
    return [tuple(p) for p in out]


def test_helix(spark):
    helical, stretched = (-57.0, -47.0), (-120.0, 130.0)
    frames = [strand([stretched] * 14), strand([stretched] * 2 + [helical] * 10 + [stretched] * 2), strand([helical] * 14)]
    t = make(spark, frames, names=["N", "CA", "C", "O"] * 14, resids=[i // 4 for i in range(56)])
    none, part, whole = helices.helix(t, every_frame=True).orderBy("frame").collect()
    assert (none.first, none.last, none.radius, none.residue_rmsd) == (-1, -1, None, None)
    # the last residues have no O-N partner but go on from the seed; the end of the chain has no psi
    assert (part.first, part.last) == (2, 11) and (whole.first, whole.last) == (1, 12)
    assert whole.phi == pytest.approx(-57) and whole.psi == pytest.approx(-47)
    assert whole.ellipticity == pytest.approx(12 * 0.44)  # the first weight that is near, not the nearest
    assert abs(whole.radius - 2.3) < 0.1 and abs(whole.twist - 99) < 3 and abs(whole.rise - 1.5) < 0.1 and whole.rmsd < 0.5 and abs(whole.ca_phi - 50) < 5 and abs(whole.hb4 - 2.9) < 0.3
    assert len(whole.residue_rmsd) == 12 and whole.rmsd == pytest.approx(math.sqrt(np.mean(np.square(whole.residue_rmsd))))
    along = helices.helix(t, fit=False, every_frame=True).where("frame = 2").first()
    assert abs(along.twist - 99) < 5 and abs(along.rise - 1.5) < 0.1 and along.length == pytest.approx(whole.length)
    held = helices.helix(t).orderBy("frame").collect()
    assert [(r.first, r.last) for r in held] == [(-1, -1), (2, 11), (2, 11)]
    assert [(r.first, r.last) for r in helices.helix(t, between=(3, 6)).collect()] == [(3, 6)] * 3
    share = {r.resid: r for r in helices.helix_residues(t, every_frame=True).collect()}
    assert [round(share[k].helicity, 3) for k in (0, 1, 2, 11, 12, 13)] == [0, 0.333, 0.667, 0.667, 0.333, 0] and share[0].jcaha is None
    shift = lambda phi, psi: 1.4 * math.sin(math.radians(psi + 138)) - 4.1 * math.cos(2 * math.radians(psi + 138)) + 2 * math.cos(2 * math.radians(phi + 30))
    assert share[5].jcaha == pytest.approx(140.3 + (shift(*stretched) + 2 * shift(*helical)) / 3)
