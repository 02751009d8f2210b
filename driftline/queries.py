"""Registered queries: each operator on the trajectory view of lineitem, with its SQL.

Doubles are rounded to six places on both sides, so that the order of sums
does not tell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import chemistry
from driftline.model import Trajectory, from_lineitem
from driftline.operators import angles, correlation, defects, distances, fluctuation, grids, helices, linear, membrane, radial, series, shape, solvation, transforms

POINTS = """p AS (
  SELECT l_orderkey % 50 AS frame, l_partkey % 40 AS atom,
         CAST(SUM(l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 50000 AS DOUBLE) / 1000 AS x,
         CAST(SUM(l_orderkey*15485863 + l_partkey*7919 + l_linenumber*104729) % 50000 AS DOUBLE) / 1000 AS y,
         CAST(SUM(l_orderkey*104729 + l_partkey*1299709 + l_linenumber*7919) % 50000 AS DOUBLE) / 1000 AS z
  FROM lineitem GROUP BY 1, 2),
t AS (
  SELECT *, CAST(1 + atom % 16 AS DOUBLE) AS mass, atom // 4 AS resid, CASE WHEN atom < 20 THEN 'A' ELSE 'B' END AS chain,
         ['N', 'CA', 'C', 'O'][(atom % 4 + 1)::INT] AS name, ['ALA', 'GLY', 'SOL', 'NA'][((atom // 4) % 4 + 1)::INT] AS resname,
         CASE WHEN atom % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS charge
  FROM p),
fr AS (SELECT range AS frame FROM range(50))"""

REGISTRY: dict[str, Query] = {}


@dataclass
class Query:
    build: Callable[[Trajectory], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(from_lineitem(spark, sf_dir))
        return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def add(name: str, build: Callable[[Trajectory], DataFrame], keys: str = "", values: str = "", body: str | None = None, ctes: str = "") -> None:
    sql = None
    if body is not None:
        out = ", ".join([*keys.split(), *[f"round({v}, 6) + 0.0::DOUBLE AS {v}" for v in values.split()]])
        sql = f"WITH {POINTS}{', ' + ctes if ctes else ''} SELECT {out} FROM ({body})"
    REGISTRY[name] = Query(build, sql)


def uneven(t: Trajectory) -> Trajectory:
    """The view in boxes of 50 x (40 + frame) x (30 + 2 frame)."""
    f = F.col("frame").cast("double")
    return replace(t, boxes=t.boxes.withColumns({"ly": 40.0 + f, "lz": 30.0 + 2.0 * f}))


def tilted(t: Trajectory) -> Trajectory:
    """The same lengths, with vectors (lx, 0, 0), (10, ly, 0), (5, -8, lz)."""
    t = uneven(t)
    cell = F.array(F.col("lx"), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.col("ly"), F.lit(0.0), F.lit(5.0), F.lit(-8.0), F.col("lz"))
    return replace(t, boxes=t.boxes.withColumn("cell", cell))


def _mi(d: str, length: str = "50.0::DOUBLE") -> str:
    return f"(({d}) - round(({d}) / {length}) * {length})"


def _norm(x: str, y: str, z: str) -> str:
    return f"sqrt(({x})*({x}) + ({y})*({y}) + ({z})*({z}))"


def _d(a: str, b: str, pbc: bool = False) -> str:
    """Distance of two aliases with x, y, z."""
    parts = [f"{b}.{c} - {a}.{c}" for c in "xyz"]
    return _norm(*[_mi(x) if pbc else x for x in parts])


def _pairs(where_a: str, where_b: str, pbc: bool = False, rule: str = "a.atom <> b.atom", more: str = "") -> str:
    """CTE body: frame, a, b, dist."""
    return f"SELECT a.frame, a.atom AS a, b.atom AS b, {_d('a', 'b', pbc)} AS dist{more} FROM t a JOIN t b ON a.frame = b.frame WHERE ({where_a}) AND ({where_b}) AND {rule}"


def _centers(**where: str) -> str:
    parts = [f"sum(CASE WHEN {w} THEN {c} END) / sum(CASE WHEN {w} THEN 1.0::DOUBLE END) AS \"{s}{c}\"" for s, w in where.items() for c in "xyz"]
    return f"SELECT frame, {', '.join(parts)} FROM t GROUP BY frame"


def _cdist(a: str, b: str, pbc: bool = False) -> str:
    parts = [f'"{b}{c}" - "{a}{c}"' for c in "xyz"]
    return _norm(*[_mi(x) if pbc else x for x in parts])


CENTERED = "c AS (SELECT frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM t GROUP BY frame), q AS (SELECT t.frame, atom, chain, x-cx AS x, y-cy AS y, z-cz AS z FROM t JOIN c USING (frame))"
TENSOR = "avg(x*x) AS xx, avg(y*y) AS yy, avg(z*z) AS zz, avg(x*y) AS xy, avg(x*z) AS xz, avg(y*z) AS yz"
EIGEN = """e1 AS (SELECT *, (xx+yy+zz)/3 AS m FROM g),
e2 AS (SELECT *, sqrt(((xx-m)*(xx-m)+(yy-m)*(yy-m)+(zz-m)*(zz-m)+2*(xy*xy+xz*xz+yz*yz))/6) AS pp FROM e1),
e3 AS (SELECT *, (((xx-m)/pp)*(((yy-m)/pp)*((zz-m)/pp)-(yz/pp)*(yz/pp)) - (xy/pp)*((xy/pp)*((zz-m)/pp)-(yz/pp)*(xz/pp)) + (xz/pp)*((xy/pp)*(yz/pp)-((yy-m)/pp)*(xz/pp)))/2 AS h FROM e2),
e4 AS (SELECT *, m + 2*pp*cos(acos(greatest(-1, least(1, h)))/3) AS l3, m + 2*pp*cos(acos(greatest(-1, least(1, h)))/3 + 2*pi()/3) AS l1 FROM e3),
e AS (SELECT *, 3*m - l1 - l3 AS l2 FROM e4)"""

# Size and shape
add("radius_of_gyration", lambda t: shape.rg(t), "frame", "rg", "SELECT frame, sqrt(avg(x*x+y*y+z*z)) AS rg FROM q GROUP BY frame", CENTERED)
add("rg_mass_weighted", lambda t: shape.rg(t, "chain A", True), "frame", "rg", "SELECT t.frame, sqrt(sum(mass*((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)))/sum(mass)) AS rg FROM t JOIN (SELECT frame, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM t WHERE chain='A' GROUP BY frame) USING (frame) WHERE chain='A' GROUP BY t.frame")
add("radgyr_tensor", lambda t: shape.radgyr_tensor(t), "frame", "rg xx yy zz xy xz yz", f"SELECT frame, sqrt(avg(x*x+y*y+z*z)) AS rg, {TENSOR} FROM q GROUP BY frame", CENTERED)
add("radgyr", lambda t: shape.radgyr(t), "frame", "rg r_max rg_x rg_y rg_z", "SELECT frame, sqrt(avg(x*x+y*y+z*z)) AS rg, max(sqrt(x*x+y*y+z*z)) AS r_max, sqrt(avg(y*y)+avg(z*z)) AS rg_x, sqrt(avg(x*x)+avg(z*z)) AS rg_y, sqrt(avg(x*x)+avg(y*y)) AS rg_z FROM q GROUP BY frame", CENTERED)
add("shape_descriptors", lambda t: shape.shape_descriptors(t), "frame", "rg l1 l2 l3 asphericity acylindricity anisotropy", "SELECT frame, rg, l1, l2, l3, l3 - 0.5*(l1+l2) AS asphericity, l2 - l1 AS acylindricity, 1.5*(l1*l1+l2*l2+l3*l3)/((l1+l2+l3)*(l1+l2+l3)) - 0.5 AS anisotropy FROM e", f"{CENTERED}, g AS (SELECT frame, sqrt(avg(x*x+y*y+z*z)) AS rg, {TENSOR} FROM q GROUP BY frame), {EIGEN}")
add("center_of_mass", lambda t: shape.center_of_mass(t, "name CA"), "frame", "x y z", "SELECT frame, sum(mass*x)/sum(mass) AS x, sum(mass*y)/sum(mass) AS y, sum(mass*z)/sum(mass) AS z FROM t WHERE name='CA' GROUP BY frame")
add("center_of_geometry", lambda t: shape.center_of_geometry(t, "resid 2-5"), "frame", "x y z", "SELECT frame, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM t WHERE resid BETWEEN 2 AND 5 GROUP BY frame")
add("check_structure", lambda t: shape.check_structure(t), "frame n_bad", "", "SELECT frame, sum(CASE WHEN isnan(x) OR isnan(y) OR isnan(z) OR isinf(x) OR isinf(y) OR isinf(z) THEN 1 ELSE 0 END)::BIGINT AS n_bad FROM t GROUP BY frame")

# The selection language
for k, (expression, where) in enumerate(
    [
        ("protein and not name CA", "resname IN ('ALA','GLY') AND name <> 'CA'"),
        ("backbone or resname NA", "(resname IN ('ALA','GLY') AND name IN ('N','CA','C','O')) OR resname = 'NA'"),
        ("(chain B and resid 5 7:8) or sidechain", "chain = 'B' AND (resid = 5 OR resid BETWEEN 7 AND 8)"),
    ]
):
    add(f"selection_{k}", lambda t, e=expression: transforms.strip(t, e).groupBy("atom").agg(F.count("*").alias("n")), "atom n", "", f"SELECT atom, count(*) AS n FROM t WHERE {where} GROUP BY atom")

# Distances
add("distance_to_point", lambda t: distances.distance_to_point(t, "name CA", (10, 20, 30), True), "frame atom", "dist", f"SELECT frame, atom, {_norm(_mi('x-10'), _mi('y-20'), _mi('z-30'))} AS dist FROM t WHERE name='CA'")
add("distance_to_reference", lambda t: distances.distance_to_reference(t, "chain A", 0), "frame atom", "dist", f"SELECT a.frame, a.atom, {_d('b', 'a')} AS dist FROM t a JOIN t b ON a.atom=b.atom AND b.frame=0 WHERE a.chain='A'")
AB = "c AS (" + _centers(a="chain='A'", b="chain='B'") + ")"
add("distance", lambda t: distances.distance(t, "chain A", "chain B", pbc=True), "frame", "dist", f"SELECT frame, {_cdist('a', 'b', True)} AS dist FROM c", AB)
add("distance_vector", lambda t: distances.distance_vector(t, "chain A", "chain B"), "frame", "dx dy dz", 'SELECT frame, bx-ax AS dx, "by"-ay AS dy, bz-az AS dz FROM c', AB)
add("multi_distance", lambda t: distances.multi_distance(t, [("chain A", "chain B"), ("name CA", "name O")]), "frame", "dist_0 dist_1", f"SELECT frame, {_cdist('a', 'b')} AS dist_0, {_cdist('u', 'v')} AS dist_1 FROM c", "c AS (" + _centers(a="chain='A'", b="chain='B'", u="name='CA'", v="name='O'") + ")")
add("multi_vector", lambda t: distances.multi_vector(t, [("chain A", "chain B")], ["name CA"]), "frame", "v0_x v0_y v0_z c0_x c0_y c0_z", 'SELECT frame, bx-ax AS v0_x, "by"-ay AS v0_y, bz-az AS v0_z, ux AS c0_x, uy AS c0_y, uz AS c0_z FROM c', "c AS (" + _centers(a="chain='A'", b="chain='B'", u="name='CA'") + ")")
add("vector", lambda t: distances.distance_vector(t, "name CA", "name O", pbc=True), "frame", "dx dy dz", f"SELECT frame, {_mi('vx-ux')} AS dx, {_mi('vy-uy')} AS dy, {_mi('vz-uz')} AS dz FROM c", "c AS (" + _centers(u="name='CA'", v="name='O'") + ")")
add("distance_center_to_point", lambda t: distances.distance_center_to_point(t, "chain A", (10, 20, 30)), "frame", "dist", f"SELECT frame, {_norm('ax-10', 'ay-20', 'az-30')} AS dist FROM c", AB)
add("distance_center_to_reference", lambda t: distances.distance_center_to_reference(t, "chain A", 0), "frame", "dist", f"SELECT c.frame, {_norm('c.ax-r.ax', 'c.ay-r.ay', 'c.az-r.az')} AS dist FROM c, c r WHERE r.frame=0", AB)
add("lowestcurve", lambda t: distances.lowestcurve(t, "chain A", "chain B"), "", "lowest", f"SELECT min({_cdist('a', 'b')}) AS lowest FROM c", AB)
add("pairwise_distance", lambda t: distances.pairwise_distance(t, "name CA", "name O", True), "frame a b", "dist", _pairs("a.name='CA'", "b.name='O'", True, "true"))
add("pair_list_distance", lambda t: distances.pair_list_distance(t, [(0, 5), (7, 31)], True), "frame pair", "dist", f"SELECT a.frame, CASE WHEN a.atom=0 THEN 0 ELSE 1 END AS pair, {_d('a', 'b', True)} AS dist FROM t a JOIN t b ON a.frame=b.frame AND ((a.atom=0 AND b.atom=5) OR (a.atom=7 AND b.atom=31))")
add("drid", lambda t: distances.drid(t, "name CA"), "frame atom", "m1 m2 m3", "SELECT frame, a AS atom, m1, sqrt(v) AS m2, sign(s)*pow(abs(s), 1.0/3) AS m3 FROM (SELECT frame, a, any_value(m1) AS m1, avg((1/dist-m1)*(1/dist-m1)) AS v, avg((1/dist-m1)*(1/dist-m1)*(1/dist-m1)) AS s FROM pr JOIN (SELECT frame, a, avg(1/dist) AS m1 FROM pr GROUP BY frame, a) USING (frame, a) GROUP BY frame, a)", "pr AS (" + _pairs("a.name='CA'", "b.name='CA'") + ")")
add("mindist", lambda t: distances.mindist(t, "name CA", "name O", True), "frame", "dist", "SELECT frame, coalesce(d, 0) AS dist FROM fr LEFT JOIN (SELECT frame, min(dist) AS d FROM pr GROUP BY frame) USING (frame)", "pr AS (" + _pairs("a.name='CA'", "b.name='O'", True, "true") + ")")
add("pairdist_extrema_min", lambda t: distances.pairdist_extrema(t, "name CA", "name CA", pbc=True, cutoff=12.0, empty=-1.0), "frame", "dist", "SELECT frame, coalesce(d, -1) AS dist FROM fr LEFT JOIN (SELECT frame, min(dist) AS d FROM pr WHERE dist <= 12 GROUP BY frame) USING (frame)", "pr AS (" + _pairs("a.name='CA'", "b.name='CA'", True) + ")")
add("pairdist_extrema_max", lambda t: distances.pairdist_extrema(t, "name CA", "name CA", largest=True), "frame", "dist", "SELECT frame, max(dist) AS dist FROM pr GROUP BY frame", "pr AS (" + _pairs("a.name='CA'", "b.name='CA'") + ")")
add("hausdorff", lambda t: distances.hausdorff(t, "name CA", "name O", True), "frame", "dist", "SELECT frame, greatest((SELECT max(m) FROM (SELECT min(dist) AS m FROM pr WHERE pr.frame=fr.frame GROUP BY a)), (SELECT max(m) FROM (SELECT min(dist) AS m FROM pr WHERE pr.frame=fr.frame GROUP BY b))) AS dist FROM fr", "pr AS (" + _pairs("a.name='CA'", "b.name='O'", True, "true") + ")")
add("closest_atom", lambda t: distances.closest_atom(t, "name CA", (10, 20, 30)), "frame atom", "", f"SELECT frame, atom FROM (SELECT frame, atom, row_number() OVER (PARTITION BY frame ORDER BY {_norm('x-10', 'y-20', 'z-30')}, atom) AS k FROM t WHERE name='CA') WHERE k=1")
NEAR = "pr AS (" + _pairs("a.resname='NA'", "b.resname='SOL'", True, "true") + ")"
add("search_neighbors", lambda t: distances.search_neighbors(t, "resname NA", "resname SOL", 9.0, True), "frame n", "", "SELECT frame, coalesce(n, 0) AS n FROM fr LEFT JOIN (SELECT frame, count(DISTINCT b) AS n FROM pr WHERE dist <= 9 GROUP BY frame) USING (frame)", NEAR)
add("search_neighbor_list", lambda t: distances.search_neighbor_list(t, "resname NA", "resname SOL", 9.0, True).withColumn("atoms", F.array_join("atoms", " ")), "frame atoms n", "", "SELECT frame, string_agg(b::VARCHAR, ' ' ORDER BY b) AS atoms, count(*) AS n FROM (SELECT DISTINCT frame, b FROM pr WHERE dist <= 9) GROUP BY frame", NEAR)
add("watershell", lambda t: distances.watershell(t, "resname NA", "resname SOL", 6.0, 12.0, True), "frame n_lower n_upper", "", "SELECT frame, coalesce(l, 0) AS n_lower, coalesce(u, 0) AS n_upper FROM fr LEFT JOIN (SELECT frame, count(DISTINCT CASE WHEN dist <= 6 THEN b END) AS l, count(DISTINCT CASE WHEN dist <= 12 THEN b END) AS u FROM pr GROUP BY frame) USING (frame)", NEAR)
add("closest", lambda t: distances.closest(t, "resname NA", "resname SOL", 3, True), "frame rank atom", "dist", "SELECT frame, rank, b AS atom, dist FROM (SELECT frame, b, dist, row_number() OVER (PARTITION BY frame ORDER BY dist, b) AS rank FROM (SELECT frame, b, min(dist) AS dist FROM pr GROUP BY frame, b)) WHERE rank <= 3", NEAR)
add("closest_coords", lambda t: distances.closest_coords(t, "resname NA", "resname SOL", 2, True), "frame atom", "x y z", "SELECT t.frame, t.atom, x, y, z FROM t WHERE resname='NA' OR (t.frame, t.atom) IN (SELECT (frame, b) FROM (SELECT frame, b, row_number() OVER (PARTITION BY frame ORDER BY dist, b) AS rank FROM (SELECT frame, b, min(dist) AS dist FROM pr GROUP BY frame, b)) WHERE rank <= 2)", NEAR)
add("native_contacts", lambda t: distances.native_contacts(t, "chain A", "chain B", 15.0, reference=0), "frame", "fraction", "SELECT frame, coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM ref) AS fraction FROM fr LEFT JOIN (SELECT frame, count(*) AS n FROM pr JOIN ref USING (a, b) WHERE dist <= 15 GROUP BY frame) USING (frame)", "pr AS (" + _pairs("a.chain='A'", "b.chain='B'") + "), ref AS (SELECT a, b FROM pr WHERE frame=0 AND dist <= 15)")
add("atom_map", lambda t: distances.atom_map(t, "name CA", "name O"), "frame atom nearest", "", "SELECT frame, a AS atom, arg_min(b, (dist, b)) AS nearest FROM pr GROUP BY frame, a", "pr AS (" + _pairs("a.name='CA'", "b.name='O'", False, "true") + ")")
add("hbond", lambda t: distances.hbond(t, "name N", "name O", 8.0), "frame n", "", "SELECT frame, coalesce(n, 0) AS n FROM fr LEFT JOIN (SELECT frame, count(*) AS n FROM pr WHERE dist <= 8 GROUP BY frame) USING (frame)", "pr AS (" + _pairs("a.name='N'", "b.name='O'") + ")")
add("mdmat", lambda t: distances.mdmat(t, "chain A", True, 20.0), "a_resid b_resid", "dist", "SELECT a_resid, b_resid, avg(least(m, 20.0)) AS dist FROM (SELECT frame, a_resid, b_resid, min(dist) AS m FROM pr GROUP BY ALL) GROUP BY ALL", "pr AS (" + _pairs("a.chain='A'", "b.chain='A'", True, "a.resid <> b.resid", ", a.resid AS a_resid, b.resid AS b_resid") + ")")
add("matrix_distance", lambda t: distances.matrix_distance(t, "name CA"), "a b", "dist", "SELECT a, b, avg(dist) AS dist FROM pr GROUP BY a, b", "pr AS (" + _pairs("a.name='CA'", "b.name='CA'") + ")")
add("saltbr", lambda t: distances.saltbr(t, None, 15.0), "a_resid b_resid kind n_contact", "dist", f"SELECT a.resid AS a_resid, b.resid AS b_resid, '+-' AS kind, sum(CASE WHEN {_d('a', 'b')} <= 15 THEN 1 ELSE 0 END)::BIGINT AS n_contact, avg({_d('a', 'b')}) AS dist FROM g a JOIN g b ON a.frame=b.frame AND a.resid < b.resid GROUP BY a.resid, b.resid", "g AS (SELECT frame, resid, sum(x)/count(*) AS x, sum(y)/count(*) AS y, sum(z)/count(*) AS z FROM t GROUP BY frame, resid)")

# Angles
ANG = "c AS (" + _centers(a="chain='A'", b="name='O'", e="chain='B'") + ")"
_angle = lambda: "degrees(acos(greatest(-1, least(1, ((ax-bx)*(ex-bx)+(ay-\"by\")*(ey-\"by\")+(az-bz)*(ez-bz)) / (" + _norm("ax-bx", 'ay-"by"', "az-bz") + "*" + _norm("ex-bx", 'ey-"by"', "ez-bz") + ")))))"
add("angle", lambda t: angles.angle(t, "chain A", "name O", "chain B"), "frame", "angle", f"SELECT frame, {_angle()} AS angle FROM c", ANG)
add("multi_angle", lambda t: angles.multi_angle(t, [("chain A", "name O", "chain B")]), "frame", "angle_0", f"SELECT frame, {_angle()} AS angle_0 FROM c", ANG)


def _dihedral_sql(a: str, b: str, c: str, d: str, back: bool = False) -> str:
    """From four prefixes of coordinate columns (a prefix may end in a dot)."""
    q = lambda p, k: f'{p}"{k}"' if p.endswith(".") else f'"{p}{k}"'
    v = [[f"({q(n, k)}-{q(m, k)})" for k in "xyz"] for m, n in ((a, b), (b, c), (c, d))]
    if back:
        v[0] = [f"(-{k})" for k in v[0]]
    cr = lambda u, w: [f"({u[1]}*{w[2]}-{u[2]}*{w[1]})", f"({u[2]}*{w[0]}-{u[0]}*{w[2]})", f"({u[0]}*{w[1]}-{u[1]}*{w[0]})"]
    do = lambda u, w: f"({u[0]}*{w[0]}+{u[1]}*{w[1]}+{u[2]}*{w[2]})"
    n1, n2 = cr(v[0], v[1]), cr(v[1], v[2])
    return f"degrees(atan2({_norm(*v[1])}*{do(v[0], n2)}, {do(n1, n2)}))"


QUAD = "c AS (" + _centers(a="resid=0", b="resid=3", g="resid=6", h="resid=9") + ")"
R4 = ("resid 0", "resid 3", "resid 6", "resid 9")
DI = _dihedral_sql("a", "b", "g", "h")
add("dihedral", lambda t: angles.dihedral(t, *R4), "frame", "dihedral", f"SELECT frame, {DI} AS dihedral FROM c", QUAD)
add("multidihedral", lambda t: angles.multidihedral(t, [R4], range360=True), "frame", "dihedral_0", f"SELECT frame, CASE WHEN {DI} < 0 THEN {DI} + 360 ELSE {DI} END AS dihedral_0 FROM c", QUAD)
add("permute_dihedrals", lambda t: angles.multidihedral(t, [R4, R4[::-1]]), "frame", "dihedral_0 dihedral_1", f"SELECT frame, {DI} AS dihedral_0, {_dihedral_sql('h', 'g', 'b', 'a')} AS dihedral_1 FROM c", QUAD)
add("dihedral_rms", lambda t: angles.dihedral_rms(t, [R4], 0), "frame", "rms", f"SELECT frame, abs({_mi('d - r', '360.0::DOUBLE')}) AS rms FROM (SELECT frame, {DI} AS d, (SELECT {DI} FROM c WHERE frame=0) AS r FROM c)", QUAD)
add("check_chirality", lambda t: angles.check_chirality(t, [R4]), "frame", "volume_0", 'SELECT frame, ((("by"-ay)*(gz-az)-(bz-az)*(gy-ay))*(hx-ax) + ((bz-az)*(gx-ax)-(bx-ax)*(gz-az))*(hy-ay) + ((bx-ax)*(gy-ay)-("by"-ay)*(gx-ax))*(hz-az)) AS volume_0 FROM c', QUAD)
RES = "r AS (SELECT frame, chain, resid, " + ", ".join(f"max(CASE WHEN name='{n}' THEN {k} END) AS {n.lower()}_{k}" for n in ("N", "CA", "C") for k in "xyz") + " FROM t GROUP BY frame, chain, resid), w AS (SELECT *, " + ", ".join(f"lag(c_{k}) OVER v AS p_{k}, lead(n_{k}) OVER v AS q_{k}" for k in "xyz") + " FROM r WINDOW v AS (PARTITION BY frame, chain ORDER BY resid))"
add("rama", lambda t: angles.rama(t), "frame chain resid", "phi psi", f"SELECT frame, chain, resid, {_dihedral_sql('p_', 'n_', 'ca_', 'c_', True)} AS phi, {_dihedral_sql('n_', 'ca_', 'c_', 'q_', True)} AS psi FROM w", RES)
QUADS = "n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY atom) - 1 AS pos FROM t), u AS (SELECT frame, pos // 4 AS quad, count(*) AS n, " + ", ".join(f"max(CASE WHEN pos%4={i} THEN {k} END) AS p{i}{k}" for i in range(4) for k in "xyz") + f" FROM n GROUP BY 1, 2), th AS (SELECT frame, quad, {_dihedral_sql('p0', 'p1', 'p2', 'p3')} AS th FROM u WHERE n=4), st AS (SELECT frame, quad, CASE WHEN abs(th)>150 THEN 'trans' WHEN abs(th)<30 THEN 'cis' WHEN th>0 THEN 'g_plus' ELSE 'g_minus' END AS s FROM th)"
add("tordiff", lambda t: angles.tordiff(t), "frame", "trans cis g_plus g_minus", "SELECT frame, " + ", ".join(f"avg((s='{s}')::INT) AS {s}" for s in angles.STATES) + " FROM st GROUP BY frame", QUADS)
add("toroidal_diffusion", lambda t: angles.toroidal_transitions(t, None, 2), "source target n", "", "SELECT source, target, count(*) AS n FROM (SELECT s AS target, lag(s, 2) OVER (PARTITION BY quad ORDER BY frame) AS source FROM st) WHERE source IS NOT NULL GROUP BY ALL", QUADS)
add("pucker", lambda t: angles.pucker(t, "resid 0 1"), "frame", "radius", f"SELECT t.frame, max({_norm('x-ax', 'y-ay', 'z-az')}) AS radius FROM t JOIN c USING (frame) WHERE resid IN (0, 1) GROUP BY t.frame", "c AS (" + _centers(a="resid IN (0, 1)") + ")")

# Polymers
BONDS = "b AS (SELECT *, " + _norm("dx", "dy", "dz") + " AS length FROM (SELECT frame, chain, row_number() OVER v - 1 AS k, " + ", ".join(f"lead({k}) OVER v - {k} AS d{k}" for k in "xyz") + " FROM t WINDOW v AS (PARTITION BY frame, chain ORDER BY resid, atom)) WHERE dx IS NOT NULL)"
add("polymer_chain_rg", lambda t: shape.chain_rg(t), "frame chain", "rg", "SELECT frame, chain, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) AS rg FROM t GROUP BY frame, chain")
add("polymer_contour_length", lambda t: angles.contour_length(t), "frame chain", "contour", "SELECT frame, chain, sum(length) AS contour FROM b GROUP BY frame, chain", BONDS)
add("polymer_end_to_end", lambda t: angles.end_to_end(t), "frame chain", "dist", "SELECT frame, chain, " + _norm("arg_max(x, atom) - arg_min(x, atom)", "arg_max(y, atom) - arg_min(y, atom)", "arg_max(z, atom) - arg_min(z, atom)") + " AS dist FROM t GROUP BY frame, chain")
add("polymer_bond_length", lambda t: angles.bond_length_distribution(t, None, 20, 50.0), "bin n", "", "SELECT range AS bin, coalesce(n, 0) AS n FROM range(20) LEFT JOIN (SELECT floor(length/2.5)::BIGINT AS bin, count(*) AS n FROM b WHERE length < 50 GROUP BY 1) ON bin = range", BONDS)
add("polymer_bond_angle", lambda t: angles.bond_angle_distribution(t, None, 18), "bin n", "", "SELECT range AS bin, coalesce(n, 0) AS n FROM range(18) LEFT JOIN (SELECT floor(th/10)::BIGINT AS bin, count(*) AS n FROM (SELECT degrees(acos(greatest(-1, least(1, -(dx*ex+dy*ey+dz*ez)/(length*l2))))) AS th FROM (SELECT *, lead(dx) OVER v AS ex, lead(dy) OVER v AS ey, lead(dz) OVER v AS ez, lead(length) OVER v AS l2 FROM b WINDOW v AS (PARTITION BY frame, chain ORDER BY k)) WHERE ex IS NOT NULL) WHERE th < 180 GROUP BY 1) ON bin = range", BONDS)
CORR = "k AS (SELECT v.k - u.k AS k, avg((u.dx*v.dx+u.dy*v.dy+u.dz*v.dz)/(u.length*v.length)) AS corr FROM b u JOIN b v ON u.frame=v.frame AND u.chain=v.chain AND v.k >= u.k GROUP BY 1)"
add("polymer_bond_correlation", lambda t: angles.bond_correlation(t), "k", "corr", "SELECT k, corr FROM k", f"{BONDS}, {CORR}")
add("polymer_persistence_length", lambda t: angles.persistence_length(t), "", "bond persistence kuhn", "SELECT any_value(m) AS bond, -1/regr_slope(ln(corr), m*k) AS persistence, -2/regr_slope(ln(corr), m*k) AS kuhn FROM k, (SELECT avg(length) AS m FROM b) WHERE corr > 0", f"{BONDS}, {CORR}")

# Fluctuations and deviations
add("rmsf", lambda t: fluctuation.rmsf(t), "atom", "rmsf", "SELECT atom, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) AS rmsf FROM t GROUP BY atom")
add("atomicfluct", lambda t: fluctuation.rmsf(t, "name CA"), "atom", "rmsf", "SELECT atom, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) AS rmsf FROM t WHERE name='CA' GROUP BY atom")
add("bfactors", lambda t: fluctuation.bfactors(t), "atom", "bfactor", "SELECT atom, 8*pi()*pi()/3*(var_pop(x)+var_pop(y)+var_pop(z)) AS bfactor FROM t GROUP BY atom")
add("atomic_adp", lambda t: fluctuation.atomic_adp(t), "atom", "uxx uyy uzz uxy uxz uyz", "SELECT atom, var_pop(x) AS uxx, var_pop(y) AS uyy, var_pop(z) AS uzz, covar_pop(x, y) AS uxy, covar_pop(x, z) AS uxz, covar_pop(y, z) AS uyz FROM t GROUP BY atom")
for alias in ("mean_structure", "get_average_frame", "make_structure"):
    add(alias, lambda t: fluctuation.mean_structure(t), "atom", "x y z", "SELECT atom, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM t GROUP BY atom")
SQ = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
add("rmsd", lambda t: fluctuation.rmsd(t, "chain A", 0), "frame", "rmsd", f"SELECT a.frame, sqrt(avg({SQ})) AS rmsd FROM t a JOIN t b ON a.atom=b.atom AND b.frame=0 WHERE a.chain='A' GROUP BY a.frame")
add("rmsd_perres", lambda t: fluctuation.rmsd_perres(t, None, 0), "frame resid", "rmsd", f"SELECT a.frame, a.resid, sqrt(avg({SQ})) AS rmsd FROM t a JOIN t b ON a.atom=b.atom AND b.frame=0 GROUP BY a.frame, a.resid")
add("distance_rmsd", lambda t: fluctuation.distance_rmsd(t, "name CA", 0), "frame", "rmsd", "SELECT u.frame, sqrt(avg((u.dist-v.dist)*(u.dist-v.dist))) AS rmsd FROM pr u JOIN pr v ON u.a=v.a AND u.b=v.b AND v.frame=0 GROUP BY u.frame", "pr AS (" + _pairs("a.name='CA'", "b.name='CA'", False, "a.atom < b.atom") + ")")
add("pairwise_rmsd", lambda t: fluctuation.pairwise_rmsd(t, "name CA"), "f1 f2", "rmsd", f"SELECT a.frame AS f1, b.frame AS f2, sqrt(avg({SQ})) AS rmsd FROM t a JOIN t b ON a.atom=b.atom AND a.frame < b.frame WHERE a.name='CA' GROUP BY 1, 2")
add("symmrmsd", lambda t: fluctuation.symmrmsd(t, [[0, 1]], "resid 0", 0), "frame", "rmsd", "SELECT frame, sqrt(least(s00 + s11, s01 + s10) / 4 + r / 4) AS rmsd FROM (SELECT a.frame, " + ", ".join(f"sum(CASE WHEN a.atom={i} AND b.atom={j} THEN {SQ} END) AS s{i}{j}" for i in (0, 1) for j in (0, 1)) + f", sum(CASE WHEN a.atom=b.atom AND a.atom > 1 THEN {SQ} ELSE 0 END) AS r FROM t a JOIN t b ON b.frame=0 AND b.resid=0 WHERE a.resid=0 GROUP BY a.frame)")
FEAT = "f AS (SELECT frame, atom*3 + k AS feature, [x, y, z][(k+1)::INT] AS value FROM t, range(3) r(k) WHERE name='CA')"
add("matrix_covariance", lambda t: fluctuation.matrix_covariance(t, "name CA"), "i j", "cov", "SELECT a.feature AS i, b.feature AS j, covar_pop(a.value, b.value) AS cov FROM f a JOIN f b ON a.frame=b.frame GROUP BY 1, 2", FEAT)
add("matrix_correlation", lambda t: fluctuation.matrix_correlation(t, "name CA"), "a b", "corr", "SELECT a.atom AS a, b.atom AS b, (covar_pop(a.x,b.x)+covar_pop(a.y,b.y)+covar_pop(a.z,b.z))/sqrt((var_pop(a.x)+var_pop(a.y)+var_pop(a.z))*(var_pop(b.x)+var_pop(b.y)+var_pop(b.z))) AS corr FROM t a JOIN t b ON a.frame=b.frame WHERE a.name='CA' AND b.name='CA' GROUP BY 1, 2")

# Transforms
add("strip", lambda t: transforms.strip(t, "name CA"), "frame atom", "x y z", "SELECT frame, atom, x, y, z FROM t WHERE name='CA'")
add("translate", lambda t: transforms.translate(t, (1.0, -2.0, 0.5)), "frame atom", "x y z", "SELECT frame, atom, x+1 AS x, y-2 AS y, z+0.5 AS z FROM t")
add("scale", lambda t: transforms.scale(t, 0.1), "frame atom", "x y z", "SELECT frame, atom, x*0.1 AS x, y*0.1 AS y, z*0.1 AS z FROM t")
add("rotate", lambda t: transforms.rotate(t, [0, -1, 0, 1, 0, 0, 0, 0, 1]), "frame atom", "x y z", "SELECT frame, atom, -y AS x, x AS y, z FROM t")
add("transform", lambda t: transforms.transform(t, [0, -1, 0, 1, 0, 0, 0, 0, 1], (5, 6, 7)), "frame atom", "x y z", "SELECT frame, atom, 5-y AS x, x+6 AS y, z+7 AS z FROM t")
add("center", lambda t: transforms.center(t, "chain A"), "frame atom", "x y z", "SELECT t.frame, atom, x-ax AS x, y-ay AS y, z-az AS z FROM t JOIN c USING (frame)", AB)
add("center_in_box", lambda t: transforms.center(t, "chain A", "box"), "frame atom", "x y z", "SELECT t.frame, atom, x+25-ax AS x, y+25-ay AS y, z+25-az AS z FROM t JOIN c USING (frame)", AB)
for alias in ("image", "autoimage", "fiximagedbonds"):
    add(alias, lambda t: transforms.image(t.with_frames(transforms.translate(t, (30.0, -30.0, 70.0))), "chain A"), "frame atom", "x y z", "SELECT frame, atom, CASE WHEN chain='A' THEN x-floor(x/50)*50 ELSE x END AS x, CASE WHEN chain='A' THEN y-floor(y/50)*50 ELSE y END AS y, CASE WHEN chain='A' THEN z-floor(z/50)*50 ELSE z END AS z FROM (SELECT frame, atom, chain, x+30 AS x, y-30 AS y, z+70 AS z FROM t)")
add("replicate_cell", lambda t: transforms.replicate_cell(t, (2, 1, 2), "name CA"), "frame atom ix iy iz", "x y z", "SELECT frame, atom, i AS ix, 0::BIGINT AS iy, k AS iz, x+50*i AS x, y, z+50*k AS z FROM t, range(2) a(i), range(2) b(k) WHERE name='CA'")
add("xtalsymm", lambda t: transforms.xtalsymm(t, [[1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0], [-1, 0, 0, 25, 0, -1, 0, 0, 0, 0, 1, 25]], "name CA"), "frame atom op", "x y z", "SELECT frame, atom, op, CASE op WHEN 0 THEN x ELSE 25-x END AS x, CASE op WHEN 0 THEN y ELSE -y END AS y, CASE op WHEN 0 THEN z ELSE z+25 END AS z FROM t, range(2) r(op) WHERE name='CA'")
#: Boxes of unequal lengths, and skewed ones, for the queries that look at nothing else.
add("volume", lambda t: transforms.volume(uneven(t)), "frame", "volume", "SELECT frame, 50.0::DOUBLE*(40+frame)*(30+2*frame) AS volume FROM fr")
add("volume_skewed", lambda t: transforms.volume(tilted(t)), "frame", "volume", "SELECT frame, 50.0::DOUBLE*(40+frame)*(30+2*frame) AS volume FROM fr")
VEL = "v AS (SELECT frame, atom, " + ", ".join(f"coalesce(({k} - lag({k}) OVER w) / ((frame - lag(frame) OVER w) * 2.0), 0.0) AS v{k}" for k in "xyz") + ", row_number() OVER w AS pos FROM t WINDOW w AS (PARTITION BY atom ORDER BY frame))"
add("get_velocity", lambda t: transforms.get_velocity(t), "frame atom", "vx vy vz", "SELECT frame, atom, vx, vy, vz FROM v", VEL)
add("runningavg", lambda t: transforms.runningavg(t, None, 5), "frame atom", "x y z", "SELECT frame, atom, avg(x) OVER w AS x, avg(y) OVER w AS y, avg(z) OVER w AS z FROM t WINDOW w AS (PARTITION BY atom ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
add("runningavg_cumulative", lambda t: transforms.runningavg(t, "name CA"), "frame atom", "x y z", "SELECT frame, atom, avg(x) OVER w AS x, avg(y) OVER w AS y, avg(z) OVER w AS z FROM t WHERE name='CA' WINDOW w AS (PARTITION BY atom ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
add("frame_stride", lambda t: transforms.select_frames(t, 3, 40, 4), "frame atom", "x y z", "SELECT frame, atom, x, y, z FROM t WHERE frame >= 3 AND frame < 40 AND (frame-3) % 4 = 0")
add("frame_pick", lambda t: transforms.pick_frames(t, [5, -1, 5, 99]), "position frame atom", "x y z", "SELECT position, frame, atom, x, y, z FROM t JOIN (VALUES (0::BIGINT, 5), (1, 49), (2, 5)) v(position, f) ON frame = f")

# Radial distributions
CAO = "pr AS (" + _pairs("a.name='CA'", "b.name='O'", True) + ")"
HIST = "h AS (SELECT range AS bin, coalesce(n, 0) AS n FROM range(20) LEFT JOIN (SELECT floor(dist/1.0)::BIGINT AS b, count(*) AS n FROM pr WHERE dist < 20 GROUP BY 1) ON b = range)"
add("pairdist_histogram", lambda t: radial.pairdist_histogram(t, "name CA", "name O", 20, 20.0, True), "bin n", "", "SELECT bin, n FROM h", f"{CAO}, {HIST}")
add("rdf", lambda t: radial.rdf(t, "name CA", "name O", 20, 20.0), "bin n", "r g integral", "SELECT bin, n, bin+0.5 AS r, n/(500*4.0/3*pi()*((bin+1)**3-bin**3)*10/125000) AS g, sum(n) OVER (ORDER BY bin)/500.0 AS integral FROM h", f"{CAO}, {HIST}")
add("pairdist", lambda t: radial.pairdist(t, "name CA", "name O", 20, 20.0, True), "bin", "mean std", "SELECT range AS bin, avg(coalesce(n, 0)) AS mean, stddev_samp(coalesce(n, 0)) AS std FROM range(20) CROSS JOIN fr LEFT JOIN (SELECT frame, floor(dist)::BIGINT AS b, count(*) AS n FROM pr WHERE dist < 20 GROUP BY 1, 2) k ON k.b = range AND k.frame = fr.frame GROUP BY range", CAO)
add("pairdist_dynamic", lambda t: radial.pairdist_dynamic(t, "name CA", "name O", 2.5, True), "bin n", "", "SELECT floor(dist/2.5)::BIGINT AS bin, count(*) AS n FROM pr GROUP BY 1", CAO)
add("structure_factor", lambda t: radial.structure_factor(t, "name CA", 20, 20.0, 10, 3.0), "k", "s", "SELECT range AS k, 1 + 4*pi()*(10/125000.0::DOUBLE)*sum((n/(500*(10/125000.0::DOUBLE)*4*pi()*(bin+0.5)**2) - 1)*sin(range*0.3*(bin+0.5))/(range*0.3*(bin+0.5))*(bin+0.5)**2) AS s FROM h, range(1, 11) GROUP BY range", "pr AS (" + _pairs("a.name='CA'", "b.name='CA'", True) + f"), {HIST}")

# Time correlation
GC = "g0 AS (SELECT frame, resid, sum(mass*x)/sum(mass) AS x, sum(mass*y)/sum(mass) AS y, sum(mass*z)/sum(mass) AS z FROM t GROUP BY frame, resid), g1 AS (SELECT frame, resid, " + ", ".join(f"coalesce({_mi(f'{k} - lag({k}) OVER w')}, {k}) AS {k}" for k in "xyz") + " FROM g0 WINDOW w AS (PARTITION BY resid ORDER BY frame)), g AS (SELECT resid, row_number() OVER w - 1 AS idx, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(z) OVER w AS z FROM g1 WINDOW w AS (PARTITION BY resid ORDER BY frame))"
add("msd_multi", lambda t: correlation.msd(t, max_lag=8), "lag", "x y z total", "SELECT b.idx-a.idx AS lag, avg((b.x-a.x)*(b.x-a.x)) AS x, avg((b.y-a.y)*(b.y-a.y)) AS y, avg((b.z-a.z)*(b.z-a.z)) AS z, avg((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) AS total FROM g a JOIN g b ON a.resid=b.resid AND b.idx-a.idx BETWEEN 1 AND 8 GROUP BY 1", GC)
add("lipid_msd", lambda t: correlation.lipid_msd(t, None, 5), "resid lag", "msd", "SELECT a.resid, b.i-a.i AS lag, avg((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS msd FROM m a JOIN m b ON a.resid=b.resid AND b.i-a.i BETWEEN 1 AND 5 GROUP BY 1, 2", "m AS (SELECT resid, row_number() OVER (PARTITION BY resid ORDER BY frame) AS i, avg(x) AS x, avg(y) AS y FROM t GROUP BY frame, resid)")
DEV = "d AS (SELECT a.atom, a.frame, row_number() OVER (PARTITION BY a.atom ORDER BY a.frame) - 1 AS i, a.x-b.x AS x, a.y-b.y AS y, a.z-b.z AS z FROM t a JOIN t b ON a.atom=b.atom AND b.frame=0 WHERE a.name='CA')"
add("atomiccorr", lambda t: correlation.atomiccorr(t, "name CA", 0, 6), "lag", "corr", "SELECT lag, avg(s) AS corr FROM (SELECT b.i-a.i AS lag, a.i, sum(a.x*b.x+a.y*b.y+a.z*b.z) AS s FROM d a JOIN d b ON a.atom=b.atom AND b.i-a.i BETWEEN 0 AND 6 GROUP BY 1, 2) GROUP BY lag", DEV)
add("xcorr", lambda t: correlation.xcorr(t, "chain A", "chain B", 6), "lag", "corr", 'SELECT v.frame-u.frame AS lag, avg((u.ax-o.ax)*(v.bx-o.bx)+(u.ay-o.ay)*(v."by"-o."by")+(u.az-o.az)*(v.bz-o.bz)) AS corr FROM c u JOIN c v ON v.frame-u.frame BETWEEN 0 AND 6 JOIN c o ON o.frame=0 GROUP BY 1', AB)
add("velocityautocorr", lambda t: correlation.velocityautocorr(t, "name CA", 6), "lag", "vacf", "SELECT b.pos-a.pos AS lag, avg(a.vx*b.vx+a.vy*b.vy+a.vz*b.vz) AS vacf FROM v a JOIN v b ON a.atom=b.atom AND b.pos-a.pos BETWEEN 0 AND 6 WHERE a.pos > 1 AND a.atom % 4 = 1 GROUP BY 1", VEL)
ROT = "o AS (SELECT a.resid, row_number() OVER (PARTITION BY a.resid ORDER BY a.frame) AS i, " + ", ".join(f"(b.{k}-a.{k})/{_d('a', 'b')} AS {k}" for k in "xyz") + " FROM t a JOIN t b ON a.frame=b.frame AND a.resid=b.resid AND a.name='N' AND b.name='O')"
add("rotacf", lambda t: correlation.rotacf(t, "name N", "name O", max_lag=6), "lag", "p1 p2", "SELECT b.i-a.i AS lag, avg(a.x*b.x+a.y*b.y+a.z*b.z) AS p1, avg(1.5*(a.x*b.x+a.y*b.y+a.z*b.z)**2-0.5) AS p2 FROM o a JOIN o b ON a.resid=b.resid AND b.i-a.i BETWEEN 0 AND 6 GROUP BY 1", ROT)
add("vanhove", lambda t: correlation.vanhove(t, "name CA", 5.0, 50.0, 4), "lag bin", "g", f"SELECT lag, bin, count(*)/any_value(n)::DOUBLE AS g FROM (SELECT lag, floor(r/5)::BIGINT AS bin, r, count(*) OVER (PARTITION BY lag) AS n FROM (SELECT b.frame-a.frame AS lag, {_d('a', 'b')} AS r FROM t a JOIN t b ON a.atom=b.atom AND b.frame-a.frame BETWEEN 0 AND 4 WHERE a.name='CA')) WHERE r < 50 GROUP BY lag, bin")
add("conductivity", lambda t: correlation.conductivity(t, "name CA", max_lag=5), "lag", "m2 sigma", "SELECT b.i-a.i AS lag, avg((b.x-a.x)**2+(b.y-a.y)**2+(b.z-a.z)**2) AS m2, avg((b.x-a.x)**2+(b.y-a.y)**2+(b.z-a.z)**2)/125000.0::DOUBLE*(1.602176634e-19::DOUBLE*1.602176634e-19::DOUBLE/(6*1.380649e-23::DOUBLE*300*1e-27::DOUBLE)) AS sigma FROM j a JOIN j b ON b.i-a.i BETWEEN 1 AND 5 GROUP BY 1", GC.replace("FROM t GROUP BY", "FROM t WHERE name='CA' GROUP BY") + ", j AS (SELECT idx AS i, -sum(x) AS x, -sum(y) AS y, -sum(z) AS z FROM g GROUP BY idx)")
DIP = "d AS (SELECT frame, resid, sum(charge*x) AS dx, sum(charge*y) AS dy, sum(charge*z) AS dz FROM t GROUP BY frame, resid)"
add("dipole_moments", lambda t: correlation.dipole_moments(t), "frame resid", "dx dy dz", "SELECT frame, resid, dx, dy, dz FROM d", DIP)
add("dipole_alignment", lambda t: correlation.dipole_alignment(t), "frame", "cos_x cos_y cos_z cos2_x cos2_y cos2_z", "SELECT frame, " + ", ".join(f"avg(d{k}/n) AS cos_{k}, avg(d{k}*d{k}/(n*n)) AS cos2_{k}" for k in "xyz") + f" FROM (SELECT *, {_norm('dx', 'dy', 'dz')} AS n FROM d) GROUP BY frame", DIP)
add("equipartition", lambda t: correlation.equipartition(t), "frame chain", "temperature", "SELECT frame, chain, sum(mass*(x*x+y*y+z*z))/(3*count(*)*0.00831446261815324::DOUBLE) AS temperature FROM t GROUP BY frame, chain")

# Grids
BIN = lambda c, n: f"least(floor((({c}) - floor(({c})/50)*50)/50*{n}), {n}-1)::BIGINT"
LD = lambda w: f"h AS (SELECT range AS bin, coalesce(w, 0.0) AS w FROM range(20) LEFT JOIN (SELECT {BIN('z', 20)} AS b, sum({w}) AS w FROM t GROUP BY 1) ON b = range)"
add("lineardensity", lambda t: grids.lineardensity(t, None, "z", 20), "bin", "center density", "SELECT bin, (bin+0.5)*2.5 AS center, w/50/6250.0 AS density FROM h", LD("1.0::DOUBLE"))
add("lineardensity_mass", lambda t: grids.lineardensity(t, None, "z", 20, "mass"), "bin", "center density", "SELECT bin, (bin+0.5)*2.5 AS center, w/50/6250.0 AS density FROM h", LD("mass"))
add("densmap", lambda t: grids.densmap(t, None, "z", 5), "i j", "density", f"SELECT {BIN('x', 5)} AS i, {BIN('y', 5)} AS j, count(*)/50.0/5000 AS density FROM t GROUP BY 1, 2")
VOX = "n AS (SELECT t.frame, floor((x-ax+15)/10)::BIGINT AS i, floor((y-ay+15)/10)::BIGINT AS j, floor((z-az+15)/10)::BIGINT AS k FROM t JOIN c USING (frame) WHERE resname='SOL'), u AS (SELECT frame, i+3*(j+3*k) AS voxel, count(*) AS n FROM n WHERE i BETWEEN 0 AND 2 AND j BETWEEN 0 AND 2 AND k BETWEEN 0 AND 2 GROUP BY 1, 2), z AS (SELECT v.voxel, fr.frame, coalesce(u.n, 0) AS n FROM (SELECT DISTINCT voxel FROM u) v CROSS JOIN fr LEFT JOIN u ON u.voxel=v.voxel AND u.frame=fr.frame)"
VARGS = ("resname SOL", "chain A", 10.0, (3, 3, 3), (15.0, 15.0, 15.0))
for alias in ("water_count", "count_in_voxel"):
    add(alias, lambda t: grids.water_count(t, *VARGS), "voxel first last min max", "mean std", "SELECT voxel, avg(n) AS mean, stddev_pop(n) AS std, arg_min(n, frame) AS first, arg_max(n, frame) AS last, min(n) AS min, max(n) AS max FROM z GROUP BY voxel", f"{AB}, {VOX}")
for alias in ("density", "volmap"):
    add(alias, lambda t: grids.density(t, *VARGS), "voxel", "mean std", "SELECT voxel, avg(n)/1000 AS mean, stddev_pop(n)/1000 AS std FROM z GROUP BY voxel", f"{AB}, {VOX}")
add("h2order", lambda t: grids.h2order(t), "bin", "cos dipole", f"SELECT {BIN('hh', 10)} AS bin, avg(dz/n) AS cos, avg(n) AS dipole FROM (SELECT *, {_norm('dx', 'dy', 'dz')} AS n FROM (SELECT frame, resid, avg(z) AS hh, sum(charge*x) AS dx, sum(charge*y) AS dy, sum(charge*z) AS dz FROM t GROUP BY frame, resid)) GROUP BY 1")
add("hydorder", lambda t: grids.hydorder(t, "name O"), "frame atom", "sg sk", "SELECT x.frame, x.a AS atom, sg, sk FROM (SELECT u.frame, u.a, 3.0/32*sum((u.ux*v.ux+u.uy*v.uy+u.uz*v.uz+1.0::DOUBLE/3)**2) AS sg FROM k u JOIN k v ON u.frame=v.frame AND u.a=v.a AND u.r < v.r GROUP BY 1, 2) x JOIN (SELECT frame, a, sum((dist-m)**2)/(12*any_value(m)**2) AS sk FROM (SELECT *, avg(dist) OVER (PARTITION BY frame, a) AS m FROM k) GROUP BY 1, 2) y ON x.frame=y.frame AND x.a=y.a", "pr AS (" + _pairs("a.name='O'", "b.name='O'", True, more="".join(f", {_mi(f'b.{k}-a.{k}')} AS d{k}" for k in "xyz")) + "), k AS (SELECT *, dx/dist AS ux, dy/dist AS uy, dz/dist AS uz FROM (SELECT *, row_number() OVER (PARTITION BY frame, a ORDER BY dist, b) AS r FROM pr) WHERE r <= 4)")
add("nmr_ired", lambda t: grids.distance_vectors(t, [(0, 1), (4, 5)]), "frame pair", "ux uy uz", "SELECT a.frame, CASE a.atom WHEN 0 THEN 0 ELSE 1 END AS pair, " + ", ".join(f"(b.{k}-a.{k})/{_d('a', 'b')} AS u{k}" for k in "xyz") + " FROM t a JOIN t b ON a.frame=b.frame AND b.atom=a.atom+1 WHERE a.atom IN (0, 4)")

# Membranes
LEAF = "m AS (SELECT frame, avg(z) AS mid FROM t GROUP BY frame), h AS (SELECT t.frame, resid, avg(z) AS z, any_value(mid) AS mid FROM t JOIN m USING (frame) GROUP BY t.frame, resid), l AS (SELECT frame, resid, CASE WHEN z > mid THEN 1 ELSE -1 END AS leaflet FROM h)"
add("lipid_leaflets", lambda t: membrane.leaflets(t), "frame resid leaflet", "", "SELECT frame, resid, leaflet FROM l", LEAF)
add("lipid_z_positions", lambda t: membrane.z_positions(t, "all", "name O"), "frame resid", "height", "SELECT t.frame, resid, avg(z) - any_value(mid) AS height FROM t JOIN m USING (frame) WHERE name='O' GROUP BY t.frame, resid", LEAF)
add("lipid_z_thickness", lambda t: membrane.z_thickness(t), "frame resid", "thickness", "SELECT frame, resid, CASE WHEN max(z)-min(z) > 25 THEN 50-(max(z)-min(z)) ELSE max(z)-min(z) END AS thickness FROM t GROUP BY frame, resid")
add("lipid_z_angles", lambda t: membrane.z_angles(t, "name N", "name O"), "frame resid", "angle", f"SELECT a.frame, a.resid, degrees(acos(greatest(-1, least(1, (a.z-b.z)/{_norm(_mi('a.x-b.x'), _mi('a.y-b.y'), 'a.z-b.z')})))) AS angle FROM t a JOIN t b ON a.frame=b.frame AND a.resid=b.resid AND a.name='N' AND b.name='O'")
add("lipid_scc", lambda t: membrane.scc(t), "frame resid", "scc", f"SELECT frame, resid, avg(1.5*(dz/{_norm('dx', 'dy', 'dz')})**2-0.5) AS scc FROM (SELECT frame, resid, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM t WINDOW w AS (PARTITION BY frame, resid ORDER BY atom)) WHERE dx IS NOT NULL GROUP BY frame, resid")
CON = "pr AS (" + _pairs("true", "true", True, "a.resid <> b.resid", ", a.resid AS ra, b.resid AS rb") + "), k AS (SELECT DISTINCT frame, ra, rb FROM pr WHERE dist <= 6), e AS (SELECT DISTINCT frame, resid FROM t)"
add("lipid_neighbours", lambda t: membrane.neighbours(t, None, 6.0), "frame resid n", "", "SELECT e.frame, e.resid, count(rb) AS n FROM e LEFT JOIN k ON e.frame=k.frame AND e.resid=ra GROUP BY 1, 2", CON)
add("lipid_neighbour_matrix", lambda t: membrane.neighbour_matrix(t, None, 6.0), "frame a_resid b_resid contact", "", "SELECT a.frame, a.resid AS a_resid, b.resid AS b_resid, CASE WHEN ra IS NULL THEN 0 ELSE 1 END::BIGINT AS contact FROM e a JOIN e b ON a.frame=b.frame LEFT JOIN k ON k.frame=a.frame AND ra=a.resid AND rb=b.resid", CON)
add("lipid_largest_cluster", lambda t: membrane.largest_cluster(t, None, 6.0))
add("lipid_membrane_thickness", lambda t: membrane.membrane_thickness(t, None, membrane.leaflets(t), 2), "frame", "thickness", f"SELECT frame, avg(u-d) AS thickness FROM (SELECT t.frame, {BIN('x', 2)} AS i, {BIN('y', 2)} AS j, avg(CASE WHEN leaflet=1 THEN z END) AS u, avg(CASE WHEN leaflet=-1 THEN z END) AS d FROM t JOIN l ON t.frame=l.frame AND t.resid=l.resid GROUP BY 1, 2, 3) GROUP BY frame", LEAF)
add("lipid_flip_flop", lambda t: membrane.flip_flop(membrane.leaflets(t), 2))
NEM = "d AS (SELECT frame, dx/n AS x, dy/n AS y, dz/n AS z FROM (SELECT a.frame, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, " + _d("a", "b") + " AS n FROM t a JOIN t b ON a.frame=b.frame AND a.resid=b.resid AND a.name='N' AND b.name='O')), g AS (SELECT frame, count(*) AS n, 1.5*avg(x*x)-0.5 AS xx, 1.5*avg(y*y)-0.5 AS yy, 1.5*avg(z*z)-0.5 AS zz, 1.5*avg(x*y) AS xy, 1.5*avg(x*z) AS xz, 1.5*avg(y*z) AS yz FROM d GROUP BY frame), " + EIGEN
add("nematic_order", lambda t: membrane.nematic(t, "name N", "name O"))
add("nematic_eigenvalue", lambda t: membrane.nematic(t, "name N", "name O").select("frame", "n", "qxx", "qxy", F.col("order").alias("largest")), "frame n", "qxx qxy largest", "SELECT frame, n, xx AS qxx, xy AS qxy, l3 AS largest FROM e", NEM)

# Solvent around a solute
TRIPLE = ("resname SOL and name O", "resname SOL and name N", "resname SOL and name C")
MOL = "m0 AS (SELECT frame, resid, " + ", ".join(f"max(CASE WHEN name='{n}' THEN {k} END) AS {p}{k}" for p, n in (("o", "O"), ("n", "N"), ("c", "C")) for k in "xyz") + " FROM t WHERE resname='SOL' GROUP BY ALL HAVING count(*) FILTER (name IN ('O','N','C')) = 3)"
MOL += ", m1 AS (SELECT frame, resid, " + ", ".join(f"{_mi(f'n{k}-o{k}')} AS e{k}, {_mi(f'c{k}-o{k}')} AS f{k}" for k in "xyz") + " FROM m0), m2 AS (SELECT *, ex+fx AS bx, ey+fy AS bly, ez+fz AS bz FROM m1), m3 AS (SELECT *, bly*fz-bz*fy AS vx, bz*fx-bx*fz AS vy, bx*fy-bly*fx AS vz, " + _norm("bx", "bly", "bz") + " AS bn FROM m2)"
MOL += ", w AS (SELECT pr.frame, pr.a, pr.b, dist, -(dx*bx+dy*bly+dz*bz)/(dist*bn) AS cos1, -(dx*vx+dy*vy+dz*vz)/(dist*" + _norm("vx", "vy", "vz") + ") AS cos2 FROM pr JOIN m3 ON pr.frame=m3.frame AND pr.resid=m3.resid)"
SOLV = "pr AS (" + _pairs("a.resname='NA'", "b.resname='SOL' AND b.name='O'", True, "true", ", b.resid AS resid, " + ", ".join(f"{_mi(f'b.{k}-a.{k}')} AS d{k}" for k in "xyz")) + ")"
add("sorient", lambda t: solvation.sorient(t, "resname NA", TRIPLE, 8, 3.0), "bin n", "r cos1 p2 sum_cos1 sum_p2 count_density", "SELECT range AS bin, (range+0.5)*3 AS r, coalesce(n, 0) AS n, coalesce(s1/n, 0) AS cos1, coalesce(s2/n, 0) AS p2, coalesce(sum(s1) OVER v, 0)/(8*50.0) AS sum_cos1, coalesce(sum(s2) OVER v, 0)/(8*50.0) AS sum_p2, coalesce(n, 0)/(3*50.0) AS count_density FROM range(8) LEFT JOIN (SELECT least(floor(dist/3), 7)::BIGINT AS b, count(*) AS n, sum(cos1) AS s1, sum(3*cos2*cos2-1) AS s2 FROM w WHERE dist <= 24 GROUP BY 1) ON b = range WINDOW v AS (ORDER BY range)", f"{SOLV}, {MOL}")
add("sorient_histogram", lambda t: solvation.sorient_histogram(t, "resname NA", TRIPLE, 5.0, 20.0, 0.25), "kind bin", "center density", "SELECT 'cos1' AS kind, range AS bin, -1+(range+0.5)*0.25 AS center, coalesce(n, 0)/((SELECT count(*) FROM s)*0.25) AS density FROM range(8) LEFT JOIN (SELECT least(floor((cos1+1)*4), 7)::BIGINT AS b, count(*) AS n FROM s GROUP BY 1) ON b=range UNION ALL SELECT 'abs_cos2', range, (range+0.5)*0.25, coalesce(n, 0)/((SELECT count(*) FROM s)*0.25) FROM range(4) LEFT JOIN (SELECT least(floor(abs(cos2)*4), 3)::BIGINT AS b, count(*) AS n FROM s GROUP BY 1) ON b=range", f"{SOLV}, {MOL}, s AS (SELECT * FROM w WHERE dist >= 5 AND dist < 20)")
POLAR = SOLV + ", np AS (SELECT frame, resid, min(dist) AS dist, " + ", ".join(f"arg_min(d{k}, (dist, a)) AS d{k}" for k in "xyz") + " FROM pr GROUP BY frame, resid)"
POLAR += ", o0 AS (SELECT frame, resid, name, charge, " + ", ".join(_mi(f"{k} - first({k}) OVER v") + f" AS o{k}" for k in "xyz") + " FROM t WHERE resname='SOL' WINDOW v AS (PARTITION BY frame, resid ORDER BY atom))"
POLAR += ", dm AS (SELECT frame, resid, " + ", ".join(f"(sum(charge*o{k}) - avg(charge)*sum(o{k}))*(1.60217733::DOUBLE/0.03336::DOUBLE)*0.1::DOUBLE AS m{k}, (max(CASE WHEN name='N' THEN o{k} END)+max(CASE WHEN name='C' THEN o{k} END))/2 - max(CASE WHEN name='O' THEN o{k} END) AS h{k}" for k in "xyz") + " FROM o0 GROUP BY ALL)"
POLAR += ", po AS (SELECT dist, " + _norm("mx", "my", "mz") + " AS mu, -(dx*mx+dy*my+dz*mz)/dist AS radial, -(dx*hx+dy*hy+dz*hz)/dist/" + _norm("hx", "hy", "hz") + " AS turn FROM np JOIN dm USING (frame, resid))"
add("spol", lambda t: solvation.spol(t, "resname NA", "resname SOL", TRIPLE, 10, 2.0), "bin n", "r per_frame cumulative", "SELECT range AS bin, coalesce(n, 0) AS n, (range+1)*2.0 AS r, coalesce(n, 0)/50.0 AS per_frame, coalesce(sum(n) OVER (ORDER BY range), 0)/50.0 AS cumulative FROM range(10) LEFT JOIN (SELECT floor(dist/2)::BIGINT AS b, count(*) AS n FROM po WHERE dist < 20 GROUP BY 1) ON b=range", POLAR)
add("spol_shell", lambda t: solvation.spol_shell(t, "resname NA", "resname SOL", TRIPLE, 3.0, 15.0, 0.5), "n", "shell_size dipole dipole_std radial_dipole radial_polarization", "SELECT count(*) AS n, count(*)/50.0 AS shell_size, avg(mu) AS dipole, stddev_pop(mu) AS dipole_std, avg(radial) AS radial_dipole, avg(radial-0.5*coalesce(turn, 0)) AS radial_polarization FROM po WHERE dist >= 3 AND dist < 15", POLAR)
IONS = "i AS (SELECT frame, resid, resname, sum(mass*x)/sum(mass) AS x, sum(mass*y)/sum(mass) AS y, sum(mass*z)/sum(mass) AS z FROM t WHERE resname IN ('NA', 'SOL') GROUP BY ALL), nb AS (SELECT a.frame, a.resid, string_agg(b.resid::VARCHAR, ' ' ORDER BY b.resid) AS cluster, arg_min(b.resid, (" + _d("a", "b", True) + ", b.resid)) AS pair FROM i a JOIN i b ON a.frame=b.frame AND a.resname <> b.resname WHERE " + _d("a", "b", True) + " < 15 GROUP BY ALL), iv AS (SELECT i.frame, i.resid, resname, cluster, pair FROM i LEFT JOIN nb USING (frame, resid)), l AS (SELECT b.frame-a.frame AS lag, a.resname, (a.pair IS NOT DISTINCT FROM b.pair)::INT AS ip, (a.cluster IS NOT DISTINCT FROM b.cluster)::INT AS cp FROM iv a JOIN iv b ON a.resid=b.resid AND b.frame-a.frame BETWEEN 0 AND 6)"
add("ion_pair_corr", lambda t: solvation.ion_pair_corr(t, "resname NA", "resname SOL", 15.0, 15.0, 6), "lag", "ip ip_cation ip_anion cp cp_cation cp_anion", "SELECT lag, " + ", ".join(f"avg({c}) AS {c}, avg({c}) FILTER (resname='NA') AS {c}_cation, avg({c}) FILTER (resname='SOL') AS {c}_anion" for c in ("ip", "cp")) + " FROM l GROUP BY lag", IONS)
DOCK = "pr AS (" + _pairs("a.chain='A'", "b.chain='B'", False, "true", ", a.charge*b.charge AS qq, a.name[1] AS ea, b.name[1] AS eb") + "), cd AS (SELECT frame, a, b, dist, CASE WHEN dist <= 3 THEN 4 WHEN dist <= 4 AND qq < 0 THEN 0 WHEN dist <= 7 AND ea IN ('N','O') AND eb IN ('N','O') THEN 1 WHEN dist <= 8 AND ea='C' AND eb='C' THEN 2 WHEN dist <= 9 THEN 3 END AS code FROM pr)"
add("docking_contacts", lambda t: solvation.docking_contacts(t, "chain A", "chain B", 9.0, 8.0, 7.0, 3.0), "frame receptor ligand code", "dist strength", "SELECT frame, a AS receptor, b AS ligand, code, dist, CASE code WHEN 1 THEN 0.5 ELSE greatest(0, least(1, 1 - dist/CASE code WHEN 2 THEN 8.0 WHEN 3 THEN 9.0 ELSE 3.0 END)) END AS strength FROM cd WHERE code > 0", DOCK)
GIST = "hc AS (SELECT frame, avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM t WHERE resname='NA' GROUP BY frame), m0 AS (SELECT frame, resid, " + ", ".join(f"max(CASE WHEN name='{n}' THEN {k} END) AS {p}{k}" for p, n in (("o", "O"), ("n", "N"), ("c", "C")) for k in "xyz") + " FROM t WHERE resname='SOL' GROUP BY ALL), hh AS (SELECT frame, ox, oy, oz, " + ", ".join(f"(n{k}+c{k})/2-o{k} AS h{k}, o{k}-s{k} AS r{k}" for k in "xyz") + " FROM m0 JOIN hc USING (frame))"
add("gist_grid", lambda t: solvation.gist_grid(t, TRIPLE, "resname NA", (5.0, 5.0, 5.0), (4, 3, 2), 10.0, 6), "voxel orientation n", "", "SELECT floor((ox-5)/10)::BIGINT + 4*(floor((oy-5)/10)::BIGINT + 3*floor((oz-5)/10)::BIGINT) AS voxel, coalesce(least(floor(((hx*rx+hy*ry+hz*rz)/" + _norm("hx", "hy", "hz") + "/" + _norm("rx", "ry", "rz") + "+1)/2*6), CASE WHEN hx IS NOT NULL THEN 5 END), -1)::BIGINT AS orientation, count(*) AS n FROM hh WHERE ox >= 5 AND ox < 45 AND oy >= 5 AND oy < 35 AND oz >= 5 AND oz < 25 AND ox IS NOT NULL GROUP BY 1, 2", GIST)
FREE = "pl AS (SELECT t.frame, x-ax+12 AS x, y-ay+12 AS y, z-az+12 AS z FROM t JOIN c USING (frame) WHERE resname='SOL'), iv AS (SELECT * FROM pl WHERE x >= 0 AND y >= 0 AND z >= 0 AND x < 24 AND y < 24 AND z < 24), tk AS (SELECT DISTINCT frame, i + 6*(j + 6*k) AS voxel FROM iv, range(6) a(i), range(6) b(j), range(6) d(k) WHERE ((i+0.5)*4-x)**2 + ((j+0.5)*4-y)**2 + ((k+0.5)*4-z)**2 <= 25), oc AS (SELECT voxel, count(*) AS n, max((frame=0)::INT) AS n0, max((frame=49)::INT) AS n1 FROM tk GROUP BY voxel), vv AS (SELECT range AS voxel, coalesce(n, 0) AS n, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, 1-coalesce(n, 0)/50.0 AS mean FROM range(216) LEFT JOIN oc ON voxel=range)"
add("free_volume", lambda t: solvation.free_volume(t, "resname SOL", "chain A", 4.0, (6, 6, 6), 5.0), "voxel first last min max", "mean std", "SELECT voxel, mean, sqrt(greatest(mean-mean*mean, 0)) AS std, (1-n0)::BIGINT AS first, (1-n1)::BIGINT AS last, (n=0)::BIGINT AS min, (n<50)::BIGINT AS max FROM vv", f"{AB}, {FREE}")

# Energies by voxel, and defects
GD = "w AS (SELECT *, (atom % 5 + 1)*0.2::DOUBLE AS sg, (atom % 3)*0.1::DOUBLE AS ep FROM t), q AS (SELECT a.frame, a.resid, b.resname = 'NA' AS solute, a.charge*b.charge AS qq, (a.sg+b.sg)/2 AS sg, sqrt(a.ep*b.ep) AS ep, " + _d("a", "b", True) + " AS r FROM w a JOIN w b ON a.frame=b.frame AND a.resid<>b.resid WHERE a.resname<>'NA'), e AS (SELECT frame, resid, sum(v) FILTER (solute) AS sw, sum(v) FILTER (NOT solute)/2 AS ww FROM (SELECT *, 4*ep*((sg/r)**12 - (sg/r)**6) + 138.935456::DOUBLE*qq/r AS v FROM q WHERE r > 0 AND r <= 12) GROUP BY frame, resid), o AS (SELECT t.*, coalesce(sw, 0) AS sw, coalesce(ww, 0) AS ww, x>=5 AND x<45 AND y>=5 AND y<35 AND z>=5 AND z<25 AS inside FROM t LEFT JOIN e USING (frame, resid) WHERE name='O' AND resname<>'NA')"
GIST = ("not resname NA", "name O and not resname NA", "resname NA", 12.0, (5.0, 5.0, 5.0), (4, 3, 2), 10.0)
charged = lambda t: replace(t, atoms=t.atoms.withColumns({"sigma": (F.col("atom") % 5 + 1) * 0.2, "epsilon": (F.col("atom") % 3) * 0.1}))
add("gist_direct", lambda t: solvation.gist_direct(charged(t), *GIST), "voxel n", "sw ww", "SELECT floor((x-5)/10)::BIGINT + 4*(floor((y-5)/10)::BIGINT + 3*floor((z-5)/10)::BIGINT) AS voxel, count(*) AS n, sum(sw) AS sw, sum(ww) AS ww FROM o WHERE inside GROUP BY 1", GD)
add("gist_frames", lambda t: solvation.gist_frames(charged(t), *GIST), "frame", "sw ww total_sw total_ww", "SELECT frame, coalesce(sum(sw) FILTER (inside), 0) AS sw, coalesce(sum(ww) FILTER (inside), 0) AS ww, sum(sw) AS total_sw, sum(ww) AS total_ww FROM o GROUP BY frame", GD)

LE = "w AS (SELECT *, (atom % 5 + 1)*0.2::DOUBLE AS sg, (atom % 3)*0.1::DOUBLE AS ep FROM t), q AS (SELECT a.frame, a.charge*b.charge AS qq, (a.sg+b.sg)/2 AS sg, sqrt(a.ep*b.ep) AS ep, " + _d("a", "b", True) + " AS r FROM w a JOIN w b ON a.frame=b.frame WHERE a.chain='A' AND b.chain<>'A')"
add("lie", lambda t: solvation.interaction_energy(charged(t), "chain A", 15.0), "frame", "vdw ele total", "SELECT fr.frame, coalesce(vdw, 0) AS vdw, coalesce(ele, 0) AS ele, coalesce(vdw+ele, 0) AS total FROM fr LEFT JOIN (SELECT frame, sum(4*ep*((sg/r)**12 - (sg/r)**6)) AS vdw, sum(138.935456::DOUBLE*qq/r) AS ele FROM q WHERE r > 0 AND r <= 15 GROUP BY frame) e USING (frame)", LE)


def _defect_sites(side: str = "true") -> str:
    """CTE: sites in a defect, by all sites against all atoms."""
    off = [_mi(f"(i{c}+0.5)*5 - t.{c}") for c in "xy"]
    flat = f"({off[0]}**2 + {off[1]}**2)"
    radius = "(CASE name WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 ELSE 1.7 END + 3)::DOUBLE"
    some = lambda rule: f"EXISTS (SELECT 1 FROM t JOIN lv USING (frame) WHERE t.frame=g.frame AND {side} AND {rule})"
    return f"lv AS (SELECT frame, avg(z) AS mid FROM t WHERE chain='A' GROUP BY frame), g AS (SELECT frame, a.range AS ix, b.range AS iy, d.range AS iz FROM fr, range(10) a, range(10) b, range(10) d), st AS (SELECT * FROM g WHERE " + some(f"chain='B' AND {flat} < 49 AND (iz+0.5)*5 < t.z") + " AND NOT " + some(f"chain='A' AND {flat} + ((iz+0.5)*5 - t.z)**2 <= {radius}**2") + ")"


DEFECT = {"voxel": 5.0, "heights": (0.0, 50.0), "probe": 3.0, "reach": 7.0}
add("hydrophobic_defects", lambda t: defects.hydrophobic_defects(t, "chain A", "chain B", **DEFECT), "ix iy iz first last min max lifetime", "mean", "SELECT ix, iy, iz, sum(n)/50 AS mean, max((a=0)::BIGINT) AS first, max((b=49)::BIGINT) AS last, (sum(n)=50)::BIGINT AS min, 1::BIGINT AS max, max(n) AS lifetime FROM rn GROUP BY ix, iy, iz", _defect_sites() + ", rn AS (SELECT ix, iy, iz, count(*) AS n, min(frame) AS a, max(frame) AS b FROM (SELECT *, frame - row_number() OVER (PARTITION BY ix, iy, iz ORDER BY frame) AS island FROM st) GROUP BY ix, iy, iz, island)")
add("hydrophobic_defect_sites", lambda t: defects.defect_sites(t, "chain A", "chain B", leaflet="upper", **DEFECT).drop("nx", "ny"), "frame ix iy iz", "", "SELECT frame, ix, iy, iz FROM st", _defect_sites("t.z >= mid"))
add("hydrophobic_defect_frames", lambda t: defects.hydrophobic_defect_frames(t, "chain A", "chain B", **DEFECT))

add("helix", lambda t: helices.helix(t, between=(5, 9)).drop("residue_rmsd"))
_cell = lambda n, d: ", ".join(f"max({c}) FILTER (name='{n}') AS {d}{c}" for c in "xyz")
_on = lambda f, k, d, e: ", ".join(f"{f}({d}{c}, {k}) OVER w AS {e}{c}" for c in "xyz")
HX = "hr AS (SELECT frame, chain, resid, " + ", ".join(_cell(n, d) for n, d in (("N", "n"), ("C", "c"), ("O", "o"))) + " FROM t GROUP BY 1, 2, 3), hd AS (SELECT *, " + ", ".join(_on("lead", k, "n", f"n{k}") for k in (3, 4)) + " FROM hr WINDOW w AS (PARTITION BY frame, chain ORDER BY resid))"
_dip = "sqrt(" + " + ".join(f"(0.42::DOUBLE*(sum(c{c}) - sum(o{c})) - 0.2::DOUBLE*sum(n{c}))**2" for c in "xyz") + ")"
add("helix_fixed", lambda t: helices.helix(replace(t, atoms=t.atoms.withColumn("resname", F.lit("PRO"))), between=(5, 9)).select("frame", "first", "last", "dipole", "hb3", "hb4"), "frame first last", "dipole hb3 hb4", f"SELECT frame, 5::BIGINT AS first, 9::BIGINT AS last, {_dip} AS dipole, avg({_norm('n3x-ox', 'n3y-oy', 'n3z-oz')}) AS hb3, avg({_norm('n4x-ox', 'n4y-oy', 'n4z-oz')}) AS hb4 FROM hd WHERE resid >= 5 GROUP BY frame", HX)

# Bundles and rings
add("multipucker", lambda t: angles.multipucker(t, "resid 0 1", 6, 40.0), "frame bin", "value", f"SELECT fr.frame, range AS bin, coalesce(n, 0)/sum(coalesce(n, 0)) OVER (PARTITION BY fr.frame) AS value FROM fr CROSS JOIN range(6) LEFT JOIN (SELECT t.frame, least(floor({_norm('x-ax', 'y-ay', 'z-az')}*6/40), 5)::BIGINT AS b, count(*) AS n FROM t JOIN c USING (frame) WHERE resid IN (0, 1) AND {_norm('x-ax', 'y-ay', 'z-az')} <= 40 GROUP BY 1, 2) k ON k.frame=fr.frame AND b=range", "c AS (" + _centers(a="resid IN (0, 1)") + ")")
BUN = "s0 AS (SELECT frame, chain, CASE WHEN name='CA' THEN 't' ELSE 'b' END AS part, " + ", ".join(f"first({k}) OVER v + {_mi(f'{k} - first({k}) OVER v')} AS {k}" for k in "xyz") + " FROM t WHERE name IN ('CA', 'O') WINDOW v AS (PARTITION BY frame, chain, name ORDER BY atom)), s1 AS (SELECT frame, chain, " + ", ".join(f"avg({k}) FILTER (part='{p}') AS {p}{k}" for p in "tb" for k in "xyz") + " FROM s0 GROUP BY frame, chain), s2 AS (SELECT frame, chain, " + ", ".join(f"(t{k}+b{k})/2 - (avg(t{k}) OVER u + avg(b{k}) OVER u)/2 AS mid_{k}, t{k}-b{k} AS v{k}" for k in "xyz").replace("+by", '+"by"').replace("(by)", '("by")').replace("-by", '-"by"') + " FROM s1 WINDOW u AS (PARTITION BY frame)), s3 AS (SELECT *, " + _norm("vx", "vy", "vz") + " AS length FROM s2), s4 AS (SELECT *, " + ", ".join(f"v{k}/length AS dir_{k}" for k in "xyz") + " FROM s3)"
BUN = BUN.replace("AS by", 'AS "by"')
_lean = lambda e: f"degrees(asin(({e})/sqrt(({e})**2 + dir_z**2)))"
add("bundle", lambda t: angles.bundle(t, "name CA", "name O"), "frame chain", "mid_x mid_y mid_z dir_x dir_y dir_z length distance z_shift tilt radial_tilt lateral_tilt", f"SELECT *, {_norm('mid_x', 'mid_y', 'mid_z')} AS distance, mid_z AS z_shift, degrees(acos(dir_z)) AS tilt, {_lean('mid_x*dir_x+mid_y*dir_y')} AS radial_tilt, {_lean('mid_y*dir_x-mid_x*dir_y')} AS lateral_tilt FROM s4", BUN)
add("jcoupling", lambda t: angles.jcoupling(t, [R4], phase=-60.0), "frame", "j_0", f"SELECT frame, 6.4*cos(radians({DI}-60))**2 - 1.4*cos(radians({DI}-60)) + 1.9 AS j_0 FROM c", QUAD)

# Series and order parameters
UV = "uv AS (SELECT a.frame, a.resid, " + ", ".join(f"(b.{k}-a.{k})/{_d('a', 'b')} AS u{k}" for k in "xyz") + " FROM t a JOIN t b ON a.frame=b.frame AND a.resid=b.resid AND a.name='N' AND b.name='CA')"
add("nh_order_parameters", lambda t: series.nh_order_parameters(t, "name N", "name CA"), "resid", "s2", "SELECT resid, 1.5*(avg(ux*ux)**2+avg(uy*uy)**2+avg(uz*uz)**2+2*(avg(ux*uy)**2+avg(ux*uz)**2+avg(uy*uz)**2))-0.5 AS s2 FROM uv GROUP BY resid", UV)
add("ired_matrix", lambda t: series.ired_matrix(t, "name N", "name CA"), "a b", "corr", "SELECT p.resid AS a, q.resid AS b, avg(1.5*(p.ux*q.ux+p.uy*q.uy+p.uz*q.uz)**2-0.5) AS corr FROM uv p JOIN uv q USING (frame) GROUP BY 1, 2", UV)
add("lipidscd", lambda t: series.lipidscd(t, "name N", "name CA"), "resid", "scd", "SELECT resid, avg(1.5*uz*uz-0.5) AS scd FROM uv GROUP BY resid", UV)
add("acorr", lambda t: series.correlate(distances.distance(t, "chain A", "chain B"), ["dist"], max_lag=8), "lag", "corr", f"SELECT b.frame-a.frame AS lag, avg(a.d*b.d)/(SELECT avg(d*d) FROM q0) AS corr FROM q0 a JOIN q0 b ON b.frame-a.frame BETWEEN 0 AND 8 GROUP BY 1", f"{AB}, q0 AS (SELECT frame, {_cdist('a', 'b')} AS d FROM c)")
add("timecorr", lambda t: series.timecorr(distances.distance_vector(t, "chain A", "chain B"), ("dx", "dy", "dz"), 2, max_lag=6), "lag", "corr", "SELECT b.frame-a.frame AS lag, avg(1.5*(a.x*b.x+a.y*b.y+a.z*b.z)**2-0.5) AS corr FROM q0 a JOIN q0 b ON b.frame-a.frame BETWEEN 0 AND 6 GROUP BY 1", AB + ', q0 AS (SELECT frame, ' + ", ".join(f'("b{k}"-a{k})/{_cdist("a", "b")} AS {k}' for k in "xyz") + " FROM c)")
add("lowest_envelope", lambda t: series.lowest_envelope(distances.distance_to_point(t, "name CA", (25, 25, 25)), "atom", "dist", 3, 8.0), "bin", "x y", f"SELECT bin, (bin+0.5)*8 AS x, avg(d) AS y FROM (SELECT bin, d, row_number() OVER (PARTITION BY bin ORDER BY d, atom) AS k FROM (SELECT atom, floor(atom/8)::BIGINT AS bin, {_norm('x-25', 'y-25', 'z-25')} AS d FROM t WHERE name='CA')) WHERE k <= 3 GROUP BY bin")
add("crank", lambda t: series.crank(angles.dihedral(t, *R4), angles.dihedral(t, "resid 1", "resid 4", "resid 7", "resid 8")), "frame", "crank", f"SELECT frame, sqrt(power({DI}, 2) + power({_dihedral_sql('e', 'f', 'k', 'l')}, 2)) AS crank FROM c", "c AS (" + _centers(a="resid=0", b="resid=3", g="resid=6", h="resid=9", e="resid=1", f="resid=4", k="resid=7", l="resid=8") + ")")
add("ti", lambda t: series.ti(t.points("name CA").select(F.floor(F.col("atom") / 8).alias("lam"), F.col("x").alias("dvdl"))), "", "integral error", "SELECT sum(w*m) AS integral, sqrt(sum(w*e*w*e)) AS error FROM (SELECT m, e, (coalesce(lead(lam) OVER v, lam) - coalesce(lag(lam) OVER v, lam))/2 AS w FROM (SELECT floor(atom/8) AS lam, avg(x) AS m, stddev_samp(x)/sqrt(count(*)) AS e FROM t WHERE name='CA' GROUP BY 1) WINDOW v AS (ORDER BY lam))")
add("project_values", lambda t: series.project_values(t.points(), "x", "y", "z", 5, (0.0, 0.0), (50.0, 50.0)), "i j n", "mean", "SELECT floor(x/10)::BIGINT AS i, floor(y/10)::BIGINT AS j, avg(z) AS mean, count(*) AS n FROM t WHERE x < 50 AND y < 50 GROUP BY 1, 2")
add("joint_density", lambda t: series.joint_density(t.points(), "x", "y", 5, (0.0, 0.0), (50.0, 50.0), 300.0), "i j", "density energy", "SELECT i, j, n/(sum(n) OVER ()*100.0) AS density, -0.00831446261815324::DOUBLE*300*ln(n/max(n) OVER ()) AS energy FROM (SELECT floor(x/10)::BIGINT AS i, floor(y/10)::BIGINT AS j, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2)")
add("set_velocity", lambda t: transforms.set_velocity(t, "name CA", 300.0, 7))
add("randomize_ions", lambda t: transforms.randomize_ions(t, "resname NA", "resname SOL", seed=7))
add("lipid_curved_leaflets", lambda t: membrane.curved_leaflets(t, "chain A", 6.0))
add("lipid_area", lambda t: membrane.area(t, None, membrane.leaflets(t)))
add("lipid_neighbour_composition", lambda t: membrane.neighbour_composition(t, None, 8.0), "frame resid resname n", "", f"SELECT frame, a AS resid, resname, count(*) AS n FROM (SELECT DISTINCT a.frame, a.resid AS a, b.resid AS b, b.resname FROM t a JOIN t b ON a.frame=b.frame AND a.resid <> b.resid WHERE {_d('a', 'b', True)} <= 8) GROUP BY ALL")
add("lipid_scc_weighted", lambda t: membrane.scc_weighted(membrane.scc(t, "chain A"), membrane.scc(t, "resid 2-7"), (1.0, 2.0)))

# Small linear algebra and clusters: no SQL, tests hold them against numpy
add("rmsd_aligned", lambda t: linear.rmsd_aligned(t, "name CA", 0))
add("align", lambda t: linear.align(t, "name CA", 0).select("frame", *[F.col("r")[i].alias(f"r{i}") for i in range(9)], *[F.col("t")[i].alias(f"t{i}") for i in range(3)]))
add("rotation_matrix", lambda t: linear.rotation_matrix(t, "name CA", 0))
add("superpose", lambda t: linear.superpose(t, "name CA", 0))
add("principal_axes", lambda t: linear.principal_axes(t).select("frame", *[F.col("moments")[i].alias(f"m{i}") for i in range(3)], *[F.col("axes")[i].alias(f"a{i}") for i in range(9)]))
add("align_principal_axis", lambda t: linear.align_principal_axis(t))
for alias in ("pca", "analyze_modes"):
    add(alias, lambda t: linear.pca(t, 5, "name CA"))
add("projection", lambda t: linear.projection(t, 3, "name CA"))
add("trajectory_cluster_dbscan", lambda t: linear.dbscan(t, 22.0, 4, "name CA"))
add("trajectory_cluster_kmeans", lambda t: linear.kmeans(t, 4, "name CA"))
add("dssp", lambda t: linear.dssp(t))
for alias in ("surf", "molsurf"):
    add(alias, lambda t: linear.surf(t))

add("dssp_fractions", lambda t: linear.dssp_fractions(t))
add("bondi_ffv", lambda t: solvation.bondi_ffv(t, "chain A", points_per_nm3=20))

# Rotations about the axis of a dihedral: Rodrigues' formula on the atoms that turn
TURN = """k0 AS (SELECT frame, bx, "by" AS by_, bz, gx-bx AS ux, gy-"by" AS uy, gz-bz AS uz, {theta} AS th FROM c),
k1 AS (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS un FROM k0),
k2 AS (SELECT t.frame, atom, {turns} AS turns, x, y, z, bx, by_, bz, ux/un AS kx, uy/un AS ky, uz/un AS kz, x-bx AS vx, y-by_ AS vy, z-bz AS vz, th FROM t JOIN k1 USING (frame)),
k3 AS (SELECT *, kx*vx+ky*vy+kz*vz AS kd FROM k2)"""
TURNED = "SELECT frame, atom, CASE WHEN turns THEN bx + vx*cos(th) + (ky*vz-kz*vy)*sin(th) + kx*kd*(1-cos(th)) ELSE x END AS x, CASE WHEN turns THEN by_ + vy*cos(th) + (kz*vx-kx*vz)*sin(th) + ky*kd*(1-cos(th)) ELSE y END AS y, CASE WHEN turns THEN bz + vz*cos(th) + (kx*vy-ky*vx)*sin(th) + kz*kd*(1-cos(th)) ELSE z END AS z FROM k3"
add("rotate_dihedral", lambda t: angles.rotate_dihedral(t, R4, "chain B", 30.0), "frame atom", "x y z", TURNED, f"{QUAD}, {TURN.format(theta='radians(30.0::DOUBLE)', turns="chain='B'")}")
add("set_dihedral", lambda t: angles.set_dihedral(t, R4, "resid 7 8 9", 60.0), "frame atom", "x y z", TURNED, f"{QUAD}, {TURN.format(theta=f'radians(60.0::DOUBLE) - radians({DI})', turns='resid BETWEEN 7 AND 9')}")

# Charges in a field
DIPOLE = "d0 AS (SELECT frame, resid, sum(charge) AS q, " + ", ".join(f"sum(charge*{c}) AS d{c}, sum(mass*{c})/sum(mass) AS m{c}" for c in "xyz") + " FROM t GROUP BY 1, 2), d1 AS (SELECT frame, " + ", ".join(f"sum(d{c}-q*m{c}) AS r{c}, sum(q*m{c}) AS t{c}" for c in "xyz") + " FROM d0 GROUP BY 1), d2 AS (SELECT frame, rx*rx+ry*ry+rz*rz AS rot2, tx*tx+ty*ty+tz*tz AS trans2, rx*tx+ry*ty+rz*tz AS \"cross\" FROM d1)"
EPSILON = "1 + (var_pop(rx+tx)+var_pop(ry+ty)+var_pop(rz+tz))*((1.602176634e-29::DOUBLE*1.602176634e-29::DOUBLE)/(3*8.8541878128e-12::DOUBLE*1.380649e-23::DOUBLE*300*1e-30::DOUBLE))/125000"
add("dipole_squares", lambda t: correlation.dipole_squares(t).withColumnRenamed("cross", "mixed"), "frame", "rot2 trans2 mixed", 'SELECT frame, rot2, trans2, "cross" AS mixed FROM d2', DIPOLE)
add("dielectric", lambda t: correlation.dielectric(t).withColumnRenamed("cross", "mixed"), "", "rot2 trans2 mixed epsilon", f'SELECT (SELECT avg(rot2) FROM d2) AS rot2, (SELECT avg(trans2) FROM d2) AS trans2, (SELECT avg("cross") FROM d2) AS mixed, {EPSILON} AS epsilon FROM d1', DIPOLE)
SIGMA = "c0 AS (SELECT frame, resid, sum(charge) AS q FROM t GROUP BY 1, 2), f0 AS (SELECT frame, row_number() OVER (ORDER BY frame)-1 AS idx FROM fr), c1 AS (SELECT f0.idx, sum(q*g.x) AS x, sum(q*g.y) AS y, sum(q*g.z) AS z FROM g JOIN f0 USING (idx) JOIN c0 ON c0.frame=f0.frame AND c0.resid=g.resid GROUP BY 1), s0 AS (SELECT b.idx-a.idx AS lag, avg((b.x-a.x)**2+(b.y-a.y)**2+(b.z-a.z)**2)/125000*((1.602176634e-19::DOUBLE*1.602176634e-19::DOUBLE)/(6*1.380649e-23::DOUBLE*300*1e-27::DOUBLE)) AS sigma FROM c1 a JOIN c1 b ON b.idx-a.idx BETWEEN 1 AND 6 GROUP BY 1)"
add("current", lambda t: correlation.current(t, max_lag=6), "quantity idx", "value", f"""SELECT 'conductivity' AS quantity, lag::BIGINT AS idx, sigma AS value FROM s0 UNION ALL SELECT 'md_sq', frame, rot2 FROM d2 UNION ALL SELECT 'mj_sq', frame, trans2 FROM d2
UNION ALL SELECT 'md_mj', frame, "cross" FROM d2 UNION ALL SELECT 'conductivity_static', 0, max_by(sigma, lag) FROM s0 UNION ALL SELECT 'dielectric_total', 0, {EPSILON} FROM d1""", f"{GC}, {SIGMA}, {DIPOLE}")
add("potential", lambda t: grids.potential(t, None, "z", 20), "bin", "density field potential", """SELECT bin, density, sum1*k AS field, -k*sum(coalesce((sum1+before)/2*2.5, 0)) OVER (ORDER BY bin) AS potential
FROM (SELECT *, lag(sum1) OVER (ORDER BY bin) AS before, 1.602176634e-10::DOUBLE/8.8541878128e-12::DOUBLE AS k FROM p2)""", f"{LD('charge')}, p0 AS (SELECT bin, w/50/6250.0 AS density FROM h), p1 AS (SELECT *, coalesce((density+lag(density) OVER (ORDER BY bin))/2*2.5, 0) AS half FROM p0), p2 AS (SELECT *, sum(half) OVER (ORDER BY bin) AS sum1 FROM p1)")

# Membranes and series
add("lipid_registration", lambda t: membrane.registration(t, None, None, membrane.leaflets(t)), "frame", "registration", "SELECT frame, corr(up, down) AS registration FROM s3 GROUP BY frame", f"""{LEAF}, s1 AS (SELECT t.frame, leaflet, {BIN('x', 4)} AS jx, {BIN('y', 4)} AS jy, count(*) AS n FROM t JOIN l ON t.frame=l.frame AND t.resid=l.resid GROUP BY ALL),
s2 AS (SELECT s1.*, i.range AS ix, j.range AS iy, exp(-(least(abs(i.range-jx), 4-abs(i.range-jx))**2 + least(abs(j.range-jy), 4-abs(j.range-jy))**2)/2.0::DOUBLE) AS w FROM s1, range(4) i, range(4) j),
s3 AS (SELECT frame, ix, iy, coalesce(sum(CASE WHEN leaflet=1 THEN n*w END), 0) AS up, coalesce(sum(CASE WHEN leaflet=-1 THEN n*w END), 0) AS down FROM s2 GROUP BY 1, 2, 3)""")
add("diffusion", lambda t: series.diffusion(t, max_lag=8), "", "x y z total", "SELECT regr_slope(x, lag*2)/2 AS x, regr_slope(y, lag*2)/2 AS y, regr_slope(z, lag*2)/2 AS z, regr_slope(total, lag*2)/6 AS total FROM (SELECT b.idx-a.idx AS lag, avg((b.x-a.x)*(b.x-a.x)) AS x, avg((b.y-a.y)*(b.y-a.y)) AS y, avg((b.z-a.z)*(b.z-a.z)) AS z, avg((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) AS total FROM g a JOIN g b ON a.resid=b.resid AND b.idx-a.idx BETWEEN 1 AND 8 GROUP BY 1)", GC)
HAAR = ", ".join(f"w{k} AS (SELECT k//2 AS k, (max(CASE WHEN k%2=0 THEN s END)+max(CASE WHEN k%2=1 THEN s END))/2 AS s, (max(CASE WHEN k%2=0 THEN s END)-max(CASE WHEN k%2=1 THEN s END))/2 AS d FROM w{k - 1} GROUP BY 1 HAVING count(*)=2)" for k in range(1, 6))
add("wavelet", lambda t: correlation.wavelet(t, "chain A", "chain B"), "level k", "smooth detail", " UNION ALL ".join(f"SELECT {k}::BIGINT AS level, k, s AS smooth, d AS detail FROM w{k}" for k in range(1, 6)), f"{AB}, w0 AS (SELECT frame AS k, {_cdist('a', 'b')} AS s FROM c), {HAAR}")

# Backbones
RESIDUES = "b0 AS (SELECT frame, chain, resid, " + ", ".join(f"max(CASE WHEN name='{n}' THEN {c} END) AS {n.lower()}_{c}" for n in ("N", "CA", "C", "O") for c in "xyz") + " FROM t GROUP BY 1, 2, 3), b1 AS (SELECT *, " + ", ".join(f"lag(c_{c}) OVER (PARTITION BY frame, chain ORDER BY resid) AS p_{c}" for c in "xyz") + " FROM b0), b2 AS (SELECT *, " + f"{_norm('n_x-p_x', 'n_y-p_y', 'n_z-p_z')} AS np, {_norm('n_x-ca_x', 'n_y-ca_y', 'n_z-ca_z')} AS nca FROM b1), b3 AS (SELECT *, " + ", ".join(f"(n_{c}-p_{c})/np + (n_{c}-ca_{c})/nca AS v{c}" for c in "xyz") + " FROM b2), b4 AS (SELECT *, " + ", ".join(f"n_{c} + v{c}/{_norm('vx', 'vy', 'vz')} AS h_{c}" for c in "xyz") + " FROM b3)"
_far = lambda p, q: f"1/{_norm(*[f'{p}_{c}-{q}_{c}' for c in 'xyz'])}"
add("kabsch_sander", lambda t: linear.kabsch_sander(t), "frame donor_chain donor acceptor_chain acceptor", "energy", f"SELECT d.frame, d.chain AS donor_chain, d.resid AS donor, a.chain AS acceptor_chain, a.resid AS acceptor, 27.888*({_far('a.o', 'd.n')} + {_far('a.c', 'd.h')} - {_far('a.o', 'd.h')} - {_far('a.c', 'd.n')}) AS energy FROM b4 d JOIN b4 a ON a.frame=d.frame AND abs(a.resid-d.resid) > 1 WHERE d.h_x IS NOT NULL", RESIDUES)
HELIX = "o0 AS (SELECT frame, resid, " + ", ".join(f"lead({c}, {k + 1}) OVER w - {f'lead({c}, {k}) OVER w' if k else c} AS s{k}{c}" for k in range(3) for c in "xyz") + " FROM t WHERE name='CA' WINDOW w AS (PARTITION BY frame ORDER BY resid, atom)), o1 AS (SELECT *, " + ", ".join(f"s{k}{c}-s{k + 1}{c} AS d{k}{c}" for k in range(2) for c in "xyz") + " FROM o0 WHERE s2x IS NOT NULL), o2 AS (SELECT *, " + f"{_norm('d0x', 'd0y', 'd0z')} AS m, {_norm('d1x', 'd1y', 'd1z')} AS n, d0x*d1x+d0y*d1y+d0z*d1z AS dd, d0y*d1z-d0z*d1y AS ax, d0z*d1x-d0x*d1z AS ay, d0x*d1y-d0y*d1x AS az FROM o1)"
add("helixorient", lambda t: linear.helix_orientation(t), "frame resid", "radius twist rise", f"SELECT frame, resid, sqrt(m*n)/(2*(1-dd/(m*n))) AS radius, degrees(acos(greatest(-1, least(1, dd/(m*n))))) AS twist, abs(s1x*ax+s1y*ay+s1z*az)/{_norm('ax', 'ay', 'az')} AS rise FROM o2", HELIX)

# Skewed cells, further metrics, frames
CELL = "v AS (SELECT t.*, 40.0::DOUBLE+frame AS ly, 30.0::DOUBLE+2*frame AS lz FROM t)"
add("image_skewed", lambda t: transforms.image(tilted(t)), "frame atom", "x y z", "SELECT frame, atom, 50*fx+10*fy+5*fz AS x, ly*fy-8*fz AS y, lz*fz AS z FROM (SELECT *, fx0-floor(fx0) AS fx, fy0-floor(fy0) AS fy, fz0-floor(fz0) AS fz FROM (SELECT *, (x-10*fy0-5*fz0)/50 AS fx0 FROM (SELECT *, (y+8*fz0)/ly AS fy0 FROM (SELECT *, z/lz AS fz0 FROM v))))", CELL)
add("pairwise_distance_skewed", lambda t: distances.pairwise_distance(tilted(t), "name CA", "name O", True), "frame a b", "dist", f"SELECT frame, a, b, {_norm('50*fx+10*fy+5*fz', 'ly*fy-8*fz', 'lz*fz')} AS dist FROM (SELECT *, fx0-round(fx0) AS fx, fy0-round(fy0) AS fy, fz0-round(fz0) AS fz FROM (SELECT *, (dx-10*fy0-5*fz0)/50 AS fx0 FROM (SELECT *, (dy+8*fz0)/ly AS fy0 FROM (SELECT *, dz/lz AS fz0 FROM (SELECT a.frame, a.atom AS a, b.atom AS b, a.ly, a.lz, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz FROM v a JOIN v b ON a.frame=b.frame AND a.name='CA' AND b.name='O')))))", CELL)
add("search_neighbors_skewed", lambda t: distances.search_neighbors(tilted(t), "resname NA", "resname SOL", 9.0, True), "frame n", "", f"SELECT frame, coalesce(n, 0) AS n FROM fr LEFT JOIN (SELECT frame, count(DISTINCT b) AS n FROM (SELECT *, fx0-round(fx0) AS fx, fy0-round(fy0) AS fy, fz0-round(fz0) AS fz FROM (SELECT *, (dx-10*fy0-5*fz0)/50 AS fx0 FROM (SELECT *, (dy+8*fz0)/ly AS fy0 FROM (SELECT *, dz/lz AS fz0 FROM (SELECT a.frame, a.atom AS a, b.atom AS b, a.ly, a.lz, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz FROM v a JOIN v b ON a.frame=b.frame AND a.resname='NA' AND b.resname='SOL'))))) WHERE {_norm('50*fx+10*fy+5*fz', 'ly*fy-8*fz', 'lz*fz')} <= 9 GROUP BY frame) USING (frame)", CELL)
add("pairwise_rmsd_dme", lambda t: fluctuation.pairwise_rmsd(t, "name CA", "dme"), "f1 f2", "rmsd", f"SELECT p.frame AS f1, q.frame AS f2, sqrt(avg((p.dist-q.dist)*(p.dist-q.dist))) AS rmsd FROM pr p JOIN pr q ON p.a=q.a AND p.b=q.b AND p.frame < q.frame GROUP BY 1, 2", "pr AS (" + _pairs("a.name='CA'", "b.name='CA'", rule="a.atom < b.atom") + ")")
add("pairwise_rmsd_fitted", lambda t: fluctuation.pairwise_rmsd(t, "name CA", "rms"))
add("rmsd_perres_fitted", lambda t: fluctuation.rmsd_perres(t, "chain A", 0, True))
add("trajectory_cluster_fitted", lambda t: linear.dbscan(t, 18.0, 4, "name CA", "rms"))
add("cluster_medoids", lambda t: linear.medoids(t, t.boxes.select("frame", (F.col("frame") % 3).alias("cluster")), "name CA"), "cluster n medoid", "", f"SELECT c AS cluster, count(*) AS n, min_by(f, total) AS medoid FROM (SELECT a.frame AS f, a.frame % 3 AS c, sum(d) AS total FROM (SELECT a.frame, b.frame AS o, sqrt(avg({SQ})) AS d FROM t a JOIN t b ON a.atom=b.atom AND a.frame <> b.frame AND a.frame % 3 = b.frame % 3 WHERE a.name='CA' GROUP BY 1, 2) a GROUP BY 1, 2) GROUP BY 1")
add("hbond_angle", lambda t: distances.hbond(t, "name N", "name O", 20.0, "name CA", 70.0), "frame n", "", f"""SELECT frame, coalesce(n, 0) AS n FROM fr LEFT JOIN (SELECT d.frame, count(*) AS n FROM t d JOIN t a ON a.frame=d.frame AND d.name='N' AND a.name='O' JOIN t h ON h.frame=d.frame AND h.atom=d.atom+1
WHERE {_d('d', 'a')} <= 20 AND ((d.x-h.x)*(a.x-h.x)+(d.y-h.y)*(a.y-h.y)+(d.z-h.z)*(a.z-h.z))/({_d('h', 'd')}*{_d('h', 'a')}) >= cos(radians(70.0::DOUBLE)) GROUP BY 1) USING (frame)""")
add("count_frames", lambda t: transforms.count_frames(t), "n_frames n_atoms", "", "SELECT count(DISTINCT frame) AS n_frames, count(DISTINCT atom) AS n_atoms FROM t")
add("decimate_frames", lambda t: transforms.decimate_frames(t, 3, 7), "frame atom", "x y z", "SELECT frame, atom, x, y, z FROM t WHERE frame < 3 OR (frame+1) % 7 = 0")
add("decimate_time", lambda t: transforms.decimate_time(t, 6.0), "frame atom", "x y z", "SELECT frame, atom, x, y, z FROM t WHERE frame % 3 = 0")
add("map_beads", lambda t: transforms.map_beads(t, t.atoms.select("atom", F.floor(F.col("atom") / 5).cast("long").alias("bead"))), "frame bead n", "x y z", "SELECT frame, atom // 5 AS bead, count(*) AS n, sum(mass*x)/sum(mass) AS x, sum(mass*y)/sum(mass) AS y, sum(mass*z)/sum(mass) AS z FROM t GROUP BY 1, 2")

add("pucker_amplitude", lambda t: angles.pucker(t, "resid 0 1", "amplitude"), "frame", "amplitude", "SELECT frame, sqrt(greatest(l1, 0)) AS amplitude FROM e", f"k AS (SELECT t.*, x-avg(x) OVER w AS dx, y-avg(y) OVER w AS dy, z-avg(z) OVER w AS dz FROM t WHERE resid < 2 WINDOW w AS (PARTITION BY frame)), g AS (SELECT frame, avg(dx*dx) AS xx, avg(dy*dy) AS yy, avg(dz*dz) AS zz, avg(dx*dy) AS xy, avg(dx*dz) AS xz, avg(dy*dz) AS yz FROM k GROUP BY 1), {EIGEN}")
add("pucker_phase", lambda t: angles.pucker(t, "resid 0 1", "amplitude", True))
_square = "avg((b.x-a.x)*(b.x-a.x)) AS x, avg((b.y-a.y)*(b.y-a.y)) AS y, avg((b.z-a.z)*(b.z-a.z)) AS z, avg((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) AS total"
add("msd_by_type", lambda t: correlation.msd(t, max_lag=6, types="chain"), "lag type", "x y z total", f"SELECT b.idx-a.idx AS lag, k.chain AS type, {_square} FROM g a JOIN g b ON a.resid=b.resid AND b.idx-a.idx BETWEEN 1 AND 6 JOIN (SELECT resid, min(chain) AS chain FROM t GROUP BY 1) k ON k.resid=a.resid GROUP BY GROUPING SETS ((b.idx-a.idx, k.chain), (b.idx-a.idx))", GC)
add("msd_multi_tau", lambda t: correlation.msd(t, mode="multi_tau", m=4, levels=3), "lag", "x y z total", " UNION ALL ".join(f"SELECT (b.idx-a.idx)*{1 << k} AS lag, {_square} FROM m{k} a JOIN m{k} b ON a.resid=b.resid AND b.idx-a.idx BETWEEN {1 if k == 0 else 2} AND 3 GROUP BY 1" for k in range(3)), f"{GC}, " + ", ".join(f"m{k} AS (SELECT resid, idx//{1 << k} AS idx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM g GROUP BY 1, 2 HAVING count(*)={1 << k})" for k in range(3)))
add("strip_inverted", lambda t: transforms.strip(t, "chain A or name CA", True), "frame atom", "x y z", "SELECT frame, atom, x, y, z FROM t WHERE atom IN (SELECT atom FROM t EXCEPT SELECT atom FROM t WHERE chain='A' OR name='CA')")
add("common_atoms", lambda t: transforms.common_atoms(t, "chain A or name CA", "resname SOL ALA"), "atom", "", "SELECT atom FROM t WHERE chain='A' OR name='CA' INTERSECT SELECT atom FROM t WHERE resname IN ('SOL', 'ALA')")
add("dssp_atoms", lambda t: linear.dssp_atoms(t))
add("elements_and_labels", lambda t: t.atoms.select("atom", chemistry.element_of(F.concat(F.lit("1"), "name")).alias("found"), chemistry.mass_of(chemistry.element_of(F.col("element"))).alias("weight"), chemistry.group_label(F.col("resname"), F.col("resid"), F.col("chain")).alias("label")), "atom found label", "weight", "SELECT DISTINCT atom, CASE name WHEN 'CA' THEN 'Ca' ELSE name END AS found, resname || resid || '@' || chain AS label, CASE name WHEN 'N' THEN 14.007 WHEN 'O' THEN 15.999 ELSE 12.011 END::DOUBLE AS weight FROM t")
add("decay_length", lambda t: t.points(None, "chain").groupBy("chain", "frame").agg(F.avg(F.exp(-F.col("z") / 25.0 - F.col("frame") / 9.0) - 0.001).alias("y")).groupBy("chain").agg(chemistry.decay_length(F.col("frame"), F.col("y")).alias("length")), "chain", "length", "SELECT chain, CASE WHEN s < 0 THEN -1/s END AS length FROM (SELECT chain, regr_slope(ln(y), frame) AS s FROM (SELECT chain, frame, avg(exp(-z/25-frame/9.0::DOUBLE)-0.001) AS y FROM t GROUP BY 1, 2) WHERE y > 0 GROUP BY 1)")

add("surf_box", lambda t: linear.surf_box(t, "chain A"), "frame", "area", "SELECT frame, 2*(a*b+b*c+c*a) AS area FROM (SELECT frame, max(x)-min(x) AS a, max(y)-min(y) AS b, max(z)-min(z) AS c FROM t WHERE chain='A' GROUP BY 1)")
add("element_by_mass", lambda t: t.atoms.select("atom", chemistry.element_by_mass(F.col("mass")).alias("found")), "atom found", "", "SELECT DISTINCT atom, CASE WHEN mass <= 2 THEN 'H' WHEN mass = 12 THEN 'C' WHEN mass = 13 THEN 'C' WHEN mass IN (14, 15) THEN 'N' WHEN mass = 16 THEN 'O' END AS found FROM t")

SPECTRUM = "e0 AS (SELECT atom, frame, " + ", ".join(f"(lead({c}) OVER w - {c})/2 AS {c}" for c in "xyz") + " FROM t WINDOW w AS (PARTITION BY atom ORDER BY frame)), e5 AS (SELECT * FROM e0 WHERE x IS NOT NULL), e6 AS (SELECT (b.frame-a.frame+49)%49 AS lag, sum(a.x*b.x+a.y*b.y+a.z*b.z) AS s FROM e5 a JOIN e5 b USING (atom) GROUP BY 1), e7 AS (SELECT lag, s/(49-lag)/120*(0.5-0.5*cos(2*pi()*lag/20)) AS c FROM e6 WHERE lag <= 20)"
add("infraredspec", lambda t: series.infraredspec(t, max_lag=20, unit="thz").withColumn("intensity", F.col("intensity") * 1e12), "k", "frequency intensity", "SELECT k, k/(21*2.0::DOUBLE) AS frequency, sum(c*cos(2*pi()*lag*k/21))*2 AS intensity FROM e7, (SELECT range AS k FROM range(11)) GROUP BY 1", SPECTRUM)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
