"""Vectors, rotations, projections and boxes as Column expressions.

A vector is a tuple of three columns. A 3x3 matrix is an array column of nine
doubles, a rigid transform one of sixteen; both are row-major.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]

# Fixed values of the data format.
MAX_PHI = 2.61946          # polar angle covered by a panorama
NUM_ROTS = 4               # upright rotations tried per scan
START_COLUMN = 0.995       # scan order starts at trunc(0.995 * (cols - 1) / 2)


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def trunc(c: Column) -> Column:
    """Truncation toward zero to int."""
    return c.cast("int")


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def plus(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def unit_clamp(c: Column) -> Column:
    """Guard an arc function against a cosine that rounding pushed past 1."""
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))


def angle(a: Vec, b: Vec) -> Column:
    """Angle between vectors; pi when either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(3.141592653589793)).otherwise(
        F.acos(unit_clamp(dot(a, b) / F.nullif(lengths, F.lit(0.0))))
    )


def flip_y(v: Vec) -> Vec:
    return (v[0], -v[1], v[2])


def rows3(m: Column) -> list[Vec]:
    return [tuple(m[3 * i + j] for j in range(3)) for i in range(3)]


def rotate(v: Vec, m: Column) -> Vec:
    return tuple(dot(r, v) for r in rows3(m))


def rotate_inv(v: Vec, m: Column) -> Vec:
    """Inverse rotation: multiply by the transpose."""
    r = rows3(m)
    return tuple(dot((r[0][j], r[1][j], r[2][j]), v) for j in range(3))


def matrix(vs: list[Vec]) -> Column:
    return F.array(*[c for v in vs for c in v])


def transpose3(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def inverse3(m: Column) -> Column:
    """Inverse through cross products of the rows; NULL when singular."""
    a, b, c = rows3(m)
    bc, ca, ab = cross(b, c), cross(c, a), cross(a, b)
    det = F.nullif(dot(a, bc), F.lit(0.0))
    return F.array(*[col / det for i in range(3) for col in (bc[i], ca[i], ab[i])])


def multiply(a: Column, b: Column, n: int) -> Column:
    """Product of two n x n matrices, cell by cell."""
    def cell(k: Column) -> Column:
        row, col = F.floor(k / n) * n, k % n
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.get(a, (row + i).cast("int")) * F.get(b, (i * n + col).cast("int")))

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell)


def _minor(rows: list[int], cols: list[int]) -> str:
    """Determinant of the 3 x 3 part of the symmetric matrix ``n00 .. n33``, less ``lam`` on its diagonal."""
    at = lambda r, c: f"(n{min(r, c)}{max(r, c)} - lam)" if r == c else f"n{min(r, c)}{max(r, c)}"
    (a, b, c), (x, y, z) = rows, cols
    return (f"({at(a, x)} * ({at(b, y)} * {at(c, z)} - {at(b, z)} * {at(c, y)}) - {at(a, y)} * ({at(b, x)} * {at(c, z)} - {at(b, z)} * {at(c, x)})"
            f" + {at(a, z)} * ({at(b, x)} * {at(c, y)} - {at(b, y)} * {at(c, x)}))")


def rotation_steps() -> list[dict[str, str]]:
    """Best rotation from a 3 x 3 cross-covariance ``sxx .. szz`` (source axis first), as named expressions in turn.

    The rotation is the unit quaternion that belongs to the largest root of a symmetric 4 x 4
    matrix. The root is reached from above by Newton steps on the characteristic polynomial
    (``newton`` is one step from ``lam``), the quaternion is a column of the adjugate, the one with
    the largest diagonal entry. Points in a plane and reflections need no special case; points
    on one line give no turn. Any engine with these names as columns can evaluate the text.
    """
    s = {f"s{a}{b}" for a in "xyz" for b in "xyz"}
    first = {
        "n00": "sxx + syy + szz", "n01": "syz - szy", "n02": "szx - sxz", "n03": "sxy - syx", "n11": "sxx - syy - szz", "n12": "sxy + syx",
        "n13": "szx + sxz", "n22": "syy - sxx - szz", "n23": "syz + szy", "n33": "szz - sxx - syy",
        "c2": "-2.0 * (" + " + ".join(f"{x} * {x}" for x in sorted(s)) + ")",
        "c1": "-8.0 * (sxx * (syy * szz - syz * szy) - sxy * (syx * szz - syz * szx) + sxz * (syx * szy - syy * szx))",
    }
    others = lambda i: [j for j in range(4) if j != i]
    whole = " + ".join(f"({'-' if j % 2 else ''}1.0) * n0{j} * {_minor([1, 2, 3], others(j))}" for j in range(4)).replace(" - lam", "")
    adjugate = {f"a{i}{j}": f"({'-' if (i + j) % 2 else ''}1.0) * {_minor(others(i), others(j))}" for i in range(4) for j in range(i, 4)}
    most = "greatest(" + ", ".join(f"abs(a{i}{i})" for i in range(4)) + ")"
    pick = {f"p{j}": f"CASE WHEN NOT most > 1e-12 * abs(lam * lam * lam) THEN {1.0 if j == 0 else 0.0} " + " ".join(
        f"WHEN abs(a{i}{i}) = most THEN a{min(i, j)}{max(i, j)}" for i in range(4)) + " END" for j in range(4)}
    unit = {f"q{j}": f"p{j} / sqrt(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3)" for j in range(4)}
    turn = {
        "r0": "q0*q0 + q1*q1 - q2*q2 - q3*q3", "r1": "2 * (q1*q2 - q0*q3)", "r2": "2 * (q1*q3 + q0*q2)", "r3": "2 * (q1*q2 + q0*q3)",
        "r4": "q0*q0 - q1*q1 + q2*q2 - q3*q3", "r5": "2 * (q2*q3 - q0*q1)", "r6": "2 * (q1*q3 - q0*q2)", "r7": "2 * (q2*q3 + q0*q1)", "r8": "q0*q0 - q1*q1 - q2*q2 + q3*q3",
    }
    step = "lam - coalesce((((lam * lam + c2) * lam + c1) * lam + c0) / nullif((4.0 * lam * lam + 2.0 * c2) * lam + c1, 0), 0)"
    return [first, {"c0": whole, "start": "sqrt(-1.5 * c2)"}, {"newton": step}, adjugate, {"most": most}, pick, unit, turn]


def with_rotation(df: DataFrame, steps: int = 80) -> DataFrame:
    """Add the best rotation ``r0 .. r8`` of the cross-covariance columns ``sxx .. szz``."""
    keep = [*df.columns, *(f"r{i}" for i in range(9))]
    for named in rotation_steps():
        if "newton" in named:
            # One step as a function of the root so far, folded over a fixed number of steps.
            lam = f"aggregate(sequence(1, {steps}), start, (lam, i) -> {named['newton']})"
            df = df.withColumn("lam", F.expr(lam))
        else:
            df = df.withColumns({name: F.expr(text) for name, text in named.items()})
    return df.select(*keep)


def transform4(v: Vec, m: Column) -> Vec:
    """Homogeneous transform followed by the perspective divide."""
    out = [m[4 * i] * v[0] + m[4 * i + 1] * v[1] + m[4 * i + 2] * v[2] + m[4 * i + 3] for i in range(4)]
    return tuple(o / out[3] for o in out[:3])


def pose_matrix(rot: Column, t: Column) -> Column:
    """4x4 transform of a pose: upright axes from the rotation, inverted, then moved.

    The first two rows are flattened to the floor and renormalised, the third is
    straight up; y changes sign on both sides because clouds are left-handed.
    """
    x, y, _ = rows3(rot)
    zero, one = F.lit(0.0), F.lit(1.0)

    def flat(v: Vec) -> tuple[Column, Column]:
        length = F.sqrt(v[0] * v[0] + v[1] * v[1])
        return v[0] / length, v[1] / length

    (a, b), (c, d) = flat(x), flat(y)
    det = F.nullif(a * d - b * c, zero)
    return F.array(d / det, b / det, zero, t[0],
                   c / det, a / det, zero, -t[1],
                   zero, zero, one, t[2],
                   zero, zero, zero, one)


def is_small_motion(m: Column, shift_xy=0.2, shift_z=0.1, tilt=0.05) -> Column:
    """A refinement step is credible: small shift, each axis nearly unturned."""
    ok = (F.abs(m[3]) < shift_xy) & (F.abs(m[7]) < shift_xy) & (F.abs(m[11]) < shift_z)
    for i in range(3):
        ok = ok & (F.acos(unit_clamp(F.abs(m[5 * i]))) < tilt)
    return ok


def to_polar(v: Vec) -> Vec:
    """(r, theta, phi); NULL phi at the origin."""
    r = norm(v)
    return (r, F.atan2(v[1], v[0]), F.acos(unit_clamp(v[2] / F.nullif(r, F.lit(0.0)))))


def to_cartesian(r: Column, theta: Column, phi: Column) -> Vec:
    return (r * F.cos(theta) * F.sin(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(phi))


def pano_xy(v: Vec, width, height) -> Vec:
    """Panorama column, row (not truncated) and range of a point."""
    r, theta, phi = to_polar(v)
    return ((theta / F.pi() + 1.0) * (_c(width) - 1.0) / 2.0, phi * (_c(height) - 1.0) / MAX_PHI, r)


def pano_inverse(px: Column, py: Column, r: Column, width, height) -> Vec:
    theta = (px * 2.0 / (_c(width) - 1.0) + 1.0) * F.pi()
    return to_cartesian(r, theta, py * MAX_PHI / (_c(height) - 1.0))


def quantise(v: Column, low: Column, scale) -> Column:
    return trunc((v - low) * scale)


def scan_order_to_rc(idx: Column, rows, cols) -> tuple[Column, Column]:
    """(row, col) of the idx-th return: rows run downward, then columns leftward with wrap."""
    rows, cols = _c(rows), _c(cols)
    start = trunc((cols - 1) * START_COLUMN / 2.0)
    row = rows - 1 - idx % rows
    return row.cast("int"), F.pmod(start - F.floor(idx / rows), cols).cast("int")


def order_axes(m1: Vec, m2: Vec, m3: Vec) -> tuple[Vec, Vec, Vec]:
    """(up, second, third): the axis with |z| > 0.5 is up, else the third one."""
    first_up, second_up = F.abs(m1[2]) > 0.5, F.abs(m2[2]) > 0.5
    up = [F.when(first_up, a).when(second_up, b).otherwise(c) for a, b, c in zip(m1, m2, m3)]
    second = tuple(F.when(first_up, b).otherwise(a) for a, b in zip(m1, m2))
    sign = F.when(up[2] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    up = tuple(u * sign for u in up)
    return up, second, cross(up, second)


def four_rotations(up: Vec, second: Vec, third: Vec) -> Column:
    """Array of the four upright rotations, one quarter turn apart."""
    ring = [second, third, scaled(second, -1.0), scaled(third, -1.0)]
    return F.array(*[matrix([ring[i], ring[(i + 1) % NUM_ROTS], up]) for i in range(NUM_ROTS)])


BOX = ("x1", "x2", "y1", "y2", "z1", "z2")


def node_box(x: Column, y: Column, meta: str, scale) -> Column:
    """Voxel box a placed scan occupies; ``meta`` prefixes the voxel metadata columns."""
    m = lambda n: F.col(f"{meta}{n}")
    x1 = trunc(x * (m("vox_per_m") / scale) - m("zx"))
    y1 = trunc(y * (m("vox_per_m") / scale) - m("zy"))
    z1 = -m("zz")
    sides = (x1, x1 + m("nx") - 1, y1, y1 + m("ny") - 1, z1, z1 + m("nz") - 1)
    return F.struct(*[s.cast("int").alias(n) for s, n in zip(sides, BOX)])


def box_intersect(a: Column, b: Column) -> Column:
    pick = lambda n: F.greatest(a[n], b[n]) if n.endswith("1") else F.least(a[n], b[n])
    return F.struct(*[pick(n).alias(n) for n in BOX])


def box_relative(box: Column, to: Column) -> Column:
    return F.struct(*[(box[n] - to[f"{n[0]}1"]).alias(n) for n in BOX])


def boxes_meet(a: Column, b: Column) -> Column:
    ok = F.lit(True)
    for n in "xyz":
        ok = ok & (a[f"{n}1"] <= b[f"{n}2"]) & (b[f"{n}1"] <= a[f"{n}2"])
    return ok


def box_volume(box: Column) -> Column:
    v = F.lit(1).cast("long")
    for n in "xyz":
        v = v * F.greatest(box[f"{n}2"] - box[f"{n}1"] + 1, F.lit(0))
    return v


def rect_pixels(x: Column, y: Column, width: Column, height: Column, cols, rows) -> Vec:
    """Rectangle given as fractions of the image -> (col, row, columns, rows)."""
    return trunc(x * cols), trunc(y * rows), trunc(width * cols), trunc(height * rows)


def rect_contains(x0: Column, y0: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    return (x >= x0) & (x <= x0 + width) & (y >= y0) & (y <= y0 + height)
