"""Vectorised numeric solvers: interpolation inverses, types, parallel vectors, vortex criteria, steppers."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
UNKNOWN, DEGENERATE = 0, 1
MINIMUM, SADDLE, MAXIMUM = 2, 4, 8
ATTRACTING_FOCUS, REPELLING_FOCUS, CENTRE = 16, 32, 64
TYPE_NAMES = {0: "unknown", 1: "degenerate", 2: "minimum", 4: "saddle", 8: "maximum", 16: "attracting focus", 32: "repelling focus", 64: "centre"}
VECTOR_TYPE_NAMES = TYPE_NAMES | {2: "repelling", 8: "attracting"}


def det2(m):
    return m[..., 0, 0] * m[..., 1, 1] - m[..., 0, 1] * m[..., 1, 0]


def det3(m):
    m = np.asarray(m)
    return sum(m[..., 0, j] * (m[..., 1, (j + 1) % 3] * m[..., 2, (j + 2) % 3] - m[..., 1, (j + 2) % 3] * m[..., 2, (j + 1) % 3]) for j in range(3))


def det4(m):
    m = np.asarray(m)
    return sum((-1) ** j * m[..., 0, j] * det3(np.delete(m[..., 1:, :], j, axis=-1)) for j in range(4))


def inverse_lerp(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Barycentric zero of (n, d+1, d) vectors on d-simplices, and whether it lies inside; NaN where the vectors don't span."""
    d = v.shape[2]
    a = np.swapaxes(v[:, :d, :] - v[:, d:, :], 1, 2)
    b = -v[:, d, :]
    with np.errstate(all="ignore"):
        if d == 1:
            mu = b / a[:, :, 0]
        elif d == 2:
            det = det2(a)
            det = np.where(det == 0, np.nan, det)
            mu = np.stack(((b[:, 0] * a[:, 1, 1] - b[:, 1] * a[:, 0, 1]) / det, (a[:, 0, 0] * b[:, 1] - a[:, 1, 0] * b[:, 0]) / det), axis=1)
        else:
            det = det3(a)
            det = np.where(det == 0, np.nan, det)
            cols = []
            for j in range(3):
                m = a.copy()
                m[:, :, j] = b
                cols.append(det3(m) / det)
            mu = np.stack(cols, axis=1)
        mu = np.concatenate((mu, 1 - mu.sum(axis=1, keepdims=True)), axis=1)
        inside = ((mu >= -EPS) & (mu <= 1 + EPS)).all(axis=1)
    return mu, inside


def inverse_lerp_least_squares(v: np.ndarray) -> np.ndarray:
    """Barycentric weights on triangles that bring (n, 3, 3) vectors nearest to zero."""
    a = np.swapaxes(v[:, :2, :] - v[:, 2:, :], 1, 2)
    n = np.einsum("nki,nkj->nij", a, a)
    r = -np.einsum("nki,nk->ni", a, v[:, 2, :])
    with np.errstate(all="ignore"):
        det = det2(n)
        x = (r[:, 0] * n[:, 1, 1] - r[:, 1] * n[:, 0, 1]) / det
        y = (n[:, 0, 0] * r[:, 1] - n[:, 1, 0] * r[:, 0]) / det
    return np.stack((x, y, 1 - x - y), axis=1)


def clamp_barycentric(mu: np.ndarray) -> np.ndarray:
    """Weights moved into the simplex; equal weights where that is undefined."""
    with np.errstate(all="ignore"):
        x = np.where(np.isnan(mu), np.nan, np.clip(mu, 0.0, 1.0))
        x = x / x.sum(axis=1, keepdims=True)
    bad = ~np.isfinite(x[:, 0])
    x[bad] = 1.0 / mu.shape[1]
    return x


def zero_weights(v: np.ndarray) -> np.ndarray:
    """Barycentric zeros, clamped where they fall outside."""
    mu, inside = inverse_lerp(v)
    out = clamp_barycentric(mu)
    out[inside] = mu[inside]
    return out


def type_2d(j: np.ndarray, symmetric: bool) -> np.ndarray:
    """Critical point types of (n, 2, 2) Jacobians, by trace, determinant and discriminant."""
    tr, det = j[:, 0, 0] + j[:, 1, 1], det2(j)
    out = np.full(len(j), DEGENERATE)
    if symmetric:
        out[(det > 0) & (tr > 0)], out[(det > 0) & (tr < 0)], out[det < 0] = MINIMUM, MAXIMUM, SADDLE
        return out
    disc = tr * tr - 4 * det
    real = disc >= 0
    out[real & (det < 0)] = SADDLE
    out[real & (det > 0) & (tr > 0)], out[real & (det > 0) & (tr < 0)] = MINIMUM, MAXIMUM
    out[~real & (tr < 0)], out[~real & (tr > 0)], out[~real & (tr == 0)] = ATTRACTING_FOCUS, REPELLING_FOCUS, CENTRE
    return out


def type_3d(j: np.ndarray, symmetric: bool) -> np.ndarray:
    """Types of (n, 3, 3) Hessians by eigenvalue signs; unknown for general Jacobians."""
    if not symmetric:
        return np.full(len(j), UNKNOWN)
    e = np.linalg.eigvalsh(j)
    out = np.full(len(j), SADDLE)
    out[(e > 0).all(axis=1)], out[(e < 0).all(axis=1)] = MINIMUM, MAXIMUM
    out[(e == 0).any(axis=1)] = DEGENERATE
    return out


def real_roots(p: np.ndarray, eps: float = 1e-12) -> list[float]:
    """Real roots of a polynomial with coefficients from the constant up."""
    p = np.trim_zeros(np.where(np.abs(p) < eps * max(1.0, np.abs(p).max()), 0.0, p), "b")
    if len(p) < 2:
        return []
    r = np.roots(p[::-1])
    return sorted(float(x.real) for x in r if abs(x.imag) <= 1e-9 * max(1.0, abs(x)))


def parallel_vectors_triangle(v: np.ndarray, w: np.ndarray, eps: float = 1e-9) -> list[tuple[float, np.ndarray]]:
    """(factor, barycentric weights) at which linear v equals factor * w on a triangle: a generalised eigenproblem."""
    a, b = np.asarray(v, float).T, np.asarray(w, float).T
    ts = np.array([0.0, 1.0, -1.0, 2.0])
    vals = np.array([np.linalg.det(a - t * b) for t in ts])
    p = np.linalg.solve(np.vander(ts, 4, increasing=True), vals)
    out = []
    for lam in real_roots(p):
        if abs(lam) <= eps:
            continue
        _, _, vt = np.linalg.svd(a - lam * b)
        mu = vt[-1]
        if abs(mu.sum()) < eps:
            continue
        mu = mu / mu.sum()
        if (mu < -1e-6).any() or (mu > 1 + 1e-6).any():
            continue
        if np.linalg.norm(np.cross(a @ mu, b @ mu)) > 1e-2:
            continue
        out.append((lam, mu))
    return out


def parallel_vectors_edge(v: np.ndarray, w: np.ndarray, eps: float = 1e-9) -> list[tuple[float, np.ndarray]]:
    """(factor, weights) at which two linear 2- or 3-vectors are parallel on an edge."""
    v, w = np.asarray(v, float), np.asarray(w, float)
    dv, dw = v[0] - v[1], w[0] - w[1]

    def cross(p, q):
        return np.cross(p, q) if len(p) == 3 else np.array([p[0] * q[1] - p[1] * q[0]])

    quad = np.stack((cross(v[1], w[1]), cross(dv, w[1]) + cross(v[1], dw), cross(dv, dw)), axis=1)
    lead = quad[np.abs(quad).max(axis=1).argmax()]
    out = []
    for x in real_roots(lead):
        if -eps <= x <= 1 + eps and np.abs(quad @ np.array([1, x, x * x])).max() <= 1e-2:
            p, q = x * dv + v[1], x * dw + w[1]
            if q @ q > 0 and abs(lam := float(p @ q / (q @ q))) > eps:
                out.append((lam, np.array([x, 1 - x])))
    return out


def parallel_vectors_tet(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomials Q (degree 3) and P (4 x degree 3) of the factor: weights on a tetrahedron are P_i / Q."""
    v, w = np.asarray(v, float), np.asarray(w, float)
    a, b = (v[:3] - v[3]).T, (w[:3] - w[3]).T
    ts = np.array([0.0, 1.0, -1.0, 2.0])
    q, p = [], []
    for t in ts:
        m, r = a - t * b, -(v[3] - t * w[3])
        q.append(np.linalg.det(m))
        row = []
        for j in range(3):
            c = m.copy()
            c[:, j] = r
            row.append(np.linalg.det(c))
        p.append([*row, q[-1] - sum(row)])
    basis = np.linalg.inv(np.vander(ts, 4, increasing=True))
    return basis @ np.array(q), (basis @ np.array(p)).T


def lambda2(j: np.ndarray) -> np.ndarray:
    """Middle eigenvalue of S^2 + W^2 of (n, 3, 3) Jacobians; negative in a vortex."""
    s, o = (j + np.swapaxes(j, 1, 2)) / 2, (j - np.swapaxes(j, 1, 2)) / 2
    return np.linalg.eigvalsh(s @ s + o @ o)[:, 1]


def cubic_discriminant(j: np.ndarray) -> np.ndarray:
    """Discriminant of the characteristic cubic of (n, 3, 3) matrices."""
    tr = np.trace(j, axis1=1, axis2=2)
    m2 = (tr**2 - np.trace(j @ j, axis1=1, axis2=2)) / 2
    b, c, d = -tr, m2, -det3(j)
    return b**2 * c**2 - 4 * c**3 - 4 * b**3 * d - 27 * d**2 + 18 * b * c * d


def multilinear(field: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a lattice field (..., components last) at n points; NaN outside."""
    d = x.shape[1]
    size = np.array(field.shape[:d])
    inside = ((x >= 0) & (x <= size - 1)).all(axis=1)
    y = np.where(inside[:, None], x, 0.0)
    lo = np.minimum(np.floor(y).astype(int), size - 2)
    f = y - lo
    out = 0.0
    for c in range(2**d):
        bit = np.array([(c >> k) & 1 for k in range(d)])
        w = np.where(bit, f, 1 - f).prod(axis=1)
        v = field[tuple((lo + bit).T)]
        out = out + (w[:, None] * v if v.ndim > 1 else w * v)
    out[~inside] = np.nan
    return out


def wachspress(corners: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Wachspress weights of a point in a convex polygon with (n, 3) corners on a sphere or plane."""
    n = len(corners)

    def area(a, b, c):
        return np.linalg.norm(np.cross(b - a, c - a)) / 2

    near = np.array([area(x, corners[k], corners[(k + 1) % n]) for k in range(n)])
    w = np.array(
        [area(corners[k - 1], corners[k], corners[(k + 1) % n]) * np.prod([near[m] for m in range(n) if m not in (k, (k - 1) % n)]) for k in range(n)]
    )
    return w / w.sum()


def in_spherical_cell(corners: np.ndarray, x: np.ndarray) -> bool:
    """Whether a point lies on the inner side of each edge's great circle."""
    return all(np.cross(corners[k], corners[(k + 1) % len(corners)]) @ x >= 0 for k in range(len(corners)))


def layer_of(tops: np.ndarray, z: float) -> int:
    """Layer i with tops[i + 1] < z <= tops[i] by bisection, tops descending; -1 outside."""
    i = int(np.searchsorted(-np.asarray(tops), -z, side="right")) - 1
    return i if 0 <= i < len(tops) - 1 else -1


def rk4(f, x: np.ndarray, h: float) -> np.ndarray:
    """One fourth-order step for n particles; NaN where a stage leaves the domain."""
    k1 = f(x)
    k2 = f(x + h / 2 * k1)
    k3 = f(x + h / 2 * k2)
    k4 = f(x + h * k3)
    return x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


def rotate_step(x: np.ndarray, v: np.ndarray, h: float) -> np.ndarray:
    """Points moved along great circles by tangent velocities; radii stay."""
    r = np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.cross(x, v)
    norm = np.linalg.norm(axis, axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        k = np.where(norm > 0, axis / norm, 0.0)
    speed = np.linalg.norm(v - (x * v).sum(axis=1, keepdims=True) * x / r**2, axis=1, keepdims=True)
    a = h * speed / r
    return x * np.cos(a) + np.cross(k, x) * np.sin(a) + k * (k * x).sum(axis=1, keepdims=True) * (1 - np.cos(a))


def spherical_rk1(f, x: np.ndarray, h: float) -> np.ndarray:
    return rotate_step(x, f(x)[:, :3], h)


def spherical_rk4(f, x: np.ndarray, h: float) -> np.ndarray:
    """Fourth-order step on the sphere; a fourth velocity component moves the radius."""
    v1 = f(x)
    v2 = f(rotate_step(x, v1[:, :3], h / 2))
    v3 = f(rotate_step(x, v2[:, :3], h / 2))
    v4 = f(rotate_step(x, v3[:, :3], h))
    v = (v1 + 2 * v2 + 2 * v3 + v4) / 6
    y = rotate_step(x, v[:, :3], h)
    if v.shape[1] > 3:
        r = np.linalg.norm(y, axis=1, keepdims=True)
        y = y * (1 + v[:, 3:4] * h / r)
    return y


def rbf_plane_weights(points: np.ndarray, x: np.ndarray, alpha: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(2, 2n) weights that rebuild an in-plane vector at x from the components along u and v at n points."""
    p = np.stack(((points - x) @ u, (points - x) @ v), axis=1)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    phi, near = 1 / (1 + (d / alpha) ** 2), 1 / (1 + (np.linalg.norm(p, axis=1) / alpha) ** 2)
    n = len(p)
    full = np.block([[phi, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    w = np.linalg.solve(full, np.append(near, 1.0))[:n]
    return np.stack((np.concatenate((w, 0 * w)), np.concatenate((0 * w, w))))


def gaussian_kernel(sigma: float, *sizes: int) -> np.ndarray:
    """Normalised Gaussian weights about the middle of a box."""
    grids = np.meshgrid(*[np.arange(n) - n // 2 for n in sizes], indexing="ij")
    k = np.exp(-sum(g.astype(float) ** 2 for g in grids) / (2 * sigma * sigma))
    return k / k.sum()
