"""The fits and scores of dist.py for many gaps at once: each row is a gap, fitted from the gaps strictly before it.

All functions take the gaps of a stretch of one series, in order and above 0, and `at`, the gaps to be fitted; sums over windows come from
running sums of centred values, and what needs a window's values themselves works on blocks of windows.  Where there is too little
history the fit is nan.
"""

import math

import numpy as np

from . import dist

BLOCK = 512
#: The normal distribution function between -9 and 9, as a cubic on each 256th, whose values and slopes are exact at the ends: within 1e-12.
_PER, _END = 256, 9


def _cubics() -> np.ndarray:
    z = np.arange(-_END * _PER, _END * _PER + 1) / _PER
    value, slope = dist.phi(z), np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / _PER
    rise = np.diff(value)
    return np.stack((value[:-1], slope[:-1], 3 * rise - 2 * slope[:-1] - slope[1:], slope[:-1] + slope[1:] - 2 * rise))


_CUBICS = _cubics()


def phi(z: np.ndarray) -> np.ndarray:
    u = (np.clip(np.nan_to_num(z, nan=0.0), -_END, _END - 1e-9) + _END) * _PER
    i = u.astype(np.int32)
    f = u - i
    a, b, c, d = _CUBICS
    return np.where(np.isnan(z), np.nan, a[i] + f * (b[i] + f * (c[i] + f * d[i])))


class Many:
    """A distribution for each row: lognormal (mean and sd of ln x) or, where `weibull`, Weibull (shape, scale); with weight w, a second lognormal (a2, b2)."""

    def __init__(self, a, b, weibull=None, a2=None, b2=None, w=None):
        self.a, self.b = np.asarray(a, float), np.asarray(b, float)
        self.weibull = np.zeros(len(self.a), bool) if weibull is None else weibull
        self.a2, self.b2, self.w = a2, b2, np.zeros(len(self.a)) if w is None else w

    def __len__(self) -> int:
        return len(self.a)

    @property
    def known(self) -> np.ndarray:
        return np.isfinite(self.a) & np.isfinite(self.b)

    def take(self, rows) -> "Many":
        pick = lambda x: None if x is None else x[rows]
        return Many(self.a[rows], self.b[rows], self.weibull[rows], pick(self.a2), pick(self.b2), self.w[rows])

    def cdf(self, t: np.ndarray) -> np.ndarray:
        """t: for each row a number, or a row of them, above 0 where it counts."""
        wide = (lambda x: x[:, None]) if t.ndim == 2 else (lambda x: x)
        positive = np.maximum(t, 1e-300)
        logs = np.log(positive)
        out = phi((logs - wide(self.a)) / wide(self.b))
        if self.weibull.any():
            own = self.weibull
            out[own] = -np.expm1(-np.exp(wide(self.a[own]) * (logs[own] - np.log(wide(self.b[own])))))
        if self.a2 is not None:
            out = (1 - wide(self.w)) * out + wide(self.w) * phi((logs - wide(self.a2)) / wide(self.b2))
        return np.where(t > 0, out, 0.0)

    def pdf(self, t: np.ndarray) -> np.ndarray:
        wide = (lambda x: x[:, None]) if t.ndim == 2 else (lambda x: x)
        bell = lambda a, b: np.exp(-0.5 * ((np.log(t) - wide(a)) / wide(b)) ** 2) / (t * wide(b) * math.sqrt(2 * math.pi))
        out = bell(self.a, self.b)
        return out if self.a2 is None else (1 - wide(self.w)) * out + wide(self.w) * bell(self.a2, self.b2)

    def ppf(self, q) -> np.ndarray:
        """(row, quantile)."""
        q = np.asarray(q, float)
        z = dist.inverse_phi(q)[None]
        x = np.exp(self.a[:, None] + self.b[:, None] * z)
        if self.weibull.any():
            own = self.weibull
            x[own] = self.b[own, None] * (-np.log1p(-q))[None] ** (1 / self.a[own, None])
        mixed = np.flatnonzero(self.w > 0)
        if len(mixed):
            m = self.take(mixed)
            other = np.exp(m.a2[:, None] + m.b2[:, None] * z)
            lo, hi = np.minimum(x[mixed], other), np.maximum(x[mixed], other)
            at = np.sqrt(lo * hi)
            for _ in range(60):  # Newton's steps, or halving where they leave the bracket
                off = m.cdf(at) - q[None]
                if np.nanmax(np.abs(off), initial=0) < 1e-13:
                    break
                lo, hi = np.where(off < 0, at, lo), np.where(off < 0, hi, at)
                step = at - off / np.maximum(m.pdf(at), 1e-300)
                at = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
            x[mixed] = at
        return x


class Normals(Many):
    """A normal distribution for each row: mean and sd."""

    def take(self, rows) -> "Normals":
        return Normals(self.a[rows], self.b[rows])

    def cdf(self, t: np.ndarray) -> np.ndarray:
        wide = (lambda x: x[:, None]) if t.ndim == 2 else (lambda x: x)
        return phi((t - wide(self.a)) / wide(self.b))

    def ppf(self, q) -> np.ndarray:
        return self.a[:, None] + self.b[:, None] * dist.inverse_phi(np.asarray(q, float))[None]


def crps(many: Many, y: np.ndarray, points: int = 512) -> np.ndarray:
    """Continuous ranked probability score of each row by the trapezoid rule, on the grid that dist.crps takes."""
    out = np.full(len(y), np.nan)
    for s in range(0, len(y), BLOCK):
        own = many.take(slice(s, s + BLOCK))
        edge, t = own.ppf([0.0005, 0.9995]), y[s : s + BLOCK]
        lo, hi = np.minimum(edge[:, 0], t) - 1e-9, np.maximum(edge[:, 1], t) + 1e-9
        step = (hi - lo) / (points - 1)
        grid = lo[:, None] + step[:, None] * np.arange(points)
        f = (own.cdf(grid) - (grid >= t[:, None])) ** 2
        out[s : s + BLOCK] = step * (f.sum(axis=1) - 0.5 * (f[:, 0] + f[:, -1]))
    return out


class Sums:
    """Sums over runs of a sequence, from running sums of its centred values."""

    def __init__(self, v: np.ndarray):
        self.middle = float(v.mean()) if len(v) else 0.0
        c = v - self.middle
        self.one, self.two = np.concatenate(([0.0], np.cumsum(c))), np.concatenate(([0.0], np.cumsum(c * c)))

    def spread(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, mean and sum of squares about the mean of v[first:last]."""
        n = np.maximum(last - first, 0)
        s, q = self.one[last] - self.one[first], self.two[last] - self.two[first]
        with np.errstate(invalid="ignore", divide="ignore"):
            return n, self.middle + s / n, np.maximum(q - s * s / n, 0.0)


def _bell(sums: Sums, first: np.ndarray, last: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (of samples) of runs of ln x."""
    n, mean, squares = sums.spread(first, last)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n >= least, mean, np.nan), np.where(n >= least, np.maximum(np.sqrt(squares / (n - 1)), 1e-6), np.nan)


def normal(x: np.ndarray, at: np.ndarray, window: int = 30, least: int = 8) -> Normals:
    a, b = _bell(Sums(x), np.maximum(at - window, 0), at, least)
    return Normals(a, np.maximum(b, 1e-3))


def branched(x: np.ndarray, kind: np.ndarray, at: np.ndarray, window: int = 400, least: int = 60, least_branch: int = 25, least_known: int = 0) -> Many:
    """A lognormal of the window's gaps that began as this one does, or of all where there are too few; kind: 0, 1, or -1 for not known."""
    y, first = np.log(x), np.maximum(at - window, 0)
    n, (a, b) = at - first, _bell(Sums(y), first, at)
    middle, known = float(y.mean()) if len(y) else 0.0, np.zeros(len(at), np.int64)
    out_a, out_b = a.copy(), b.copy()
    for g in (0, 1):
        own = kind == g
        run = lambda v, own=own: np.concatenate(([0.0], np.cumsum(np.where(own, v, 0.0))))
        k, s, q = (c[at] - c[first] for c in (run(np.ones(len(y))), run(y - middle), run((y - middle) ** 2)))
        known += k.astype(np.int64)
        with np.errstate(all="ignore"):
            mean, sd = middle + s / k, np.maximum(np.sqrt(np.maximum(q - s * s / k, 0) / (k - 1)), 1e-6)
        use = (kind[at] == g) & (k >= max(least_branch, 12))
        out_a, out_b = np.where(use, mean, out_a), np.where(use, sd, out_b)
    plain = known < least_known
    out_a, out_b = np.where(plain, a, out_a), np.where(plain, b, out_b)
    return Many(np.where(n >= least, out_a, np.nan), np.where(n >= least, out_b, np.nan))


def lognormal(x: np.ndarray, at: np.ndarray, window: int = 100) -> Many:
    return Many(*_bell(Sums(np.log(x)), np.maximum(at - window, 0), at))


def _windows(x: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """(row, window): the last gaps before each, nan before the first."""
    held = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(window, np.nan), x)), window)
    return held[at]


def _weibull(p: np.ndarray, use: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of the values in use in each row, by Newton's method on the shape."""
    n = use.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(use, p, 0).sum(axis=1) / n
        ln = np.where(use, np.log(np.where(use, p, 1.0) / mean[:, None]), 0.0)
        middle = ln.sum(axis=1) / n
        sd = np.sqrt((np.where(use, ln - middle[:, None], 0) ** 2).sum(axis=1) / n)
        spread = np.where(use, p - mean[:, None], 0).any(axis=1)
    top = np.where(use, ln, -np.inf).max(axis=1, initial=-np.inf)
    ok = (n >= least) & spread
    shape, scale = np.full(len(p), np.nan), np.full(len(p), np.nan)
    todo = np.flatnonzero(ok)
    c = 1.2 / np.maximum(sd[todo], 1e-3)
    for _ in range(60):
        if not len(todo):
            break
        e = np.where(use[todo], np.exp(c[:, None] * (ln[todo] - top[todo, None])), 0)
        s0, s1, s2 = e.sum(axis=1), (e * ln[todo]).sum(axis=1), (e * ln[todo] ** 2).sum(axis=1)
        step = (s1 / s0 - 1 / c - middle[todo]) / (s2 / s0 - (s1 / s0) ** 2 + 1 / c**2)
        c = np.maximum(c - step, c / 4)
        shape[todo] = c
        going = np.abs(step) >= 1e-10 * c
        todo, c = todo[going], c[going]
    e = np.where(use, np.exp(np.where(ok, shape, 1.0)[:, None] * ln), 0).sum(axis=1)
    scale[ok] = (mean[ok] * (e[ok] / n[ok]) ** (1 / shape[ok]))
    return shape, scale


def _by_block(f, at: np.ndarray):
    """f of blocks of at, put together."""
    parts = [f(at[s : s + BLOCK]) for s in range(0, len(at), BLOCK)] or [f(at)]
    return [np.concatenate(x) for x in zip(*parts)]


def weibull(x: np.ndarray, at: np.ndarray, window: int = 100) -> Many:
    def fit(own):
        p = _windows(x, own, window)
        return _weibull(p, ~np.isnan(p))

    shape, scale = _by_block(fit, at)
    return Many(shape, scale, np.ones(len(at), bool))


def best_parametric(x: np.ndarray, at: np.ndarray, window: int = 150) -> Many:
    """Lognormal or Weibull, whichever gives the last quarter of the window the greater likelihood, fitted again on all of it."""
    sums = Sums(np.log(x))

    def fit(own):
        first = np.maximum(own - window, 0)
        n = own - first
        cut = first + (0.75 * n).astype(int)
        p = _windows(x, own, window)
        there = ~np.isnan(p)
        early = there & (np.arange(window)[None] < (window - (own - cut))[:, None])
        late = there & ~early
        with np.errstate(all="ignore"):
            y = np.log(np.where(there, p, 1.0))
            m, s = _bell(sums, first, cut)
            bell = np.where(late, -0.5 * ((y - m[:, None]) / s[:, None]) ** 2 - np.log(s * math.sqrt(2 * math.pi))[:, None] - y, 0).sum(axis=1)
            c, k = _weibull(p, early)
            r = np.log(np.where(there, p, 1.0) / k[:, None])
            tail = np.where(late, np.log(c / k)[:, None] + (c - 1)[:, None] * r - np.exp(c[:, None] * r), 0).sum(axis=1)
            other = (tail > np.where(np.isfinite(bell), bell, -np.inf)) & (n >= 24)
            a, b = _bell(sums, first, own, 24)
            a[other], b[other] = _weibull(p[other], there[other])
        return a, b, other

    return Many(*_by_block(fit, at))


def last_changepoint(x: np.ndarray, at: np.ndarray, window: int = 800, least: int = 40, penalty: float = 8.0, back: int = 600) -> np.ndarray:
    """Of the last `window` gaps before each: where the newest stretch with a mean of its own begins, else 0."""
    sums = Sums(x)

    def find(own):
        first = np.maximum(own - window, 0)
        n = own - first
        low, high = np.maximum(least, n - back), n - least
        k = low[:, None] + np.arange(max(back - least, 1))[None]
        there = (k < high[:, None]) & (n >= 2 * least)[:, None]
        cut = first[:, None] + np.where(there, k, low[:, None])
        cut = np.minimum(cut, own[:, None])
        with np.errstate(all="ignore"):
            within = sums.spread(first[:, None], cut)[2] + sums.spread(cut, own[:, None])[2]
        within = np.where(there, within, np.inf)
        best = within.argmin(axis=1)
        total = sums.spread(first, own)[2]
        least_within = within[np.arange(len(own)), best]
        with np.errstate(all="ignore"):
            enough = total - least_within >= penalty * total / n * np.log(n)
        return (np.where(there.any(axis=1) & enough, low + best, 0),)

    return _by_block(find, at)[0]


def adaptive_lognormal(x: np.ndarray, at: np.ndarray, windows=(25, 50, 100, 200), holdout: int = 25, window: int = 800) -> tuple[Many, np.ndarray, np.ndarray]:
    """A lognormal on the run, of the stretch since the last change, that gives the last gaps the greatest likelihood; the stretch's gaps and the run's."""
    y = np.log(x)
    sums, plain = Sums(y), np.concatenate(([0.0], np.cumsum(y)))
    first = np.maximum(at - window, 0)
    n = at - first
    change = last_changepoint(x, at, window)
    start = np.where(n - change >= 40, first + change, first)
    mid = np.maximum(at - holdout, 0)
    gain, best = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)
    held, mean, squares = sums.spread(mid, at)
    for w in windows:
        m, s = _bell(sums, np.minimum(np.maximum(mid - w, start), mid), mid)
        with np.errstate(all="ignore"):
            g = -(squares + held * (mean - m) ** 2) / (2 * s * s) - held * np.log(s * math.sqrt(2 * math.pi)) - (plain[at] - plain[mid])
        better = np.isfinite(g) & (g > gain)
        gain, best = np.where(better, g, gain), np.where(better, w, best)
    used = np.minimum(np.where(best > 0, best, 200), at - start)
    m, s = _bell(sums, at - used, at)
    enough = at >= 60
    return Many(np.where(enough, m, np.nan), np.where(enough, s, np.nan)), at - start, used


def widened(x: np.ndarray, at: np.ndarray, narrow: Many | None = None) -> Many:
    """The narrow fit with a wide tail about the same median, where there is history enough to know the tail."""
    sums = Sums(np.log(x))
    near = lognormal(x, at)
    narrow = narrow or near
    far = _bell(sums, np.maximum(at - 2000, 0), at)[1]
    sd = np.maximum(np.maximum(far, 2 * near.b), 0.2)
    centre = np.where(narrow.weibull, np.log(np.maximum(narrow.ppf([0.5])[:, 0], 1e-9)), narrow.a)
    wide = at >= 300
    return Many(narrow.a, narrow.b, narrow.weibull, np.where(wide, centre, 0.0), np.where(wide, sd, 1.0), np.where(wide, 0.15, 0.0))


def series_modes(x: np.ndarray, branch: np.ndarray, at: np.ndarray, window: int = 600) -> dict[str, np.ndarray]:
    """Two modes of the gaps of a window, within a series of events and between series: `split` parts them (nan: there is one mode), the
    mean and sd of ln x of each, and the share of long ones, of gaps that began as this one does and of all; and the lognormal of all.
    """

    def fit(own):
        p = _windows(x, own, window)
        kind = _windows(branch.astype(float), own, window)
        n = np.minimum(own, window)
        enough = n >= 80
        with np.errstate(all="ignore"):
            ordered = np.sort(p, axis=1)  # nan last

            def quantile(q):
                place = q * np.maximum(n - 1, 0)
                low = np.floor(place).astype(int)
                a, b = ordered[np.arange(len(own)), low], ordered[np.arange(len(own)), np.minimum(low + 1, np.maximum(n - 1, 0))]
                return a + (b - a) * (place - low)

            lo, hi = quantile(0.25), quantile(0.75)
            split = np.sqrt(lo * hi)
            there = ~np.isnan(p)
            y = np.log(np.where(there, p, 1.0))
            short, long = there & (p < split[:, None]), there & (p >= split[:, None])
            two = enough & (hi >= 3.5 * lo) & (np.minimum(short.sum(axis=1), long.sum(axis=1)) >= 25)

            def bell(use):
                k = use.sum(axis=1)
                m = np.where(use, y, 0).sum(axis=1) / k
                return m, np.maximum(np.sqrt((np.where(use, y - m[:, None], 0) ** 2).sum(axis=1) / (k - 1)), 1e-6)

            same = there & (kind == branch[own].astype(float)[:, None])
            share_all = long.sum(axis=1) / n
            share = np.where(same.sum(axis=1) >= 25, (long & same).sum(axis=1) / same.sum(axis=1), share_all)
            only = lambda v, keep: np.where(keep, v, np.nan)
            clip = lambda v: np.clip(v, 0.05, 0.95)
            return (only(split, two), *[only(v, two) for v in (*bell(short), *bell(long), clip(share), clip(share_all))], *[only(v, enough) for v in bell(there)])

    return dict(zip(("split", "short_mean", "short_sd", "long_mean", "long_sd", "share", "share_all", "mean", "sd"), _by_block(fit, at)))


def series_conditional(x: np.ndarray, branch: np.ndarray, at: np.ndarray, window: int = 600) -> Many:
    m = series_modes(x, branch, at, window)
    two = np.isfinite(m["split"])
    pick = lambda a, b: np.where(two, m[a], m[b])
    return Many(pick("short_mean", "mean"), pick("short_sd", "sd"), None, np.where(two, m["long_mean"], 0.0), np.where(two, m["long_sd"], 1.0), np.where(two, m["share"], 0.0))


class Draws:
    """Random numbers for renewal forecasts, the same for all of them: `sims` paths of `steps` gaps."""

    def __init__(self, sims: int, steps: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.z, self.u, self.steps = rng.standard_normal((sims, steps)), rng.random((sims, steps)), steps

    def renewals(self, many: Many, k: int, ages: list[float], p_seen: float) -> list[tuple[float, float, list[float]]]:
        """For each silence in minutes: expected events missed, the chance that none was, and the quantiles 0.05, 0.5 and 0.95 of the minutes left (dist.renewal)."""
        logs = many.a[k] + many.b[k] * self.z
        if many.w[k] > 0:
            logs = np.where(self.u < many.w[k], many.a2[k] + many.b2[k] * self.z, logs)
        sums = np.cumsum(np.maximum(np.exp(logs), 1e-6), axis=1)
        p = min(max(p_seen, 0.05), 0.995)
        out = []
        for age in ages:
            missed = (sums < age).sum(axis=1)
            past = missed < self.steps  # paths that get beyond the age
            if not past.any():
                missed, past = np.minimum(missed, self.steps - 1), np.ones(len(sums), bool)
            samples = sums[np.arange(len(sums)), np.minimum(missed, self.steps - 1)]
            w = np.power(1 - p, missed - missed[past].min()) * past
            w /= w.sum()
            order = np.argsort(samples)
            c = np.cumsum(w[order])
            q = np.interp([0.05, 0.5, 0.95], c / c[-1], samples[order]) - age
            out.append((float((w * missed).sum()), float(w[missed == 0].sum()), q.tolist()))
        return out
