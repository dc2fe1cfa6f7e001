"""Smoothing closed outlines by four-point subdivision, and Bezier curves through them."""

from __future__ import annotations

import math

import numpy as np

Point = tuple[float, float]


def _turns(ring: np.ndarray) -> np.ndarray:
    """Signed turn at each vertex of a closed ring without the repeated end; not a number at edges of length 0."""
    into, out = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    heading = lambda v: np.where((v == 0).all(1), np.nan, np.arctan2(v[:, 1], v[:, 0]))
    turn = heading(out) - heading(into)
    return np.where(turn > math.pi, turn - 2 * math.pi, np.where(turn < -math.pi, turn + 2 * math.pi, turn))


def corners(path: list[Point], threshold: float) -> np.ndarray:
    """Vertices that turn by ``threshold`` radians or more."""
    ring = np.array(path[:-1], float)
    return np.abs(_turns(ring)) >= threshold if len(ring) else np.zeros(0, bool)


def _subdivide(ring: np.ndarray, corner: np.ndarray, outset: float, least: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """One round over all edges at once: a new point outside the middle of each long edge, but between two corners."""
    nxt = np.roll(ring, -1, 0)
    prev, after = np.roll(ring, 1, 0), np.roll(ring, -2, 0)
    length = np.hypot(*(nxt - ring).T)
    with np.errstate(divide="ignore", invalid="ignore"):
        uneven = (np.roll(length, 1) / length >= 2) | (np.roll(length, -1) / length >= 2)
    here, there = corner, np.roll(corner, -1)
    split = (length > least) & ~uneven & ~(here & there)
    middle = (ring + nxt) / 2
    inner = (np.where(here[:, None], ring, prev) + np.where(there[:, None], nxt, after)) / 2
    away = (middle - inner) / outset
    new = np.where(np.hypot(*away.T)[:, None] < np.finfo(float).eps, middle, middle + away)
    more = split & ((np.hypot(*(new - ring).T) > least) | (np.hypot(*(new - nxt).T) > least))
    order = np.argsort(np.r_[np.arange(len(ring)), np.flatnonzero(split) + 0.5], kind="stable")
    return np.vstack([ring, new[split]])[order], np.r_[corner, np.zeros(split.sum(), bool)][order], not more.any()


def smooth(path: list[Point], threshold: float = math.pi / 3, outset: float = 8.0, least: float = 4.0, rounds: int = 10) -> list[Point]:
    """A closed path, subdivided until no edge is longer than ``least`` or the rounds are over; corners stay."""
    if len(path) < 3:
        return list(path)
    ring, corner = np.array(path[:-1], float), corners(path, threshold)
    for _ in range(rounds):
        ring, corner, done = _subdivide(ring, corner, outset, least)
        if done:
            break
    return [tuple(p) for p in ring.tolist()] + [tuple(ring[0].tolist())]


def splices(path: list[Point], threshold: float = math.pi / 4) -> list[int]:
    """Where curves should part: at inflections, and when the turns since the last part add up to ``threshold``."""
    turn = _turns(np.array(path[:-1], float))
    out, turned, rising = [], 0.0, None
    for i, t in enumerate(turn.tolist()):
        up = math.copysign(1, t) > 0
        turned += t
        if rising is not None and up != rising or abs(turned) >= threshold:
            out.append(i)
            turned = 0.0
        rising = up
    return out


def fit_bezier(points: list[Point]) -> list[Point]:
    """One cubic by least squares on chord lengths, end tangents free; four control points."""
    p = np.array(points, float)
    t = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    if len(p) < 3 or t[-1] == 0:
        third = (p[-1] - p[0]) / 3
        return [tuple(x) for x in (p[0], p[0] + third, p[-1] - third, p[-1])]
    t = t / t[-1]
    basis = np.stack([3 * t * (1 - t) ** 2, 3 * t**2 * (1 - t)], 1)
    rest = p - np.outer((1 - t) ** 3, p[0]) - np.outer(t**3, p[-1])
    inner, *_ = np.linalg.lstsq(basis, rest, rcond=None)
    return [tuple(x) for x in (p[0], inner[0], inner[1], p[-1])]


def spline(path: list[Point], threshold: float = math.pi / 4) -> list[Point]:
    """1 + 3n control points of cubics through a smoothed closed path."""
    ring = path[:-1]
    if len(ring) < 3:
        return []
    cut = splices(path, threshold) or [0]
    if len(cut) == 1:
        cut = sorted({cut[0], (cut[0] + len(ring) // 2) % len(ring)})
    out: list[Point] = []
    for a, b in zip(cut, [*cut[1:], cut[0] + len(ring)], strict=True):
        curve = fit_bezier([ring[k % len(ring)] for k in range(a, b + 1)])
        out += curve if not out else curve[1:]
    return out
