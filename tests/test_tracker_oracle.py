"""The tracker against a slow one in plain Python lists, written from its rules step by step."""

import math

import numpy as np
import pytest

from vidtables.operators import tracking


def unit(v):
    size = math.sqrt(math.fsum(x * x for x in v))
    return [x / size for x in v] if size > 0 and size == size else None


def cos(a, b):
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))


class Slow:
    def __init__(self, p, n_slots, skips):
        self.p, self.n_slots, self.skips = p, n_slots, skips
        self.refs, self.tracks, self.lost = None, {}, {}

    def source(self, i):
        return "SKIP" if i in self.skips else "SWAP" if self.p.apply_all else str(i)

    def mean(self, tr):
        if not tr["history"]:
            return tr["emb"]
        held = tr["history"] + [tr["emb"]]
        n = len(held)
        return [sum((0.5 + 0.5 * k / (n - 1)) * v[j] for k, v in enumerate(held)) for j in range(len(held[0]))]

    def accept(self, tr, base, v):
        if base < 0:
            return False
        thr, hist = max(self.p.threshold, 0.18), tr["history"]
        if len(hist) >= 5:
            steps = [s for s in (cos(a, b) for a, b in zip(hist, hist[1:])) if s > 0]
            if steps:
                m = sum(steps) / len(steps)
                var = sum((s - m) ** 2 for s in steps) / len(steps)
                if var > 0.02:
                    thr *= 0.85
                elif var > 0.01:
                    thr *= 0.90
                elif m < thr + 0.03:
                    thr *= 0.93
        if len(hist) >= 3:
            orig = cos(v, tr["first"])
            if orig > 0:
                if orig > thr + 0.1:
                    thr *= 0.8
                elif orig > thr + 0.05:
                    thr *= 0.85
                before = [s for s in (cos(h, tr["first"]) for h in hist[-3:]) if s > 0]
                if before and orig - sum(before) / len(before) > 0.03:
                    thr *= 0.85
        if thr - 0.06 < base < thr + 0.02:
            tr["tol"] += 1
            if tr["tol"] >= 2:
                thr *= 1 - min(0.15, 0.03 * tr["tol"])
        elif base > thr + 0.02:
            tr["tol"] = 0
        thr = max(thr, 0.15)
        s = tr["stab"]
        return base >= thr + 0.03 or (base >= thr and s >= 1) or (base >= thr - 0.03 and s >= 2) or (base >= thr - 0.06 and s >= 3)

    def prune(self, at):
        if self.p.max_age < 0:
            return
        for k in list(self.tracks):
            tr = self.tracks[k]
            if at - tr["seen"] > self.p.max_age and not (self.p.apply_all and tr["source"] == "SKIP"):
                self.lost[k] = {"emb": tr["emb"], "source": tr["source"], "frame": tr["seen"] + self.p.max_age + 1, "history": tr["history"]}
                del self.tracks[k]
        for k in list(self.lost):
            if at - self.lost[k]["frame"] > 8 * self.p.max_age:
                del self.lost[k]

    def step(self, frame, dets):
        t = self.p.threshold
        new = lambda v, first, source, stab=1, history=(): {"emb": v, "seen": frame, "first": first, "history": list(history), "stab": stab, "source": source, "tol": 0}
        if self.refs is None:
            self.refs = {i: v for i, v in enumerate(dets) if v and (self.p.apply_all or i < self.n_slots)}
            self.tracks = {i: new(v, v, self.source(i)) for i, v in self.refs.items()}
        self.prune(frame - 1)
        if frame > 0 and frame % self.p.reset_interval == 0 and self.refs:
            pairs = sorted((-cos(v, r), i, k) for i, v in enumerate(dets) if v for k, r in self.refs.items() if cos(v, r) >= 0.6 * t)
            bound, used = {}, set()
            for _, i, k in pairs:
                if i not in used and k not in bound:
                    used.add(i)
                    bound[k] = new(dets[i], self.tracks[k]["first"] if k in self.tracks else self.refs[k], self.source(k), 2)
            for k, tr in self.tracks.items():
                if k not in bound and frame - tr["seen"] <= 5:
                    bound[k] = tr
            for k in bound:
                if k in self.lost and bound[k]["stab"] == 2 and bound[k]["seen"] == frame:
                    del self.lost[k]
            self.tracks = bound
        for v in dets:
            best, at = 0.0, None
            for k, x in self.lost.items() if v else ():
                skip = x["source"] == "SKIP"
                score = max(cos(v, y) for y in [x["emb"]] + x["history"][-3 if skip else -2 :])
                if score > (0.75 if skip else 0.7) * t and score > best:
                    best, at = score, k
            if at is not None:
                x = self.lost.pop(at)
                self.tracks[at] = new(v, x["emb"], x["source"], 1, x["history"])
        pairs = []
        for i, v in enumerate(dets):
            for order, (k, tr) in enumerate(self.tracks.items()) if v else ():
                base = cos(self.mean(tr), v)
                if self.accept(tr, base, v):
                    pairs.append((-base, i, order, k))
        out, matched = {}, set()
        for s, i, _, k in sorted(pairs):
            if i in out or k in matched:
                continue
            matched.add(k)
            tr, sim = self.tracks[k], -s
            act = sim > t + 0.03 or (sim > t and tr["stab"] >= 1) or (sim > t - 0.03 and tr["stab"] >= 2)
            said = "act" if act else "hold" if sim > t - 0.03 else "none"
            tr["stab"] += said != "none"
            tr["emb"], tr["seen"] = dets[i], frame
            tr["history"] = (tr["history"] + [dets[i]])[-12:]
            out[i] = (k, tr["source"], sim, said, tr["stab"])
        for k, tr in self.tracks.items():
            if k not in matched:
                tr["stab"] = max(1, tr["stab"] - 1)
        if self.p.apply_all:
            for i, v in enumerate(dets):
                if v and i not in out:
                    k = max([-1, *self.tracks, *self.lost]) + 1
                    self.tracks[k] = new(v, v, "SWAP")
                    out[i] = (k, "SWAP", None, "act", 1)
        self.prune(frame)
        return [out.get(i, (None, None, None, "none", None)) for i in range(len(dets))]


@pytest.mark.parametrize("apply_all", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_tracker_equals_the_slow_one(apply_all, seed):
    rng = np.random.default_rng(seed)
    params = tracking.Params(max_age=int(rng.integers(2, 6)), reset_interval=int(rng.integers(5, 15)), apply_all=apply_all)
    base = rng.normal(size=(4, 12))
    fast, slow = tracking.Tracker(params, 3, (1,)), Slow(params, 3, (1,))
    recovered = 0
    for frame in range(90):
        if frame and rng.random() < 0.25:
            continue
        seen = [k for k in range(4) if frame == 0 or rng.random() < 0.6]
        dets = [None if frame and rng.random() < 0.05 else base[k] + rng.normal(scale=0.5, size=12) for k in seen]
        a = fast.frame(frame, [tracking.unit(v) for v in dets])
        b = slow.step(frame, [None if v is None else unit(v.tolist()) for v in dets])
        recovered += sum(x[6] for x in a)
        for x, y in zip(a, b, strict=True):
            assert (x[0], x[1], x[3], x[4]) == (y[0], y[1], y[3], y[4]), (frame, a, b)
            assert (x[2] is None) == (y[2] is None) and (x[2] is None or abs(x[2] - y[2]) < 1e-9)
