"""Keyed state machines: one pure step per rule, used by the batch replay and
by the streaming operator alike.

State is a small dict of plain values, so it can be stored as JSON.  A step
takes the state and one row and returns the output tuples for that row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.operators.ordering import DAY_US, ordered_fold, previous_row, running


@dataclass(frozen=True)
class Fold:
    start: Callable[[], dict]
    step: Callable[[dict, object], list]
    out: str  # output fields after the keys
    restart_us: int | None = None  # a longer or equal pause surely restarts the state
    state: str | None = None  # fields of the state, for stores with typed state


def replay(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, width_us: int = DAY_US) -> DataFrame:
    """Batch twin.  Keys run in parallel; where a long enough pause restarts the
    state, a key is cut there too, so that a hot key spreads over its segments."""
    types = dict(rows.dtypes)
    by = list(keys)
    if fold.restart_us is not None:
        d = previous_row(rows, keys, order, [order[0]], width_us)
        cut = (F.coalesce(F.col(order[0]) - F.col(f"prev.{order[0]}") >= fold.restart_us, F.lit(False))).cast("long")
        rows = running(d.withColumn("_cut", cut).drop("prev"), keys, order, {"segment": ("sum", F.col("_cut"))}, width_us).drop("_cut")
        by = [*keys, "segment"]

    def step(state, row):
        k = tuple(getattr(row, n) for n in keys)
        return [(*k, *o) for o in fold.step(state, row)]

    return ordered_fold(rows, by, order, fold.start, step, ", ".join(f"{n} {types[n]}" for n in keys) + ", " + fold.out)


def follow(stream: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """Streaming twin: state per key survives between micro-batches as JSON."""
    types = dict(stream.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in keys) + ", " + fold.out
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(key, frames, state: GroupState):
        saved = json.loads(state.get[0]) if state.exists else fold.start()
        batch = pd.concat(list(frames)).sort_values(order)
        out = []
        for row in batch.itertuples(index=False):
            out.extend((*key, *o) for o in fold.step(saved, row))
        state.update((json.dumps(saved),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "saved string", "append", GroupStateTimeout.NoTimeout)


def token_bucket(capacity: float, rate: float) -> Fold:
    """Refill by elapsed time up to capacity; allow when a token is left."""
    def step(s, r):
        if capacity <= 0 or rate <= 0:
            return [(r.event_id, True, None)]
        elapsed = 0.0 if s["last"] is None else (r.us - s["last"]) / 1e6
        s["tokens"] = min(capacity, s["tokens"] + elapsed * rate)
        s["last"] = int(r.us)
        if s["tokens"] >= 1.0:
            s["tokens"] -= 1.0
            return [(r.event_id, True, None)]
        return [(r.event_id, False, max(1, math.ceil((1.0 - s["tokens"]) / rate)))]

    full = math.ceil(capacity / rate * 1e6) if rate > 0 and capacity > 0 else None
    return Fold(lambda: {"tokens": float(capacity), "last": None}, step, "event_id long, allowed boolean, retry_after long", full, "tokens double, last long")


def failure_throttle(window_s: int, threshold: int, base_s: int, max_s: int) -> Fold:
    def step(s, r):
        now = int(r.us // 1_000_000)
        if s["started"] is None or now - s["started"] >= window_s:
            s.update(attempts=1, started=now, locked=0)
        else:
            n = s["attempts"] + 1
            if n >= threshold:
                s["locked"] = max(s["locked"], now + min(max_s, base_s * (1 << min(10, n - threshold))))
            s["attempts"] = min(n, 1_000_000)
        return [(r.event_id, s["attempts"], s["locked"])]

    return Fold(lambda: {"attempts": 0, "started": None, "locked": 0}, step, "event_id long, attempts int, locked_until long", (window_s + 1) * 1_000_000, "attempts int, started long, locked long")


def echo_filter(ttl_us: int) -> Fold:
    """Rows with recorded=true remember their fingerprint; an incoming row within
    the time is suppressed once per recorded occurrence."""
    def step(s, r):
        if s["n"] and r.us - s["at"] > ttl_us:
            s["n"] = 0
        if r.recorded:
            s.update(n=s["n"] + 1, at=int(r.us))
            return []
        if s["n"]:
            s["n"] -= 1
            return [(r.event_id, True)]
        return [(r.event_id, False)]

    return Fold(lambda: {"n": 0, "at": 0}, step, "event_id long, suppressed boolean", ttl_us + 1, "n long, at long")


def scene_stability(scale: float, below: float, frames: int) -> Fold:
    def step(s, r):
        small = s["last"] is not None and abs(r.value - s["last"]) / scale < below
        s.update(last=float(r.value), run=s["run"] + 1 if small else 0)
        return [(r.event_id, s["run"], s["run"] > frames)]

    return Fold(lambda: {"last": None, "run": 0}, step, "event_id long, run long, stable boolean", state="last double, run long")


def motion_analyser(alpha: float, weights=(0.4, 0.3, 0.2, 0.1), ahead: float = 1.0, stale_us: int | None = None) -> Fold:
    """Smoothed velocity and acceleration, weighted score, class and prediction."""
    def step(s, r):
        p = [float(r.x), float(r.y), float(r.z)]
        if s["p"] is None:
            s.update(p=p, v=[0.0] * 3, a=[0.0] * 3, vol=float(r.volume))
        delta = [a - b for a, b in zip(p, s["p"])]
        jerk = [d - v for d, v in zip(delta, s["v"])]
        s["v"] = [v * (1 - alpha) + d * alpha for v, d in zip(s["v"], delta)]
        s["a"] = [v * (1 - alpha) + d * alpha for v, d in zip(s["a"], jerk)]
        shape = min(abs(r.volume / s["vol"] - 1), 1.0) if s["vol"] > 0 else 0.0
        s.update(p=p, vol=float(r.volume))
        parts = [min(math.sqrt(sum(c * c for c in vec)), 1.0) for vec in (delta, s["v"], s["a"])] + [shape]
        score = min(max(sum(w * q for w, q in zip(weights, parts)), 0.0), 1.0)
        kind = "static" if score < 0.1 else "slow" if score < 0.4 else "dynamic" if score < 0.8 else "rapid"
        return [(r.event_id, score, kind, p[0] + s["v"][0] * ahead + s["a"][0] * 0.5 * ahead * ahead)]

    return Fold(lambda: {"p": None, "v": None, "a": None, "vol": 0.0}, step, "event_id long, score double, motion string, next_x double", stale_us,
                "p array<double>, v array<double>, a array<double>, vol double")


def _iou(a, b) -> float:
    lo = [max(p, q) for p, q in zip(a[:3], b[:3])]
    hi = [min(p, q) for p, q in zip(a[3:], b[3:])]
    if any(h < low for low, h in zip(lo, hi)):
        return 0.0

    def vol(low, h):
        return (h[0] - low[0]) * (h[1] - low[1]) * (h[2] - low[2])

    inter = vol(lo, hi)
    union = vol(a[:3], a[3:]) + vol(b[:3], b[3:]) - inter
    return inter / union if union > 0 else 0.0


def object_tracker(max_distance=1.0, min_iou=0.3, max_lost=30, confirm=3) -> Fold:
    """Greedy tracker over one row per frame (frame, detections array of
    det_id, x, y, z and box); tracks take detections in track order.  Skipped
    frames count as lost."""
    def step(s, r):
        gap = 0 if s["frame"] is None else int(r.frame) - s["frame"]
        s["frame"] = int(r.frame)
        dets = [(int(d["det_id"]), [float(d[c]) for c in ("x", "y", "z")], [float(d[c]) for c in ("x0", "y0", "z0", "x1", "y1", "z1")]) for d in sorted(r.detections, key=lambda d: d["det_id"])]
        free = dict.fromkeys(range(len(dets)))
        for t in s["tracks"]:
            t["lost"] += max(gap - 1, 0)
        s["tracks"] = [t for t in s["tracks"] if t["lost"] <= max_lost]
        out = []
        for t in s["tracks"]:
            best = None
            for i in free:
                _, centre, box = dets[i]
                dist, iou = math.dist(t["c"], centre), _iou(t["box"], box)
                if dist < max_distance or iou > min_iou:
                    score = dist - iou * max_distance
                    if best is None or score < best[1]:
                        best = (i, score)
            if best is None:
                t["lost"] += 1
            else:
                del free[best[0]]
                t.update(c=dets[best[0]][1], box=dets[best[0]][2], hits=t["hits"] + 1, lost=0, det=dets[best[0]][0])
        for i in free:
            s["tracks"].append({"id": s["next"], "c": dets[i][1], "box": dets[i][2], "hits": 1, "lost": 0, "det": dets[i][0]})
            s["next"] += 1
        s["tracks"] = [t for t in s["tracks"] if t["lost"] <= max_lost]
        out.extend((s["frame"], t["id"], t["det"], t["hits"], t["lost"]) for t in s["tracks"] if t["hits"] >= confirm)
        return out

    return Fold(lambda: {"frame": None, "tracks": [], "next": 0}, step, "frame long, track_id int, det_id long, hits int, lost int")


def delta_encoder(threshold: float, max_gap: int, pause_us: int | None = None) -> Fold:
    """Emit a row when a coordinate moved past the threshold since the last emitted
    one; a key frame after a sequence gap, which a pause of ``pause_us`` always is."""
    def step(s, r):
        p = [float(r.x), float(r.y), float(r.z)]
        key = s["p"] is None or r.sequence > s["seq"] + max_gap
        moved = key or any(abs(a - b) > threshold for a, b in zip(p, s["p"]))
        if moved:
            s["p"] = p
        s["seq"] = int(r.sequence)
        return [(r.event_id, bool(moved), bool(key))]

    return Fold(lambda: {"p": None, "seq": 0}, step, "event_id long, emitted boolean, key_frame boolean", pause_us, "p array<double>, seq long")


def job_machine() -> Fold:
    """Updates (status, progress, us, error); pending resets a job, attempts grow on
    the first running state, started keeps the first time, finished the latest."""
    def step(s, r):
        if r.status == "pending":
            s.update(status="pending", progress=0.0, started=None, finished=None, error=None)
        elif r.status == "progress":
            s["progress"] = float(r.progress)
        else:
            if r.status == "running" and s["started"] is None:
                s["attempts"] += 1
            begun = int(r.us) if r.status == "running" else None
            ended = int(r.us) if r.status in ("completed", "failed") else None
            s.update(status=r.status, progress=float(r.progress), started=s["started"] if s["started"] is not None else begun,
                     finished=ended if ended is not None else s["finished"], error="failed" if r.status == "failed" else None)
        s["seq"] += 1
        return [(s["seq"], s["status"], s["progress"], s["started"], s["finished"], s["error"], s["attempts"])]

    return Fold(lambda: {"status": "pending", "progress": 0.0, "started": None, "finished": None, "error": None, "attempts": 0, "seq": 0}, step,
                "seq long, status string, progress double, started_at long, finished_at long, last_error string, attempts int")


def work_journal(retry_limit: int) -> Fold:
    """claim / commit / fail / interrupt per group; an interrupted attempt is given back."""
    def step(s, r):
        decision = None
        if r.action == "claim":
            if s["status"] == "committed":
                decision = "already_committed"
            elif s["status"] is not None and s["attempts"] >= max(retry_limit, 1):
                decision = "retry_limit"
            else:
                s.update(status="running", attempts=s["attempts"] + 1)
                decision = "process"
        elif s["status"] is not None:
            if r.action == "commit":
                s["status"] = "committed"
            else:
                s["status"] = "failed"
                if r.action == "interrupt":
                    s["attempts"] = max(s["attempts"] - 1, 0)
        return [(r.event_id, decision, s["status"], s["attempts"])]

    return Fold(lambda: {"status": None, "attempts": 0}, step, "event_id long, decision string, status string, attempts int",
                state="status string, attempts int")


def lease_log(ttl_us: int) -> Fold:
    """acquire when free, expired or own; renew and release only by the owner."""
    def step(s, r):
        own, now = s["owner"], int(r.us)
        if r.action == "acquire":
            ok = own is None or s["until"] <= now or own == r.owner
            if ok:
                s.update(owner=int(r.owner), until=now + ttl_us)
        elif r.action == "renew":
            ok = own is not None and own == r.owner
            if ok:
                s["until"] = now + ttl_us
        else:
            ok = own is not None and own == r.owner
            if ok:
                s.update(owner=None, until=0)
        return [(r.event_id, bool(ok), s["owner"], s["until"])]

    return Fold(lambda: {"owner": None, "until": 0}, step, "event_id long, ok boolean, holder long, until long", state="owner long, until long")


def posterior(conflict_sigma: float = 6.0) -> Fold:
    """Precision-weighted mean; saturated evidence pulls the mean up as a
    truncated-normal lower bound, unless it conflicts."""
    def step(s, r):
        flag = "none"
        if pd.notna(r.mean) and pd.notna(r.variance):
            v = max(float(r.variance), 1e-300)
            if s["var"] is None:
                s.update(mean=float(r.mean), var=float(r.variance))
            else:
                a, b = 1 / max(s["var"], 1e-300), 1 / v
                s.update(mean=(s["mean"] * a + r.mean * b) / (a + b), var=1 / (a + b))
            flag = "updated"
        if pd.notna(r.lower_bound) and s["var"] is not None:
            sigma = math.sqrt(max(s["var"], 0.0))
            z = (r.lower_bound - s["mean"]) / max(sigma, 1e-300)
            if z > conflict_sigma:
                flag = "conflict"
            elif z > -conflict_sigma:
                survive = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)
                mills = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / survive
                s.update(mean=s["mean"] + sigma * mills, var=s["var"] * max(1 + z * mills - mills * mills, 1e-6))
                flag = "censored"
        return [(r.event_id, s["mean"], s["var"], flag)]

    return Fold(lambda: {"mean": None, "var": None}, step, "event_id long, mean double, variance double, effect string")


def detection_hysteresis(memory_us: int, stable_us: int) -> Fold:
    """Confidence .7 new + .3 old while the last detection is fresh; stable once
    similar boxes have lasted long enough (box as shares of the frame)."""
    def step(s, r):
        now, box = int(r.us), [float(r.bx), float(r.by), float(r.bw), float(r.bh)] if r.detected else None
        fresh = s["seen"] is not None and now - s["seen"] < memory_us
        conf = min(max(r.confidence * 0.7 + s["conf"] * 0.3, 0.0), 1.0) if fresh else float(r.confidence)
        stable, since = False, None
        if box is not None:
            since = now
            old = s["box"] if fresh else None
            if old is not None:
                shift = [abs((old[i] + old[i + 2] * 0.5) - (box[i] + box[i + 2] * 0.5)) for i in (0, 1)]
                grow = [abs(old[i] - box[i]) for i in (2, 3)]
                if max(shift) < 0.02 and max(grow) < 0.08:
                    since = s["since"] if s["since"] is not None else now
                    stable = now - since >= stable_us
        s.update(box=box, since=since, seen=now, conf=conf)
        return [(r.event_id, conf, stable, 0 if since is None else now - since)]

    return Fold(lambda: {"box": None, "since": None, "seen": None, "conf": 0.0}, step, "event_id long, confidence double, stable boolean, stable_us long", memory_us,
                "box array<double>, since long, seen long, conf double")
