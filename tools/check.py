"""Compare registered queries with their SQL on one data folder.

usage: python tools/check.py [-d folder] [name or id prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scanloom.plans import QUERIES  # noqa: E402
from scanloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


#: Queries beyond SQL, and the test that holds each against a planted or independent truth.
TRUTH = {
    "iso_calibration_gates": "test_planted_sensor_noise_is_recovered",
    "isosurface_triangles": "test_isosurface_of_a_ball_is_closed",
    "focus_stack_fused": "test_focus_stack_blocks_agree",
    "neighbour_normals": "test_normals_of_a_plane",
    "geometry_normal_consistency": "test_normal_consistency_of_tilted_planes",
    "object_tracking": "test_tracker_keeps_identity_and_drops_lost_tracks",
    "censored_posterior": "test_a_bound_never_lowers_the_mean",
}

spark_s = 0.0


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql, name=None):
    """Return (ok, message, number of rows); without SQL a query passes only with a test in TRUTH."""
    t0 = time.time()
    got_cols, got = rows_of(df.columns, df.collect())
    global spark_s
    spark_s = time.time() - t0
    if sql is None:
        return name in TRUTH and len(got) > 0, f"rows only, see {TRUTH.get(name)}", len(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        only = sorted(set(map(repr, got)) - set(map(repr, want)))[:3]
        miss = sorted(set(map(repr, want)) - set(map(repr, got)))[:3]
        return False, f"{len(got)} vs {len(want)} rows, {len(diff)} differ\n   spark {only}\n   sql   {miss}\n   {got_cols}", len(got)
    kinds = {type(x).__name__ for r in got for x in r}
    return True, ",".join(sorted(kinds)), len(got)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("pick", nargs="*")
    a = ap.parse_args()
    spark = local_session()
    con = connect(a.d)
    bad = []
    for name, q in QUERIES.items():
        if a.pick and not any(name == p or any(i == p or i.startswith(p + ".") for i in q.ids) for p in a.pick):
            continue
        t0 = time.time()
        try:
            ok, msg, n = compare(q.run(spark, a.d), con, q.sql, name)
        except Exception as ex:
            ok, msg, n = False, "".join(traceback.format_exception_only(ex))[-900:], -1
        print(f"{'ok  ' if ok else 'FAIL'} {'/'.join(q.ids):12s} {name:36s} {n:7d} rows {time.time()-t0:6.2f}s (spark {spark_s:.2f})  {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
