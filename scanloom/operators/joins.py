"""Temporal, lookup and verification joins.

Temporal joins never pair rows by cartesian product: both sides are put on one
time line and the chunked running scans carry the nearest row, or prefix sums,
across chunk borders.  A hot key is spread over its time chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.ordering import DAY_US, running
from scanloom.session import scratch_path


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, payload: list[str], tie: str = "later",
                 width_us: int = DAY_US) -> DataFrame:
    """Nearest right row in time for each left row (both carry ``us``), or null.
    ``tie`` says which neighbour wins at equal distance."""
    hit = F.struct(F.col("us").alias("us"), *payload)
    types = right.select(hit.alias("h")).schema["h"].dataType
    l = left.select(*keys, "us", F.lit(1).alias("_side"), F.col(left_id), F.lit(None).cast(types).alias("_r"))
    r = right.select(*keys, "us", F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), hit.alias("_r"))
    line = l.unionByName(r).withColumn("_neg", -F.col("us"))
    line = running(line, keys, ["us", "_side"], {"_before": ("max", F.col("_r"))}, width_us)
    line = running(line, keys, ["_neg", "_side"], {"_after": ("min", F.col("_r"))}, width_us)
    before, after = F.col("us") - F.col("_before.us"), F.col("_after.us") - F.col("us")
    take_after = F.col("_before").isNull() | ((after <= before) if tie == "later" else (after < before))
    best = F.when(F.coalesce(take_after, F.lit(False)), F.col("_after")).otherwise(F.coalesce("_before", "_after"))
    return line.filter("_side = 1").select(*keys, left_id, "us", best.alias("nearest"), F.abs(best.getField("us") - F.col("us")).alias("distance_us"))


def prefix_at(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, probes: dict[str, tuple[Column, bool]],
              sums: dict[str, Column], width_us: int = DAY_US) -> DataFrame:
    """Running sums of the right side read at probe times of the left side
    (name -> (time, inclusive)); one output row per left id."""
    parts = right.select(*keys, "us", F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_probe"),
                         F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), *[c.alias(n) for n, c in sums.items()])
    zero = [F.lit(0).cast(parts.schema[n].dataType).alias(n) for n in sums]
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("_probe"), t.cast("long").alias("us"), F.lit(2 if incl else 0).alias("_side")) for n, (t, incl) in probes.items()]))
    asked = left.select(*keys, left_id, at.alias("_a")).select(*keys, "_a.us", "_a._side", "_a._probe", left_id, *zero)
    line = running(parts.unionByName(asked), keys, ["us", "_side"], {f"_{n}": ("sum", F.col(n)) for n in sums}, width_us)
    return line.filter(F.col("_probe").isNotNull()).groupBy(*keys, left_id).agg(
        *[F.max(F.when(F.col("_probe") == p, F.col(f"_{n}"))).alias(f"{p}_{n}") for p in probes for n in sums])


def window_mean(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, value: str, half_us: int) -> DataFrame:
    """Mean over right rows within ``half_us`` (inclusive), else the nearest value, else null."""
    p = prefix_at(left, right, keys, left_id, {"lo": (F.col("us") - half_us, False), "hi": (F.col("us") + half_us, True)},
                  {"s": F.col(value), "n": F.lit(1).cast("long")})
    near = asof_nearest(left, right, keys, left_id, [value], tie="earlier").select(*keys, left_id, F.col(f"nearest.{value}").alias("_near"))
    n = F.col("hi_n") - F.col("lo_n")
    return p.join(near, [*keys, left_id]).select(*keys, left_id, F.when(n > 0, (F.col("hi_s") - F.col("lo_s")) / n).otherwise(F.col("_near")).alias("mean"), n.alias("hits"))


def interval_match(events: DataFrame, files: DataFrame, keys: list[str], event_id: str, file_cols: list[str], tolerance_us: int) -> DataFrame:
    """Earliest files closer than the tolerance, at most ``expected`` per event.
    Files are ranked per key; each event reads its rank range, so a dense burst
    of files never multiplies with the events near it."""
    ranked = running(files, keys, ["us", *file_cols], {"_rank": ("sum", F.lit(1).cast("long"))})
    p = prefix_at(events, files, keys, event_id, {"lo": (F.col("us") - tolerance_us, True), "hi": (F.col("us") + tolerance_us, False)}, {"n": F.lit(1).cast("long")})
    p = p.join(events.select(*keys, event_id, "expected"), [*keys, event_id])
    last = F.least(F.col("hi_n"), F.col("lo_n") + F.col("expected"))
    spans = p.filter(last > F.col("lo_n")).select(*keys, event_id, F.col("lo_n"), F.explode(F.sequence(F.col("lo_n") + 1, last)).alias("_rank"))
    return spans.join(ranked, [*keys, "_rank"]).select(*keys, event_id, (F.col("_rank") - F.col("lo_n") - 1).cast("int").alias("slot"), *file_cols)


def suffix_lookup(paths: DataFrame, frames: DataFrame, path: str, image: str, order: str, payload: str) -> DataFrame:
    """First frame in order whose path equals the path or ends with its file name.
    A file name has no slash, so it can only be a suffix of the base name: all
    suffixes of base names turn the lookup into an equi-join."""
    base = F.element_at(F.split(F.col(image), "/"), -1)
    suffixes = frames.select(order, payload, F.explode(F.transform(F.sequence(F.lit(1), F.length(base)), lambda i: F.substr(base, i))).alias("_name"))
    first = suffixes.groupBy("_name").agg(F.min_by(F.struct(order, payload), order).alias("_f"))  # one row per suffix, however many frames share it
    exact = frames.groupBy(F.col(image).alias(path)).agg(F.min_by(F.struct(order, payload), order).alias("_e"))
    d = paths.withColumn("_name", F.element_at(F.split(F.col(path), "/"), -1)).join(first, "_name", "left").join(exact, path, "left")
    pick = F.when(F.col(f"_e.{order}") <= F.col(f"_f.{order}"), F.col("_e")).otherwise(F.coalesce("_f", "_e"))
    return d.withColumn("_p", pick).drop("_name", "_f", "_e").select("*", f"_p.{order}", f"_p.{payload}").drop("_p")


def resolve_observations(tracks: DataFrame, keypoints: DataFrame, poses: DataFrame, track_id: str) -> DataFrame:
    """Tracks of (image, keypoint) against their tables; unresolved references are counted."""
    o = tracks.select(track_id, F.explode("track").alias("o")).select(track_id, "o.image", "o.keypoint")
    d = o.join(keypoints, "keypoint", "left").join(poses, "image", "left")
    lost = F.col("u").isNull() | F.col("tx").isNull()
    return d.groupBy(track_id).agg(F.count("*").alias("observations"), F.count_if(lost).alias("invalid"), F.sum(F.when(~lost, F.abs(F.col("u") - F.col("tx")))).alias("error"))


def compare_runs(baseline: DataFrame, current: DataFrame, label: str) -> DataFrame:
    """Full outer by label: no delta without a baseline, a missing current counts as zero."""
    d = baseline.select(label, F.col("value").alias("baseline")).join(current.select(label, F.col("value").alias("current")), label, "full_outer")
    return d.withColumn("delta", F.when(F.col("baseline").isNotNull(), F.coalesce("current", F.lit(0.0)) - F.col("baseline")))


def packed(c: str) -> Column:
    """Text as bytes, lower-case hex in half its length; different texts stay different."""
    short = F.unhex(c)
    return F.when(F.lower(F.hex(short)) == F.col(c), F.concat(F.lit(b"\0"), short)).otherwise(F.concat(F.lit(b"\1"), F.encode(c, "UTF-8")))


def verify_anchors(records: DataFrame, anchors: DataFrame, log: str) -> DataFrame:
    """Anchors against audit records by hash.  ``signature_ok`` is an input column.

    Payloads are settled from the anchors alone, so only hashes and stamps meet the records."""
    expected = F.concat_ws("|", "hash", "prev_hash", "event_id", "stamp", "key_id")
    signed = F.when(F.col("signature_payload") != expected, "payload_mismatch").when(~F.col("signature_ok"), "signature_invalid")
    anchors = anchors.select(log, "anchor_no", packed("hash").alias("hash"), packed("prev_hash").alias("prev_hash"), "stamp", (F.col("status") != "anchored").alias("_error"), signed.alias("_signed"))
    r = records.select(log, packed("hash").alias("hash"), F.col("seq").alias("_seq"), packed("prev_hash").alias("_prev"), F.col("stamp").alias("_stamp"))
    d = anchors.join(r, [log, "hash"], "left")
    reason = (F.when(F.col("_signed").isNotNull(), F.col("_signed"))
              .when(F.col("_seq").isNull(), "record_missing").when(F.col("_prev") != F.col("prev_hash"), "prev_hash_mismatch")
              .when(F.col("_stamp") != F.col("stamp"), "timestamp_mismatch").otherwise("anchored"))
    d = d.withColumn("reason", reason)
    s = d.groupBy(log).agg(
        F.count("*").alias("anchor_records"), F.count_if("_error").alias("anchor_errors"),
        F.count_if(F.col("reason") == "anchored").alias("anchored"),
        F.count_if(F.col("reason").isin("payload_mismatch", "signature_invalid")).alias("invalid_signatures"),
        F.count_if(F.col("reason").isin("record_missing", "prev_hash_mismatch", "timestamp_mismatch")).alias("missing"),
        F.max_by("_seq", "anchor_no").alias("_last"))
    n = records.groupBy(log).agg(F.count("*").alias("records"))
    out = n.join(s, log, "left").withColumn("unanchored_tail", F.col("records") - F.coalesce("_last", F.lit(0)))
    return out.drop("_last").fillna(0).withColumn("ok", (F.col("anchor_errors") + F.col("missing") + F.col("invalid_signatures") + F.col("unanchored_tail") == 0) & (F.col("anchor_records") > 0))


def verify_artifacts(entries: DataFrame, files: DataFrame, key: str, full: bool) -> DataFrame:
    """Committed entries whose artifacts all exist with equal size, equal mtime
    (unless recorded as zero) and, in full mode or without mtime, equal digest."""
    a = entries.select(key, "status", F.explode_outer("artifacts").alias("a")).select(key, "status", "a.*")
    d = a.join(files.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("sha256").alias("_sha")), "path", "left")
    same_time = (F.col("mtime") == 0) | (F.col("mtime") == F.col("_mtime"))
    same_hash = F.col("sha256") == F.col("_sha")
    if not full:
        same_hash = (F.col("mtime") != 0) | same_hash
    good = F.coalesce((F.col("size") == F.col("_size")) & same_time & same_hash, F.lit(False))
    return d.groupBy(key).agg((F.first("status") == "committed").alias("_c"), F.bool_and(good & F.col("path").isNotNull()).alias("_g")).select(key, (F.col("_c") & F.col("_g")).alias("valid"))


def public_gallery(public: DataFrame, links: DataFrame, access: DataFrame, now: Column, tag: str | None = None) -> DataFrame:
    """Listed shares with their number of asset accesses; the counts are
    aggregated once instead of per row."""
    views = access.filter("event = 'asset'").groupBy("token").agg(F.count("*").alias("views"))
    live = links.filter(~F.col("revoked") & F.col("allow_embed") & (F.col("expires_at") > now))
    d = public.filter("is_public")
    if tag is not None:
        d = d.filter(F.lower("tags").contains(tag.lower()))
    return d.join(live, "token").join(views, "token", "left").fillna(0, ["views"])


def align_hashes(source: DataFrame, reference: DataFrame, keys: list[str], step_ms: int, per_hash: int | None = None, tolerance_ms: int = 40) -> DataFrame:
    """Vote on the offset between hashed tracks and fit the drift.

    ``source`` (keys, hash, time) and ``reference`` (hash, time) count steps of
    ``step_ms``.  With ``per_hash`` each reference hash keeps that many first times.  Matches are
    joined and moved once, to the task of their track, and summed per offset there; the
    offsets near the winner are written, which serve the vote and the fit."""
    ref = reference.select("hash", F.col("time").alias("_rt"))
    if per_hash:
        first = Window.partitionBy("hash").orderBy("_rt")
        ref = ref.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_hash).drop("_n")
    st, rt = F.col("time"), F.col("_rt")
    pairs = source.join(ref, "hash").select(*keys, st.alias("_st"), ((rt - st) * step_ms).alias("offset_ms"))
    x = F.col("_st")
    # most offsets hold one match, so sums per offset are no shorter than the matches: only those near the winner are kept
    path = scratch_path(source.sparkSession, "votes")
    votes = pairs.repartition(*keys).groupBy(*keys, "offset_ms").agg(F.count("*").alias("votes"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    top = F.max(F.struct("votes", (-F.col("offset_ms")).alias("m"))).over(Window.partitionBy(*keys))
    votes.withColumn("_top", top).filter(F.abs(F.col("offset_ms") + F.col("_top.m")) <= tolerance_ms).drop("_top").write.parquet(path)
    votes = source.sparkSession.read.parquet(path)
    best = votes.groupBy(*keys).agg(F.max_by(F.struct("offset_ms", "votes"), F.struct("votes", (-F.col("offset_ms")).alias("m"))).alias("b")).select(*keys, F.col("b.offset_ms").alias("best_ms"), F.col("b.votes").alias("best_votes"))
    total = source.groupBy(*keys).agg(F.count("*").alias("hashes"))
    steps = (F.col("offset_ms") / step_ms).cast("long")  # reference time less source time, whole for every match of an offset
    near = votes.join(best, keys).filter(F.abs(F.col("offset_ms") - F.col("best_ms")) <= tolerance_ms)
    near = near.withColumns({"sy": F.col("sx") + F.col("votes") * steps, "sxy": F.col("sxx") + F.col("sx") * steps})
    fit = near.groupBy(*keys).agg(F.sum("votes").alias("pairs"), *[F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "sxy")])

    def exact(*factors):  # whole numbers beyond 64 bits
        return F.col(factors[0]).cast("decimal(19,0)") * F.col(factors[1]).cast("decimal(19,0)")

    den = (exact("pairs", "sxx") - exact("sx", "sx")).cast("double")
    slope = (exact("pairs", "sxy") - exact("sx", "sy")).cast("double") / F.when(den != 0, den)
    unit = step_ms / 1000.0
    shift = (F.col("sy") - F.col("sx")) / F.col("pairs") * unit
    few = F.col("pairs") < 3
    d = best.join(fit, keys).join(total, keys).withColumns({"_flat": den / F.col("pairs") * unit * unit < 1e-9, "_slope": slope})
    intercept = (F.col("sy") - F.col("_slope") * F.col("sx")) / F.col("pairs") * unit
    return d.select(*keys, "best_ms", F.col("best_votes").alias("votes"), "pairs", F.when(few | F.col("_flat"), 1.0).otherwise(F.col("_slope")).alias("stretch"),
                    (F.col("best_ms") / 1000.0 + F.when(few, 0.0).when(F.col("_flat"), shift).otherwise(intercept)).alias("offset_s"),
                    F.least(F.col("best_votes") / F.col("hashes"), F.lit(1.0)).alias("confidence"))


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def close_to(a: Column, b: Column, share: float) -> Column:
    return F.abs(a - b) <= share * F.greatest(F.abs(a), F.lit(1e-9))


def match_profiles(captures: DataFrame, profiles: DataFrame, focus_slack: str = "sensor") -> DataFrame:
    """Captures to calibration profiles: equi-join on identity, then the
    tolerances.  Zero or several hits are flagged."""
    p = profiles.select(plain_name(F.col("make")).alias("_make"), plain_name(F.col("model")).alias("_model"), "width", "height", "profile_id",
                        F.col("aperture").alias("_ap"), F.col("focal").alias("_fl"), "focus_min", "focus_max")
    c = captures.withColumns({"_make": plain_name(F.col("make")), "_model": plain_name(F.col("model"))})

    def slack(v):
        return F.greatest(v * 0.02, F.lit(0.005)) if focus_slack == "sensor" else v * 0.005

    ok = (close_to(F.col("_ap"), F.col("aperture"), 0.01) & close_to(F.col("_fl"), F.col("focal"), 0.005)
          & (F.col("focus") >= F.col("focus_min") - slack(F.col("focus_min"))) & (F.col("focus") <= F.col("focus_max") + slack(F.col("focus_max"))))
    hits = c.join(p, ["_make", "_model", "width", "height"]).filter(ok).groupBy("capture_id").agg(F.count("*").alias("hits"), F.min("profile_id").alias("profile_id"))
    d = captures.select("capture_id").join(hits, "capture_id", "left").fillna(0, ["hits"])
    return d.withColumn("match", F.when(F.col("hits") == 0, "none").when(F.col("hits") == 1, "one").otherwise("ambiguous"))


def score_candidates(candidates: DataFrame, probes: DataFrame, keys: list[str], budget_ms: float, max_blur: float, max_thermal: float) -> DataFrame:
    """Information gain of each candidate over the probes of its own session;
    rejections in order: missing ISO, time, thermal, motion."""
    cost = F.col("shutter") * 1000 + F.col("readout_ms")
    reason = (F.when(~F.col("calibrated"), "missing_iso").when(cost > budget_ms, "time").when(F.col("thermal") + cost * 0.001 > max_thermal, "thermal")
              .when(F.col("shutter") * F.col("motion") > max_blur, "motion"))
    c = candidates.withColumns({"cost_ms": cost, "rejected": reason})
    gain = F.col("weight") * 0.5 * F.log(1 + F.col("variance") / F.col("noise"))
    s = c.filter("rejected IS NULL").join(probes, keys).groupBy("candidate_id").agg(F.sum(gain).alias("nats"))
    return c.join(s, "candidate_id", "left").withColumn("utility", F.col("nats") / F.greatest(F.col("cost_ms"), F.lit(1e-3)))
