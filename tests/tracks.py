"""Small tracks for the operator tests."""

from pyspark.sql import functions as F

from fleetlens.schema import TRACK_FIELDS


def track(spark, rows, case=1):
    """Rows of dicts to a track: row_idx by position, t in seconds, UTC from t unless given."""
    schema = "case_id long, row_idx long, segment_index int, t_us long, is_outlier boolean, " + ", ".join(f"{k} {v.simpleString()}" for k, v in TRACK_FIELDS.items())
    out = []
    for i, r in enumerate(rows):
        t = r.get("t")
        real = r.get("state", "") not in ("damaged", "interpolated")
        utc = r.get("utc", f"{int(t or 0):06d}.{int(round((t or 0) % 1 * 100)):02d}" if real else None)
        full = {
            "case_id": case, "row_idx": i, "segment_index": r.get("seg", 0), "t_us": None if t is None else round(t * 1e6), "is_outlier": False, "start_time_sec": t,
            "end_time_sec": None if t is None else t + 1, "latitude": r.get("lat", 37.5 + i * 1e-5 if real else None), "longitude": r.get("lon", 127.0 if real else None), "speed_kmh": r.get("v"),
            "gps_date": "180624" if real else None, "gps_utc_time": utc, "gps_checksum_ok": r.get("ok", True if real else None), "gps_trusted": True if real else None, "gps_status": "A" if real else "",
            "source_offset": r.get("at"), "recovery_state": r.get("state", ""), "time_estimated": False, "x_g": r.get("g"), "y_g": 0.0 if "g" in r else None, "z_g": 0.0 if "g" in r else None,
        }
        names = [f.strip().split(" ")[0] for f in schema.split(", ")]
        out.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(out, schema)


def speeds(spark, values, dt=1.0):
    return track(spark, [{"t": i * dt, "v": float(v)} for i, v in enumerate(values)])


def kinds(spark, values, vehicle="car", dt=1.0):
    from fleetlens.operators import events

    rows = events.detect(speeds(spark, values, dt)).filter(F.col("vehicle") == vehicle).orderBy("start_index", "kind").collect()
    return [r["kind"] for r in rows]
