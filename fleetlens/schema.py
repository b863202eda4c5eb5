"""Row types. A track is keyed by case_id and ordered by row_idx; time is seconds (DOUBLE) and t_us (BIGINT)."""

from pyspark.sql import types as T

TRACK_FIELDS = {
    "start_time_sec": T.DoubleType(), "end_time_sec": T.DoubleType(), "time_source": T.StringType(),
    "latitude": T.DoubleType(), "longitude": T.DoubleType(), "speed_kmh": T.DoubleType(), "track_deg": T.DoubleType(),
    "gps_date": T.StringType(), "gps_utc_time": T.StringType(),
    "gps_checksum_ok": T.BooleanType(), "gps_trusted": T.BooleanType(), "gps_status": T.StringType(),
    "gps_abs_time": T.StringType(), "gps_elapsed": T.DoubleType(),
    "latitude_last": T.DoubleType(), "longitude_last": T.DoubleType(), "speed_kmh_last": T.DoubleType(),
    "x_g": T.DoubleType(), "y_g": T.DoubleType(), "z_g": T.DoubleType(),
    "x_g_cal": T.DoubleType(), "y_g_cal": T.DoubleType(), "z_g_cal": T.DoubleType(),
    "source_offset": T.LongType(), "recovery_state": T.StringType(), "time_estimated": T.BooleanType(),
}
TRACK = T.StructType([T.StructField(k, v) for k, v in TRACK_FIELDS.items()])
EVENT_KINDS = ("accel", "start", "decel", "stop")
SYNTHETIC_STATES = ("damaged", "interpolated")
