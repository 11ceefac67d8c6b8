"""Explicit superset schemas; nothing is inferred."""

BOX = "struct<cls:string,xyxy:array<double>,confidence:double,source:string>"
LABEL = (
    f"frame_id string, scene string, triplet_ts string, frame_ts string, source string, audited boolean, verdict string, "
    f"width int, height int, fisheye_bboxes array<{BOX}>, thermal_bboxes array<{BOX}>, obstacle_bins_fisheye array<int>, safe_heading_deg double"
)
DETECTIONS = f"frame_id string, boxes array<{BOX}>"
INSTANCES = "frame_id string, instances array<struct<cls:string,confidence:double,polygon:array<double>>>"
SECTOR = (
    "timestamp string, protocol int, bin_centers_deg array<double>, scores array<double>, min_range_m array<double>, "
    "sensor_hits array<array<int>>, tracked boolean, per_bin_velocity_mps array<double>, per_bin_ttc_s array<double>, "
    "recommended_heading_deg double, heading_reason string, smoothed_heading_deg double, "
    "attitude struct<roll_deg:double,pitch_deg:double,yaw_deg:double>, free_space_m array<double>, confirmed array<boolean>, "
    "p_obstacle array<double>, p_obstacle_smooth array<double>, threat array<double>, "
    "shadow struct<tick_ms:double,seg_fresh:boolean,yolo_fresh:boolean,scorer_ok:boolean,source_latency_s:double,skipped_rows:bigint>"
)
TRIAL = (
    "kind string, trial int, t_s double, wall string, phase string, why string, result string, rel_heading_deg double, "
    "abs_heading_deg double, heading double, distance_m double, lat double, lon double, bins array<double>, p array<double>, "
    "min_range_m array<double>, pattern string, dry_run boolean, name string, note string"
)
WINDOWS = "windows array<struct<t0:string,t1:string,state:string,bearing_min:double,bearing_max:double>>"
AUDIT = "id string, clip_key string, frame_ts string, record string, created_at timestamp"
RECORD = "id string, clip_key string, frame_ts string, frame_id string, verdict string, boxes string, source string, created_at string"
