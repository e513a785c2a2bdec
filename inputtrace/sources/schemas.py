"""Declared schemas; nothing is inferred."""

LOG = (
    "recording_id string, ord bigint, ts_us bigint, etype string, raw_key string, "
    "button string, dx double, dy double, uncaptured boolean"
)

# Parsed entries also hold the direction that merged scrolls name; other logs may lack it.
PARSED_LOG = LOG + ", direction string"

ACTIONS = "array<struct<frame:string,type:string,details:string>>"

CLIP = f"clip_id string, clip_dir string, num_frames int, fps int, actions {ACTIONS}"

# Raw log entries stay texts until parsed, because their elements differ in type.
EVAL_CLIP = "start_s double, end_s double, tag string, actions array<string>"

RESULTS = (
    "model_id string, api_url string, fps int, tolerance int, coalesce boolean, "
    "interleave_labels boolean, clips array<struct<clip_index:int,clip_name:string,tag:string,"
    "start_s:double,ground_truth:array<string>,"
    "predictions:array<struct<frame:string,type:string,details:string,detail:string>>,"
    "raw_response:string>>"
)

METADATA = (
    "input_dir string, fps int, resolution string, top_bar_fraction double, black_threshold double, "
    "clip_length int, clip_stride int, action_types string, label_frames boolean, total_clips bigint, "
    "num_failed_recordings bigint, train_recordings bigint, val_recordings bigint, seed int, "
    "timing struct<total_s:double,mean_per_recording_s:double,median_per_recording_s:double,max_per_recording_s:double>"
)
