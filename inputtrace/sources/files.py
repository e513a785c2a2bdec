"""Recordings, clip indexes, evaluation clips, result documents and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

# Paths of recordings (parent folder, session, segment, suffix) and frames.
RECORDING_PATH = r"^(.*)/[^/]+/recording_([0-9a-fA-F-]+)_seg(\d+)(_filtered)?\.mp4$"
FRAME_NAME = r"F(\d+)\.\w+$"


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Paths under a folder, of files that are not empty; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )


def pair_recordings(videos: DataFrame, keylogs: DataFrame) -> DataFrame:
    """Videos whose log exists: same session, segment and suffix, in the folder beside theirs.

    Each path is exploded from a list of one, so that it is made and taken apart once: Spark moves
    conditions below a projection, and repeats for each of them what it computes, but not below that."""
    names = ["folder", "session_id", "number", "suffix"]

    def taken_apart(path: Column) -> Column:
        return F.struct(path.alias("video_path"), *[F.regexp_extract(path, RECORDING_PATH, i + 1).alias(n) for i, n in enumerate(names)])

    found = videos.select(F.inline(F.transform(F.array("path"), taken_apart))).where("session_id <> ''")
    named = found.select(
        "folder", "session_id", F.nullif("number", F.lit("")).cast("int").alias("seg"), "suffix", "video_path"
    )
    log = F.concat(
        "folder", F.lit("/keylogs/input_"), "session_id", F.format_string("_seg%04d", "seg"), "suffix", F.lit(".msgpack")
    )
    expected = named.withColumn("keylog_path", log).drop("folder")
    return expected.join(keylogs.select(F.explode(F.array("path")).alias("keylog_path")), "keylog_path", "left_semi")


def find_recordings(spark: SparkSession, root: str) -> DataFrame:
    return pair_recordings(
        list_files(spark, root, "recording_*.mp4"), list_files(spark, root, "input_*.msgpack")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_clip_index(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Clips of the splits that exist, as written by ``write_clip_index`` or one file per split.

    Blank lines are skipped.
    """
    found = [(s, p) for s in splits for p in (f"{root}/split={s}", f"{root}/{s}/{s}.jsonl") if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], schemas.CLIP + ", split string")
    out = None
    for split, path in found:
        part = spark.read.schema(schemas.CLIP).json(path).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def write_clip_index(clips: DataFrame, root: str) -> None:
    """One JSON line per clip, a folder per split."""
    columns = ["clip_id", "clip_dir", "num_frames", "fps", "actions", "split"]
    clips.select(*columns).write.mode("errorifexists").partitionBy("split").json(root)


def sibling(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def with_video(descriptions: DataFrame, videos: DataFrame) -> DataFrame:
    """Clip descriptions (``path``) whose video of the same name exists."""
    named = descriptions.withColumn("mp4_path", sibling(F.col("path"), ".mp4")).withColumn(
        "clip_name", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    )
    return named.join(videos.select(F.col("path").alias("mp4_path")), "mp4_path", "left_semi")


def read_eval_clips(spark: SparkSession, root: str) -> DataFrame:
    """``clip_*.json`` with a video beside them, found in all sub-folders."""
    described = (
        spark.read.schema(schemas.EVAL_CLIP)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "clip_*.json")
        .json(root)
        .select("*", F.col("_metadata.file_path").alias("path"))
    )
    return with_video(described, list_files(spark, root, "clip_*.mp4")).drop("path")


def read_results(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per clip of stored result documents, settings repeated.

    ``document`` tells documents apart, since each numbers its clips from 0: the file, and the
    place in it where a file has one document per line."""
    documents = spark.read.schema(schemas.RESULTS).option("multiLine", str(not one_per_line).lower()).json(path)
    name = F.col("_metadata.file_path")
    if one_per_line:
        name = F.concat_ws("#", name, F.monotonically_increasing_id().cast("string"))
    documents = documents.select("*", name.alias("document"))
    settings = ["document", "model_id", "fps", "tolerance", "coalesce", "interleave_labels"]
    return documents.select(*settings, F.explode("clips").alias("clip")).select(*settings, "clip.*")


def truth_entries(results: DataFrame, key: list[str]) -> DataFrame:
    """One row per truth entry of result rows, for ``parse_entries``."""
    return results.select(*key, "fps", "start_s", F.posexplode("ground_truth").alias("ord", "entry"))


def predicted_actions(results: DataFrame, key: list[str]) -> DataFrame:
    return results.select(*key, F.posexplode("predictions").alias("pos", "pred")).select(*key, "pos", "pred.*")


def tag_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames and broken images: ``origin, frame_idx, height, width, n_channels, data``, and the
    ``reason`` why an image is bad. Folders named ``column=value`` are columns, by which a condition
    leaves out whole folders."""
    image = F.col("image")
    broken = F.coalesce(image["height"] < 0, F.lit(True))
    opened = spark.read.format("image").option("dropInvalid", "false").load(path)
    return opened.select(
        *[c for c in opened.columns if c != "image"],
        image["origin"].alias("origin"),
        F.regexp_extract(image["origin"], FRAME_NAME, 1).try_cast("int").alias("frame_idx"),
        image["height"].alias("height"),
        image["width"].alias("width"),
        image["nChannels"].alias("n_channels"),
        image["data"].alias("data"),
        F.when(broken, "not an image").alias("reason"),
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames that can be decoded; ``tag_frames`` has the others too."""
    return tag_frames(spark, path).where("reason is null").drop("reason")


def read_frame_bytes(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Undecoded frame files: ``path, frame_idx, content``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    number = F.regexp_extract("path", FRAME_NAME, 1).try_cast("int")
    return files.select("path", number.alias("frame_idx"), "content")


def first_fps(clips: DataFrame, position: str, default: int = 5) -> DataFrame:
    """Frame rate of the first clip, and how many different rates there are."""
    return clips.agg(
        F.coalesce(F.min_by("fps", position), F.lit(default)).alias("fps"),
        F.count_distinct("fps").alias("distinct_fps"),
    )


def write_summary(scores: DataFrame, path: str) -> None:
    """The long score table as JSON lines."""
    scores.write.mode("errorifexists").json(path)


def write_summary_documents(documents: DataFrame, path: str) -> None:
    """Nested summaries, one JSON document a line; they appear together, when all are written."""
    documents.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_metadata(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON file."""
    row.coalesce(1).write.mode("errorifexists").json(path)
