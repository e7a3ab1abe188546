"""The input relations of the operators, derived from the driver's tables.

The column lists are plain SQL with slots for what Spark and DuckDB spell differently, so that the
queries and their SQL counterparts start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.series import positions
from strandline.session import own_tables, ship

SPARK = {"K": "cast(get_json_object(props, '$.k') as int)", "ARR": "array", "STR": "string"}
DUCK = {"K": "cast(json_extract_string(props, '$.k') as int)", "ARR": "list_value", "STR": "varchar"}

_DET = """cast(floor(event_id / 10) as bigint) frame_idx; cast(event_id % 10 as int) det_idx; user_id gt_track_id;
cast((event_id % 10) * 180 + (event_id * 7) % 90 as double) x1; cast((event_id * 13) % 700 as double) y1;
cast((event_id % 10) * 180 + (event_id * 7) % 90 + 40 + event_id % 23 as double) x2;
cast((event_id * 13) % 700 + 80 + event_id % 41 as double) y2;
cast(event_id % 11 as double) / cast(10 as double) score;
case event_type when 'click' then 1 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end category_id;
{K} jersey"""
_TRK = "frame_idx; det_idx trk_idx; x1 + (gt_track_id % 17) x1; y1 + (gt_track_id % 11) y1; x2 + (gt_track_id % 17) x2; y2 + (gt_track_id % 11) y2"
_OBS = """user_id track_id; idx; event_id frame_idx;
cast(user_id * 10 + (idx + 1) * 2 + case when event_id % 29 = 0 then 300 else 0 end as double) x1;
cast(200 + event_id % 5 as double) y1; cast(user_id * 10 + (idx + 1) * 2 + 40 as double) x2; cast(290 + event_id % 7 as double) y2;
1 - value / cast(1000 as double) conf;
case when {K} % 10 = 9 then null when {K} % 4 = 0 then {K} % 3 else cast(floor(idx / 22) as int) % 3 end jersey;
case when {K} % 13 = 0 then null else cast(floor(idx / 15) as int) % 2 end team;
case when {K} % 12 = 11 then 'referee' else 'player' end role"""
_OCR = """user_id track_id; event_id frame_idx;
case when {K} % 10 = 9 then concat(' x', cast({K} as {STR})) else concat(' ', cast({K} as {STR}), ' ') end label;
{ARR}(1 - value / cast(1000 as double), 1 - (event_id % 50) / cast(100 as double), cast(0.99 as double)) char_confs"""
_POSE = """event_id crop_id; cast(40 + event_id % 23 as int) crop_w; cast(80 + event_id % 41 as int) crop_h;
cast(5 + event_id % 11 as double) ls_x; cast(10 + event_id % 7 as double) ls_y; cast(event_id % 10 as double) / cast(10 as double) ls_s;
cast(30 + event_id % 13 as double) rs_x; cast(11 + event_id % 5 as double) rs_y; cast((event_id * 3) % 10 as double) / cast(10 as double) rs_s;
cast(8 + event_id % 9 as double) lh_x; cast(50 + event_id % 17 as double) lh_y; cast((event_id * 7) % 10 as double) / cast(10 as double) lh_s;
cast(28 + event_id % 12 as double) rh_x; cast(52 + event_id % 19 as double) rh_y; cast((event_id * 9) % 10 as double) / cast(10 as double) rh_s"""
_ENTROPY = "case when jersey is null then cast(1 as double) else -conf * ln(conf) end entropy"


def _columns(text: str, slots: dict) -> list[str]:
    for k, v in slots.items():
        text = text.replace("{%s}" % k, v)
    return [c.strip() for c in text.split(";")]


def _sql(text: str, source: str, extra: str = "") -> str:
    return f"select {', '.join(_columns(text, DUCK))}{extra} from {source}"


#: The same relations as common table expressions for DuckDB.
CTE = {
    "det": _sql(_DET, "events"),
    "trk": _sql(_TRK, "det"),
    "obs": f"select *, {_ENTROPY} from ({_sql(_OBS, '(select *, cast(row_number() over (partition by user_id order by event_id) - 1 as int) idx from events) e')}) o",
    "emb": "select cast(label as bigint) track_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) idx, vec_id frame_idx, list_transform(embedding, lambda x: cast(x as double)) embedding from embeddings",
    "ocr": _sql(_OCR, "events"),
    "pose": _sql(_POSE, "events"),
}


def with_ctes(*names: str) -> str:
    """``with`` clause for DuckDB of the named relations, in order."""
    return "with recursive " + ", ".join(f"{n} as ({CTE[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(_DET, SPARK))


def annotation_files(spark: SparkSession, sf_dir: str) -> str:
    """The detections as annotation documents, one per sequence of 100 frames, in the shared folder; where they are."""
    det = detections(spark, sf_dir).withColumn("sequence_id", F.expr("frame_idx div 100"))
    image = F.struct(F.col("frame_idx").cast("string").alias("image_id"), F.format_string("f%06d.jpg", "frame_idx").alias("file_name"))
    corner = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    shown = F.struct(F.col("jersey").cast("string").alias("jersey"), F.when(F.col("gt_track_id") % 2 == 0, "left").otherwise("right").alias("team"), F.when(F.col("category_id") == 1, "player").otherwise("referee").alias("role"))
    own = F.struct("frame_idx", "det_idx", image["image_id"].alias("image_id"), "category_id", F.col("gt_track_id").alias("track_id"), corner.alias("bbox_image"), shown.alias("attributes"))
    docs = det.groupBy("sequence_id").agg(F.array_sort(F.collect_set(image)).alias("images"), F.array_sort(F.collect_list(own)).alias("annotations"))
    path = f"{own_tables(spark)}/annotations-{uuid.uuid4().hex}"
    docs.write.partitionBy("sequence_id").json(path)
    return path


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).selectExpr(*_columns(_TRK, SPARK))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = positions(table(spark, sf_dir, "events"), "user_id", "event_id")
    return events.selectExpr(*_columns(_OBS, SPARK)).selectExpr("*", _ENTROPY)


def appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return rows.selectExpr("cast(label as bigint) track_id", "idx", "vec_id frame_idx", "transform(embedding, x -> cast(x as double)) embedding")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(_OCR, SPARK))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(_POSE, SPARK))
