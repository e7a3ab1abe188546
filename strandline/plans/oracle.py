"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from strandline.config import SplitConfig
from strandline.operators.motion import POSITION, VELOCITY
from strandline.sources.adapters import with_ctes

ORACLE: dict[str, str] = {}
C = SplitConfig()


def _put(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = f"{with_ctes(*ctes.split())} {body}"


_put("scan_category_filter", "det", "select frame_idx, det_idx, gt_track_id, category_id, jersey from det where category_id in (1, 2, 3)")
_put("xywh_to_xyxy", "det", "select frame_idx, det_idx, x1, y1, x1 + (x2 - x1) as x2, y1 + (y2 - y1) as y2 from det")
_put(
    "box_conversions",
    "det",
    """select frame_idx, det_idx, round(x2 - x1, 6) as w, round(y2 - y1, 6) as h, round(x1 + (x2 - x1) / 2, 6) as cx, round(y1 + (y2 - y1) / 2, 6) as cy,
  round((x2 - x1) / (y2 - y1), 6) as aspect, round(x1 - (x2 - x1) * cast(0.6 as double), 6) as sx1, round(y1 - (y2 - y1) * cast(0.6 as double), 6) as sy1,
  round(x2 + (x2 - x1) * cast(0.6 as double), 6) as sx2, round(y2 + (y2 - y1) * cast(0.6 as double), 6) as sy2 from det""",
)
_put(
    "annotation_reader",
    "det",
    """select 'f' || lpad(cast(frame_idx as varchar), 6, '0') || '.jpg' as filename, x1, y1, x2, y2, cast(1 as double) as score, category_id as class_id, gt_track_id,
  cast(jersey as varchar) as gt_jersey, case when gt_track_id % 2 = 0 then 'left' else 'right' end as gt_team, case when category_id = 1 then 'player' else 'referee' end as gt_role
  from det where category_id in (1, 2, 3)""",
)
_put("frame_index", "det", "select sequence_id, frame_idx, cast(row_number() over (partition by sequence_id order by frame_idx) - 1 as int) as idx from (select distinct frame_idx // 100 as sequence_id, frame_idx from det)")
_put("frame_left_join_annotations", "det", "select f.frame_idx, d.det_idx, d.category_id from (select distinct frame_idx from det) f left join (select * from det where category_id in (2, 3)) d on f.frame_idx = d.frame_idx")
_put("score_buckets", "det", "select frame_idx, det_idx, case when score > cast(0.6 as double) then 'high' when score > cast(0.3 as double) and score < cast(0.6 as double) then 'low' end as bucket, score >= cast(0.4 as double) as may_start from det")

_BOTH = "greatest(0, least(t.x2, d.x2) - greatest(t.x1, d.x1)) * greatest(0, least(t.y2, d.y2) - greatest(t.y1, d.y1))"
_IOU = f"({_BOTH}) / ((t.x2 - t.x1) * (t.y2 - t.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - ({_BOTH}) + cast(0.000001 as double))"
_BOTH1 = "greatest(0, least(t.x2, d.x2) - greatest(t.x1, d.x1) + 1) * greatest(0, least(t.y2, d.y2) - greatest(t.y1, d.y1) + 1)"
_IOU1 = f"({_BOTH1}) / ((t.x2 - t.x1 + 1) * (t.y2 - t.y1 + 1) + (d.x2 - d.x1 + 1) * (d.y2 - d.y1 + 1) - ({_BOTH1}))"


def _grown(rel: str, e: float) -> str:
    dx, dy = (f"floor((cast({2 * e} as double) * ({c}2 - {c}1) + ({c}2 - {c}1)) / 2)" for c in "xy")
    return f"(select * replace (x1 - {dx} as x1, y1 - {dy} as y1, x2 + {dx} as x2, y2 + {dy} as y2) from {rel})"


def _pairs(value: str, name: str, t: str = "trk", d: str = "det", measure: str = _IOU1) -> str:
    return f"select frame_idx, trk_idx, det_idx, round({value}, 6) as {name} from (select t.frame_idx, trk_idx, det_idx, score, cast(abs(trk_idx - det_idx) as double) / cast(10 as double) as cosine, {measure} as iou from {t} t join {d} d on t.frame_idx = d.frame_idx) where iou > 0"


_put("iou_pairs", "det trk", _pairs("iou", "iou", measure=_IOU))
_put("iou_pairs_inclusive", "det trk", _pairs("iou", "iou"))
_put("expanded_iou_pairs", "det trk", _pairs("iou", "iou", _grown("trk", 0.7), _grown("det", 0.7)))
_put("fused_cost", "det trk", _pairs("least(1 - iou, case when cosine / 2 > cast(0.2 as double) or 1 - iou > cast(0.5 as double) then 1 else cosine / 2 end)", "cost"))
_put("fuse_iou", "det trk", _pairs("1 - (1 - cosine) * (1 + (1 - (1 - iou))) / 2", "cost"))
_put("fuse_score", "det trk", _pairs("1 - (1 - (1 - iou)) * score", "cost"))

_BEST = f"select * from (select t.frame_idx, trk_idx, det_idx, category_id, gt_track_id, jersey, {_IOU} as iou from trk t join det d on t.frame_idx = d.frame_idx) where iou > cast(0.5 as double) qualify row_number() over (partition by frame_idx, trk_idx order by iou desc, det_idx) = 1"
_put("best_overlap_match", "det trk", f"select frame_idx, trk_idx, det_idx, round(iou, 6) as iou from trk left join ({_BEST}) b using (frame_idx, trk_idx)")
_put("attribute_transfer", "det trk", f"select frame_idx, trk_idx, coalesce(category_id, 0) as class_id, gt_track_id, jersey as gt_jersey from trk left join ({_BEST}) b using (frame_idx, trk_idx)")
_put("compose_matches", "det trk", f"select b.frame_idx, b.trk_idx as a, d.gt_track_id as c from ({_BEST}) b join det d on b.frame_idx = d.frame_idx and b.det_idx = d.det_idx")
# All ways to take or leave the pairs of a frame; one that shares no box with another is always taken.
ORACLE["optimal_assignment"] = f"""{with_ctes("det", "trk")},
p as (select *, count(*) over (partition by frame_idx, a) + count(*) over (partition by frame_idx, b) > 2 as rival, row_number() over (partition by frame_idx order by a, b) as k
  from (select t.frame_idx, cast(trk_idx as bigint) as a, cast(det_idx as bigint) as b, 1 - {_IOU1} as cost from trk t join det d on t.frame_idx = d.frame_idx) where cost < cast(0.8 as double)),
s as (select frame_idx, cast(0 as bigint) as k, cast([] as bigint[]) as rows, cast([] as bigint[]) as columns, cast(0 as double) as gain from (select distinct frame_idx from p)
  union all select s.frame_idx, p.k, case when take then list_append(rows, a) else rows end, case when take then list_append(columns, b) else columns end, case when take then gain + cost - cast(0.8 as double) else gain end
  from s join p on p.frame_idx = s.frame_idx and p.k = s.k + 1 join (values (true), (false)) c(take) on (take and not list_contains(rows, a) and not list_contains(columns, b)) or (not take and rival)),
w as (select s.* from s join (select frame_idx, max(k) as k from p group by frame_idx) m using (frame_idx, k) qualify row_number() over (partition by frame_idx order by gain) = 1),
u as (select frame_idx, unnest(rows) as a, unnest(columns) as b from w)
select frame_idx, a, b, round(cost, 6) as cost from u join p using (frame_idx, a, b)"""
_put("embedding_cosine_pairs", "emb", "select a.track_id, a.idx, round(greatest(0, 1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding)))), 6) as distance from emb a join emb b on a.track_id = b.track_id and b.idx = a.idx + 1")
_CLOSE = f"(select t.frame_idx, trk_idx, det_idx, trk_idx * 7 % 5 > det_idx * 3 % 5 as older from trk t join det d on t.frame_idx = d.frame_idx where 1 - {_IOU1} < cast(0.15 as double))"
_put(
    "duplicate_suppression",
    "det trk",
    f"""select 'tracked' as side, frame_idx, trk_idx as id from trk t where not exists (select 1 from {_CLOSE} c where c.frame_idx = t.frame_idx and c.trk_idx = t.trk_idx and not older)
  union all select 'lost', frame_idx, det_idx from det d where not exists (select 1 from {_CLOSE} c where c.frame_idx = d.frame_idx and c.det_idx = d.det_idx and older)""",
)
_put("ordered_union", "det", "select id, min(side) as side from (select frame_idx * 10 + det_idx as id, 'a' as side from det where category_id < 3 union all select frame_idx * 10 + det_idx, 'b' from det where score > cast(0.5 as double)) group by id")
_put("anti_difference", "det", "select frame_idx * 10 + det_idx as id, 'a' as side from det where category_id < 3 and not score > cast(0.5 as double)")


def _kalman(columns: str) -> str:
    axes = [("x", "w"), ("y", "h"), ("w", "w"), ("h", "h")]
    measured = {"x": "(x1 + x2) / 2", "y": "(y1 + y2) / 2", "w": "x2 - x1", "h": "y2 - y1"}
    p, v = f"cast({POSITION!r} as double)", f"cast({VELOCITY!r} as double)"
    first = ", ".join(f"{measured[a]} as {a}, cast(0 as double) as {a}v, pow(2 * {p} * ({measured[s]}), 2) as {a}00, cast(0 as double) as {a}01, pow(10 * {v} * ({measured[s]}), 2) as {a}11" for a, s in axes)
    ahead = ", ".join(f"k.{a} + k.{a}v as {a}, k.{a}v as {a}v, k.{a}00 + 2 * k.{a}01 + k.{a}11 + pow({p} * k.{s}, 2) as {a}00, k.{a}01 + k.{a}11 as {a}01, k.{a}11 + pow({v} * k.{s}, 2) as {a}11" for a, s in axes)
    totals = ", ".join(f"{a}00 + pow({p} * {s}, 2) as {a}t, {measured[a]} - {a} as {a}d" for a, s in axes)
    new = ", ".join(f"{a} + {a}00 / {a}t * {a}d, {a}v + {a}01 / {a}t * {a}d, {a}00 - pow({a}00 / {a}t, 2) * {a}t, {a}01 - {a}00 / {a}t * {a}01 / {a}t * {a}t, {a}11 - pow({a}01 / {a}t, 2) * {a}t" for a, _ in axes)
    gate = " + ".join(f"pow({a}d, 2) / {a}t" for a, _ in axes)
    return f""", k as (select track_id, idx, {first}, cast(null as double) as gate from obs where idx = 0
  union all select track_id, idx, {new}, {gate} from (select *, {totals} from (select o.track_id, o.idx, o.x1, o.y1, o.x2, o.y2, {ahead} from k join obs o on o.track_id = k.track_id and o.idx = k.idx + 1)))
select track_id, idx, {columns} from k"""


def _expected(columns: str, camera: bool = False) -> str:
    """Predictions of all positions from the first with a number on; those without one aren't seen. The camera keeps axes apart."""
    axes = [("x", "w"), ("y", "h"), ("w", "w"), ("h", "h")]
    measured = {"x": "(x1 + x2) / 2", "y": "(y1 + y2) / 2", "w": "x2 - x1", "h": "y2 - y1"}
    turn = {a: f"(1 + (idx % 7) / cast({100 if a in 'xw' else -200} as double))" if camera else "cast(1 as double)" for a in "xywh"}
    shift = {"x": "idx % 7 - cast(3 as double)", "y": "cast(2 as double)"} if camera else {}
    p, v = f"cast({POSITION!r} as double)", f"cast({VELOCITY!r} as double)"
    first = ", ".join(f"{measured[a]} as {a}, cast(0 as double) as {a}v, pow(2 * {p} * ({measured[s]}), 2) as {a}00, cast(0 as double) as {a}01, pow(10 * {v} * ({measured[s]}), 2) as {a}11" for a, s in axes)
    speed = {a: f"case when k.seen then k.{a}v else 0 end" if a in "wh" else f"k.{a}v" for a, _ in axes}
    ahead = ", ".join(f"k.{a} + {speed[a]} as {a}, {speed[a]} as {a}v, k.{a}00 + 2 * k.{a}01 + k.{a}11 + pow({p} * k.{s}, 2) as {a}00, k.{a}01 + k.{a}11 as {a}01, k.{a}11 + pow({v} * k.{s}, 2) as {a}11" for a, s in axes)
    turned = ", ".join(f"{a} * {turn[a]} + {shift.get(a, '0')} as {a}, {a}v * {turn[a]} as {a}v, " + ", ".join(f"{a}{n} * pow({turn[a]}, 2) as {a}{n}" for n in ("00", "01", "11")) for a, _ in axes)
    totals = ", ".join(f"{a}00 + pow({p} * {s}, 2) as {a}t, {measured[a]} - {a} as {a}d" for a, s in axes)
    new = ", ".join(f"case when seen then {a} + {a}00 / {a}t * {a}d else {a} end, case when seen then {a}v + {a}01 / {a}t * {a}d else {a}v end, case when seen then {a}00 - pow({a}00 / {a}t, 2) * {a}t else {a}00 end, case when seen then {a}01 - {a}00 / {a}t * {a}01 / {a}t * {a}t else {a}01 end, case when seen then {a}11 - pow({a}01 / {a}t, 2) * {a}t else {a}11 end" for a, _ in axes)
    expected = "x - w / 2, y - h / 2, x + w / 2, y + h / 2"
    return f""", f as (select track_id, min(idx) filter (jersey is not null) as start, max(idx) filter (jersey is not null) as last from obs group by track_id),
o as (select obs.*, jersey is not null as seen from obs join f using (track_id) where idx between start and last),
k as (select track_id, idx, seen, {first}, x1 as p1, y1 as q1, x2 as p2, y2 as q2 from o join f using (track_id) where idx = start
  union all select track_id, idx, seen, {new}, {expected} from (select *, {totals} from (select track_id, idx, seen, x1, y1, x2, y2, {turned} from (select o.track_id, o.idx, o.seen, o.x1, o.y1, o.x2, o.y2, {ahead} from k join o on o.track_id = k.track_id and o.idx = k.idx + 1))))
select k.track_id, k.idx, k.seen, {columns} from k join o on o.track_id = k.track_id and o.idx = k.idx"""


_INSIDE = "greatest(least(p2, x2) - greatest(p1, x1) + 1, 0) * greatest(least(q2, y2) - greatest(q1, y1) + 1, 0)"
ORACLE["predicted_overlap"] = with_ctes("obs") + _expected(f"round(1 - {_INSIDE} / ((p2 - p1 + 1) * (q2 - q1 + 1) + (x2 - x1 + 1) * (y2 - y1 + 1) - {_INSIDE}), 6) as distance")
ORACLE["camera_warp"] = with_ctes("obs") + _expected("round(p1, 6) as x1, round(q1, 6) as y1, round(p2, 6) as x2, round(q2, 6) as y2", True)
ORACLE["kalman_filter_series"] = with_ctes("obs") + _kalman("round(x, 6) as cx, round(y, 6) as cy, round(w, 6) as w, round(h, 6) as h, round(xv, 6) as vx, round(yv, 6) as vy")
ORACLE["gating_distance"] = with_ctes("obs") + _kalman("round(gate, 6) as gate")
ORACLE["motion_fused_cost"] = with_ctes("obs") + _kalman("round(case when gate > cast(9.4877 as double) then -1 else cast(0.5 as double) * cast(0.98 as double) + gate * (1 - cast(0.98 as double)) end, 6) as cost") + " where gate is not null"
_UNIT = "list_transform({0}, lambda u: u / sqrt(list_dot_product({0}, {0})))"
ORACLE["ema_embedding"] = f"""{with_ctes("emb")}, n as (select track_id, idx, {_UNIT.format("embedding")} as e from emb), k as (select track_id, idx, e as f from n where idx = 0
  union all select track_id, idx, {_UNIT.format("m")} from (select n.track_id, n.idx, list_transform(n.e, lambda u, i: cast(0.9 as double) * k.f[i] + (1 - cast(0.9 as double)) * u) as m from k join n on n.track_id = k.track_id and n.idx = k.idx + 1))
select track_id, idx, round(f[1], 6) as f0, round(f[64], 6) as f63 from k"""

_put("series_collect", "obs", "select track_id, cast(count(*) as int) as n, string_agg(cast(frame_idx as varchar), ',' order by idx) as frames from obs group by track_id")
_put("series_slice", "obs", "select track_id, idx, frame_idx, jersey from obs where idx between 5 and 20")
_put("frame_regroup", "obs", "select frame_idx // 10 as frame_idx, cast(count(*) as int) as n, string_agg(cast(track_id as varchar), ',' order by track_id, idx) as tracks from obs group by 1")
_put(
    "frame_labels",
    "obs",
    """select track_id, idx, role, track_id || '|' || coalesce(cast(team as varchar), 'X') || '|' || coalesce(cast(jersey as varchar), 'X') || ':' || case when jersey is null then 'X' else format('{:.4g}', entropy) end as label,
  'track' || printf('%04d', track_id) || '_frame' || printf('%05d', frame_idx) || '_gt' || coalesce(cast(jersey as varchar), 'None') || '.jpg' as crop_name from obs""",
)
_put(
    "centroid_outlier_filter",
    "emb",
    """, e as (select track_id, idx, unnest(embedding) as x, generate_subscripts(embedding, 1) as p from emb), m as (select track_id, p, avg(x) as m from e group by track_id, p),
  d as (select track_id, idx, sqrt(sum((x - m) * (x - m))) as d from e join m using (track_id, p) group by track_id, idx)
  select track_id, idx, round(d, 6) as distance from (select *, count(*) over w as n, avg(d) over w as a, stddev_pop(d) over w as s from d window w as (partition by track_id)) where n < 3 or d - a <= cast(0.5 as double) * s""",
)
_put(
    "model_heads",
    "emb",
    """select track_id, idx, round(1 / (1 + exp(-embedding[1])), 6) as legible, round(exp(embedding[1]) / (exp(embedding[1]) + exp(embedding[2]) + exp(embedding[3]) + exp(embedding[4])), 6) as first_class,
  round((embedding[4] + embedding[12]) / 2, 6) as mean_3 from emb""",
)
_NUMBER = "case when regexp_full_match(trim(label), '[0-9]+') and cast(trim(label) as int) between 0 and 99 then cast(trim(label) as int) end"
_SURE = "list_avg(char_confs[1:2])"
_READ = f"select track_id, frame_idx, {_NUMBER} as jersey, case when {_NUMBER} is null then 0 else {_SURE} end as confidence, case when {_NUMBER} is null then 1 when {_SURE} > 0 then -{_SURE} * ln({_SURE}) end as entropy from ocr"
_put("ocr_parse", "ocr", f"select track_id, frame_idx, jersey from ({_READ})")
_put("confidence_entropy", "ocr", f"select track_id, frame_idx, round(confidence, 6) as confidence, round(entropy, 6) as entropy from ({_READ})")
_put("dense_backfill", "ocr obs", f"select o.track_id, o.idx, r.jersey, round(coalesce(confidence, 0), 6) as confidence, round(case when r.track_id is null then 1 else r.entropy end, 6) as entropy from obs o left join ({_READ} where char_confs[1] >= cast(0.6 as double)) r on r.track_id = o.track_id and r.frame_idx = o.frame_idx")

_VALID = "list_filter([{'n': 's', 'x': ls_x, 'y': ls_y, 's': ls_s}, {'n': 's', 'x': rs_x, 'y': rs_y, 's': rs_s}, {'n': 'h', 'x': lh_x, 'y': lh_y, 's': lh_s}, {'n': 'h', 'x': rh_x, 'y': rh_y, 's': rh_s}], lambda p: p.s >= cast(0.3 as double))"
_TORSO = f""", v as (select *, {_VALID} as v from pose), b as (select *, list_transform(v, lambda p: p.x) as xs, list_transform(v, lambda p: p.y) as ys, list_contains(list_transform(v, lambda p: p.n), 's') and list_contains(list_transform(v, lambda p: p.n), 'h') as enough from v),
  q as (select *, greatest(0, cast(trunc(list_min(xs) - 5) as int)) as a, greatest(0, cast(trunc(list_min(ys) - 5) as int)) as b, least(crop_w, cast(trunc(list_max(xs) + 5) as int)) as c, least(crop_h, cast(trunc(list_max(ys)) as int)) as d from b),
  t as (select *, enough and c > a and d > b as good, cast(trunc(crop_h * cast(0.2 as double)) as int) as top, cast(trunc(crop_h * cast(0.8 as double)) as int) as bottom from q)"""
_put("torso_box_pose", "pose", f"{_TORSO} select crop_id, case when good then a end as x1, case when good then b end as y1, case when good then c end as x2, case when good then d end as y2 from t")
_put("torso_box_heuristic", "pose", f"{_TORSO} select crop_id, coalesce(good, false) as from_pose, case when good then a else 0 end as x1, case when good then b else top end as y1, case when good then c else crop_w end as x2, case when good then d else bottom end as y2 from t")
_put("crop_clamp", "det", "select * from (select frame_idx, det_idx, greatest(0, cast(trunc(x1) as int)) as crop_x1, greatest(0, cast(trunc(y1) as int)) as crop_y1, least(1280, cast(trunc(x2) as int)) as crop_x2, least(720, cast(trunc(y2) as int)) as crop_y2 from det) where crop_x2 > crop_x1 and crop_y2 > crop_y1")
_put("systematic_sample", "obs", "select track_id, idx, frame_idx from (select *, greatest(1, count(*) over (partition by track_id) // 10) as step from obs) where idx % step = 0 and idx // step < 10")


def _persistent(rel: str, value: str, length: int, least: int, gate: str) -> str:
    return f"""select track_id, idx, {value} from (select *, list({value}) filter (where {value} is not null) over w as win, count(*) over w as rows_seen, lead(entropy) over (partition by track_id order by idx) as next_entropy
  from {rel} window w as (partition by track_id order by idx rows between current row and {length - 1} following))
  where {value} is not null and {gate} and len(list_filter(win, lambda x: x = {value})) >= greatest({least}, list_max(map_values(list_aggregate(win, 'histogram'))))"""


def _number(rel: str) -> str:
    t = f"cast({C.entropy_threshold} as double)"
    return _persistent(rel, "jersey", C.number_lookahead, C.number_min_persistence, f"entropy <= {t} and next_entropy <= {t}")


def _team(rel: str) -> str:
    return _persistent(rel, "team", C.team_lookahead, C.team_min_persistence, "len(list_filter(win, lambda x: x = team)) >= rows_seen - len(win)")


def _switches(persistent: str, value: str) -> str:
    return f"select * from (select track_id, idx, lag({value}) over (partition by track_id order by idx) as before, {value} as after from ({persistent})) where before <> after"


def _refined(rel: str, found: str) -> str:
    return f"""select track_id, idx, case when n >= 4 and top > mean + cast(2.5 as double) * std and top > {C.min_pixel_jump:g} and peak < idx then peak else idx end as cut from (
  select track_id, idx, count(*) as n, avg(v) as mean, stddev_pop(v) as std, max(v) as top, arg_min(at_idx, (-v, at_idx)) filter (where v is not null) as peak from (
    select s.track_id, s.idx, o.idx as at_idx, sqrt(pow(o.x1 + o.x2 / 2 - lag(o.x1 + o.x2 / 2) over w, 2) + pow(o.y1 + o.y2 / 2 - lag(o.y1 + o.y2 / 2) over w, 2)) as v
    from ({found}) s join {rel} o on o.track_id = s.track_id and o.idx between s.idx - {C.lookback} and s.idx window w as (partition by s.track_id, s.idx order by o.idx)) group by track_id, idx)"""


def _pieces(rel: str, cuts: str, least: int) -> str:
    return f"""select track_id, frag_no, start_idx, end_idx from (select *, count(*) over (partition by track_id) as kept from (
  select track_id, cast(row_number() over w - 1 as int) as frag_no, cut as start_idx, lead(cut) over w - 1 as end_idx from (
    select track_id, cast(idx as bigint) as place, cast(cut as int) as cut from ({cuts}) union all
    select distinct track_id, -1, 0 from ({cuts}) union all
    select track_id, 4611686018427387904, cast(max(idx) + 1 as int) from {rel} where track_id in (select track_id from ({cuts})) group by track_id)
  window w as (partition by track_id order by place)) where end_idx - start_idx + 1 >= {least}) where kept >= 2"""


def _split(rel: str, frags: str) -> str:
    """Next stage's relation: parent_id, place (list), track_id, idx and the other columns."""
    rest = "frame_idx, x1, y1, x2, y2, jersey, entropy, team"
    return f"""select parent_id, list_append(place, frag_no) as place, new_id as track_id, idx - start_idx as idx, {rest} from {rel} join (
    select f.*, (select coalesce(max(track_id), 0) from {rel}) + row_number() over (order by p.parent_id, p.place, frag_no) as new_id
    from ({frags}) f join (select distinct track_id, parent_id, place from {rel}) p using (track_id)) using (track_id) where idx between start_idx and end_idx
  union all select parent_id, list_append(place, -1), track_id, idx, {rest} from {rel} where track_id not in (select track_id from ({frags}))"""


_NUMBER_CUTS = _refined("obs", _switches(_number("obs"), "jersey"))
_NUMBER_FRAGS = _pieces("obs", _NUMBER_CUTS, C.number_min_fragment)
_TEAM_CUTS = "select track_id, idx, idx as cut from ({})".format
_STAGES = f""", s0 as materialized (select track_id as parent_id, cast([] as int[]) as place, * from obs), f0 as materialized ({_pieces("s0", _refined("s0", _switches(_number("s0"), "jersey")), C.number_min_fragment)}),
s1 as materialized ({_split("s0", "select * from f0")}), f1 as materialized ({_pieces("s1", _TEAM_CUTS(_switches(_team("s1"), "team")), C.team_min_fragment)}), s2 as ({_split("s1", "select * from f1")})"""

_put("number_persistence", "obs", _number("obs"))
_put("number_switches", "obs", _switches(_number("obs"), "jersey"))
_put("refined_switches", "obs", f"select track_id, idx, cast(cut as int) as refined_idx from ({_NUMBER_CUTS})")
_put("number_fragments", "obs", _NUMBER_FRAGS)
_put("team_persistence", "obs", _team("obs"))
_put("team_switches", "obs", _switches(_team("obs"), "team"))
_put("team_fragments", "obs", _pieces("obs", _TEAM_CUTS(_switches(_team("obs"), "team")), C.team_min_fragment))
_put("number_split_ids", "obs", f"{_STAGES} select parent_id, track_id, count(*) as n, min(frame_idx) as first_frame from s1 group by parent_id, track_id")
_put("split_two_stage", "obs", f"{_STAGES} select parent_id, track_id, idx, frame_idx, jersey, team from s2")
ORACLE["sequence_sessions_stream"] = """
with e as (select user_id, epoch_us(ts) as us, value from events),
s as (select *, sum(fresh) over (partition by user_id order by us) as session from (select *, case when us < lag(us) over (partition by user_id order by us) + 1800000000 then 0 else 1 end as fresh from e)),
w as (select user_id, min(us) as start_us, max(us) + 1800000000 as end_us, count(*) as n_events, round(sum(value), 6) as total from s group by user_id, session)
select * from w where end_us <= (select max(us) from e) - 3600000000
"""
_put("split_summary", "obs", f"{_STAGES} select (select count(distinct track_id) from obs) as tracks, count(*) filter (where n > 1) as tracks_split, cast(coalesce(sum(n), 0) as bigint) as tracks_after from (select parent_id, count(distinct track_id) as n from s1 group by parent_id)")


ORACLE["team_rounds"] = with_ctes("emb") + """,
p as (select track_id % 2 as sequence_id, track_id, idx, embedding as v from emb where idx % 12 <> 11),
c0 as (select sequence_id, unnest([0, 1]) as c, unnest([arg_min(v, struct_pack(track_id, idx)), arg_max(v, struct_pack(track_id, idx))]) as m from p group by sequence_id),
""" + ",\n".join(
    f"""n{r} as (select p.sequence_id, track_id, idx, v, arg_min(c, struct_pack(d := list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c)) as team from p join c{r} using (sequence_id) group by p.sequence_id, track_id, idx, v),
s{r} as (select sequence_id, team as c, i, avg(v[i]) as x from n{r}, range(1, 65) g(i) group by all),
c{r + 1} as (select c{r}.sequence_id, c{r}.c, coalesce(own.m, c{r}.m) as m from c{r} left join (select sequence_id, c, list(x order by i) as m from s{r} group by sequence_id, c) own using (sequence_id, c))"""
    for r in range(4)
) + """
select sequence_id, track_id, idx, team from n3
"""

ORACLE["path_rank"] = with_ctes("det") + """,
n as (select frame_idx // 100 as sequence_id, md5(det_idx::varchar) || '/f' || lpad((frame_idx % 100)::varchar, 3, '0') || '.jpg' as path from det)
select *, row_number() over (partition by sequence_id order by path) - 1 as frame_idx from n
"""
