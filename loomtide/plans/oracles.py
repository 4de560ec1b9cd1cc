"""The queries of this package as DuckDB SQL over the same tables."""

from __future__ import annotations

from loomtide.plans.queries import DAY, HOUR, REQUIRED, SEGMENTS

EV = "ev AS (SELECT user_id % 4 AS rec, event_type AS topic, epoch_us(ts) * 1000 AS timestamp_ns, event_id AS seq, value FROM events)"
TB = "tb AS (SELECT rec, topic, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM ev GROUP BY ALL)"
BD = "bd AS (SELECT rec, max(first_ns) AS start_ns, max(last_ns) AS end_ns FROM tb GROUP BY rec)"


def _grid(step: int) -> str:
    return f"g AS (SELECT rec, unnest(range(start_ns, end_ns + 1, {step})) AS t FROM bd), gt AS (SELECT g.rec, tb.topic, g.t FROM g JOIN tb USING (rec))"


_REQ = ", ".join(f"'{t}'" for t in REQUIRED)
_SEG = "seg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{label}', {str(ok).lower()}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for i, label, ok, a, b in SEGMENTS) + ") AS s(segment_index, segment_label, segment_success, start_s, end_s)), recs AS (SELECT unnest(range(4)) AS rec), rs AS (SELECT * FROM recs CROSS JOIN seg)"
_TIMING = """count(timestamp_ns) AS message_count, min(timestamp_ns) AS first_message_timestamp_ns, max(timestamp_ns) AS last_message_timestamp_ns,
 coalesce((max(timestamp_ns) - min(timestamp_ns)) / 1e9, 0) AS observed_topic_span_s,
 coalesce(least((max(timestamp_ns) - min(timestamp_ns)) / (max(end_ns) - max(start_ns)), 1), 0) AS episode_coverage_ratio,
 CASE WHEN max(timestamp_ns) > min(timestamp_ns) THEN (count(timestamp_ns) - 1) / ((max(timestamp_ns) - min(timestamp_ns)) / 1e9) END AS observed_hz,
 quantile_cont(i, 0.5) AS median_topic_interval_ms,
 CASE WHEN avg(i) > 0 THEN stddev_pop(i) / avg(i) END AS topic_interval_cv,
 max(i) AS max_topic_interval_ms,
 CASE WHEN quantile_cont(i, 0.5) > 0 THEN max(i) / quantile_cont(i, 0.5) END AS max_interval_over_median"""
_TM = f"""tm0 AS (SELECT ev.rec, topic, timestamp_ns, start_ns, end_ns, (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY ev.rec, topic ORDER BY timestamp_ns)) / 1e6 AS i FROM ev JOIN bd ON ev.rec = bd.rec WHERE timestamp_ns BETWEEN start_ns AND end_ns),
tm1 AS (SELECT rec, topic, {_TIMING} FROM tm0 GROUP BY rec, topic),
names AS (SELECT DISTINCT rec, topic FROM ev UNION SELECT DISTINCT rec, unnest([{_REQ}]) FROM bd),
tm AS (SELECT n.rec, n.topic, coalesce(message_count, 0) AS message_count, first_message_timestamp_ns, last_message_timestamp_ns, coalesce(observed_topic_span_s, 0) AS observed_topic_span_s, coalesce(episode_coverage_ratio, 0) AS episode_coverage_ratio, observed_hz, median_topic_interval_ms, topic_interval_cv, max_topic_interval_ms, max_interval_over_median, n.topic IN ({_REQ}) AS is_required_topic FROM names n LEFT JOIN tm1 ON n.rec = tm1.rec AND n.topic = tm1.topic)"""


def _shift(steps: int, fill: str) -> str:
    move = f"lead(value, {steps})" if steps > 0 else f"lag(value, {-steps})"
    w = "PARTITION BY rec, topic ORDER BY timestamp_ns, seq"
    value = "coalesce(s, 0)" if fill == "zero" else f"coalesce(last_value(s IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(s IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    return f"WITH {EV}, m AS (SELECT rec, topic, timestamp_ns, seq, {move} OVER ({w}) AS s FROM ev) SELECT rec, topic, timestamp_ns, seq, {value} AS value FROM m"


_POSE = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x, l_tax * 100 AS y, l_discount AS z, sin(l_discount * 5 + l_linenumber * 0.7) AS qz, cos(l_discount * 5 + l_linenumber * 0.7) AS qw FROM lineitem)"


def _delta(target: bool) -> str:
    # All turns are about z: (0, 0, s, c) turns by the angle whose half has that sine and cosine.
    turned = "(1 - 2 * bz * bz) * dx + 2 * bw * bz * dy AS tx, (1 - 2 * bz * bz) * dy - 2 * bw * bz * dx AS ty" if target else "dx AS tx, dy AS ty"
    return f"""WITH {_POSE}, l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, lag(qz) OVER w AS bz, lag(qw) OVER w AS bw FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
a AS (SELECT *, CASE WHEN qz * bz + qw * bw < 0 THEN -qz ELSE qz END AS az, CASE WHEN qz * bz + qw * bw < 0 THEN -qw ELSE qw END AS aw FROM l),
o AS (SELECT l_orderkey, l_linenumber, {turned}, dz AS tz, bw * az - bz * aw AS rz, bw * aw + bz * az AS rw FROM a)
SELECT l_orderkey, l_linenumber, round(coalesce(tx, 0), 6) + 0.0 AS tx, round(coalesce(ty, 0), 6) + 0.0 AS ty, round(coalesce(tz, 0), 6) + 0.0 AS tz, CAST(0 AS DOUBLE) AS rx, CAST(0 AS DOUBLE) AS ry, round(coalesce(rz, 0), 6) + 0.0 AS rz, round(coalesce(rw, 1), 6) + 0.0 AS rw FROM o"""


_ASOF = "ASOF LEFT JOIN ev ON gt.rec = ev.rec AND gt.topic = ev.topic AND"
_TASKS = "tasks AS (SELECT p_partkey % 5 AS source, p_type AS task, min(p_partkey) AS task_index FROM part GROUP BY ALL), firsts AS (SELECT task, min((source, task_index)) AS f FROM tasks GROUP BY task), ids AS (SELECT task, row_number() OVER (ORDER BY f) - 1 AS global_task_index FROM firsts)"
_EPISODES = "e AS (SELECT l_orderkey % 3 AS source, l_orderkey AS episode_index, count(*) AS length FROM lineitem GROUP BY ALL)"
_PATH = "regexp_extract(url, '^https?://[^/]+(/.*)$', 1)"
_HELD = f"""{EV}, {TB}, {BD}, {_grid(HOUR)}, h0 AS (SELECT gt.rec, gt.topic, gt.t, ev.timestamp_ns, ev.seq, ev.value FROM gt {_ASOF} gt.t >= ev.timestamp_ns),
h AS (SELECT rec, topic, t AS synched_timestamp_ns, timestamp_ns, seq, value, timestamp_ns IS NOT NULL AND timestamp_ns IS DISTINCT FROM lag(timestamp_ns) OVER (PARTITION BY rec, topic ORDER BY t) AS is_fresh FROM h0)"""

ORACLES: dict[str, str] = {
    "topic_catalog": f"WITH {EV} SELECT rec, topic, count(*) AS n, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM ev GROUP BY ALL",
    "timeline_bounds": f"WITH {EV}, {TB}, {BD} SELECT * FROM bd",
    "timeline_grid": f"WITH {EV}, {TB}, {BD} SELECT rec, unnest(range(start_ns, end_ns + 1, {HOUR})) AS synched_timestamp_ns FROM bd",
    "sync_zoh": f"WITH {_HELD} SELECT * FROM h",
    "sync_nearest": f"""WITH {EV}, {TB}, {BD}, {_grid(HOUR)}, b AS (SELECT gt.rec, gt.topic, gt.t, ev.timestamp_ns AS bt, ev.value AS bv FROM gt {_ASOF} gt.t >= ev.timestamp_ns),
f AS (SELECT gt.rec, gt.topic, gt.t, ev.timestamp_ns AS ft, ev.value AS fv FROM gt {_ASOF} gt.t <= ev.timestamp_ns),
c AS (SELECT b.rec, b.topic, b.t, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - b.t < b.t - bt) THEN ft ELSE bt END AS timestamp_ns, CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - b.t < b.t - bt) THEN fv ELSE bv END AS value FROM b JOIN f ON b.rec = f.rec AND b.topic = f.topic AND b.t = f.t)
SELECT rec, topic, t AS synched_timestamp_ns, timestamp_ns, value, timestamp_ns IS NOT NULL AND timestamp_ns IS DISTINCT FROM lag(timestamp_ns) OVER (PARTITION BY rec, topic ORDER BY t) AS is_fresh FROM c""",
    "sync_timestamp_merge": f"WITH {EV}, {TB}, {BD}, gt AS (SELECT ev.rec, tb.topic, ev.timestamp_ns AS t FROM ev JOIN bd ON ev.rec = bd.rec JOIN tb ON ev.rec = tb.rec WHERE ev.timestamp_ns BETWEEN start_ns AND end_ns) SELECT gt.rec, gt.topic, gt.t AS synched_timestamp_ns, ev.timestamp_ns, ev.value FROM gt {_ASOF} gt.t >= ev.timestamp_ns",
    "asof_forward": f"WITH {EV}, {TB}, {BD}, {_grid(DAY)} SELECT gt.rec, gt.topic, gt.t AS synched_timestamp_ns, ev.timestamp_ns, ev.value FROM gt {_ASOF} gt.t <= ev.timestamp_ns",
    "sync_excluded_rows": f"WITH {EV}, {TB}, {BD} SELECT ev.* FROM ev JOIN bd ON ev.rec = bd.rec WHERE timestamp_ns NOT BETWEEN start_ns AND end_ns",
    "shift_future_edge": _shift(2, "edge"),
    "shift_past_edge": _shift(-3, "edge"),
    "shift_zero": _shift(1, "zero"),
    "delta_array": "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(coalesce(x - lag(x) OVER (PARTITION BY label, pos ORDER BY vec_id), 0) + 0.0, 6) AS d FROM e",
    "delta_transform_source": _delta(False),
    "delta_transform_target": _delta(True),
    "tf_buffer": f"""WITH {EV}, m AS (SELECT * FROM ev WHERE value IS NOT NULL), times AS (SELECT DISTINCT rec, timestamp_ns AS t FROM m), frames AS (SELECT DISTINCT rec, topic FROM m), gt AS (SELECT times.rec, topic, t FROM times JOIN frames USING (rec)),
j AS (SELECT gt.rec, gt.t, gt.topic, m.timestamp_ns, m.value FROM gt ASOF JOIN m ON gt.rec = m.rec AND gt.topic = m.topic AND gt.t >= m.timestamp_ns),
k AS (SELECT *, count(*) OVER (PARTITION BY rec, t) AS n FROM j) SELECT k.rec, t AS timestamp_ns, topic AS child_frame_id, value AS x, timestamp_ns = t AS is_fresh FROM k JOIN (SELECT rec, count(*) AS want FROM frames GROUP BY rec) USING (rec) WHERE n = want""",
    "tf_chain": f"""WITH {_POSE}, c AS (SELECT *, 1 - 2 * qz * qz AS cs, 2 * qw * qz AS sn FROM p), h AS (SELECT *, x + cs * 1.0 - sn * 0.5 AS hx, y + sn * 1.0 + cs * 0.5 AS hy FROM c)
SELECT l_orderkey * 10 + l_linenumber AS timestamp_ns, round(hx + 2.0, 6) + 0.0 AS tx, round(hy - 0.5, 6) + 0.0 AS ty, round(z, 6) + 0.0 AS tz, round(qz, 6) + 0.0 AS rz, round(qw, 6) + 0.0 AS rw, round(-(cs * hx + sn * hy), 6) + 0.0 AS bx, round(-(cs * hy - sn * hx), 6) + 0.0 AS "by", true AS fresh FROM h""",
    "uuid_stamp": f"WITH {EV} SELECT '0b6f6e0a-recording' AS rosbag_uuid, rec, seq, value FROM ev",
    "interval_ms": f"WITH {EV} SELECT rec, topic, seq, round((timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY rec, topic ORDER BY timestamp_ns)) / 1e6, 6) AS interval_ms FROM ev",
    "topic_timing_metrics": f"WITH {EV}, {TB}, {BD}, {_TM} SELECT rec, topic, message_count, first_message_timestamp_ns, last_message_timestamp_ns, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("observed_topic_span_s", "episode_coverage_ratio", "observed_hz", "median_topic_interval_ms", "topic_interval_cv", "max_topic_interval_ms", "max_interval_over_median")) + ", is_required_topic FROM tm",
    "segment_metrics": f"""WITH {EV}, {_SEG}, asked AS (SELECT rec, segment_index, CAST(round(start_s * 1e9) AS BIGINT) AS start_ns, CAST(round(end_s * 1e9) AS BIGINT) AS end_ns, unnest([{_REQ}]) AS topic FROM rs),
i0 AS (SELECT a.rec, a.segment_index, a.topic, timestamp_ns, start_ns, end_ns, (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY a.rec, a.segment_index, a.topic ORDER BY timestamp_ns)) / 1e6 AS i FROM ev JOIN asked a ON ev.rec = a.rec AND ev.topic = a.topic WHERE timestamp_ns BETWEEN start_ns AND end_ns),
t AS (SELECT rec, segment_index, topic, {_TIMING} FROM i0 GROUP BY ALL),
w AS (SELECT a.rec, a.segment_index, bool_and(coalesce(message_count, 0) > 0) AS ok, min(coalesce(episode_coverage_ratio, 0)) AS c, max(max_topic_interval_ms) AS m, max(max_interval_over_median) AS r FROM asked a LEFT JOIN t ON a.rec = t.rec AND a.segment_index = t.segment_index AND a.topic = t.topic GROUP BY ALL)
SELECT rs.rec, rs.segment_index, segment_label, segment_success, round(end_s - start_s, 6) AS segment_duration_s, ok AS has_all_required_topics, round(c, 6) AS minimum_required_segment_coverage_ratio, round(m, 6) AS worst_topic_max_interval_ms, round(r, 6) AS worst_topic_max_interval_over_median FROM rs JOIN w ON rs.rec = w.rec AND rs.segment_index = w.segment_index""",
    "episode_metrics": f"""WITH {EV}, {TB}, {BD}, {_TM} SELECT rec, 'bake' AS episode_label, rec % 2 = 0 AS episode_success, CAST(rec * 10 AS DOUBLE) AS episode_duration_s, bool_and(message_count > 0) AS has_all_required_topics, round(min(episode_coverage_ratio), 6) AS minimum_required_episode_coverage_ratio, round(max(max_topic_interval_ms), 6) AS worst_topic_max_interval_ms, round(max(max_interval_over_median), 6) AS worst_topic_max_interval_over_median, round(max(topic_interval_cv), 6) AS worst_topic_interval_cv FROM tm WHERE is_required_topic GROUP BY rec""",
    "duration_percentile_rank": "WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS duration FROM orders), c AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY duration) AS r, count(*) OVER (PARTITION BY o_orderpriority, duration) AS ties, count(*) OVER (PARTITION BY o_orderpriority) AS group_size FROM o) SELECT o_orderkey, o_orderpriority, duration, group_size, round(CASE WHEN group_size = 1 THEN 0.5 ELSE (r - 1 + (ties - 1) / 2.0) / (group_size - 1) END, 6) AS percentile_rank FROM c",
    "field_path_index": "SELECT vec_id, embedding[1] AS first, embedding[len(embedding)] AS last, CAST(NULL AS FLOAT) AS beyond FROM embeddings",
    "field_path_slice": "SELECT vec_id, round(embedding[2]::DOUBLE + embedding[3]::DOUBLE, 6) AS s1, round(embedding[63]::DOUBLE + embedding[64]::DOUBLE, 6) AS s2, 4 AS n3, 0 AS n4 FROM embeddings",
    "segment_assemble": f"WITH {_HELD}, {_SEG} SELECT rs.rec, rs.segment_index, a.synched_timestamp_ns, " + ", ".join(f"t{k}.value AS {t}, t{k}.is_fresh AS {t}_fresh" for k, t in enumerate(REQUIRED)) + " FROM rs JOIN (SELECT DISTINCT rec, synched_timestamp_ns FROM h) a ON rs.rec = a.rec AND a.synched_timestamp_ns BETWEEN CAST(trunc(start_s * 1e9) AS BIGINT) AND CAST(trunc(end_s * 1e9) AS BIGINT) " + " ".join(f"JOIN h t{k} ON t{k}.rec = a.rec AND t{k}.synched_timestamp_ns = a.synched_timestamp_ns AND t{k}.topic = '{t}'" for k, t in enumerate(REQUIRED)),
    "segment_overlap": f"WITH {EV}, {_SEG}, r AS (SELECT rec, min(timestamp_ns) AS a, max(timestamp_ns) AS b FROM ev GROUP BY rec) SELECT rs.* FROM rs JOIN r ON rs.rec = r.rec WHERE CAST(round(end_s * 1e9) AS BIGINT) >= a AND CAST(round(start_s * 1e9) AS BIGINT) <= b",
    "episode_axes": "WITH n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS episode_index, coalesce(sum(c) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n), f AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS frame_index FROM lineitem) SELECT f.l_orderkey, l_linenumber, frame_index, CAST(frame_index + off AS BIGINT) AS \"index\", episode_index, round(frame_index * CAST(0.1 AS DOUBLE), 6) AS timestamp FROM f JOIN o ON f.l_orderkey = o.l_orderkey",
    "next_done": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = count(*) OVER (PARTITION BY l_orderkey) AS next_done, CAST(-1 AS BIGINT) AS short_horizon_task_index, l_suppkey % 10 AS primitive_action_index, l_returnflag = 'N' AS success_primitive_action, l_suppkey % 10 AS task_index FROM lineitem",
    "frame_spacing": f"WITH {EV}, d AS (SELECT DISTINCT rec, topic, timestamp_ns FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY rec, topic ORDER BY timestamp_ns) AS k FROM d), s AS (SELECT rec, topic, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS s FROM r WHERE k <= 2 GROUP BY ALL HAVING count(*) = 2) SELECT rec, topic, round(s, 6) AS spacing_s, CAST(greatest(round(1 / s), 1) AS BIGINT) AS fps FROM s",
    "scalar_stats": "SELECT l_returnflag, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, count(l_extendedprice) AS count FROM lineitem GROUP BY 1",
    "list_stats": "WITH u AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, pos, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS count FROM u GROUP BY ALL",
    "struct_to_list": f"WITH {_POSE} SELECT l_orderkey, l_linenumber, 7 AS n, round(x, 6) AS v0, round(qw, 6) AS v6 FROM p",
    "task_dedup": f"WITH {_TASKS} SELECT * FROM ids",
    "task_remap": f"WITH {_TASKS}, f AS (SELECT p_partkey, p_partkey % 5 AS source, CASE WHEN p_size < 5 THEN -1 ELSE p_partkey END AS t FROM part) SELECT p_partkey, f.source, coalesce(global_task_index, t) AS task_index FROM f LEFT JOIN (SELECT source, task_index, global_task_index FROM tasks JOIN ids USING (task)) m ON f.source = m.source AND f.t = m.task_index",
    "episode_renumber": f"WITH {_EPISODES} SELECT *, row_number() OVER w - 1 AS new_episode_index, CAST(coalesce(sum(length) OVER (ORDER BY source, episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame_offset FROM e WINDOW w AS (ORDER BY source, episode_index)",
    "dataset_totals": f"WITH {_EPISODES}, {_TASKS} SELECT (SELECT count(*) FROM e) AS total_episodes, (SELECT CAST(sum(length) AS BIGINT) FROM e) AS total_frames, (SELECT count(DISTINCT task) FROM tasks) AS total_tasks, (SELECT count(*) * 2 FROM e) AS total_videos, (SELECT CAST(ceil(count(*) / 1000) AS BIGINT) FROM e) AS total_chunks",
    "depth_quantize": "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 20) AS BIGINT) AS mm FROM lineitem), q AS (SELECT *, CASE WHEN mm <= 0 OR mm > 4092 THEN 0 ELSE greatest(1, least(1023, (mm * 1023 + 2046) // 4092)) END AS code FROM l) SELECT l_orderkey, l_linenumber, mm, CAST(code AS BIGINT) AS code, CAST((code * 4092 + 511) // 1023 AS BIGINT) AS back FROM q",
    "payload_index": "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS \"index\" FROM p",
    "payload_lookup": "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, strlen(html) AS n_bytes FROM pages) SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS \"index\" FROM p",
    "topic_routes": "WITH k AS (SELECT page_id, CAST(page_id % 5 + 1 AS INTEGER) AS k FROM pages) SELECT page_id, '/cam' || page_id || ['/image/compressed', '/depth/compressedDepth', '/image_raw', '/points', '/joint_states'][k] AS topic, ['compressed_image', 'compressed_depth', 'image', 'point_cloud', 'plain'][k] AS route FROM k",
    "task_table": "WITH f AS (SELECT conv_id, role AS task, min((turn, role)) AS seen FROM conversations GROUP BY ALL) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seen) - 1 AS task_index, task FROM f",
    "image_shapes": "WITH p AS (SELECT p_partkey % 50 AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS own, p_size FROM part) SELECT '/cam' || k || '/image/compressed' AS topic, coalesce(max(own), max(p_size + 100)) AS height, coalesce(max(own * 2), max(p_size)) AS width FROM p GROUP BY k",
    "channel_stats": "WITH u AS (SELECT label, vec_id, unnest(range(len(embedding))) % 4 AS c, CAST(trunc(abs(unnest(embedding) * CAST(255 AS FLOAT))) AS INTEGER) / 255.0::DOUBLE AS x FROM embeddings) SELECT label, " + ", ".join(f"round({f}(x) FILTER (c = {k}), 6) AS {n}{k}" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop")) for k in range(4)) + ", count(DISTINCT vec_id) AS count FROM u GROUP BY label",
    "command_synthesis": f"WITH {EV}, s AS (SELECT rec, arg_min(value, timestamp_ns) AS v, arg_min(seq, timestamp_ns) AS q FROM ev WHERE topic = 'view' GROUP BY rec) SELECT ev.rec, timestamp_ns, seq, CAST(q AS DOUBLE) AS p0, v AS p1, 'a,b' AS joints FROM ev JOIN s ON ev.rec = s.rec WHERE topic = 'click'",
    "topic_file_stem": f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS parts FROM p) SELECT page_id, replace(ltrim(path, '/'), '/', '__') AS stem, parts[len(parts)] AS last, array_to_string(parts[1:len(parts) - 2], '/') || '/camera_info' AS info FROM s",
    "payload_format": "SELECT doc_id, ['jpg', 'png', 'webp', 'bin', 'jpg'][CAST(doc_id % 5 + 1 AS INTEGER)] AS format, 'episode_' || CASE WHEN doc_id < 1000000 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') ELSE CAST(doc_id AS VARCHAR) END AS episode, source || ':' || n_chars AS segment_id FROM documents",
    "feature_compat": """WITH a AS (SELECT 'f' || p_partkey AS name, p_brand AS d, CASE WHEN p_size % 11 = 1 THEN 0 ELSE p_size END AS s FROM part WHERE p_partkey % 7 <> 1), b AS (SELECT 'f' || p_partkey AS name, p_brand AS d, CASE WHEN p_size % 11 = 2 THEN 0 ELSE p_size END AS s FROM part WHERE p_partkey % 7 <> 2)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'only right' WHEN b.name IS NULL THEN 'only left' ELSE 'shape' END AS difference FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.s <> b.s""",
    "metadata_json": f"WITH {EV}, m AS (SELECT *, seq % 3 <> 0 AS new FROM ev) SELECT seq, CASE WHEN new THEN '2' ELSE '1' END AS version, CASE WHEN new THEN 'r' || seq END AS uuid, CASE WHEN new THEN 2 END AS n_segments, CASE WHEN new THEN 'rest' END AS first, CASE WHEN new THEN CASE WHEN seq % 2 = 1 THEN 'rest' ELSE topic END END AS second, CASE WHEN new THEN round(timestamp_ns / 1e9 + 1 + 1, 6) END AS end_time FROM m",
}
