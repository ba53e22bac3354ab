"""DuckDB SQL of the dataset queries."""

from __future__ import annotations

ANN = r"""
WITH RECURSIVE nd AS (SELECT count(*) AS n FROM documents),
ann AS (SELECT d.doc_id AS image_id, CASE WHEN d.doc_id % 20 = 0 THEN (d.doc_id + 4) % nd.n ELSE xor(d.doc_id, 1) END AS hard_id, d.doc_id // 4 AS video_id, d.text AS caption,
  (['goal', 'full', 'wentwrong'])[d.doc_id % 3 + 1] AS bucket, CASE WHEN l.toxic = 1 THEN 'anomaly' ELSE 'normal' END AS label_type, d.source AS label, d.lang AS action, d.doc_id % 7 AS scene,
  'train/imgs_' || (d.doc_id // 50) || '/' || (['goal', 'full', 'wentwrong'])[d.doc_id % 3 + 1] || '/' || d.doc_id || '.jpg' AS image
  FROM documents d CROSS JOIN nd LEFT JOIN labels l USING (doc_id)),
a AS (SELECT ann.*, h.text AS hard_c FROM ann LEFT JOIN documents h ON h.doc_id = ann.hard_id),
an AS (SELECT *, regexp_replace(regexp_replace(lower(caption), '\s+', ' ', 'g'), '^ | $', '', 'g') AS key, regexp_replace(regexp_replace(lower(hard_c), '\s+', ' ', 'g'), '^ | $', '', 'g') AS hard_key FROM a)
"""
COMP = """,
ed AS (SELECT DISTINCT x.video_id AS s, y.video_id AS t FROM ann x JOIN ann y ON y.image_id = x.hard_id),
sy AS (SELECT s, t FROM ed UNION SELECT t, s FROM ed UNION SELECT s, s FROM ed UNION SELECT t, t FROM ed),
reach AS (SELECT s AS node, t AS other FROM sy UNION SELECT r.node, y.t FROM reach r JOIN sy y ON y.s = r.other),
comp AS (SELECT node AS video_id, min(other) AS component FROM reach GROUP BY 1),
csize AS (SELECT component, count(*) AS n_rows, count(DISTINCT video_id) AS n_videos FROM ann JOIN comp USING (video_id) GROUP BY 1),
cord AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, sha256('2026:split:component:' || component), component) AS place FROM csize)
"""
DEAL = (
    COMP
    + """,
tt AS (SELECT sum(n_rows) AS total FROM csize),
fold AS (SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS component, CAST(0 AS BIGINT) AS n_rows, CAST('' AS VARCHAR) AS split, CAST(0 AS BIGINT) AS c1, CAST(0 AS BIGINT) AS c2, CAST(0 AS BIGINT) AS c3
  UNION ALL SELECT place, component, n_rows, split, c1 + CASE WHEN split = 'train' THEN n_rows ELSE 0 END, c2 + CASE WHEN split = 'dev' THEN n_rows ELSE 0 END, c3 + CASE WHEN split = 'report' THEN n_rows ELSE 0 END
  FROM (SELECT cord.place, cord.component, cord.n_rows, c1, c2, c3, (SELECT s FROM (VALUES
      ('train', 0, c1, (total * CAST(0.8 AS DOUBLE) - c1) / (total * CAST(0.8 AS DOUBLE))), ('dev', 1, c2, (total * CAST(0.1 AS DOUBLE) - c2) / (total * CAST(0.1 AS DOUBLE))), ('report', 2, c3, (total * CAST(0.1 AS DOUBLE) - c3) / (total * CAST(0.1 AS DOUBLE)))) v(s, k, c, d)
      ORDER BY d DESC, c, k LIMIT 1) AS split FROM fold JOIN cord ON cord.place = fold.place + 1 CROSS JOIN tt) x),
dealt AS (SELECT component, n_rows, split FROM fold WHERE place > 0),
sv AS (SELECT video_id, split FROM comp JOIN dealt USING (component)),
asp AS (SELECT an.*, split FROM an JOIN sv USING (video_id)),
pr AS (SELECT x.*, y.split AS hard_split, y.bucket AS hard_bucket, y.video_id AS hard_video, y.action AS hard_action, y.scene AS hard_scene,
  CASE WHEN y.split IS NULL OR x.hard_id = x.image_id THEN 'missing_target' WHEN x.split <> 'train' OR y.split <> 'train' THEN 'outside_train'
    WHEN coalesce(x.key, '') = '' OR coalesce(x.hard_key, '') = '' THEN 'empty_text' WHEN x.key = x.hard_key THEN 'same_text' END AS reason,
  CASE WHEN (x.bucket = 'goal' AND y.bucket IN ('full', 'wentwrong')) OR (y.bucket = 'goal' AND x.bucket IN ('full', 'wentwrong')) THEN 5.0 ELSE 0.0 END::DOUBLE
    + CASE WHEN x.video_id = y.video_id THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN x.action IS DISTINCT FROM y.action THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN x.scene = y.scene THEN 1.5 ELSE 0.0 END::DOUBLE AS hardness
  FROM asp x LEFT JOIN asp y ON y.image_id = x.hard_id)
"""
)
QUOTA = """,
qb(bucket, ord, ratio) AS (VALUES ('goal', 0, CAST(0.37109 AS DOUBLE)), ('full', 1, CAST(0.34398 AS DOUBLE)), ('wentwrong', 2, CAST(0.28493 AS DOUBLE))),
qx AS (SELECT n, bucket, ord, n * ratio AS exact, CAST(floor(n * ratio) AS BIGINT) AS whole FROM (SELECT unnest([7, 20, 40, 80, 100, 1000, 2000, 5000, 10000, 30000, 50000]) AS n), qb),
quota AS (SELECT n, bucket, ord, whole + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY exact - whole DESC, ord) <= n - sum(whole) OVER (PARTITION BY n) THEN 1 ELSE 0 END AS quota FROM qx)
"""
EVAL = (
    DEAL
    + QUOTA
    + """,
dev AS (SELECT *, sha256('2026:dev:query:' || image_id) AS h, sha256('2026:dev:gallery:' || image_id) AS gh FROM asp WHERE split = 'dev'),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY h, image_id) AS r FROM dev WHERE key <> '') WHERE r = 1),
q1 AS (SELECT image_id, bucket, h, key FROM uniq WHERE bucket = 'goal' ORDER BY h, image_id LIMIT 7),
q2 AS (SELECT image_id, bucket, h, key FROM uniq WHERE bucket = 'full' AND key NOT IN (SELECT key FROM q1) ORDER BY h, image_id LIMIT 7),
q3 AS (SELECT image_id, bucket, h, key FROM uniq WHERE bucket = 'wentwrong' AND key NOT IN (SELECT key FROM q1 UNION ALL SELECT key FROM q2) ORDER BY h, image_id LIMIT 6),
eq AS (FROM q1 UNION ALL FROM q2 UNION ALL FROM q3),
pool AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY gh, image_id) AS r FROM dev WHERE image_id NOT IN (SELECT image_id FROM eq)),
gal AS (SELECT image_id, bucket, true AS is_query FROM eq UNION ALL SELECT image_id, bucket, false FROM pool JOIN (SELECT bucket, quota FROM quota WHERE n = 40) q USING (bucket)
  WHERE r <= quota - (SELECT count(*) FROM eq WHERE eq.bucket = pool.bucket))
"""
)
MAN = (
    DEAL
    + """,
sel AS (SELECT * FROM pr WHERE reason IS NULL),
mt AS (SELECT image_id, hard_id AS pair_image_id, caption, key, video_id, bucket, label, label_type, scene, action, split, false AS is_hard_target, image FROM sel
  UNION ALL SELECT image_id, NULL, caption, key, video_id, bucket, label, label_type, scene, action, split, true, image FROM asp WHERE image_id IN (SELECT hard_id FROM sel) AND image_id NOT IN (SELECT image_id FROM sel)),
ma AS (FROM mt UNION ALL SELECT image_id, NULL, caption, key, video_id, bucket, label, label_type, scene, action, split, false, image FROM asp WHERE split <> 'train')
"""
)
HARD = """,
he AS (SELECT p.*, concat_ws(',', CASE WHEN video_id = hard_video THEN 'same_video' END, CASE WHEN bucket <> hard_bucket THEN 'cross_bucket' END, CASE WHEN action IS DISTINCT FROM hard_action THEN 'action_changed' END, CASE WHEN scene = hard_scene THEN 'same_scene' END) AS relation
  FROM pr p WHERE reason IS NULL AND hard_id IN (SELECT image_id FROM pr WHERE reason IS NULL))
"""
TASK = r""",
tk AS (SELECT image_id, label_type, label, action, field, original FROM (SELECT image_id, label_type, label, action, unnest(['caption', 'hard_c']) AS field, unnest([caption, hard_c]) AS original FROM a)
  WHERE coalesce(label, '') <> '' AND trim(coalesce(original, '')) <> '' AND NOT (field = 'hard_c' AND image_id % 4 = 0))
"""
GATE = r""",
gen AS (SELECT image_id, caption AS original, label_type, CASE image_id % 6 WHEN 0 THEN caption WHEN 1 THEN 'Caption: ' || caption WHEN 2 THEN '**' || caption || '**' WHEN 3 THEN substr(caption, 1, length(caption) // 2) WHEN 4 THEN '' ELSE '"' || caption || '"' END AS raw FROM a),
cl AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '(?i)^\s*(?:(?:enhanced|rewritten|revised)\s+)?caption\s*:\s*', ''), '^(?:\*\*|__)(.*)(?:\*\*|__)$', '\1'), '\*\*|__|\*', '', 'g'), '^`+|`+$', '', 'g'), '^"(.*)"$', '\1'), '^''(.*)''$', '\1'), '\s+', ' ', 'g')) AS clean,
  len(regexp_extract_all(lower(original), '[a-z0-9]+')) AS n, len(regexp_extract_all(lower(raw), '[a-z0-9]+')) AS nr FROM gen),
gt AS (SELECT *, len(regexp_extract_all(lower(clean), '[a-z0-9]+')) AS m, regexp_matches(raw, '\*\*|__|`|^#{1,6}\s|^\s*[-*]\s') AS raw_md, regexp_matches(clean, '\*\*|__|`|^#{1,6}\s|^\s*[-*]\s') AS clean_md FROM cl),
gb AS (SELECT *, trim(clean) = '' OR clean_md OR (n > 0 AND NOT (m / n BETWEEN 0.75 AND 1.35)) AS bad FROM gt)
"""
BOX = """
WITH cb AS (SELECT l_orderkey AS image_id, l_linenumber AS line, greatest(0, least(1, (l_quantity - 1) / 100)) AS x1, greatest(0, least(1, l_discount * 5)) AS y1,
  greatest(0, least(1, (l_quantity - 1) / 100 + CAST(0.02 AS DOUBLE) + l_tax * 5)) AS x2, greatest(0, least(1, l_discount * 5 + CAST(0.4 AS DOUBLE))) AS y2, l_extendedprice / 105000 AS score FROM lineitem),
bw AS (SELECT *, score * greatest(greatest(0, x2 - x1) * greatest(0, y2 - y1), 1e-8) AS weight FROM cb WHERE score >= CAST(0.2 AS DOUBLE)),
st AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey IN (SELECT image_id FROM bw) THEN 'ok' ELSE 'no_person' END AS status FROM orders)
"""
_H = "sha256('2026:{s}:{p}:' || {k})"
def _pairs_sql(k: int) -> str:
    """Plans of batches of k pairs; {e} stands for the epoch."""
    return MAN + """,
rp AS (SELECT image_id AS a, hard_id AS b, video_id AS grp FROM sel),
pb AS (SELECT *, sha256('2026:{e}:pair:' || a || '-' || b) AS h, sha256('2026:{e}:group:' || grp) AS gh FROM rp),
pl AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h, a, b) AS turn FROM pb),
pz AS (SELECT grp, count(*) AS size FROM pb GROUP BY 1),
pf AS (SELECT coalesce(max(n), 0) AS full_n FROM (SELECT n FROM (SELECT unnest(range(0, (SELECT count(*) // {k} + 1 FROM pb))) AS n), pz GROUP BY n HAVING sum(least(size, n)) >= n * {k})),
pk AS (SELECT *, row_number() OVER (ORDER BY gh, grp, turn) - 1 AS place FROM pl, pf WHERE turn <= full_n),
plan AS (SELECT {e} AS epoch, place % full_n AS batch, place // full_n AS slot, a, b, grp FROM pk WHERE place < full_n * {k}),
up AS (SELECT epoch, batch, slot * 2 AS pos, a AS row_id, slot * 2 + 1 AS partner_pos FROM plan UNION ALL SELECT epoch, batch, slot * 2 + 1, b, slot * 2 FROM plan)
""".replace("{k}", str(k))


P0, P1 = (_pairs_sql(8).replace("{e}", e) for e in "01")


def _u(*parts: str) -> str:
    return f"(CAST('0x' || substr(sha256('2026:' || {' || chr(58) || '.join(parts)}), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE))"


_FAMILIES = {"blur": 0.3, "jpeg": 0.3, "scale": 0.2, "jitter": 0.4, "noise": 0.2, "erase": 0.25}
AUGMENT = (
    "WITH d AS (SELECT doc_id AS row_id FROM documents), f AS ("
    + " UNION ALL ".join(
        f"SELECT row_id, {_u(repr(n), repr('order'), 'row_id')} AS o, '{n}' AS name, {_u(repr(n), repr('strength'), 'row_id')} AS s FROM d WHERE {_u(repr(n), repr('on'), 'row_id')} < CAST({p} AS DOUBLE)" for n, p in _FAMILIES.items()
    )
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY o) AS k FROM f) SELECT d.row_id, coalesce(string_agg(name || '=' || printf('%.6f', round(s, 6)), ',' ORDER BY k), '') AS spec FROM d LEFT JOIN r ON r.row_id = d.row_id AND k <= 2 GROUP BY 1"
)

SQL = {
    "components": ANN + COMP + "SELECT video_id, component FROM comp",
    "component_sizes": ANN + COMP + "SELECT component, n_rows, n_videos FROM csize",
    "split_assign": ANN + DEAL + "SELECT component, n_rows, split FROM dealt",
    "split_summary": ANN + DEAL + "SELECT split, sum(d.n_rows)::BIGINT AS n_rows, sum(n_videos)::BIGINT AS n_videos, count(*) AS n_components, max(d.n_rows) AS largest, round(sum(d.n_rows) / sum(sum(d.n_rows)) OVER (), 6) AS share FROM dealt d JOIN csize USING (component) GROUP BY split",
    "split_leakage": ANN + DEAL + "SELECT count(*) AS leaks FROM asp x JOIN asp y ON y.image_id = x.hard_id WHERE x.split <> y.split",
    "ordered_components": ANN + COMP + "SELECT component, n_rows, place FROM cord",
    "quota_apportion": """WITH one AS (SELECT coalesce(source, '') AS "of", count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT CAST(doc_id // 97 AS VARCHAR), count(*) * 7 + min(doc_id) % 11 FROM documents GROUP BY 1),
x AS (SELECT one.*, bucket, ord, n * ratio AS exact, CAST(floor(n * ratio) AS BIGINT) AS whole FROM one, (VALUES ('goal', 0, CAST(0.37109 AS DOUBLE)), ('full', 1, CAST(0.34398 AS DOUBLE)), ('wentwrong', 2, CAST(0.28493 AS DOUBLE))) b(bucket, ord, ratio))
SELECT "of", n, bucket, CAST(whole + CASE WHEN row_number() OVER (PARTITION BY "of" ORDER BY exact - whole DESC, ord) <= n - sum(whole) OVER (PARTITION BY "of") THEN 1 ELSE 0 END AS BIGINT) AS quota FROM x""",
    "reject_reasons": ANN + DEAL + "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM pr GROUP BY 1",
    "nested_subset": ANN + DEAL + QUOTA + """,
el AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY hardness DESC, of_label, sha256('2026:train:order:' || image_id), image_id) AS nth FROM (SELECT *, count(*) OVER (PARTITION BY bucket, label) AS of_label FROM pr WHERE reason IS NULL)),
bl AS (SELECT """ + ", ".join(f"[{', '.join(f'list({c} ORDER BY nth) FILTER (bucket = {b!r})' for b in ('goal', 'full', 'wentwrong'))}] AS {n}" for c, n in (("image_id", "ids"), ("key", "ks"), ("hard_key", "hs"))) + """ FROM el),
ph AS (SELECT row_number() OVER (ORDER BY n, ord) AS i, ord + 1 AS b, quota AS upto, n FROM quota WHERE n IN (20, 40, 80)),
walk AS (SELECT CAST(0 AS BIGINT) AS step, CAST(1 AS BIGINT) AS i, CAST([1, 1, 1] AS BIGINT[]) AS ptr, CAST([0, 0, 0] AS BIGINT[]) AS have, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS got, CAST([] AS BIGINT[]) AS since
  UNION ALL SELECT step + 1, CASE WHEN full_b THEN i + 1 ELSE i END, CASE WHEN full_b THEN ptr ELSE list_transform([1, 2, 3], lambda x: ptr[x] + CASE WHEN x = b THEN 1 ELSE 0 END) END,
    CASE WHEN full_b OR clash THEN have ELSE list_transform([1, 2, 3], lambda x: have[x] + CASE WHEN x = b THEN 1 ELSE 0 END) END, CASE WHEN full_b OR clash THEN used ELSE list_concat(used, [k, h]) END,
    CASE WHEN full_b OR clash THEN got ELSE list_append(got, id) END, CASE WHEN full_b OR clash THEN since ELSE list_append(since, n) END
  FROM (SELECT *, list_contains(used, k) OR list_contains(used, h) AS clash FROM (SELECT walk.*, ph.b, ph.n, have[ph.b] >= upto AS full_b, ids[ph.b][ptr[ph.b]] AS id, ks[ph.b][ptr[ph.b]] AS k, hs[ph.b][ptr[ph.b]] AS h FROM walk JOIN ph ON ph.i = walk.i CROSS JOIN bl))),
fin AS (SELECT unnest(got) AS image_id, unnest(since) AS n FROM (SELECT * FROM walk ORDER BY step DESC LIMIT 1))
SELECT CAST(s.n AS BIGINT) AS size, image_id FROM fin JOIN (SELECT DISTINCT n FROM ph) s ON s.n >= fin.n""",
    "reject_cases": ANN + DEAL + """, k AS (SELECT *, CASE WHEN image_id % 11 = 0 THEN '' ELSE key END AS k1 FROM pr), k2 AS (SELECT *, CASE WHEN image_id % 7 = 0 THEN k1 ELSE hard_key END AS h1 FROM k)
SELECT bucket, CASE WHEN hard_split IS NULL OR image_id % 13 = 0 OR hard_id = image_id THEN 'missing_target' WHEN split <> 'train' OR hard_split <> 'train' THEN 'outside_train' WHEN coalesce(k1, '') = '' OR coalesce(h1, '') = '' THEN 'empty_text' WHEN k1 = h1 THEN 'same_text' ELSE 'ok' END AS reason, count(*) AS n FROM k2 GROUP BY 1, 2""",
    "hard_score_order": ANN + DEAL + "SELECT image_id, bucket, hardness, row_number() OVER (PARTITION BY bucket ORDER BY hardness DESC, of_label, sha256('2026:train:order:' || image_id), image_id)::INT AS ord FROM (SELECT *, count(*) OVER (PARTITION BY bucket, label) AS of_label FROM pr)",
    "rare_label_boost": ANN + "SELECT bucket, label, count(*) AS n, round(pow(count(*), -0.25), 6) AS rarity FROM ann GROUP BY 1, 2",
    "eval_queries": ANN + EVAL + "SELECT image_id, bucket, h FROM eq",
    "eval_gallery": ANN + EVAL + "SELECT image_id, bucket, is_query FROM gal",
    "gallery_pool": ANN + EVAL + "SELECT bucket, count(*) AS n FROM pool GROUP BY 1",
    "suite_sorted": ANN + EVAL + "SELECT row_number() OVER (ORDER BY image_id) AS place, image_id, is_query FROM gal",
    "stable_hash_order": ANN + "SELECT * FROM (SELECT image_id, bucket, sha256('2026:train:pick:' || image_id) AS h, row_number() OVER (PARTITION BY bucket ORDER BY sha256('2026:train:pick:' || image_id), image_id)::INT AS place FROM ann) WHERE place <= 10",
    "hard_edges": ANN + DEAL + HARD + "SELECT image_id || '->' || hard_id AS edge_id, image_id, hard_id, bucket, hard_bucket, video_id, relation FROM he",
    "edge_degree": ANN + DEAL + HARD + "SELECT image_id, count(*) AS degree FROM (SELECT image_id FROM he UNION ALL SELECT hard_id FROM he) GROUP BY 1",
    "manifest_train": ANN + MAN + r"SELECT image_id, coalesce(pair_image_id, -1) AS pair_image_id, 'images/' || regexp_replace(regexp_replace(replace(image, '\', '/'), '^train/', ''), '\.[^./]+$', '.webp') AS image_path, coalesce(nullif(trim(caption), ''), '') AS caption, 'v' || video_id || '_' || bucket AS sequence_id, label, label_type, bucket, scene, action, split, is_hard_target FROM mt",
    "manifest_all": ANN + MAN + "SELECT split, is_hard_target, bucket, count(*) AS n, count(DISTINCT video_id) AS videos FROM ma GROUP BY 1, 2, 3",
    "eval_caption_demote": ANN + MAN + "SELECT image_id, split, CASE WHEN r > 1 THEN '' ELSE key END AS key, r > 1 AS demoted FROM (SELECT *, row_number() OVER (PARTITION BY split, key ORDER BY image_id) AS r FROM ma WHERE split <> 'train')",
    "manifest_joins": ANN + MAN + ", b AS (SELECT l_orderkey AS image_id, count(*) AS n_boxes, round(max(l_extendedprice / 105000), 6) AS best FROM lineitem GROUP BY 1) SELECT image_id, split, is_hard_target, coalesce(n_boxes, 0) AS n_boxes, coalesce(best, 0) AS best, CASE WHEN n_boxes IS NULL THEN 'missing' ELSE 'ok' END AS bbox_status FROM mt LEFT JOIN b USING (image_id)",
    "pair_index": ANN + MAN + ", r AS (SELECT *, row_number() OVER (ORDER BY image_id) - 1 AS row FROM mt) SELECT x.row, y.row AS partner, x.video_id FROM r x JOIN r y ON y.image_id = x.pair_image_id WHERE x.row <> y.row",
    "label_counts": ANN + "SELECT bucket, label_type, action, count(*) AS n FROM ann GROUP BY 1, 2, 3",
    "label_counts_topn": ANN + "SELECT label, count(*) AS n FROM ann GROUP BY 1 ORDER BY n DESC, label LIMIT 20",
    "caption_distinct": ANN + "SELECT bucket, count(*) AS n, count(DISTINCT key) AS distinct_keys, count(*) - count(DISTINCT key) AS surplus FROM an GROUP BY 1",
    "dup_id_guard": "SELECT doc_id AS image_id, 2::BIGINT AS n FROM documents WHERE doc_id % 97 = 0",
    "missing_id_guard": "SELECT doc_id + (SELECT max(doc_id) FROM documents) + 1 AS image_id FROM documents WHERE doc_id % 50 = 0",
    "instance_codes": "SELECT doc_id AS image_id, source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS code FROM documents",
    "first_occurrence_dedupe": ANN + "SELECT min(image_id) AS image_id FROM an GROUP BY key",
    "chunk_partition": "SELECT CAST(doc_id // 50 AS INT) AS chunk, count(*) AS n FROM documents GROUP BY 1",
    "shard_sizes": "SELECT shard, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS shard FROM documents) GROUP BY 1",
    "stride_sample": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, greatest(1, count(*) OVER () // 64) AS stride FROM documents) SELECT doc_id AS image_id FROM r WHERE k % stride = 0 AND k // stride < 64",
    "asset_union": ANN + ", u AS (SELECT image AS path, image_id, 'anchor' AS role FROM ann UNION ALL SELECT y.image, y.image_id, 'target' FROM ann x JOIN ann y ON y.image_id = x.hard_id) SELECT path, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, min(image_id) AS image_id FROM u GROUP BY 1",
    "text_key": ANN + "SELECT image_id, md5(key) AS key_md5 FROM an",
    "caption_hash": "SELECT doc_id AS image_id, CAST('0x' || substr(sha256(lower(trim(text))), 1, 15) AS BIGINT) AS hash FROM documents",
    "long_caption_rate": ANN + r"SELECT bucket, round(avg((len(list_filter(regexp_split_to_array(caption, '\s+'), lambda w: w <> '')) > 72)::INT), 6) AS rate FROM ann GROUP BY 1",
    "label_bucket_path": ANN + r"SELECT image_id, CASE WHEN label_type = 'anomaly' THEN 'anomaly' WHEN image_id % 3 <> 0 THEN 'normal' ELSE 'unknown' END AS label_type, CASE WHEN label_type = 'anomaly' OR image_id % 3 <> 0 THEN label ELSE '' END AS label, bucket, 'root/imgs_' || (image_id // 50) || '/' || bucket || '/' || image_id || '.webp' AS path, 'v' || video_id || '_' || bucket AS sequence_id FROM ann",
    "path_rules": r"""SELECT doc_id AS image_id,
  CASE doc_id % 6 WHEN 0 THEN '/root/data/train_webp/a/' || doc_id || '.jpg' WHEN 1 THEN '/root/data/train_webp/b/' || doc_id || '.jpg' WHEN 2 THEN '/img/imgs_3/full/' || doc_id || '.jpg'
    WHEN 3 THEN '/img/imgs_1/goal/' || doc_id || '.webp' WHEN 4 THEN '/abs/x/train_webp/c/' || doc_id || '.jpg' ELSE '/root/data/other/d/' || doc_id || '.jpg' END AS source,
  'train_webp/' || CASE doc_id % 6 WHEN 0 THEN 'a/' || doc_id || '.jpg' WHEN 1 THEN 'b/' || doc_id || '.jpg' WHEN 2 THEN 'imgs_3/full/' || doc_id || '.jpg'
    WHEN 3 THEN 'imgs_1/goal/' || doc_id || '.webp' WHEN 4 THEN 'c/' || doc_id || '.jpg' ELSE doc_id || '.jpg' END AS output FROM documents""",
    "caption_coalesce": "SELECT doc_id AS image_id, md5(CASE WHEN doc_id % 3 = 1 THEN 'x' || doc_id ELSE coalesce(nullif(trim(text), ''), '') END) AS caption_md5 FROM documents",
    "manifest_scan": ANN + DEAL + "SELECT image_id, video_id, split FROM asp WHERE split = 'report'",
    "split_filter": ANN + DEAL + "SELECT image_id, video_id, split FROM asp WHERE split = 'report'",
    "query_filter": "SELECT doc_id AS image_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND trim(coalesce(text, '')) <> ''",
    "cache_and_task_keys": ANN + """SELECT image_id, image_id || ':' || lpad(lower(hex(CAST('0x' || substr(sha256(lower(trim(caption))), 1, 15) AS BIGINT))), 16, '0') AS cache_key, sha256('{"field":"caption","row":' || image_id || ',"type":"' || label_type || '"}') AS task_key FROM ann""",
    "caption_tasks": ANN + TASK + "SELECT image_id, field, label_type, length(original)::INT AS n FROM tk",
    "selected_tasks": ANN + TASK + "SELECT image_id, field FROM tk WHERE label_type = 'anomaly'",
    "limited_tasks": ANN + TASK + "SELECT image_id, field FROM tk ORDER BY image_id, field LIMIT 25",
    "prompt_render": ANN + TASK + "SELECT image_id, field, md5('Rewrite the caption. Label: ' || label_type || '. Action: ' || action || '. Source: ' || label || '. Caption: ' || original) AS prompt_md5 FROM tk",
    "caption_gate": ANN + GATE + "SELECT image_id, nr::INT AS n_tokens, bad, md5(clean) AS clean_md5, md5(CASE WHEN trim(raw) = '' OR raw_md OR (label_type = 'anomaly' AND bad) OR clean = '' THEN original ELSE clean END) AS final_md5 FROM gb",
    "progress_replay": "SELECT doc_id AS image_id, CASE WHEN doc_id % 10 = 0 THEN 'second' ELSE 'pending' END AS state FROM documents",
    "box_primary_union": BOX
    + """, pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, score, x1, y1, x2, y2) AS r FROM bw) WHERE r = 1),
u AS (SELECT image_id, min(x1) AS u1, min(y1) AS u2, max(x2) AS u3, max(y2) AS u4, count(*) AS n FROM bw GROUP BY 1),
j AS (SELECT *, (u3 - u1) * (u4 - u2) > CAST(0.85 AS DOUBLE) AS wide FROM u JOIN pb USING (image_id))
SELECT image_id, n, round(x1, 6) AS p_x1, round(y1, 6) AS p_y1, round(x2, 6) AS p_x2, round(y2, 6) AS p_y2, round(CASE WHEN wide THEN x1 ELSE u1 END, 6) AS u_x1, round(CASE WHEN wide THEN y1 ELSE u2 END, 6) AS u_y1,
  round(CASE WHEN wide THEN x2 ELSE u3 END, 6) AS u_x2, round(CASE WHEN wide THEN y2 ELSE u4 END, 6) AS u_y2 FROM j""",
    "box_coverage": BOX + "SELECT count(*) AS total, round(avg((status = 'ok')::INT), 6) AS coverage, avg((status = 'ok')::INT) < 0.97 AS warn FROM st",
    "pending_assets": BOX + "SELECT image_id FROM st WHERE NOT (image_id % 3 = 0 AND status = 'ok')",
    "fallback_assets": BOX + "SELECT image_id FROM st WHERE status = 'no_person'",
    "bbox_xywh": BOX + ", d AS (SELECT DISTINCT image_id, line, x1, y1, x2, y2 FROM cb) SELECT image_id, line, round(x1, 6) AS b0, round(y1, 6) AS b1, round(greatest(x2 - x1, 1e-6), 6) AS b2, round(greatest(y2 - y1, 1e-6), 6) AS b3 FROM d",
    "bbox_expand": BOX
    + ", d AS (SELECT DISTINCT image_id, line, x1, y1, greatest(x2 - x1, 1e-6) AS w, greatest(y2 - y1, 1e-6) AS h FROM (SELECT DISTINCT image_id, line, x1, y1, x2, y2 FROM cb)) SELECT image_id, line, round(greatest(0, least(1, x1 - w * 0.125)), 6) AS b0, round(greatest(0, least(1, y1 - h * 0.125)), 6) AS b1, round(greatest(0, least(1, x1 + w * 1.125)), 6) AS b2, round(greatest(0, least(1, y1 + h * 1.125)), 6) AS b3 FROM d",
    "box_normalise": """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 1.0 ELSE 200.0 END::DOUBLE AS hh FROM lineitem),
b AS (SELECT *, greatest(0, least(1, (l_quantity - 10) / 100)) AS x1, greatest(0, least(1, l_quantity / hh)) AS y1, greatest(0, least(1, l_quantity * 3 / 100)) AS x2, greatest(0, least(1, l_quantity * 5 / hh)) AS y2 FROM d)
SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey, round(x1, 6) AS b0, round(y1, 6) AS b1, round(x2, 6) AS b2, round(y2, 6) AS b3, round(greatest(0, x2 - x1) * greatest(0, y2 - y1), 6) AS area FROM b""",
    "parse_list_cell": "SELECT vec_id, CASE WHEN vec_id % 5 IN (0, 4) THEN floor(CAST(embedding[1] AS DOUBLE) * 1000) END AS a, CASE WHEN vec_id % 5 IN (0, 4) THEN floor(CAST(embedding[4] AS DOUBLE) * 1000) END AS d FROM embeddings",
    "keypoints_flat": """WITH k AS (SELECT vec_id, vec_id % 5 <> 4 AND vec_id % 7 <> 5 AS ok, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CASE WHEN vec_id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE 100 END AS w FROM embeddings)
SELECT vec_id, CASE WHEN ok THEN 51 ELSE -1 END AS n, CASE WHEN ok THEN round(list_sum(list_transform(range(17), lambda i: e[3 * i + 1] / w + e[3 * i + 2] / 50 + e[3 * i + 3])), 6) END AS total FROM k""",
    "tokenizer": r"""WITH t AS (SELECT doc_id AS image_id, list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:98], lambda w: CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 30517 + 5) AS ids FROM documents),
p AS (SELECT image_id, list_concat([1], ids, [2]) AS ids FROM t)
SELECT image_id, array_to_string(list_concat(ids, list_transform(range(100 - len(ids)), lambda x: 0)), ' ') AS ids, repeat('1', len(ids)) || repeat('0', 100 - len(ids)) AS mask FROM p""",
    "table_fingerprint": ANN + """, r AS (SELECT sha256(concat_ws(chr(31), coalesce(action, chr(30)), coalesce(bucket, chr(30)), coalesce(caption, chr(30)), coalesce(hard_c, chr(30)), coalesce(hard_id::VARCHAR, chr(30)), coalesce(image, chr(30)), coalesce(image_id::VARCHAR, chr(30)), coalesce(label, chr(30)), coalesce(label_type, chr(30)), coalesce(scene::VARCHAR, chr(30)), coalesce(video_id::VARCHAR, chr(30)))) AS h FROM a)
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS first, CAST(sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS second FROM r""",
    "mixed_batches": ANN + _pairs_sql(4).replace("{e}", "0") + """, od AS (SELECT image_id AS row_id, row_number() OVER (ORDER BY sha256('2026:0:filler:' || image_id)) - 1 AS nth FROM ann),
ks AS (SELECT batch, k, (batch * 16 + k) % (SELECT count(*) FROM ann) AS nth FROM (SELECT DISTINCT batch FROM up), (SELECT unnest(range(16)) AS k)),
sp AS (SELECT ks.batch, row_id, row_number() OVER (PARTITION BY ks.batch ORDER BY k) AS r FROM ks JOIN od USING (nth) WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.batch = ks.batch AND up.row_id = od.row_id))
SELECT epoch, batch, pos, row_id FROM up UNION ALL SELECT 0, batch, r - 1 + 8, row_id FROM sp WHERE r <= 8""",
    "grouped_batches": """WITH gs AS (SELECT source AS grp, count(*) AS size, least(8, count(*)) AS m, row_number() OVER (ORDER BY source) - 1 AS gi FROM documents WHERE source IS NOT NULL GROUP BY 1),
bt AS (SELECT b, gs.*, row_number() OVER (PARTITION BY gi ORDER BY b) - 1 AS v FROM (SELECT unnest(range((SELECT count(*) // 16 FROM documents))) AS b) JOIN gs ON gi = CAST('0x' || substr(sha256('2026:0:pick:' || b), 1, 12) AS BIGINT) % (SELECT count(*) FROM gs)),
vs AS (SELECT *, v // (size // m) AS lap, v % (size // m) AS turn FROM bt),
lp AS (SELECT l.grp, l.lap, m, doc_id AS row_id, row_number() OVER (PARTITION BY l.grp, l.lap ORDER BY sha256('2026:0:lap:' || l.grp || '-' || l.lap || '-' || doc_id), doc_id) - 1 AS p FROM (SELECT DISTINCT grp, lap, m FROM vs) l JOIN documents ON source = l.grp),
od AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY sha256('2026:0:fill:' || doc_id), doc_id) - 1 AS nth FROM documents)
SELECT 0 AS epoch, b AS batch, p % lp.m AS pos, row_id FROM lp JOIN vs ON vs.grp = lp.grp AND vs.lap = lp.lap AND vs.turn = p // lp.m
UNION ALL SELECT 0, b, nth % 16 + m, row_id FROM od JOIN vs ON b = nth // 16 WHERE nth % 16 < 16 - m""",
    "pair_batches": ANN + P0 + "SELECT epoch, batch, slot, a, b, grp FROM plan",
    "partner_index": ANN + P0 + "SELECT epoch, batch, pos, row_id, partner_pos FROM up",
    "itm_pairs_explicit": ANN + P0 + "SELECT batch, pos AS i, pos AS j, 1 AS label FROM up UNION ALL SELECT batch, pos, partner_pos, 0 FROM up UNION ALL SELECT batch, partner_pos, pos, 0 FROM up",
    "epoch_reshuffle": ANN + P1 + "SELECT epoch, batch, slot, a FROM plan",
    "augment_spec": AUGMENT,
}
