"""SQL of the queries that SQL can express."""

P1_SQL = """
WITH RECURSIVE rec AS (
  SELECT match_id || '/' || chunk AS seq, track_id FROM fragments WHERE track_id IS NOT NULL AND match_id IS NOT NULL AND chunk IS NOT NULL
  UNION SELECT seq, track_id FROM queue_items WHERE seq IS NOT NULL AND track_id IS NOT NULL),
e AS (
  SELECT DISTINCT seq_a, track_a, seq_b, track_b FROM relink_pairs p
  WHERE verdict = 'same' AND (seq_a <> seq_b OR track_a <> track_b)
    AND EXISTS (SELECT 1 FROM rec r WHERE r.seq = p.seq_a AND r.track_id = p.track_a)
    AND EXISTS (SELECT 1 FROM rec r WHERE r.seq = p.seq_b AND r.track_id = p.track_b)),
b AS (SELECT seq_a AS s, track_a AS t, seq_b AS s2, track_b AS t2 FROM e UNION SELECT seq_b, track_b, seq_a, track_a FROM e),
w AS (SELECT DISTINCT s, t, s AS ws, t AS wt FROM b UNION SELECT b.s2, b.t2, w.ws, w.wt FROM w JOIN b ON b.s = w.s AND b.t = w.t),
m AS (SELECT s, t, min({'s': ws, 't': wt}) AS g FROM w GROUP BY s, t)
SELECT s AS seq, t AS track_id, g.s AS group_seq, g.t AS group_track_id FROM m
"""

P2_SQL = """
WITH l AS (SELECT DISTINCT label_id, match_id, chunk, frame FROM carrier_labels WHERE frame IS NOT NULL),
c AS (SELECT DISTINCT click_id, match_id, chunk, frame FROM ball_clicks WHERE frame IS NOT NULL),
j AS (SELECT label_id, click_id, row_number() OVER (PARTITION BY label_id ORDER BY abs(c.frame - l.frame), c.frame, click_id) AS k
  FROM l JOIN c ON c.match_id = l.match_id AND c.chunk = l.chunk AND c.frame BETWEEN l.frame - 12 AND l.frame + 12)
SELECT label_id, click_id FROM j WHERE k = 1
"""

SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL}
