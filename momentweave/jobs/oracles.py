"""Independent SQL of the registered queries. Common table expressions rebuild the input tables of jobs.views."""

from __future__ import annotations

WORDS = r"""
split AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
word_rows AS (SELECT doc_id AS video_id, unnest(range(len(ws)))::INT AS word_idx, unnest(ws) AS word FROM split),
words AS MATERIALIZED (
  SELECT video_id, word_idx, word,
         ((sum(1000 + 200 * length(word)) OVER w)::BIGINT - 1000 - 200 * length(word))::DOUBLE / 1000 AS start,
         (sum(1000 + 200 * length(word)) OVER w)::DOUBLE / 1000 AS "end"
  FROM word_rows WINDOW w AS (PARTITION BY video_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING))"""

SEGMENTS = (
    WORDS
    + r""",
ends AS MATERIALIZED (SELECT video_id, word_idx FROM words WHERE right(word, 1) IN ('.', '!', '?')),
lengths AS (SELECT video_id, max(word_idx) + 1 AS n FROM words GROUP BY 1),
starts AS (SELECT video_id, 0 AS pos FROM lengths UNION SELECT video_id, word_idx + 1 FROM ends),
steps AS MATERIALIZED (
  SELECT s.video_id, s.pos, e.word_idx AS until FROM starts s ASOF JOIN ends e ON s.video_id = e.video_id AND s.pos + 4 <= e.word_idx),
chain AS (
  SELECT video_id, 0 AS segment_id, pos, until FROM steps WHERE pos = 0
  UNION ALL
  SELECT s.video_id, c.segment_id + 1, s.pos, s.until FROM chain c JOIN steps s ON s.video_id = c.video_id AND s.pos = c.until + 1),
last AS (SELECT video_id, max(segment_id) AS k, max(until) AS u FROM chain GROUP BY 1),
bounds AS MATERIALIZED (
  SELECT * FROM chain
  UNION ALL
  SELECT l.video_id, coalesce(k + 1, 0), coalesce(u + 1, 0), n - 1 FROM lengths l LEFT JOIN last USING (video_id) WHERE n - coalesce(u + 1, 0) >= 3),
opened AS MATERIALIZED (SELECT b.*, a.start AS start_time FROM bounds b JOIN words a ON a.video_id = b.video_id AND a.word_idx = b.pos),
segments AS MATERIALIZED (
  SELECT b.video_id, b.segment_id, b.segment_id AS idx, b.start_time, z."end" AS end_time, b.pos AS word_from, b.until AS word_to,
         ['hook', 'story', 'question', 'setup', 'payoff', 'conclusion', 'revelation', 'advice'][(b.video_id * 7 + b.segment_id) % 8 + 1] AS segment_type,
         b.segment_id % 2 = 0 AS is_complete, ((b.video_id * 31 + b.segment_id * 17) % 101)::DOUBLE AS score
  FROM opened b JOIN words z ON z.video_id = b.video_id AND z.word_idx = b.until)"""
)

ENERGY = """
energy AS MATERIALIZED (
  SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_idx,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE / 10 AS time_sec, value AS energy
  FROM events)"""

COMBOS = (
    SEGMENTS
    + """,
combos AS MATERIALIZED (
  SELECT a.video_id, a.idx AS i, b.idx AS j, a.start_time AS t0, b.end_time AS t1
  FROM segments a
  JOIN segments b ON b.video_id = a.video_id AND b.idx BETWEEN a.idx + 1 AND a.idx + 5
  JOIN segments a2 ON a2.video_id = a.video_id AND a2.idx = a.idx + 1
  JOIN segments b2 ON b2.video_id = a.video_id AND b2.idx = b.idx - 1
  WHERE b.end_time - a.start_time BETWEEN 30 AND 180
    AND (a.segment_type IN ('hook', 'story', 'question', 'setup') OR a2.segment_type IN ('hook', 'story', 'question', 'setup')
         OR b.segment_type IN ('payoff', 'conclusion', 'revelation', 'advice') OR b2.segment_type IN ('payoff', 'conclusion', 'revelation', 'advice')
         OR b.idx - a.idx <= 2))"""
)

ESTIMATES = (
    COMBOS
    + """,
pairs AS (
  SELECT c.video_id, c.i, c.j, c.t0, c.t1, s.score, s.segment_type, s.is_complete,
         (least(c.t1, s.end_time) - greatest(c.t0, s.start_time)) / (s.end_time - s.start_time) AS weight
  FROM combos c JOIN segments s ON s.video_id = c.video_id AND s.idx BETWEEN c.i AND c.j
  WHERE least(c.t1, s.end_time) > greatest(c.t0, s.start_time)),
estimates AS MATERIALIZED (
  SELECT video_id, i, j, t0, t1,
         least(100, greatest(0, sum(score * weight) / sum(weight)
           + sum(CASE WHEN weight > 0.3 AND segment_type IN ('hook', 'question', 'setup') THEN 3 ELSE 0 END
               + CASE WHEN weight > 0.3 AND segment_type IN ('payoff', 'conclusion', 'revelation', 'advice') THEN 3 ELSE 0 END
               + CASE WHEN is_complete THEN 1 ELSE 0 END)
           - abs(t1 - t0 - 148) * 0.5)) AS estimated_score
  FROM pairs GROUP BY video_id, i, j, t0, t1)"""
)


EXTENDED = """
reach AS MATERIALIZED (SELECT a.video_id, a.idx AS i, b.idx AS j, a.start_time AS t0, b.end_time AS t1
  FROM (SELECT *, unnest(range(idx, idx + 60)) AS k FROM segments) a JOIN segments b ON b.video_id = a.video_id AND b.idx = a.k
  WHERE a.end_time - a.start_time >= 10 AND a.end_time - a.start_time < 145 AND b.end_time - a.start_time <= 180),
picked AS (SELECT video_id, i, t0, coalesce(min(CASE WHEN abs(t1 - t0 - 148) <= 3 AND j > i THEN j END), max(j)) AS j FROM reach GROUP BY video_id, i, t0),
extended AS MATERIALIZED (
  SELECT p.video_id, p.i, p.j, p.t0, r.t1 FROM picked p JOIN reach r ON r.video_id = p.video_id AND r.i = p.i AND r.j = p.j WHERE r.t1 - p.t0 >= 30
  UNION ALL SELECT video_id, idx, idx, start_time, end_time FROM segments WHERE abs(end_time - start_time - 148) <= 3)"""

ARCS = """
arcs AS MATERIALIZED (SELECT * FROM (SELECT a.video_id, a.idx AS i, b.idx AS j, a.start_time AS t0, b.end_time AS t1
  FROM (SELECT *, unnest(range(idx + 3, idx + 8)) AS j FROM segments) a JOIN segments b ON b.video_id = a.video_id AND b.idx = a.j) WHERE t1 - t0 BETWEEN 145 AND 180)"""

PAIRS = """
pairs AS MATERIALIZED (SELECT a.video_id, a.idx AS i, b.idx AS j, a.start_time AS t0, b.end_time AS t1
  FROM (SELECT *, unnest(range(idx + 1, idx + 60)) AS k FROM segments) a JOIN segments b ON b.video_id = a.video_id AND b.idx = a.k
  WHERE a.segment_type IN ('hook', 'story', 'question', 'setup') AND b.segment_type IN ('payoff', 'conclusion', 'revelation', 'advice') AND b.end_time - a.start_time BETWEEN 30 AND 180)"""


def snaps(name: str, targets: str) -> str:
    """The natural boundary, if there is one, of each target (video_id, target, forward): a table called name."""
    return f"""
{name}_targets AS MATERIALIZED ({targets}),
{name}_scored AS (SELECT t.video_id, t.target, t.forward, w."end", w.word_idx,
    10 + CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 50 WHEN right(word, 1) IN (',', ';', ':') THEN 20 ELSE 0 END - abs(w."end" - target) * 3 AS points
  FROM (SELECT *, unnest([floor(target / 5) - 1, floor(target / 5), floor(target / 5) + 1])::BIGINT AS bucket FROM {name}_targets) t
  JOIN placed_words w ON w.video_id = t.video_id AND w.bucket = t.bucket WHERE abs(w."end" - target) <= 5),
{name} AS MATERIALIZED (SELECT video_id, target, forward, "end" FROM {name}_scored WHERE points > -1
  QUALIFY row_number() OVER (PARTITION BY video_id, target, forward ORDER BY points DESC, CASE WHEN forward THEN word_idx ELSE -word_idx END) = 1)"""


def greedy(name: str, source: str) -> str:
    """Ranges of source without near-repeats: a table called name. Starts a second or more apart part a video; each part
    is folded into the list of what is kept."""
    return f"""
{name}_marked AS (SELECT *, CASE WHEN t0 - lag(t0) OVER w < 1 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT video_id, i, j, t0, t1 FROM {source}) WINDOW w AS (PARTITION BY video_id ORDER BY t0, t1, i, j)),
{name}_parted AS (SELECT *, sum(fresh) OVER w AS part FROM {name}_marked WINDOW w AS (PARTITION BY video_id ORDER BY t0, t1, i, j ROWS UNBOUNDED PRECEDING)),
{name}_lists AS (SELECT video_id, list([struct_pack(i := i, j := j, t0 := t0, t1 := t1)] ORDER BY t0, t1, i, j) AS rs FROM {name}_parted GROUP BY video_id, part),
{name} AS MATERIALIZED (SELECT video_id, r.i AS i, r.j AS j, r.t0 AS t0, r.t1 AS t1 FROM (SELECT video_id, unnest(list_reduce(rs,
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: abs(x[1].t0 - k.t0) < 1 AND abs(x[1].t1 - k.t1) < 1)) = 0 THEN list_concat(kept, x) ELSE kept END)) AS r FROM {name}_lists))"""


GENERATED = (
    COMBOS + "," + EXTENDED + "," + ARCS + "," + PAIRS + """,
placed_words AS MATERIALIZED (SELECT *, floor("end" / 5)::BIGINT AS bucket FROM words),
strategies AS MATERIALIZED (SELECT video_id, i, j, t0, t1 FROM combos UNION ALL FROM extended UNION ALL FROM arcs UNION ALL FROM pairs),
long AS MATERIALIZED (SELECT video_id, idx, start_time, end_time FROM segments WHERE end_time - start_time > 151),"""
    + snaps("snap", """SELECT video_id, t0 AS target, true AS forward FROM strategies UNION SELECT video_id, t1, false FROM strategies UNION SELECT video_id, start_time + 148, false FROM long""")
    + """,
built AS MATERIALIZED (
  SELECT r.video_id, i, j, coalesce(a."end", t0) AS t0, coalesce(b."end", t1) AS t1 FROM strategies r
  LEFT JOIN snap a ON a.video_id = r.video_id AND a.target = t0 AND a.forward LEFT JOIN snap b ON b.video_id = r.video_id AND b.target = t1 AND NOT b.forward
  UNION ALL
  SELECT l.video_id, idx, idx, start_time, least(end_time, CASE WHEN coalesce(s."end", start_time + 148) - start_time < 30 THEN start_time + 30 ELSE coalesce(s."end", start_time + 148) END)
  FROM long l LEFT JOIN snap s ON s.video_id = l.video_id AND s.target = start_time + 148 AND NOT s.forward),"""
    + greedy("singled", "built") + """,
candidates AS MATERIALIZED (SELECT * FROM singled WHERE t1 - t0 BETWEEN 30 AND 180),
moved AS MATERIALIZED (
  SELECT video_id, i, j, t0 AS a, t1 AS b, needed, delta, t0 + delta AS t0, t1 + delta AS t1
  FROM (SELECT *, 300 - count(*) OVER (PARTITION BY video_id) AS needed FROM candidates), (SELECT unnest([-2.0::DOUBLE, -1.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS delta) WHERE needed > 0),"""
    + snaps("moved_snap", "SELECT video_id, t0 AS target, true AS forward FROM moved UNION SELECT video_id, t1, false FROM moved")
    + """,
variants AS MATERIALIZED (
  SELECT video_id, i, j, x AS t0, y AS t1 FROM (
    SELECT r.video_id, i, j, needed, r.a, r.b, delta, coalesce(p."end", t0) AS x, coalesce(q."end", t1) AS y FROM moved r
    LEFT JOIN moved_snap p ON p.video_id = r.video_id AND p.target = t0 AND p.forward LEFT JOIN moved_snap q ON q.video_id = r.video_id AND q.target = t1 AND NOT q.forward)
  WHERE y - x BETWEEN 30 AND 180 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY a, b, i, j, delta) <= needed),
filled AS (FROM candidates UNION ALL FROM variants),"""
    + greedy("distinct_filled", "filled") + """,
generated AS MATERIALIZED (SELECT * FROM distinct_filled WHERE t1 - t0 BETWEEN 30 AND 180)"""
)

# Ends that were moved lie at most seven seconds off, less than two segments.
GENERATED_ESTIMATES = GENERATED + """,
weighed AS (
  SELECT c.video_id, c.i, c.j, c.t0, c.t1, s.score, s.segment_type, s.is_complete, (least(c.t1, s.end_time) - greatest(c.t0, s.start_time)) / (s.end_time - s.start_time) AS weight
  FROM (SELECT *, unnest(range(i - 3, j + 4)) AS k FROM generated) c JOIN segments s ON s.video_id = c.video_id AND s.idx = c.k
  WHERE least(c.t1, s.end_time) > greatest(c.t0, s.start_time)),
sums AS (
  SELECT video_id, i, j, t0, t1, sum(score * weight) / sum(weight) AS mean,
         sum(CASE WHEN weight > 0.3 AND segment_type IN ('hook', 'question', 'setup') THEN 3 ELSE 0 END
             + CASE WHEN weight > 0.3 AND segment_type IN ('payoff', 'conclusion', 'revelation', 'advice') THEN 3 ELSE 0 END + CASE WHEN is_complete THEN 1 ELSE 0 END) AS bonus
  FROM weighed GROUP BY video_id, i, j, t0, t1),
estimates AS MATERIALIZED (
  SELECT g.video_id, g.i, g.j, g.t0, g.t1, coalesce(least(100, greatest(0, mean + bonus - abs(g.t1 - g.t0 - 148) * 0.5)), 50) AS estimated_score
  FROM generated g LEFT JOIN sums USING (video_id, i, j, t0, t1))"""


def sql(tables: str, query: str) -> str:
    return f"WITH RECURSIVE {tables.strip()}\n{query.strip()}"
