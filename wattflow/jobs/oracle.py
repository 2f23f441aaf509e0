"""SQL for the registered queries, in the dialect of DuckDB, over the same tables."""

from __future__ import annotations

from .queries import APPLIANCES, BANDWIDTH, BIN_WIDTH, CHANNELS, DELAY, LATE_AT, LATE_EVERY, NOISE_LEVEL, SMALL_MODEL, STATE_THRESHOLD, TOLERANCE, TURNS

_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNELS.items())
_NAMES = ", ".join(f"('{v}')" for v in CHANNELS.values())

READINGS = f"""readings AS (
  SELECT CAST(user_id % 6 + 1 AS INT) AS building, CASE event_type {_CASES} END AS channel,
         CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, value AS watts
  FROM events)"""

#: The detector's definition, step by step; EDGES has a row for each emission.
EDGES = f"""{READINGS},
r1 AS (
  SELECT *, row_number() OVER s - 1 AS i, lag(watts) OVER s AS m_before, lag(t) OVER s AS t_before,
         first_value(watts) OVER s AS m_first, lead(t) OVER s IS NOT NULL AS more
  FROM readings WINDOW s AS (PARTITION BY building, channel ORDER BY t, seq)),
r2 AS (SELECT *, coalesce(abs(watts - m_before) > {STATE_THRESHOLD}, false) AS c FROM r1),
r3 AS (
  SELECT *, sum(CAST(c AS INT)) OVER (s ROWS UNBOUNDED PRECEDING) AS run,
         bool_or(c) OVER (s ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c_recent,
         coalesce(lag(c) OVER s, false) AS c_before
  FROM r2 WINDOW s AS (PARTITION BY building, channel ORDER BY t, seq)),
r4 AS (
  SELECT *, avg(watts) OVER (PARTITION BY building, channel, i > 0, run ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS mean
  FROM r3),
r5 AS (SELECT *, i >= 2 AND NOT c_recent AND more AS chk FROM r4),
r6 AS (
  SELECT *, coalesce(last_value(CASE WHEN chk THEN mean END IGNORE NULLS) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), m_first) AS level,
         coalesce(lag(chk) OVER s, false) AS checked, lag(mean) OVER s AS mean_before
  FROM r5 WINDOW s AS (PARTITION BY building, channel ORDER BY t, seq)),
r7 AS (SELECT *, i > 0 AND abs(watts - level) > {NOISE_LEVEL} AS x, checked AND abs(mean_before - level) > {NOISE_LEVEL} AS emits FROM r6),
r8 AS (
  SELECT *, coalesce(sum(CAST(emits AS INT)) OVER p, 0) AS edge_no,
         last_value(CASE WHEN c THEN t END IGNORE NULLS) OVER p AS last_change
  FROM r7 WINDOW p AS (PARTITION BY building, channel ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
edges AS (
  SELECT building, channel, CAST(edge_no AS BIGINT) AS edge_no, max(mean_before - level) FILTER (emits) AS transition,
         CAST(sum(CAST(x AS INT) + CAST(c_before AS INT)) AS INT) AS duration,
         coalesce(min(t_before) FILTER (x), max(last_change) FILTER (emits)) AS start,
         max(last_change) FILTER (emits) AS "end", max(mean_before) FILTER (emits) AS active_average,
         sum(CASE WHEN x THEN m_before ELSE 0 END + CASE WHEN c_before THEN m_before ELSE 0 END) AS total
  FROM r8 GROUP BY ALL HAVING bool_or(emits))"""


def _pairs(source: str, key: str, outermost: bool = False) -> str:
    """Pairs of the edges of a table by a key, as table pairs."""
    return f"""
l1 AS (SELECT *, CASE WHEN transition > 0 THEN 1 ELSE -1 END AS v FROM {source}),
l2 AS (SELECT *, sum(v) OVER (PARTITION BY building, {key} ORDER BY edge_no) AS b FROM l1),
l3 AS (SELECT *, least(0, min(b) OVER (PARTITION BY building, {key} ORDER BY edge_no)) AS low FROM l2),
l4 AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY building, {key} ORDER BY edge_no), 0) AS low_before FROM l3),
l5 AS (SELECT *, b - low + CASE WHEN v = 1 THEN 0 ELSE 1 END AS lev FROM l4 WHERE v = 1 OR b >= low_before),
l6 AS (
  SELECT *, lag(v) OVER w AS rise_v, lag(transition) OVER w AS rise_transition, lag(start) OVER w AS rise_start, lag(edge_no) OVER w AS rise_no
  FROM l5 {"WHERE lev = 1" if outermost else ""} WINDOW w AS (PARTITION BY building, {key}, lev ORDER BY edge_no)),
pairs AS (
  SELECT building, {key}, rise_no, edge_no AS fall_no, rise_transition AS transition, "end" - rise_start AS duration, rise_start AS start, "end"
  FROM l6 WHERE v = -1 AND rise_v = 1)"""


_LIST = ", ".join(f"'{a}'" for a in APPLIANCES)
MATCHES = f"""matches AS (
  SELECT a.building, a.channel, a.edge_no, min(m.edge_no) AS main_edge
  FROM edges a JOIN edges m ON a.building = m.building AND m.channel = 'main' AND a.channel <> 'main'
   AND a.start - m."end" <= {2 * TOLERANCE} AND m.start - a."end" <= {2 * TOLERANCE}
  GROUP BY ALL)"""
_FLAGS = ", ".join(f"CAST(count(*) FILTER (x.channel = '{a}') > 0 AS INT) AS \"{a.replace(' ', '_')}_label\"" for a in APPLIANCES)
_LABEL = " ".join(f"WHEN \"{a.replace(' ', '_')}_label\" = 1 THEN '{a}'" for a in APPLIANCES)
LABELLED = f"""flags AS (
  SELECT m.building, m.edge_no, any_value(m.transition) AS transition, any_value(m.start) AS start, any_value(m."end") AS "end", {_FLAGS}
  FROM edges m LEFT JOIN matches x ON m.building = x.building AND m.edge_no = x.main_edge
  WHERE m.channel = 'main' GROUP BY m.building, m.edge_no),
labelled AS (SELECT *, CASE {_LABEL} ELSE 'unknown' END AS label FROM flags)"""

PAIRS = f"WITH {EDGES},{_pairs('edges', 'channel')}"
PAINTED = f"""{PAIRS},
painted AS (
  SELECT r.*, CAST(EXISTS (SELECT 1 FROM pairs p WHERE p.building = r.building AND p.channel = r.channel AND r.t BETWEEN p.start AND p."end") AS INT) AS "on"
  FROM readings r)"""

FEATURES = """features AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label
  FROM lineitem)"""


def _quantized(x: str) -> str:
    """Bits of one feature as a number of 4 bits: normal law of the standardised value, by formula 7.1.26."""
    z = f"(({x} - avg_{x}) / std_{x} / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * abs({z})))"
    poly = f"((((({t} * 1.061405429 - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    erf = f"CASE WHEN {z} >= 0 THEN 1 ELSE -1 END * (1 - {poly} * exp(-{z} * {z}))"
    return f"CAST(round_even(0.5 * (1 + {erf}) * 15, 0) AS INT)"


_STATS = ", ".join(f"avg(f{i}) AS avg_f{i}, stddev_pop(f{i}) AS std_f{i}" for i in range(4))
_STRING = " || ".join(f"lpad(bin(q{i}), 4, '0')" for i in range(4))
BITS = f"""{FEATURES},
stats AS (SELECT {_STATS} FROM features),
quantized AS (SELECT features.*, {", ".join(f"{_quantized(f'f{i}')} AS q{i}" for i in range(4))} FROM features, stats),
bits AS (SELECT *, {_STRING} AS bits FROM quantized)"""


def _clause(positive: list[int], negative: list[int]) -> str:
    tests = [f"bits[{p + 1}] = '1'" for p in positive] + [f"bits[{p + 1}] = '0'" for p in negative]
    return f"CAST({' AND '.join(tests) or 'true'} AS INT)"


_VOTES = [" ".join(f"{'+' if j % 2 == 0 else '-'} {_clause(p, n)}" for c, j, p, n in SMALL_MODEL if c == k) for k in range(3)]
PREDICTED = f"""WITH {BITS},
voted AS (SELECT *, {", ".join(f"CAST(0 {v} AS INT) AS votes_{k}" for k, v in enumerate(_VOTES))} FROM bits),
predicted AS (
  SELECT *, CASE WHEN votes_0 >= votes_1 AND votes_0 >= votes_2 THEN 0 WHEN votes_1 >= votes_2 THEN 1 ELSE 2 END AS pred FROM voted)"""

_VOTED = f"{PREDICTED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, pred, votes_0, votes_1, votes_2 FROM predicted"
_GAPPY = f"""{READINGS}, gappy AS (SELECT building, channel, t, seq, CASE WHEN seq % 7 <> 0 THEN watts END AS watts FROM readings)"""
_SPLIT = "md5(concat_ws(':', '7', CAST({} AS VARCHAR)))"



def _near(distance: int) -> str:
    """Of rises and falls so many edges apart, those that are still free and of like size, and who is free after that."""
    d, step = distance, distance - 1
    return f"""
n{d} AS (
  SELECT *, coalesce(f{step} AND w > 0 AND abs(w + lead(CASE WHEN f{step} AND w <= 0 THEN w END, {d}) OVER s) < CASE WHEN w >= 1000 THEN 0.035 * w ELSE 20 END, false) AS k{d}
  FROM m{step} WINDOW s AS (PARTITION BY building, channel ORDER BY edge_no)),
m{d} AS (
  SELECT *, f{step} AND NOT k{d} AND NOT coalesce(lag(k{d}, {d}) OVER s, false) AS f{d}
  FROM n{d} WINDOW s AS (PARTITION BY building, channel ORDER BY edge_no))"""


_TAKEN = " ".join(f"WHEN k{d} THEN {d}" for d in range(1, 20))
TOLERANCE_PAIRS = f"""WITH {EDGES},
m0 AS (SELECT building, channel, edge_no, transition AS w, start, "end", true AS f0, row_number() OVER (PARTITION BY building, channel ORDER BY edge_no) AS place FROM edges WHERE "end" IS NOT NULL),
{",".join(_near(d) for d in range(1, 20))},
rises AS (SELECT *, place + CASE {_TAKEN} END AS other FROM m19 WHERE CASE {_TAKEN} END IS NOT NULL),
near_pairs AS (
  SELECT r.building, r.channel, r.edge_no AS rise_no, f.edge_no AS fall_no, r.w AS t1_w, f.w AS t2_w, r.start, f."end"
  FROM rises r JOIN m0 f ON f.building = r.building AND f.channel = r.channel AND f.place = r.other)"""

#: Readings with the quarter in which they arrive; late is what the watermark of the quarters before has reached.
ARRIVED = f"""{READINGS},
ends AS (SELECT min(t) AS low, max(t) AS high FROM readings),
arriving AS (
  SELECT readings.*, least({TURNS - 1}, CAST(floor((t - low) * {TURNS} / (high - low + 1)) AS INT) + CAST(seq % {LATE_EVERY} = {LATE_AT} AS INT)) AS turn FROM readings, ends),
marks AS (SELECT b AS turn, max(t) - {DELAY} AS mark FROM arriving, (SELECT unnest(range({TURNS + 1})) AS b) WHERE arriving.turn < b GROUP BY b),
arrived AS (SELECT a.*, coalesce(a.t <= mark, false) AS late FROM arriving a LEFT JOIN marks USING (turn)),
in_time AS (SELECT building, channel, t, seq, watts FROM arrived WHERE NOT late AND t <= (SELECT mark FROM marks WHERE turn = {TURNS}))"""
IN_TIME_EDGES = ARRIVED + EDGES.removeprefix(READINGS).replace("FROM readings", "FROM in_time")

#: Edges of readings whose gaps are filled; trailing gaps stay and do not count.
_FILLED = f"""{READINGS}, gappy AS (SELECT building, channel, t, seq, CASE WHEN seq % 7 <> 0 THEN watts END AS watts FROM readings),
filled AS (SELECT * FROM (
  SELECT building, channel, t, seq, first_value(watts IGNORE NULLS) OVER (PARTITION BY building, channel ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS watts FROM gappy)
  WHERE watts IS NOT NULL)"""
FILLED_EDGES = _FILLED + EDGES.removeprefix(READINGS).replace("FROM readings", "FROM filled")
FILLED_PAIRS = f"WITH {FILLED_EDGES},{_pairs('edges', 'channel')}"


def _dense(source: str, final: str = "true") -> str:
    """Hourly means of a table, 0 in the hours without readings between each series' first and last."""
    return f"""hourly AS (SELECT building, channel, t // 3600 * 3600 AS t, avg(watts) AS watts FROM {source} WHERE {final} GROUP BY ALL),
hours AS (SELECT building, channel, unnest(range(min(t), max(t) + 3600, 3600)) AS t FROM hourly GROUP BY building, channel)
SELECT building, channel, t, round(coalesce(watts, 0), 6) AS watts FROM hours LEFT JOIN hourly USING (building, channel, t)"""


ORACLE_SQL = {
    "melt": f"""WITH {READINGS}, hours AS (SELECT building, t // 3600 AS t, channel, max(watts) AS watts FROM readings GROUP BY ALL)
      SELECT g.building, g.t, c.channel, h.watts FROM (SELECT DISTINCT building, t FROM hours) g CROSS JOIN (VALUES {_NAMES}) c(channel)
      LEFT JOIN hours h ON h.building = g.building AND h.t = g.t AND h.channel = c.channel""",
    "parts_round_trip": f"""WITH {READINGS}, hours AS (SELECT building, t // 3600 AS hour, channel, round(max(watts), 6) AS watts FROM readings GROUP BY ALL),
      numbered AS (SELECT building, hour, row_number() OVER (PARTITION BY building ORDER BY hour // 100 % 3, hour) - 1 AS n FROM (SELECT DISTINCT building, hour FROM hours))
      SELECT g.building, g.hour, g.n, c.channel, h.watts FROM numbered g CROSS JOIN (VALUES {_NAMES}) c(channel)
      LEFT JOIN hours h ON h.building = g.building AND h.hour = g.hour AND h.channel = c.channel""",
    "csv_round_trip": f"WITH {EDGES} SELECT building, channel, edge_no, duration AS n_samples, round(total, 4) AS total_watts FROM edges",
    "stage_round_trip": f"""WITH {EDGES} SELECT building, channel, edge_no, round(transition, 6) AS transition, "end" FROM edges WHERE building IN (1, 3) AND channel IN ('main', 'fridge')""",
    "submission_round_trip": f"""WITH {READINGS}, lit AS (SELECT DISTINCT channel, t FROM readings WHERE building = 2 AND channel <> 'main' AND watts >= 80)
      SELECT CAST(2 AS INT) AS building, c.channel, g.t, CAST(EXISTS (SELECT 1 FROM lit WHERE lit.channel = c.channel AND lit.t = g.t) AS DOUBLE) AS value
      FROM (SELECT DISTINCT t FROM lit) g CROSS JOIN (SELECT unnest([{_LIST}]) AS channel) c""",
    "labelled_csv": f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT 'class ' || label AS label, CAST({i} AS INT) AS pos, count(*) AS n, round(avg(f{i}), 6) AS mean, round(stddev_pop(f{i}), 6) AS std FROM features GROUP BY label" for i in range(4)),
    "unknown_edges": f"WITH {EDGES}, {MATCHES}, {LABELLED} SELECT building, edge_no, round(transition, 6) AS transition FROM labelled WHERE label = 'unknown'",
    "feedback_probability": f"""{PREDICTED}, own AS (SELECT *, greatest(-1, least(1, CASE label WHEN 0 THEN votes_0 WHEN 1 THEN votes_1 ELSE votes_2 END)) AS v FROM predicted)
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (1 - v) / 2.0 AS as_target, (1 + v) / 2.0 AS as_other FROM own""",
    "training_footprint": """SELECT CAST(52 + 8 * n + 4 * n * literals AS BIGINT) AS n_bytes, n AS n_clauses
      FROM (SELECT 20 * count(DISTINCT label) AS n, 2 * max(len(embedding)) AS literals FROM embeddings)""",
    "wide": f"""WITH {READINGS} SELECT building, t, {", ".join(f"CAST(coalesce(max(CAST(watts >= 80 AS INT)) FILTER (channel = '{a}'), 0) AS INT) AS {a.replace(' ', '_')}" for a in APPLIANCES)}
      FROM readings WHERE channel <> 'main' GROUP BY ALL""",
    "sample_number": f"WITH {READINGS} SELECT building, t, seq, row_number() OVER (PARTITION BY building ORDER BY t, seq) - 1 AS n FROM readings",
    "binarize": f"""WITH {READINGS} SELECT building, channel, t, seq, CAST(watts >= 80 AS INT) AS "on" FROM readings WHERE channel <> 'main'""",
    "missing_channels": f"""WITH {READINGS}, kept AS (SELECT * FROM readings WHERE NOT (building % 2 = 0 AND channel = 'fridge'))
      SELECT b.building, c.channel FROM (SELECT DISTINCT building FROM kept) b CROSS JOIN (SELECT unnest([{_LIST}, 'washer dryer']) AS channel) c
      WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.building = b.building AND k.channel = c.channel)""",
    "slice_time": f"WITH {READINGS} SELECT * FROM readings WHERE t >= 1704067200 AND t < 1704067200 + 43200",
    "head_per_building": f"WITH {READINGS} SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY building ORDER BY t, seq) <= 100",
    "channel_stats": f"WITH {READINGS} SELECT building, channel, round(avg(watts), 6) AS mean_watts, round(min(watts), 6) AS min_watts, round(max(watts), 6) AS max_watts FROM readings GROUP BY ALL",
    "backfill": f"""WITH {_GAPPY} SELECT building, channel, t, seq,
      first_value(watts IGNORE NULLS) OVER (PARTITION BY building, channel ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS watts FROM gappy""",
    "fill_zero": f"WITH {_GAPPY} SELECT building, channel, t, seq, coalesce(watts, 0) AS watts FROM gappy",
    "transitions": f"""WITH {EDGES} SELECT building, channel, edge_no, round(transition, 6) AS transition, duration, "end", start FROM edges""",
    "transition_samples": f"WITH {EDGES} SELECT building, channel, edge_no, duration AS n_samples, round(total, 4) AS total_watts FROM edges",
    "transition_sequence": f"""WITH {EDGES}, items AS (
        SELECT building, channel, edge_no, i, k, m_before FROM r8, (VALUES (0), (1)) v(k) WHERE CASE k WHEN 0 THEN x ELSE c_before END)
      SELECT building, channel, edge_no, md5(coalesce(string_agg(CAST(CAST(round(m_before * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY i, k), '')) AS sequence_md5
      FROM edges LEFT JOIN items USING (building, channel, edge_no) GROUP BY ALL""",
    "match_counts": f"""WITH {EDGES}, {MATCHES},
      own AS (SELECT e.building, e.channel, m.main_edge IS NOT NULL AS matched FROM edges e LEFT JOIN matches m USING (building, channel, edge_no) WHERE e.channel <> 'main')
      SELECT building, channel, count(*) AS n_edges, count(*) FILTER (matched) AS n_matched, count(*) FILTER (NOT matched) AS n_not_found FROM own GROUP BY ROLLUP (building, channel)""",
    "steady_states": f"""WITH {EDGES} SELECT building, channel, "end" AS t, round(active_average, 6) AS active_average FROM edges""",
    "pair_edges": f"""{PAIRS} SELECT building, channel, rise_no, fall_no, round(transition, 6) AS transition, duration, start, "end" FROM pairs""",
    "edge_counts": f"""{PAIRS}, counts AS (
        SELECT e.building, e.channel, e.n AS n_edges, coalesce(p.n, 0) AS n_paired
        FROM (SELECT building, channel, count(*) AS n FROM edges GROUP BY ALL) e
        LEFT JOIN (SELECT building, channel, 2 * count(*) AS n FROM pairs GROUP BY ALL) p USING (building, channel))
      SELECT building, channel, CAST(sum(n_edges) AS BIGINT) AS n_edges, CAST(sum(n_paired) AS BIGINT) AS n_paired FROM counts GROUP BY ROLLUP (building, channel)""",
    "on_time": f"{PAIRS} SELECT building, channel, count(*) AS n_on, CAST(sum(duration) AS BIGINT) AS on_time FROM pairs GROUP BY ALL",
    "match_edges": f"WITH {EDGES}, {MATCHES} SELECT * FROM matches",
    "unmatched_edges": f"WITH {EDGES}, {MATCHES} SELECT building, channel, edge_no FROM edges WHERE channel <> 'main' AND (building, channel, edge_no) NOT IN (SELECT (building, channel, edge_no) FROM matches)",
    "label_main_edges": f"WITH {EDGES}, {MATCHES}, {LABELLED} SELECT * EXCLUDE (transition, start, \"end\") FROM labelled",
    "pair_outermost": f"""WITH {EDGES}, {MATCHES}, {LABELLED},{_pairs("labelled", "label", True)}
      SELECT building, label, rise_no, fall_no, round(transition, 6) AS transition, duration, start, "end" FROM pairs""",
    "paint_intervals": f"""{PAINTED} SELECT building, channel, t, seq, "on" FROM painted""",
    "score_on_off": f"""{PAINTED}, c AS (
        SELECT building, channel, count(*) FILTER ("on" = 1) AS n_predicted, count(*) FILTER (watts > CASE building WHEN 2 THEN 60 ELSE 80 END) AS n_true,
               count(*) FILTER ("on" = 1 AND watts > CASE building WHEN 2 THEN 60 ELSE 80 END) AS n_hit
        FROM painted GROUP BY ALL)
      SELECT *, round(100.0 * n_hit / nullif(n_predicted, 0), 6) AS precision, round(100.0 * n_hit / nullif(n_true, 0), 6) AS recall FROM c""",
    "check_submission": f"""WITH {READINGS}, c AS (
        SELECT building, channel, NOT (building = 3 AND seq % 11 = 0) AS s, NOT (building = 4 AND seq % 13 = 0) AS u FROM readings),
      n AS (SELECT building, channel, count(*) FILTER (s) AS n_submitted, count(*) FILTER (u) AS n_truth, count(*) FILTER (s AND NOT u) AS n_only_submitted, count(*) FILTER (u AND NOT s) AS n_only_truth FROM c GROUP BY ALL)
      SELECT *, n_submitted = n_truth AND n_only_submitted = 0 AND n_only_truth = 0 AS conforms FROM n""",
    "feature_stats": f"WITH {FEATURES}, cells AS (SELECT unnest([f0, f1, f2, f3]) AS x FROM features) SELECT round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std FROM cells",
    "feature_stats_each": f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS pos, round(avg(f{i}), 8) AS mean, round(stddev_pop(f{i}), 8) AS std FROM features" for i in range(4)),
    "booleanize": f"WITH {BITS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, bits FROM bits",
    "encode_labels": f"WITH {FEATURES} SELECT label, count(*) AS n FROM features GROUP BY ALL",
    "n_classes": f"WITH {FEATURES} SELECT count(DISTINCT label) AS n_classes FROM features",
    "train_test_split": f"SELECT vec_id, label, row_number() OVER (ORDER BY {_SPLIT.format('vec_id')}, vec_id) <= floor((SELECT count(*) FROM embeddings) * 0.8) AS is_train FROM embeddings",
    "hash_split": f"SELECT event_id AS seq, CAST('0x' || substr({_SPLIT.format('event_id')}, 1, 8) AS BIGINT) / 4294967296.0 < 0.8 AS is_train FROM events",
    "balance": f"SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_SPLIT.format('vec_id')}, vec_id) <= 20",
    "seeded_shuffle": f"SELECT event_id AS seq, row_number() OVER (ORDER BY {_SPLIT.format('event_id')}, event_id) AS place FROM events",
    "predict": _VOTED,
    "votes_by_join": _VOTED,
    "accuracy": f"{PREDICTED} SELECT round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy FROM predicted",
    "confusion": f"{PREDICTED} SELECT label, " + ", ".join(f"count(*) FILTER (pred = {k}) AS pred_{k}" for k in range(3)) + " FROM predicted GROUP BY ALL",
    "report": f"""{PREDICTED}, k AS (
        SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS predicted, count(*) FILTER (label = c AND pred = c) AS hits
        FROM predicted, (VALUES (0), (1), (2)) v(c) GROUP BY c),
      m AS (SELECT c, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM k WHERE predicted > 0 OR support > 0),
      f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)
      SELECT CAST(c AS VARCHAR) AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
      UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
      UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
      UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
    "stream_transitions": f"""WITH {EDGES} SELECT building, channel, edge_no, round(transition, 6) AS transition, duration, start, "end" FROM edges""",
    "stream_late_edges": f"""WITH {IN_TIME_EDGES} SELECT building, channel, edge_no, round(transition, 6) AS transition, duration, start, "end" FROM edges""",
    "stream_late_counts": f"WITH {ARRIVED} SELECT building, channel, count(*) AS n_late FROM arrived WHERE late GROUP BY ALL",
    "stream_resampled_dense": f"WITH {ARRIVED}, {_dense('in_time', f'(t // 3600 + 1) * 3600 - 1 <= (SELECT mark FROM marks WHERE turn = {TURNS})')}",
    "cluster_pairs": f"""{TOLERANCE_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)},
      bins AS (SELECT building, (floor((abs(t1_w) + abs(t2_w)) / 2 / {BIN_WIDTH}) + 0.5) * {BIN_WIDTH} AS x, count(*) AS n FROM near_pairs GROUP BY ALL),
      shift AS (
        SELECT building, x, n, x AS pos, 0 AS step FROM bins
        UNION ALL
        SELECT s.building, s.x, s.n, sum(b.n * b.x) / sum(b.n), s.step + 1 FROM shift s JOIN bins b ON b.building = s.building AND abs(s.pos - b.x) <= {BANDWIDTH} WHERE s.step < 60 GROUP BY ALL),
      placed AS (SELECT building, pos, n, row_number() OVER (PARTITION BY building ORDER BY pos, n) AS place FROM shift WHERE step = 60),
      merged AS (
        SELECT building, place, pos AS center, n FROM placed WHERE place = 1
        UNION ALL
        SELECT p.building, p.place, CASE WHEN p.pos - m.center <= {BANDWIDTH / 2} THEN m.center ELSE p.pos END, p.n FROM merged m JOIN placed p ON p.building = m.building AND p.place = m.place + 1)
      SELECT building, round(center, 6) AS center_w, CAST(sum(n) AS BIGINT) AS n FROM merged GROUP BY building, center""",
    "resample_hourly": f"WITH {READINGS}, {_dense('readings')}",
    "stream_predict": f"{PREDICTED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, pred FROM predicted",
    "stream_resampled": f"WITH {READINGS} SELECT building, channel, t // 3600 * 3600 AS t, round(avg(watts), 6) AS watts FROM readings GROUP BY ALL",
    "on_intervals": f"""{FILLED_PAIRS} SELECT building, channel, rise_no, fall_no, round(transition, 6) AS transition, duration, start, "end" FROM pairs""",
    "painted_scores": f"""{FILLED_PAIRS}, truth AS (SELECT building, channel, t, max(watts) AS watts FROM gappy GROUP BY ALL),
      painted AS (SELECT r.*, EXISTS (SELECT 1 FROM pairs p WHERE p.building = r.building AND p.channel = r.channel AND r.t BETWEEN p.start AND p."end") AS "on" FROM truth r),
      c AS (SELECT building, channel, count(*) FILTER ("on") AS n_predicted, count(*) FILTER (watts > 80) AS n_true, count(*) FILTER ("on" AND watts > 80) AS n_hit FROM painted GROUP BY ALL)
      SELECT *, round(100.0 * n_hit / nullif(n_predicted, 0), 6) AS precision, round(100.0 * n_hit / nullif(n_true, 0), 6) AS recall FROM c""",
    "labelled_pairs": f"""WITH {FILLED_EDGES}, {MATCHES}, {LABELLED},{_pairs("labelled", "label", True)}
      SELECT building, label, rise_no, fall_no, round(transition, 6) AS transition, duration, start, "end" FROM pairs""",
    "pair_by_tolerance": f"""{TOLERANCE_PAIRS} SELECT building, channel, rise_no, fall_no, round(t1_w, 6) AS t1_w, round(t2_w, 6) AS t2_w, start, "end" FROM near_pairs""",
    "tolerance_shape": f"""{TOLERANCE_PAIRS} SELECT building, channel, rise_no, round((abs(t1_w) + abs(t2_w)) / 2, 6) AS height_w, "end" - start AS duration_s FROM near_pairs""",
    "pair_shape": f"""{PAIRS} SELECT building, channel, rise_no, round(transition, 6) AS height_w, "end" - start AS duration_s FROM pairs""",
}

#: Series cut into chunks, and buckets in place of a sweep, give what the plain forms give.
ORACLE_SQL |= {name: ORACLE_SQL[name.split("_by_")[0]] for name in (
    "transitions_by_chunks", "steady_states_by_chunks", "pair_edges_by_chunks", "pair_outermost_by_chunks", "match_edges_by_chunks", "match_edges_by_buckets", "backfill_by_chunks", "paint_intervals_by_chunks",
    "on_intervals_by_chunks", "painted_scores_by_chunks", "labelled_pairs_by_chunks",
)}
