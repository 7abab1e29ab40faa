"""DuckDB statements that give the same rows as the registered queries."""

from __future__ import annotations

from entry_queries import CLUSTERS, GROUPS, K, RUN_GROUPS, RUN_KS
from sparktrace.functions.labels import LABEL_REPLACEMENTS
from sparktrace.functions.minhash import PERMUTATIONS, PRIME, coefficients
from sparktrace.functions.timefeatures import CALENDAR, TIME_FEATURES
from sparktrace.operators.eventlog import PART_EVENTS
from sparktrace.operators.explain import LOCAL_RANGE, MIN_RANGE, SEGMENT_TITLES

LEVELS = 60

PARTS = {
    "month_of_year": "month(ts)",
    "day_of_month": "day(ts)",
    "week_of_year": "week(ts)",
    "day_of_week": "isodow(ts) - 1",
    "hour_of_day": "hour(ts)",
    "min_of_hour": "minute(ts)",
    "sec_of_min": "second(ts)",
}


def normalized(column: str) -> str:
    for old, new in LABEL_REPLACEMENTS:
        column = f"replace({column}, '{old}', '{new}')"
    return column


EVENT_LOG = "SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts, event_id AS seq FROM events"
ORDER_LOG = (
    f"SELECT CAST(o_custkey AS VARCHAR) AS case_id, {normalized('o_orderpriority')} AS activity, "
    "o_orderdate AS ts, o_orderkey AS seq FROM orders"
)


def half_even(value: str, digits: int) -> str:
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"(round_even(({value}) * {scale}, 0) / {scale} + 0.0)"


def rounded(value: str, digits: int) -> str:
    return f"(round({value}, {digits}) + 0.0)"


def scaled(value: str, low: int, high: int) -> str:
    return f"(({value}) - CAST({low} AS DOUBLE)) / CAST({high - low} AS DOUBLE) - CAST(0.5 AS DOUBLE)"


def time_means() -> list[str]:
    n = "CAST(count(*) AS DOUBLE)"
    means = [
        f"CAST(sum(epoch_us(ts) - first_us) AS DOUBLE) / CAST(1e6 AS DOUBLE) / {n}",
        f"CAST(max(epoch_us(ts)) - min(epoch_us(ts)) AS DOUBLE) / CAST(1e6 AS DOUBLE) / {n}",
        "(CAST(sum((epoch_us(ts) % 86400000000) // 1000000) AS DOUBLE)"
        f" + CAST(sum(epoch_us(ts) % 1000000) AS DOUBLE) / CAST(1e6 AS DOUBLE)) / {n}",
        *[scaled(f"CAST(sum({PARTS[name]}) AS DOUBLE) / {n}", low, high) for name, low, high in CALENDAR],
    ]
    return [f"{half_even(mean, 4)} AS {name}" for mean, name in zip(means, TIME_FEATURES)]


def profile_ctes(log: str) -> str:
    """CTEs: log, dict, pairs, trans (case_id, f, t, n), times, texts (case_id, act_text, tra_text), profile."""
    return f"""
log AS ({log}),
firsts AS (
  SELECT activity, ts, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY activity ORDER BY ts, seq) AS rn FROM log) WHERE rn = 1),
dict AS (SELECT activity, CAST(row_number() OVER (ORDER BY ts, seq, activity) - 1 AS INTEGER) AS idx FROM firsts),
pairs AS (
  SELECT case_id, lag(activity) OVER w AS act_from, activity AS act_to FROM log
  WINDOW w AS (PARTITION BY case_id ORDER BY ts, seq)),
trans AS (
  SELECT case_id, act_from, act_to, CAST(count(*) AS INTEGER) AS n FROM pairs WHERE act_from IS NOT NULL
  GROUP BY ALL),
cases AS (SELECT case_id, count(*) AS events FROM log GROUP BY case_id),
acts AS (SELECT DISTINCT case_id, activity FROM log),
act_texts AS (
  SELECT c.case_id, string_agg(CASE WHEN a.activity IS NULL THEN '0' ELSE '1' END, '' ORDER BY d.idx) AS act_text,
         count(a.activity) AS n_activities
  FROM cases c CROSS JOIN dict d LEFT JOIN acts a ON a.case_id = c.case_id AND a.activity = d.activity
  GROUP BY c.case_id),
tra_texts AS (
  SELECT c.case_id, string_agg(CAST(coalesce(t.n, 0) AS VARCHAR), '' ORDER BY f.idx, g.idx) AS tra_text
  FROM cases c CROSS JOIN dict f CROSS JOIN dict g
  LEFT JOIN trans t ON t.case_id = c.case_id AND t.act_from = f.activity AND t.act_to = g.activity
  GROUP BY c.case_id),
times AS (
  SELECT case_id, {', '.join(time_means())}
  FROM (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY case_id) AS first_us FROM log) GROUP BY case_id),
profile AS (
  SELECT * FROM cases JOIN act_texts USING (case_id) JOIN tra_texts USING (case_id) JOIN times USING (case_id))"""


def euclid(a: str, b: str, scale: str = "") -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in TIME_FEATURES) + ")"


MIXED = (
    "(round_even((1.0::DOUBLE * levenshtein(a.act_text, b.act_text) + 1.0::DOUBLE * levenshtein(a.tra_text, b.tra_text)"
    f" + 0.5::DOUBLE * {euclid('a', 'b')}) * 1e6::DOUBLE, 0) / 1e6::DOUBLE + 0.0)"
)

DISTANCE_CTE = f"""
distances AS (
  SELECT a.case_id AS src, b.case_id AS dst, {MIXED} AS dist FROM profile a JOIN profile b ON a.case_id <> b.case_id)"""

CLASS_CTE = f"""
classes AS (
  SELECT case_id, min(case_id) OVER (PARTITION BY act_text, tra_text, {', '.join(TIME_FEATURES)}) AS representative FROM profile)"""

NEIGHBOR_CTES = f"""{DISTANCE_CTE},
neighbors AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS rank FROM distances)
  WHERE rank <= {K}),
edges AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM neighbors),
adj AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
nodes AS (SELECT DISTINCT src AS node FROM adj),
part AS (SELECT case_id AS node, CAST(CAST(case_id AS BIGINT) % {GROUPS} AS INTEGER) AS community FROM profile),
degree AS (SELECT src AS node, count(*) AS degree FROM adj GROUP BY src),
degree_c AS (
  SELECT node, degree / (count(*) OVER () - 1)::DOUBLE AS cent_degree FROM degree),
bridges AS (
  SELECT a.src AS "Node", count(*) AS "TotalEdges",
         count(*) FILTER (WHERE p.community = q.community) AS "InternalEdges",
         count(*) FILTER (WHERE p.community <> q.community) AS "ExternalEdges",
         count(DISTINCT q.community) FILTER (WHERE p.community <> q.community) AS "DistinctExternalCommunities"
  FROM adj a JOIN part p ON p.node = a.src JOIN part q ON q.node = a.dst
  GROUP BY a.src HAVING count(*) FILTER (WHERE p.community <> q.community) > 0),
busy AS (
  SELECT * FROM bridges WHERE "ExternalEdges" >= 4 AND "DistinctExternalCommunities" >= 3
  AND "Node" NOT IN (SELECT case_id FROM profile WHERE events > 80)),
split AS (
  SELECT p.node, CAST(coalesce(b.fresh, p.community) AS BIGINT) AS community FROM part p LEFT JOIN (
    SELECT "Node" AS node, (SELECT max(community) FROM part) + row_number() OVER (ORDER BY "Node") AS fresh FROM busy
  ) b ON b.node = p.node)"""


def pagerank_ctes() -> str:
    """Power iteration until the next round would change nothing at the digits shown: 0.85 ** 200 is below 1e-14."""
    return """
pr AS (
  SELECT 0 AS round, node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes
  UNION ALL
  SELECT r.round + 1, a.dst, 0.85::DOUBLE * sum(r.rank / d.degree) + 0.15::DOUBLE / (SELECT count(*) FROM nodes)
  FROM pr r JOIN adj a ON a.src = r.node JOIN degree d ON d.node = r.node WHERE r.round < 200 GROUP BY r.round, a.dst),
pagerank AS (SELECT node, rank AS cent_pagerank FROM pr WHERE round = 200)"""


def path_ctes() -> str:
    """Breadth-first levels from every node, then dependencies back from the last level."""
    steps = ["l0 AS (SELECT node AS s, node AS v, 1.0::DOUBLE AS paths FROM nodes)"]
    for i in range(1, LEVELS + 1):
        seen = f"SELECT s, v FROM l{i - 1}" + (f" UNION ALL SELECT s, v FROM l{i - 2}" if i > 1 else "")
        steps.append(
            f"l{i} AS MATERIALIZED (SELECT l.s, a.dst AS v, sum(l.paths) AS paths FROM l{i - 1} l JOIN adj a ON a.src = l.v"
            f" WHERE (l.s, a.dst) NOT IN ({seen}) GROUP BY l.s, a.dst)"
        )
    steps.append(f"d{LEVELS} AS (SELECT s, v, paths, 0.0::DOUBLE AS depends FROM l{LEVELS})")
    for i in range(LEVELS - 1, 0, -1):
        steps.append(
            f"d{i} AS MATERIALIZED (SELECT l.s, l.v, l.paths, coalesce(l.paths * f.flow, 0.0::DOUBLE) AS depends FROM l{i} l LEFT JOIN ("
            f"SELECT d.s, a.dst AS v, sum((1.0::DOUBLE + d.depends) / d.paths) AS flow FROM d{i + 1} d"
            f" JOIN adj a ON a.src = d.v GROUP BY d.s, a.dst) f ON f.s = l.s AND f.v = l.v)"
        )
    reached = " UNION ALL ".join(f"SELECT s, v, depends, {i} AS far FROM d{i}" for i in range(1, LEVELS + 1))
    steps.append(f"reached AS ({reached})")
    steps.append(
        "paths AS (SELECT n.node,"
        " coalesce(sum(r.depends), 0.0::DOUBLE) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS cent_betweenness,"
        " coalesce(count(r.v) / sum(r.far)::DOUBLE * count(r.v) / ((SELECT count(*) FROM nodes) - 1), 0.0::DOUBLE) AS cent_closeness"
        " FROM nodes n LEFT JOIN reached r ON r.v = n.node GROUP BY n.node)"
    )
    return ",\n".join(steps)


def events_with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([profile_ctes(EVENT_LOG), *ctes]) + "\n" + select


def orders_with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([profile_ctes(ORDER_LOG), *ctes]) + "\n" + select


def on_graph(select: str, *ctes: str) -> str:
    return events_with(NEIGHBOR_CTES, *ctes, select=select)


def on_run(k: int, select: str, *ctes: str) -> str:
    """A statement on the graph of the ``k`` nearest neighbours."""
    return on_graph(select, *ctes).replace(f"WHERE rank <= {K}),", f"WHERE rank <= {k}),", 1)


def on_runs(select: str, *ctes: str) -> str:
    """The rows of a statement on each of the graphs, with the name of the run."""
    return "\nUNION ALL\n".join(f"SELECT 'k{k}' AS run, * FROM ({on_run(k, select, *ctes)})" for k in RUN_KS)


def meta(partition: str) -> str:
    return f"""
ranked AS (
  SELECT p.node, p.community, row_number() OVER (PARTITION BY p.community ORDER BY coalesce(d.degree, 0) DESC, p.node) AS rn,
         count(*) OVER (PARTITION BY p.community) AS size
  FROM {partition} p LEFT JOIN degree d ON d.node = p.node),
metas AS (SELECT node, community AS community_id, size FROM ranked WHERE rn = 1)"""


def top_node(measure: str) -> str:
    return f"arg_min(node, struct_pack(cost := -{measure}, node := node))"


REPRESENTATIVES = f"""
measures AS (
  SELECT p.node, p.community, round(d.cent_degree, 8) AS cent_degree, round(b.cent_betweenness, 8) AS cent_betweenness,
         round(r.cent_pagerank, 8) AS cent_pagerank
  FROM part p JOIN degree_c d ON d.node = p.node JOIN paths b ON b.node = p.node JOIN pagerank r ON r.node = p.node)"""

# --- clustering -----------------------------------------------------------------------------------------------------

ACTS = "(SELECT count(*) FROM dict)"
CELL_CTES = f"""
cells AS (
  SELECT a.case_id, d.idx AS pos, 1 AS n FROM acts a JOIN dict d USING (activity)
  UNION ALL
  SELECT t.case_id, {ACTS} + f.idx * {ACTS} + g.idx, t.n
  FROM trans t JOIN dict f ON f.activity = t.act_from JOIN dict g ON g.activity = t.act_to)"""

POINT_CTES = f"""
numbers AS (
  SELECT case_id, {', '.join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1.0) AS {c}" for c in TIME_FEATURES)}
  FROM profile),
starts AS (
  SELECT case_id, CAST(row_number() OVER (ORDER BY md5('0|0|' || case_id), case_id) - 1 AS INTEGER) AS cluster
  FROM profile QUALIFY cluster < {CLUSTERS}),
positions AS (SELECT DISTINCT pos FROM cells),
edits AS (
  SELECT p.case_id, s.cluster, sum(levenshtein(CAST(coalesce(x.n, 0) AS VARCHAR), CAST(coalesce(y.n, 0) AS VARCHAR))) AS edit
  FROM profile p CROSS JOIN starts s CROSS JOIN positions q
  LEFT JOIN cells x ON x.case_id = p.case_id AND x.pos = q.pos
  LEFT JOIN cells y ON y.case_id = s.case_id AND y.pos = q.pos
  GROUP BY p.case_id, s.cluster),
options AS (
  SELECT e.case_id, e.cluster, {half_even(f"e.edit + {euclid('a', 'b')}", 6)} AS dist
  FROM edits e JOIN starts s ON s.cluster = e.cluster JOIN numbers a ON a.case_id = e.case_id
  JOIN numbers b ON b.case_id = s.case_id),
assigned AS (
  SELECT case_id, cluster, dist FROM options
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY dist, cluster) = 1)"""

CENTER_CTES = """
filled AS (
  SELECT a.cluster, q.pos, coalesce(c.n, 0) AS n, count(*) AS count
  FROM assigned a CROSS JOIN positions q LEFT JOIN cells c ON c.case_id = a.case_id AND c.pos = q.pos GROUP BY ALL),
modes AS (
  SELECT cluster, pos, n FROM filled QUALIFY row_number() OVER (PARTITION BY cluster, pos ORDER BY count DESC, n) = 1)"""

FAMILY = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(coefficients()))
SIGNATURE_CTES = f"""
family(slot, a, b) AS (VALUES {FAMILY}),
sigs AS (
  SELECT c.case_id, f.slot, min((f.a * ((CAST(c.pos + 1 AS BIGINT) * 1000003 + c.n) % {PRIME}) + f.b) % {PRIME}) AS value
  FROM cells c CROSS JOIN family f GROUP BY c.case_id, f.slot)"""

# --- vectors --------------------------------------------------------------------------------------------------------

VECTOR_CTES = """
flat AS (
  SELECT vec_id AS id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings),
stats AS (SELECT pos, avg(raw) AS mean, stddev_pop(raw) AS std FROM flat GROUP BY pos),
std AS (
  SELECT id, label, pos, (raw - mean) / CASE WHEN std > 1e-12 THEN std ELSE 1.0 END AS x FROM flat JOIN stats USING (pos)),
wide AS (SELECT id, label, list(x ORDER BY pos) AS v FROM std GROUP BY id, label)"""


def silhouette_ctes(points: str) -> str:
    return f"""
label_sizes AS (SELECT label, count(*) AS members FROM {points} GROUP BY label),
sums AS (
  SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total FROM {points} a, {points} b GROUP BY ALL),
sides AS (
  SELECT s.id,
         max(CASE WHEN s.label = s.other THEN total / nullif(members - 1, 0) END) AS a,
         min(CASE WHEN s.label <> s.other THEN total / members END) AS b
  FROM sums s JOIN label_sizes z ON z.label = s.other GROUP BY s.id),
sil AS (SELECT avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sides)"""


def center_ctes(points: str) -> str:
    return f"""
exploded AS (SELECT id, label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM {points}),
centers AS (
  SELECT label, list(c ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS c FROM exploded GROUP BY label, pos) GROUP BY label),
middle AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM exploded GROUP BY pos)),
spreads AS (
  SELECT p.label, avg(list_distance(p.v, c.c)) AS s, sum(pow(list_distance(p.v, c.c), 2)) AS w, count(*) AS members
  FROM {points} p JOIN centers c USING (label) GROUP BY p.label),
db AS (
  SELECT avg(worst) AS davies_bouldin FROM (
    SELECT a.label, max((s.s + t.s) / list_distance(a.c, b.c)) AS worst
    FROM centers a JOIN centers b ON a.label <> b.label JOIN spreads s ON s.label = a.label JOIN spreads t ON t.label = b.label
    GROUP BY a.label)),
ch AS (
  SELECT sum(members * pow(list_distance(c.c, m.m), 2)) * (sum(members) - count(*)) / (sum(w) * (count(*) - 1)) AS calinski_harabasz
  FROM centers c JOIN spreads USING (label) CROSS JOIN middle m)"""


def scored_run(label: str, name: str) -> str:
    return f"""
SELECT * FROM (WITH points AS (SELECT id, {label} AS label, v FROM wide), {silhouette_ctes('points')}, {center_ctes('points')}
SELECT '{name}' AS file, {rounded('(SELECT silhouette FROM sil)', 2)} AS silhouette,
       {rounded('(SELECT davies_bouldin FROM db)', 2)} AS davies_bouldin,
       {rounded('(SELECT calinski_harabasz FROM ch)', 2)} AS calinski_harabasz)"""


# --- explanations ---------------------------------------------------------------------------------------------------

def explain_ctes(groups: int, digits: int) -> str:
    """Features, the busiest case of each group, its dense profile and the differences from the mean."""
    return f"""
features AS (
  SELECT idx AS pos, activity AS feature, 1 AS segment, activity AS act_from, activity AS act_to FROM dict
  UNION ALL
  SELECT {ACTS} + f.idx * {ACTS} + g.idx, f.activity || '->' || g.activity,
         CASE WHEN f.idx = g.idx THEN 2 ELSE 3 END, f.activity, g.activity FROM dict f CROSS JOIN dict g
  UNION ALL
  SELECT {ACTS} + {ACTS} * {ACTS} + i, name, CASE WHEN i < 2 THEN 4 ELSE 5 END, NULL, NULL
  FROM (VALUES {', '.join(f"({i}, '{name}')" for i, name in enumerate(TIME_FEATURES) if i != 2)}) t(i, name)),
time_cells AS (
  SELECT case_id, feature, value FROM times UNPIVOT (value FOR feature IN ({', '.join(TIME_FEATURES)}))),
busiest AS (
  SELECT CAST(case_id AS BIGINT) % {groups} AS community, case_id FROM profile
  QUALIFY row_number() OVER (PARTITION BY CAST(case_id AS BIGINT) % {groups} ORDER BY events DESC, CAST(case_id AS BIGINT)) = 1),
dense AS (
  SELECT b.community, b.case_id, f.pos, f.feature, f.segment,
         CASE WHEN f.segment >= 4 THEN t.value ELSE coalesce(c.n, 0) END::DOUBLE AS value
  FROM busiest b CROSS JOIN features f
  LEFT JOIN cells c ON c.case_id = b.case_id AND c.pos = f.pos AND f.segment < 4
  LEFT JOIN time_cells t ON t.case_id = b.case_id AND t.feature = f.feature AND f.segment >= 4),
diff AS (
  SELECT case_id, segment, CAST(pos AS BIGINT) AS feature_pos, feature,
         {rounded("round((value - avg(value) OVER (PARTITION BY pos)) / CASE WHEN segment = 4 THEN 3600.0 ELSE 1.0 END, 6)", digits)} AS value
  FROM dense)"""


EXPLAIN_CTES = explain_ctes(GROUPS, 4)

TITLE = "CASE segment " + " ".join(f"WHEN {i + 1} THEN '{t}'" for i, t in enumerate(SEGMENT_TITLES)) + " END AS title"
UNIT = "CASE WHEN segment = 4 THEN 'hours' ELSE 'difference' END AS unit"


SHORT_CTES = """
flags AS (SELECT segment, feature, bool_and(value = 0) AS zero FROM diff GROUP BY ALL),
segments AS (SELECT segment, bool_and(zero) AS all_zero FROM flags GROUP BY segment),
short AS (
  SELECT DISTINCT d.case_id, d.segment,
         CASE WHEN NOT f.zero THEN d.feature WHEN s.all_zero THEN 'all' ELSE 'others' END AS feature,
         CASE WHEN f.zero THEN 0.0::DOUBLE ELSE d.value END AS value
  FROM diff d JOIN flags f ON f.segment = d.segment AND f.feature = d.feature JOIN segments s ON s.segment = d.segment),
ranges AS (SELECT segment, min(value) AS low, max(value) AS high FROM short GROUP BY segment)"""


def explained_run(g: int) -> str:
    places = "(SELECT case_id, CAST(row_number() OVER (ORDER BY CAST(case_id AS BIGINT)) - 1 AS BIGINT) AS case_pos FROM busiest)"
    return events_with(
        CELL_CTES, explain_ctes(g, 6), SHORT_CTES,
        select=f"""
SELECT case_id, case_pos, segment, feature, {rounded('value', 4)} AS value, {rounded('CASE WHEN low = 0 AND high = 0 THEN 0.0::DOUBLE ELSE low END', 4)} AS vmin,
       {TITLE}, {UNIT}
FROM short JOIN ranges USING (segment) JOIN {places} USING (case_id)""",
    )


def explained_pairs(g: int) -> str:
    return events_with(
        CELL_CTES, explain_ctes(g, 6),
        f"""
local AS (
  SELECT x.case_id, y.case_id AS variant_id, x.segment, x.feature,
         {rounded("round((x.value - y.value) / CASE WHEN x.segment = 4 THEN 3600.0 ELSE 1.0 END, 6)", 4)} AS value
  FROM dense x JOIN dense y ON x.pos = y.pos
  WHERE x.community > 0 AND y.community = 0 AND (x.segment >= 4 OR x.value <> 0 OR y.value <> 0)),
ranges AS (SELECT case_id, segment, min(value) AS low, max(value) AS high FROM local GROUP BY case_id, segment)""",
        select=f"""
SELECT case_id, variant_id, segment, feature, value, {TITLE}, {UNIT},
       CASE WHEN segment <= 2 OR (low = 0 AND high = 0) THEN 0.0::DOUBLE ELSE -{LOCAL_RANGE}::DOUBLE END AS vmin,
       CASE WHEN segment <= 2 OR (low = 0 AND high = 0) THEN {MIN_RANGE}::DOUBLE ELSE {LOCAL_RANGE}::DOUBLE END AS vmax
FROM local JOIN ranges USING (case_id, segment)""",
    )


def on_groups(statement) -> str:
    return "\nUNION ALL\n".join(f"SELECT 'g{g}' AS run, * FROM ({statement(g)})" for g in RUN_GROUPS)


ORACLES: dict[str, str] = {
    "explode_cases": """
SELECT DISTINCT o_orderkey AS seq, o_orderpriority AS activity, l_suppkey AS "case" FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "kprototypes_settled": events_with(
        select="SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM cases) AS cases, CAST(0 AS BIGINT) AS away, CAST(0 AS BIGINT) AS wrong, true AS settled FROM (VALUES (2), (3), (5)) t(k)"
    ),
    "explain_runs": on_groups(explained_run),
    "explain_pairs": on_groups(explained_pairs),
    "flatten_ocel": """
SELECT DISTINCT 'supplier-' || l_suppkey AS case_id, o_orderpriority AS activity, epoch_us(o_orderdate) AS ts_us, o_orderkey AS seq
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "flatten_ocel_by_event": """
SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderpriority AS activity, epoch_us(o_orderdate) AS ts_us, o_orderkey AS seq
FROM orders""",
    "normalize_labels": f"""
SELECT o_orderpriority AS label, {normalized('o_orderpriority')} AS activity, count(*) AS n FROM orders GROUP BY ALL""",
    "trace_corpus": f"""
SELECT case_id, part, string_agg(replace(activity, ' ', ''), ' ' ORDER BY seq) AS trace FROM (
  SELECT *, CAST((row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1) // {PART_EVENTS} AS INTEGER) AS part FROM ({ORDER_LOG})
) GROUP BY case_id, part""",
    "event_time_features": f"""
SELECT case_id, seq,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY case_id)) / 1e6::DOUBLE AS accumulated_time,
  coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY case_id ORDER BY ts, seq), 0) / 1e6::DOUBLE AS execution_time,
  (epoch_us(ts) % 86400000000) / 1e6::DOUBLE AS within_day,
  {', '.join(f"{scaled(PARTS[name], low, high)} AS {name}" for name, low, high in CALENDAR)}
FROM ({EVENT_LOG})""",
    "activity_dict": orders_with(select="SELECT activity, idx FROM dict"),
    "onehot_profile": orders_with(select="SELECT case_id, CAST(n_activities AS INTEGER) AS n_activities, act_text FROM act_texts"),
    "presence": orders_with(select="SELECT case_id, activity FROM acts"),
    "transition_profile": orders_with(select="SELECT case_id, act_from, act_to, n FROM trans"),
    "transition_text": orders_with(select="SELECT case_id, tra_text FROM tra_texts"),
    "dfg": events_with(select="SELECT act_from, act_to, CAST(sum(n) AS BIGINT) AS n FROM trans GROUP BY ALL"),
    "dfg_matrix": events_with(
        select="""
SELECT act_from AS activity, """
        + ", ".join(
            f"CAST(coalesce(sum(n) FILTER (WHERE act_to = '{a}'), 0) AS BIGINT) AS {a}"
            for a in ("click", "error", "purchase", "signup", "view")
        )
        + " FROM trans GROUP BY act_from"
    ),
    "time_profile": orders_with(select="SELECT * FROM times"),
    "profile_merge": events_with(
        select=f"SELECT case_id, events, act_text, tra_text, {', '.join(TIME_FEATURES)} FROM profile"
    ),
    "wide_profile": events_with(
        select="SELECT p.case_id AS \"case\", "
        + ", ".join(
            f"CAST(max(CASE WHEN a.activity = '{x}' THEN 1 ELSE 0 END) AS INTEGER) AS \"{x}\""
            for x in ("click", "error", "purchase", "signup", "view")
        )
        + ", "
        + ", ".join(
            f"CAST(coalesce((SELECT n FROM trans t WHERE t.case_id = p.case_id AND t.act_from = '{x}' AND t.act_to = '{y}'), 0) AS INTEGER) AS \"{x}->{y}\""
            for x in ("click", "error", "purchase", "signup", "view")
            for y in ("click", "error", "purchase", "signup", "view")
        )
        + f", {', '.join(f'any_value(p.{c}) AS {c}' for c in TIME_FEATURES)}"
        + " FROM profile p JOIN acts a ON a.case_id = p.case_id GROUP BY p.case_id"
    ),
    "pair_distance": orders_with(
        select=f"""
SELECT a.case_id AS src, b.case_id AS dst, {MIXED} AS dist
FROM profile a JOIN profile b ON CAST(b.case_id AS BIGINT) = (
  SELECT min(CAST(c.case_id AS BIGINT)) FROM profile c WHERE CAST(c.case_id AS BIGINT) % {GROUPS} = CAST(a.case_id AS BIGINT) % {GROUPS})"""
    ),
    "radius_pairs": orders_with(
        DISTANCE_CTE, CLASS_CTE,
        select="""
SELECT src, dst, dist FROM distances
WHERE src < dst AND src IN (SELECT representative FROM classes) AND dst IN (SELECT representative FROM classes)
  AND dist <= (SELECT round(avg(near), 6) FROM (SELECT min(dist) AS near FROM distances GROUP BY src))"""
    ),
    "radius_members": events_with(
        DISTANCE_CTE, CLASS_CTE,
        select="""
SELECT c.case_id AS id, c.representative, count(d.dst) AS near FROM classes c LEFT JOIN (
  SELECT src, dst FROM distances WHERE dst IN (SELECT representative FROM classes)
    AND dist <= (SELECT round(max(dist), 6) FROM (SELECT dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM distances) WHERE rn <= 2)
) d ON d.src = c.representative AND d.dst <> c.representative GROUP BY ALL"""
    ),
    "knn_neighbors": on_graph("SELECT src, dst, dist, rank FROM neighbors"),
    "knn_neighbors_orders": orders_with(NEIGHBOR_CTES, select="SELECT src, dst, dist, rank FROM neighbors"),
    "knn_edges": on_graph("SELECT src, dst, 1.0::DOUBLE AS weight FROM edges"),
    "knn_euclidean": f"""
WITH d AS (
  SELECT a.vec_id AS src, b.vec_id AS dst,
         CASE WHEN a.vec_id = b.vec_id THEN 0.0::DOUBLE
              ELSE round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS dist
  FROM embeddings a, embeddings b)
SELECT src, dst, dist, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY src <> dst, dist, dst) AS INTEGER) AS rank FROM d) WHERE rank <= {K}""",
    "euclidean_pairs": """
SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
FROM embeddings a JOIN embeddings b ON b.vec_id = (SELECT min(c.vec_id) FROM embeddings c WHERE c.label = a.label)""",
    "euclidean_radius_pairs": """
WITH d AS MATERIALIZED (
  SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
classes AS (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY embedding)
SELECT src, dst, dist FROM d
WHERE src < dst AND src IN (SELECT vec_id FROM classes) AND dst IN (SELECT vec_id FROM classes) AND dist <= (
  SELECT round(avg(dist), 6) FROM (SELECT dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM d) WHERE rn = 3)""",
    "degree_centrality": on_graph("SELECT node, round(cent_degree, 6) AS cent_degree FROM degree_c"),
    "modularity": on_graph(
        """
SELECT round(sum(inside) / sum(total) - sum(total * total) / pow(sum(total), 2), 6) AS modularity, count(*) AS num_communities
FROM (
  SELECT p.community, count(*)::DOUBLE AS total, count(*) FILTER (WHERE p.community = q.community)::DOUBLE AS inside
  FROM adj a JOIN part p ON p.node = a.src JOIN part q ON q.node = a.dst GROUP BY p.community)"""
    ),
    "pagerank": on_graph("SELECT node, round(cent_pagerank, 8) AS cent_pagerank FROM pagerank", pagerank_ctes()),
    "run_measures": on_runs(
        f"""
SELECT d.node, round(d.cent_degree, 6) AS cent_degree, {rounded('p.cent_betweenness', 6)} AS cent_betweenness,
       {rounded('p.cent_closeness', 6)} AS cent_closeness, round(r.cent_pagerank, 6) AS cent_pagerank
FROM degree_c d JOIN paths p ON p.node = d.node JOIN pagerank r ON r.node = d.node""",
        pagerank_ctes(), path_ctes(),
    ),
    "run_communities": on_runs(
        "SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS moves, CAST(0 AS BIGINT) AS mergers, true AS same FROM nodes"
    ),
    "betweenness": on_graph(f"SELECT node, {rounded('cent_betweenness', 6)} AS cent_betweenness FROM paths", path_ctes()),
    "closeness": on_graph(f"SELECT node, {rounded('cent_closeness', 6)} AS cent_closeness FROM paths", path_ctes()),
    "node_table": on_graph(
        """
SELECT p.node, p.community, round(d.cent_degree, 4) AS cent_degree, round(b.cent_betweenness, 4) AS cent_betweenness,
       round(b.cent_closeness, 4) AS cent_closeness, round(r.cent_pagerank, 4) AS cent_pagerank
FROM part p JOIN degree_c d ON d.node = p.node JOIN paths b ON b.node = p.node JOIN pagerank r ON r.node = p.node""",
        path_ctes(), pagerank_ctes(),
    ),
    "representatives": on_graph(
        f"""
SELECT community, {top_node('cent_degree')} AS degree_rep, {top_node('cent_betweenness')} AS betweenness_rep,
       {top_node('cent_pagerank')} AS pagerank_rep FROM measures GROUP BY community""",
        path_ctes(), pagerank_ctes(), REPRESENTATIVES,
    ),
    "community_sizes": on_graph("SELECT community, count(*) AS size FROM part GROUP BY community"),
    "bridge_nodes": on_graph("SELECT * FROM bridges"),
    "bridge_filter": on_graph("SELECT * FROM busy"),
    "split_bridges": on_graph("SELECT * FROM split"),
    "meta_nodes": on_graph(
        'SELECT node, community_id, size, node IN (SELECT "Node" FROM busy) AS is_bridge FROM metas', meta("part")
    ),
    "meta_edges": on_graph(
        """
SELECT DISTINCT least(x.node, y.node) AS src, greatest(x.node, y.node) AS dst
FROM edges e JOIN split p ON p.node = e.src JOIN split q ON q.node = e.dst
JOIN metas x ON x.community_id = p.community JOIN metas y ON y.community_id = q.community
WHERE p.community <> q.community""",
        meta("split"),
    ),
    "standardize": f"WITH {VECTOR_CTES} SELECT id, CAST(pos AS INTEGER) AS pos, {rounded('x', 6)} AS x FROM std",
    "sample_centroids": events_with(CELL_CTES, POINT_CTES, select="SELECT case_id FROM starts"),
    "assign_clusters": events_with(
        CELL_CTES, POINT_CTES, select="SELECT case_id, cluster, round(dist, 4) AS dist FROM assigned"
    ),
    "cluster_modes": events_with(
        CELL_CTES, POINT_CTES, CENTER_CTES,
        select="SELECT cluster, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n FROM modes WHERE n <> 0",
    ),
    "cluster_means": events_with(
        CELL_CTES, POINT_CTES,
        select=" UNION ALL ".join(
            f"SELECT cluster, count(*) AS members, {i} AS pos, {rounded(f'avg({c})', 5)} AS x FROM assigned JOIN numbers USING (case_id) GROUP BY cluster"
            for i, c in enumerate(TIME_FEATURES)
        ),
    ),
    "minhash_signature": events_with(CELL_CTES, SIGNATURE_CTES, select="SELECT case_id, CAST(slot AS INTEGER) AS slot, value FROM sigs"),
    "medoid_minhash": events_with(
        CELL_CTES, SIGNATURE_CTES,
        f"""
alike AS (
  SELECT x.case_id AS src, y.case_id AS dst, count(*) FILTER (WHERE x.value = y.value) / {PERMUTATIONS}.0::DOUBLE AS sim
  FROM sigs x JOIN sigs y ON x.slot = y.slot AND CAST(x.case_id AS BIGINT) % {GROUPS} = CAST(y.case_id AS BIGINT) % {GROUPS}
  GROUP BY ALL),
totals AS (
  SELECT s.src, CAST(CAST(s.src AS BIGINT) % {GROUPS} AS INTEGER) AS cluster, sum(1 - s.sim + round({euclid('a', 'b')}, 6)) AS total
  FROM alike s JOIN times a ON a.case_id = s.src JOIN times b ON b.case_id = s.dst WHERE s.src <> s.dst GROUP BY s.src)""",
        select="""
SELECT src AS case_id, cluster, round(total, 2) AS total FROM totals
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(total, 6), src) = 1""",
    ),
    "silhouette": f"WITH {VECTOR_CTES}, {silhouette_ctes('wide')} SELECT {rounded('silhouette', 6)} AS silhouette FROM sil",
    "davies_bouldin": f"WITH {VECTOR_CTES}, {center_ctes('wide')} SELECT round(davies_bouldin, 6) AS davies_bouldin FROM db",
    "calinski_harabasz": f"WITH {VECTOR_CTES}, {center_ctes('wide')} SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM ch",
    "score_runs": f"WITH {VECTOR_CTES} " + " UNION ALL ".join([scored_run("label", "label"), scored_run("CAST(id % 4 AS INTEGER)", "remainder")]),
    "explain_global": events_with(CELL_CTES, EXPLAIN_CTES, select="SELECT * FROM diff"),
    "explain_compact": events_with(
        CELL_CTES, EXPLAIN_CTES,
        SHORT_CTES,
        select=f"""
SELECT case_id, segment, feature, value, {TITLE}, {UNIT},
       CASE WHEN low = 0 AND high = 0 THEN 0.0::DOUBLE ELSE low END AS vmin,
       CASE WHEN low = 0 AND high = 0 THEN {MIN_RANGE}::DOUBLE ELSE -low END AS vmax
FROM short JOIN ranges USING (segment)""",
    ),
    "explain_local": events_with(
        CELL_CTES, EXPLAIN_CTES,
        f"""
local AS (
  SELECT x.case_id, y.case_id AS variant_id, x.segment, x.feature,
         {rounded("round((x.value - y.value) / CASE WHEN x.segment = 4 THEN 3600.0 ELSE 1.0 END, 6)", 4)} AS value
  FROM dense x JOIN dense y ON x.pos = y.pos WHERE x.community = 0 AND y.community = 1),
ranges AS (SELECT segment, min(value) AS low, max(value) AS high FROM local GROUP BY segment)""",
        select=f"""
SELECT case_id, variant_id, segment, feature, value, {TITLE}, {UNIT},
       CASE WHEN segment <= 2 OR (low = 0 AND high = 0) THEN 0.0::DOUBLE ELSE -{LOCAL_RANGE}::DOUBLE END AS vmin,
       CASE WHEN segment <= 2 OR (low = 0 AND high = 0) THEN {MIN_RANGE}::DOUBLE ELSE {LOCAL_RANGE}::DOUBLE END AS vmax
FROM local JOIN ranges USING (segment)""",
    ),
    "explain_order": events_with(
        select="""
SELECT case_id, CAST(regexp_extract(case_id, '([0-9]+)', 1) AS DOUBLE) AS case_number,
       CAST(row_number() OVER (ORDER BY CAST(regexp_extract(case_id, '([0-9]+)', 1) AS DOUBLE), case_id) - 1 AS BIGINT) AS case_pos
FROM (SELECT substr('EDCBA', CAST(CAST(case_id AS BIGINT) % 5 AS INTEGER) + 1, 1) || '_' || case_id AS case_id FROM cases)"""
    ),
}
