"""The same computations as DuckDB SQL: graph collections, unrolled refinement, and what follows from it."""

from __future__ import annotations

#: Vertices v(vid, gid, label) and symmetric edges e(src, dst, gid, label) of each graph collection.
FIXTURES = {
    "ep": """
ev AS (SELECT user_id AS gid, ts, event_id, event_type AS label, count(*) OVER (PARTITION BY user_id) AS n FROM events),
v AS (SELECT row_number() OVER (ORDER BY gid, ts, event_id) - 1 AS vid, gid, label FROM ev WHERE n > 1),
half AS (SELECT a.vid AS src, b.vid AS dst, a.gid, NULL::VARCHAR AS label FROM v a JOIN v b ON a.gid = b.gid AND b.vid = a.vid + 1),
e AS (SELECT src, dst, gid, label FROM half UNION ALL SELECT dst, src, gid, label FROM half),
g AS (SELECT user_id AS gid, CAST(CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) > 0 AS INT) AS VARCHAR) AS graph_label FROM events GROUP BY user_id)""",
    "cp": """
ev AS (SELECT conv_id AS gid, turn, role AS label, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
v AS (SELECT row_number() OVER (ORDER BY gid, turn, label) - 1 AS vid, gid, label FROM ev WHERE n > 1),
half AS (SELECT a.vid AS src, b.vid AS dst, a.gid, NULL::VARCHAR AS label FROM v a JOIN v b ON a.gid = b.gid AND b.vid = a.vid + 1),
e AS (SELECT src, dst, gid, label FROM half UNION ALL SELECT dst, src, gid, label FROM half),
g AS (SELECT conv_id AS gid, CAST(count(*) % 2 AS VARCHAR) AS graph_label FROM conversations GROUP BY conv_id)""",
    "os": """
pairs AS (SELECT l_orderkey AS gid, l_partkey AS p, max(l_returnflag) AS label FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2),
nodes AS (SELECT DISTINCT gid, 0 AS kind, gid AS k, 'order' AS label FROM pairs UNION ALL SELECT gid, 1, p, p_brand FROM pairs JOIN part ON p = p_partkey),
v AS (SELECT row_number() OVER (ORDER BY gid, kind, k) - 1 AS vid, gid, kind, k, label FROM nodes),
half AS (SELECT a.vid AS src, b.vid AS dst, p.gid, p.label FROM pairs p JOIN v a ON a.gid = p.gid AND a.kind = 0 JOIN v b ON b.gid = p.gid AND b.kind = 1 AND b.k = p.p),
e AS (SELECT src, dst, gid, label FROM half UNION ALL SELECT dst, src, gid, label FROM half),
g AS (SELECT o_orderkey AS gid, o_orderpriority AS graph_label FROM orders)""",
    "cs": """
pairs AS (SELECT DISTINCT c_nationkey::BIGINT AS gid, o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
nodes AS (SELECT DISTINCT gid, 0 AS kind, c AS k, c_mktsegment AS label FROM pairs JOIN customer ON c = c_custkey UNION ALL SELECT DISTINCT gid, 1, s, 'supplier' FROM pairs),
v AS (SELECT row_number() OVER (ORDER BY gid, kind, k) - 1 AS vid, gid, kind, k, label FROM nodes),
half AS (SELECT a.vid AS src, b.vid AS dst, p.gid, NULL::VARCHAR AS label FROM pairs p JOIN v a ON a.gid = p.gid AND a.kind = 0 AND a.k = p.c JOIN v b ON b.gid = p.gid AND b.kind = 1 AND b.k = p.s),
e AS (SELECT src, dst, gid, label FROM half UNION ALL SELECT dst, src, gid, label FROM half),
g AS (SELECT n_nationkey::BIGINT AS gid, CAST(n_regionkey AS VARCHAR) AS graph_label FROM nation)""",
}


def initial(labelled: bool = True) -> str:
    """c0(vid, gid, cls, color)."""
    if not labelled:
        return "c0 AS (SELECT vid, gid, 0 AS cls, 0 AS color FROM v)"
    return """
f0 AS (SELECT vid, gid, min(vid) OVER (PARTITION BY label) AS cls FROM v),
c0 AS (SELECT vid, gid, cls, dense_rank() OVER (ORDER BY cls) AS color FROM f0)"""


def wl(step: int, edge_labels: bool = False) -> str:
    """c<step> from the level before; colours are numbered on from the largest so far."""
    k, b = step, step - 1
    key = "{'c': c.cls, 'l': e.label}" if edge_labels else "c.cls"
    return f"""
n{k} AS (SELECT e.src, list_sort(list({key})) AS sig FROM e JOIN c{b} c ON e.dst = c.vid GROUP BY e.src),
s{k} AS (SELECT c.vid, c.gid, c.cls AS own, n.sig FROM c{b} c LEFT JOIN n{k} n ON n.src = c.vid),
f{k} AS (SELECT vid, gid, min(vid) OVER (PARTITION BY own, sig) AS cls FROM s{k}),
c{k} AS (SELECT vid, gid, cls, (SELECT max(color) FROM c{b}) + dense_rank() OVER (ORDER BY cls) AS color FROM f{k})"""


def stack(upto: int) -> str:
    """st(step, vid, gid, color)."""
    return "st AS (" + " UNION ALL ".join(f"SELECT {k} AS step, vid, gid, color FROM c{k}" for k in range(upto + 1)) + ")"


def qsc0(labelled: bool = True) -> str:
    """b0(vid, gid, block)."""
    return "b0 AS (SELECT vid, gid, color - 1 AS block FROM c0)" if labelled else "b0 AS (SELECT vid, gid, color AS block FROM c0)"


def qsc_statistics(step: int, weight: str = "1.0") -> str:
    """x<step>(bi, bj, n, s, upper, lower, error), d<step>(vid, bj, d)."""
    k = step
    return f"""
d{k} AS (SELECT e.src AS vid, b.block AS bj, count(*)::DOUBLE AS d FROM e JOIN b{k} b ON e.dst = b.vid GROUP BY 1, 2),
z{k} AS (SELECT block AS bi, count(*) AS n FROM b{k} GROUP BY 1),
y{k} AS (SELECT b.block AS bi, d.bj, max(d) AS hi, min(d) AS lo, count(*) AS c, sum(d) AS s FROM d{k} d JOIN b{k} b USING (vid) GROUP BY 1, 2),
x{k} AS (SELECT bi, bj, n, s, hi AS upper, CASE WHEN c < n THEN least(lo, 0.0) ELSE lo END AS lower,
         (hi - CASE WHEN c < n THEN least(lo, 0.0) ELSE lo END) * {weight} AS error FROM y{k} JOIN z{k} USING (bi))"""


def qsc_step(step: int) -> str:
    """w<step-1> witnesses and b<step> blocks; needs the statistics of the level before."""
    k, p = step, step - 1
    return f"""
w{p} AS (SELECT bi, bj, n, s, error FROM x{p} WHERE error >= (SELECT max(error) FROM x{p})),
t{p} AS (SELECT b.vid, list_sort(list({{'j': w.bj, 'bit': coalesce(d.d, 0.0) * w.n > w.s}})) AS sig FROM b{p} b JOIN w{p} w ON w.bi = b.block LEFT JOIN d{p} d ON d.vid = b.vid AND d.bj = w.bj GROUP BY b.vid),
u{p} AS (SELECT b.vid, b.gid, b.block, t.sig FROM b{p} b LEFT JOIN t{p} t USING (vid)),
h{p} AS (SELECT vid, gid, block, min(vid) OVER (PARTITION BY block, sig) AS first, min(vid) OVER (PARTITION BY block) AS head FROM u{p}),
r{p} AS (SELECT block, first, (SELECT max(block) FROM b{p}) + row_number() OVER (ORDER BY block, first) AS new FROM (SELECT DISTINCT block, first FROM h{p} WHERE first <> head)),
b{k} AS (SELECT h.vid, h.gid, coalesce(r.new, h.block) AS block FROM h{p} h LEFT JOIN r{p} r ON r.block = h.block AND r.first = h.first)"""


def gradual(step: int, colors: range, k: int, turns: int, start: str, seed: int = 4321, restarts: int = 1, by_head: bool = False) -> str:
    """c<step>(vid, gid, color): one gradual step without edge labels from the level before, whose colours lie in ``colors``. ``start``: ``first``,
    ``kmeans++`` (two clusters) or ``forgy``. Means are cut to whole numbers; turns are unrolled (more than it needs change nothing).
    New colours go by old colour and cluster; with ``by_head`` old colours go by their first vertex."""
    z, b = step, step - 1
    n = [f"n{i}" for i in colors]
    every = ", ".join(n)
    apart = lambda p, m: " + ".join(f"({p}.{x} - {m}.{x}) * ({p}.{x} - {m}.{x})" for x in n)
    draw = lambda r, turn, i: f"(('0x' || substr(md5('{seed}:' || {r} || ':{turn}:' || {i}), 1, 13))::BIGINT + 1) / 4503599627370496.0"
    own = ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in n)
    out = f"""
h{z} AS (SELECT c.vid, c.gid, c.color, min(c.vid) OVER (PARTITION BY c.color) AS head, {", ".join(f"coalesce(sum(CAST(d.color = {i} AS INT)), 0) AS n{i}" for i in colors)}
       FROM c{b} c LEFT JOIN e ON e.src = c.vid LEFT JOIN c{b} d ON d.vid = e.dst GROUP BY c.vid, c.gid, c.color),
p{z} AS (SELECT color, {every}, count(*) AS w, min(vid) AS i FROM h{z} GROUP BY color, {every})"""
    if start == "kmeans++":
        out += f""",
i{z} AS (SELECT color, {every}, i FROM p{z} QUALIFY row_number() OVER (PARTITION BY color ORDER BY {draw(0, 0, "i")}, i) = 1),
j{z} AS (SELECT p.*, {apart("p", "f")} AS near FROM p{z} p JOIN i{z} f USING (color)),
m{z}_0 AS (SELECT 0 AS r, 0 AS c, color, {own} FROM i{z} UNION ALL
  SELECT 0, 1, color, {own} FROM (SELECT * FROM j{z} WHERE near > 0 QUALIFY row_number() OVER (PARTITION BY color ORDER BY -(ln({draw(0, 1, "i")}) / near), i) = 1))"""
    else:
        order = every if start == "first" else f"{draw('r', 0, 'i')}, i"
        out += f""",
m{z}_0 AS (SELECT CAST(r AS INT) AS r, row_number() OVER (PARTITION BY color, r ORDER BY {order}) - 1 AS c, color, {own} FROM p{z}, range({restarts}) x(r) QUALIFY c < {k})"""
    for t in range(1, turns + 1):
        out += f""",
a{z}_{t} AS (SELECT p.*, m.r, m.c FROM p{z} p JOIN m{z}_{t - 1} m ON m.color = p.color
         QUALIFY row_number() OVER (PARTITION BY p.color, p.i, m.r ORDER BY {apart("p", "m")}, m.c) = 1),
m{z}_{t} AS (SELECT m.r, m.c, m.color, {", ".join(f"coalesce(trunc(sum(a.w * a.{x}) / sum(a.w)), min(m.{x})) AS {x}" for x in n)}
         FROM m{z}_{t - 1} m LEFT JOIN a{z}_{t} a ON a.color = m.color AND a.c = m.c AND a.r = m.r GROUP BY m.r, m.c, m.color)"""
    same = " AND ".join(f"a.{x} = h.{x}" for x in n)
    return out + f""",
s{z} AS (SELECT a.color, a.r, sum(a.w * ({apart("a", "m")}) * ({apart("a", "m")})) AS score FROM a{z}_{turns} a JOIN m{z}_{turns} m ON m.color = a.color AND m.c = a.c AND m.r = a.r GROUP BY a.color, a.r),
b{z}_best AS (SELECT color, r FROM s{z} QUALIFY row_number() OVER (PARTITION BY color ORDER BY score, r) = 1),
c{z} AS (SELECT h.vid, h.gid, (SELECT max(color) FROM c{b}) + dense_rank() OVER (ORDER BY {"h.head" if by_head else "h.color"}, a.c) AS color
         FROM h{z} h JOIN b{z}_best s ON s.color = h.color JOIN a{z}_{turns} a ON a.color = h.color AND a.r = s.r AND {same})"""


def query(fixture: str, *parts: str, body: str) -> str:
    return "WITH " + ",\n".join([FIXTURES[fixture].strip(), *(p.strip() for p in parts)]) + "\n" + body
