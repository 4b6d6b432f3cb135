"""DuckDB statements of the queries in ``training``, written from the definitions."""

from __future__ import annotations

from growmap.plans.twins import CTE, SQL as BASE, _LINE, _STATS, _nan_dist, sql

SHADES = " ░▒▓█"
LONG = ", rl AS (SELECT row_id, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM r), w0 AS (SELECT neuron_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS dim FROM n)"


def _best(k: int) -> str:
    """best{k}: the neuron of each row under the weights w{k}."""
    return f""", best{k} AS (SELECT row_id, neuron_id, d FROM (SELECT row_id, neuron_id, sqrt(sum((rl.v - u.v) ** 2)) AS d FROM rl JOIN w{k} u ON u.dim = rl.dim GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, neuron_id) = 1)"""


def _epochs(sigmas: list[float]) -> str:
    out = LONG
    for k, s in enumerate(sigmas):
        out += _best(k) + f""", s{k} AS (SELECT neuron_id, dim, sum(v) AS s, count(v) AS c FROM rl JOIN best{k} USING (row_id) GROUP BY ALL),
            w{k + 1} AS (SELECT dst_id AS neuron_id, dim, sum(exp(-(hops * hops) / {2 * s * s}::DOUBLE) * s) / sum(exp(-(hops * hops) / {2 * s * s}::DOUBLE) * c) AS v FROM gd JOIN s{k} s ON s.neuron_id = src_id GROUP BY ALL)"""
    return out


def _fitted(sigmas: list[float]) -> str:
    k = len(sigmas)
    return sql(
        "n r gd",
        _epochs(sigmas)
        + _best(k)
        + f""", h AS (SELECT neuron_id, count(*) AS hits, sum(d) AS error FROM best{k} GROUP BY 1),
        m AS (SELECT n.neuron_id, x, y, coalesce(hits, 0)::BIGINT AS hits, coalesce(error, 0) AS error, row_number() OVER (PARTITION BY hits IS NULL ORDER BY n.neuron_id) AS nth FROM n LEFT JOIN h ON h.neuron_id = n.neuron_id)
        SELECT m.neuron_id, x, y, hits, round(error, 6) AS error, round(max(v) FILTER (dim = 1), 6) AS first_weight, round(sum(v), 6) AS weight_sum FROM m JOIN w{k} u ON u.neuron_id = m.neuron_id
        WHERE hits > 0 OR nth > 12 GROUP BY ALL""",
    )


def _hop(a: str, b: str) -> str:
    """Grid distance of cells (x, y) of two tables."""
    cx = lambda t: f"({t}.x - ({t}.y - ({t}.y & 1)) // 2)"
    return f"greatest(abs({cx(a)} - {cx(b)}), abs({a}.y - {b}.y), abs({cx(a)} + {a}.y - {cx(b)} - {b}.y))"


def _directions(cells: str) -> str:
    """From g (neuron_id, x, y, w1, ws, error): dirs, where and how each neuron with an empty cell grows."""
    return f""", g AS ({cells}),
        slot AS (SELECT s.neuron_id, k, s.x + dx AS x, s.y + dy AS y FROM g s JOIN off ON odd = (s.y & 1)),
        free AS (SELECT slot.* FROM slot ANTI JOIN g ON g.x = slot.x AND g.y = slot.y),
        occ AS (SELECT slot.neuron_id, g.neuron_id AS q, k, g.x, g.y, w1, ws, error, row_number() OVER (PARTITION BY slot.neuron_id ORDER BY error DESC, g.neuron_id) AS i, count(*) OVER (PARTITION BY slot.neuron_id) AS c FROM slot JOIN g ON g.x = slot.x AND g.y = slot.y),
        sec AS (SELECT p.neuron_id, q.neuron_id AS q, q.x, q.y, q.w1, q.ws FROM g p JOIN g q ON {_hop('p', 'q')} = 2 WHERE EXISTS (SELECT 1 FROM free a WHERE a.neuron_id = p.neuron_id AND {_hop('a', 'q')} = 1)
            QUALIFY row_number() OVER (PARTITION BY p.neuron_id ORDER BY q.error DESC, q.neuron_id) = 1),
        cnt AS (SELECT g.neuron_id, g.w1, g.ws, count(occ.q) AS c FROM g LEFT JOIN occ ON occ.neuron_id = g.neuron_id WHERE g.neuron_id IN (SELECT neuron_id FROM free) GROUP BY ALL),
        cand AS (SELECT cnt.neuron_id, cnt.c, a.x, a.y, CASE
                WHEN cnt.c = 0 THEN a.k
                WHEN cnt.c <= 2 AND sec.q IS NOT NULL THEN 10 * {_hop('a', 'sec')} + a.k
                WHEN cnt.c <= 2 THEN -10 * {_hop('a', 'hi')} + a.k
                WHEN cnt.c <= 4 THEN 10 * {_hop('a', 'hi')} + a.k ELSE a.k END AS cost,
            CASE WHEN cnt.c = 0 THEN NULL WHEN cnt.c <= 2 AND sec.q IS NOT NULL THEN (cnt.w1 + sec.w1) / 2 WHEN cnt.c <= 2 THEN 2 * cnt.w1 - hi.w1 WHEN cnt.c <= 4 THEN 2 * cnt.w1 - lo.w1
                ELSE 2 * cnt.w1 - (SELECT arg_min(o.w1, o.i) FROM occ o WHERE o.neuron_id = cnt.neuron_id AND {_hop('o', 'a')} = 2) END AS w1,
            CASE WHEN cnt.c = 0 THEN NULL WHEN cnt.c <= 2 AND sec.q IS NOT NULL THEN (cnt.ws + sec.ws) / 2 WHEN cnt.c <= 2 THEN 2 * cnt.ws - hi.ws WHEN cnt.c <= 4 THEN 2 * cnt.ws - lo.ws
                ELSE 2 * cnt.ws - (SELECT arg_min(o.ws, o.i) FROM occ o WHERE o.neuron_id = cnt.neuron_id AND {_hop('o', 'a')} = 2) END AS ws
            FROM cnt JOIN free a ON a.neuron_id = cnt.neuron_id LEFT JOIN sec ON sec.neuron_id = cnt.neuron_id
            LEFT JOIN occ hi ON hi.neuron_id = cnt.neuron_id AND hi.i = 1 LEFT JOIN occ lo ON lo.neuron_id = cnt.neuron_id AND lo.i = lo.c),
        dirs AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY neuron_id ORDER BY cost) = 1)"""


_CORNER = "SELECT neuron_id, x, y, w[1] AS w1, list_sum(w) AS ws, CASE WHEN neuron_id = 3 THEN 9.0 ELSE 1.0 END::DOUBLE AS error FROM n"


def _grown(new: str) -> str:
    return f"""SELECT neuron_id, x, y, round(w1, 6) AS first_weight, round(ws, 6) AS weight_sum, CASE WHEN neuron_id = 3 THEN 0 ELSE error END::DOUBLE AS error FROM g
        UNION ALL SELECT 16, x::INT, y::INT, round(w1, 6), round(ws, 6), 0 FROM {new}"""


def _ward(members: str, points: str, low: int, high: int) -> str:
    """members (g, i) and points (i, dim, v) -> wd (g, step, i, c, height), prof (g, k, davies_bouldin,
    silhouette), picked (g, i, cluster): the labels of the k with the least Davies-Bouldin index."""
    return f""", mem AS ({members}), size AS (SELECT g, count(*) AS m FROM mem GROUP BY 1), l AS ({points}),
        wd AS (SELECT g, 0::BIGINT AS step, i::BIGINT AS i, (row_number() OVER (PARTITION BY g ORDER BY i) - 1)::BIGINT AS c, NULL::DOUBLE AS height, NULL::BIGINT AS ma, NULL::BIGINT AS mb FROM mem
            UNION ALL (WITH cen AS (SELECT g, c, dim, avg(v) AS m, count(*) AS n FROM wd JOIN l USING (i) GROUP BY ALL),
            best AS (SELECT a.g, a.c AS a, b.c AS b, sqrt(2.0::DOUBLE * any_value(a.n) * any_value(b.n) / (any_value(a.n) + any_value(b.n)) * sum((a.m - b.m) ** 2)) AS height
                FROM cen a JOIN cen b ON a.g = b.g AND a.dim = b.dim AND a.c < b.c GROUP BY a.g, a.c, b.c QUALIFY row_number() OVER (PARTITION BY a.g ORDER BY height, a.c, b.c) = 1)
            SELECT wd.g, step + 1, i, CASE WHEN c IN (a, b) THEN size.m + step ELSE c END, best.height, a, b FROM wd JOIN best ON best.g = wd.g JOIN size ON size.g = wd.g)),
        lab AS (SELECT wd.g, m - step AS k, i, c FROM wd JOIN size ON size.g = wd.g),
        cand AS (SELECT lab.* FROM lab JOIN size ON size.g = lab.g WHERE k BETWEEN {low} AND least({high}, m - 1)),
        cen AS (SELECT g, k, c, dim, avg(v) AS m FROM cand JOIN l USING (i) GROUP BY ALL),
        spread AS (SELECT g, k, c, avg(d) AS s FROM (SELECT cand.g, cand.k, cand.c, i, sqrt(sum((v - m) ** 2)) AS d FROM cand JOIN l USING (i) JOIN cen ON cen.g = cand.g AND cen.k = cand.k AND cen.c = cand.c AND cen.dim = l.dim GROUP BY ALL) GROUP BY ALL),
        apart AS (SELECT a.g, a.k, a.c, b.c AS o, sqrt(sum((a.m - b.m) ** 2)) AS d FROM cen a JOIN cen b ON a.g = b.g AND a.k = b.k AND a.dim = b.dim AND a.c <> b.c GROUP BY ALL),
        db AS (SELECT g, k, avg(w) AS davies_bouldin FROM (SELECT p.g, p.k, p.c, max((x.s + z.s) / d) AS w FROM apart p JOIN spread x ON x.g = p.g AND x.k = p.k AND x.c = p.c JOIN spread z ON z.g = p.g AND z.k = p.k AND z.c = p.o GROUP BY ALL) GROUP BY ALL),
        dd AS (SELECT a.i, b.i AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM l a JOIN l b ON a.dim = b.dim AND a.i <> b.i GROUP BY ALL),
        near AS (SELECT a.g, a.k, a.i, a.c = b.c AS own, avg(d) AS m FROM cand a JOIN cand b ON a.g = b.g AND a.k = b.k JOIN dd ON dd.i = a.i AND dd.j = b.i GROUP BY a.g, a.k, a.i, a.c, b.c),
        sil AS (SELECT g, k, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM (SELECT g, k, i, max(m) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM near GROUP BY ALL) GROUP BY ALL),
        prof AS (SELECT db.g, db.k, davies_bouldin, silhouette FROM db JOIN sil ON sil.g = db.g AND sil.k = db.k),
        chosen AS (SELECT size.g, least(coalesce((SELECT arg_min(k, (davies_bouldin, k)) FROM prof WHERE prof.g = size.g), {low}), m) AS k FROM size),
        firsts AS (SELECT lab.g, lab.i, min(lab.i) OVER (PARTITION BY lab.g, lab.c) AS first FROM lab JOIN chosen ON chosen.g = lab.g AND chosen.k = lab.k),
        picked AS (SELECT g, i, (dense_rank() OVER (PARTITION BY g ORDER BY first))::INT AS cluster FROM firsts)"""


_NEURONS = "SELECT 0 AS g, neuron_id AS i FROM n"
_POINTS = "SELECT neuron_id AS i, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS dim FROM n"
_UNEVEN = "SELECT k AS i, dim, v::DOUBLE AS v FROM (SELECT k, unnest([1, 2, 3]) AS dim, unnest([k * k, (k * k * k) % 7, 3 * (k % 4)]) AS v FROM range(9) t(k))"


def _kmeans(low: int, high: int) -> str:
    """All partitions of the nine neurons are tried; of the numbers of clusters the one with the least
    Davies-Bouldin index of its best partition is taken."""
    return f"""WITH l AS ({_UNEVEN}), x AS (SELECT i, max(v) FILTER (dim = 1) AS a, max(v) FILTER (dim = 2) AS b, max(v) FILTER (dim = 3) AS c FROM l GROUP BY i),
        p AS (SELECT k, p FROM range({low}, {high + 1}) t(k), range((k ** 9)::BIGINT) u(p)),
        m AS (SELECT k, p, i, a, b, c, (p // (k ** i)::BIGINT) % k AS g FROM p, x),
        cen AS (SELECT k, p, g, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, count(*) AS n FROM m GROUP BY ALL),
        cost AS (SELECT k, p, -sum(n * (ma * ma + mb * mb + mc * mc)) AS cost FROM cen GROUP BY ALL HAVING count(*) = k),
        best AS (SELECT k, arg_min(p, (round(cost, 9), p)) AS p FROM cost GROUP BY k),
        bm AS (SELECT m.*, ma, mb, mc FROM m JOIN best USING (k, p) JOIN cen USING (k, p, g)),
        s AS (SELECT k, g, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mc) AS mc, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2 + (c - mc) ** 2)) AS s FROM bm GROUP BY ALL),
        db AS (SELECT k, avg(w) AS db FROM (SELECT u.k, u.g, max((u.s + v.s) / sqrt((u.ma - v.ma) ** 2 + (u.mb - v.mb) ** 2 + (u.mc - v.mc) ** 2)) AS w FROM s u JOIN s v ON u.k = v.k AND u.g <> v.g GROUP BY ALL) GROUP BY k),
        f AS (SELECT i, min(i) OVER (PARTITION BY g) AS first FROM bm WHERE k = (SELECT arg_min(k, (db, k)) FROM db))
        SELECT i::INT AS neuron_id, (dense_rank() OVER (ORDER BY first))::INT AS cluster FROM f"""


def _metrics(clusters: str, more: str = "") -> str:
    """name, value of nmi, ari, purity, n_clusters of c (cluster, label)."""
    entropy = lambda by: f"(SELECT -sum(n / t.n * ln(n / t.n)) FROM (SELECT sum(n)::DOUBLE AS n FROM k GROUP BY {by}))"
    pairs = lambda by: f"(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n)::DOUBLE AS n FROM k GROUP BY {by}))"
    return f""", c AS ({clusters}), k AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM c GROUP BY ALL), t AS (SELECT sum(n) AS n FROM k),
        h AS (SELECT {entropy('cluster')} AS hu, {entropy('label')} AS hv, {entropy('cluster, label')} AS huv, {pairs('cluster, label')} AS ij, {pairs('cluster')} AS i, {pairs('label')} AS j, t.n * (t.n - 1) / 2 AS a, (SELECT sum(m) FROM (SELECT max(n) AS m FROM k GROUP BY cluster)) / t.n AS p FROM t)
        SELECT 'nmi' AS name, round(2 * (hu + hv - huv) / (hu + hv), 6) AS value FROM h UNION ALL SELECT 'ari', round((ij - i * j / a) / ((i + j) / 2 - i * j / a), 6) FROM h
        UNION ALL SELECT 'purity', round(p, 6) FROM h UNION ALL SELECT 'n_clusters', count(DISTINCT cluster)::DOUBLE FROM k{more}"""


_IMPUTE = sql(
    "n gd r",
    f""", rr AS (SELECT row_id, list_transform(f, lambda v, k: CASE WHEN k > 1 OR row_id % 97 = 0 THEN v END) AS f FROM r),
    rl AS (SELECT row_id, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM rr),
    wt AS (SELECT dim, avg(CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0 END) ** 2 AS wt FROM rl GROUP BY 1),
    best AS (SELECT row_id, neuron_id FROM ({_nan_dist('rr', 'wt')}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, neuron_id) = 1),
    s AS (SELECT neuron_id, dim, sum(v) AS s, count(v) AS c FROM rl JOIN best USING (row_id) GROUP BY ALL),
    smooth AS (SELECT dst_id AS neuron_id, dim, sum(exp(-(hops * hops) / 0.32::DOUBLE) * s) AS num, sum(exp(-(hops * hops) / 0.32::DOUBLE) * c) AS den FROM gd JOIN s ON s.neuron_id = src_id GROUP BY ALL),
    old AS (SELECT neuron_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS dim FROM n),
    upd AS (SELECT neuron_id, dim, CASE WHEN den * wt > 2.220446049250313e-16 THEN num / den ELSE v END AS v, coalesce(den * wt, 0) AS den FROM old JOIN wt USING (dim) LEFT JOIN smooth USING (neuron_id, dim)),
    mx AS (SELECT neuron_id, greatest(1, 0.1::DOUBLE * max(den)) AS least FROM upd GROUP BY 1),
    nb AS (SELECT src_id AS k, list(dst_id ORDER BY dst_id) AS js, list(1.0::DOUBLE / hops ORDER BY dst_id) AS hs FROM gd WHERE hops BETWEEN 1 AND 2 GROUP BY 1),
    it AS (SELECT 0 AS k, dim, list(v ORDER BY neuron_id) AS ws, list(den < least ORDER BY neuron_id) AS poor FROM upd JOIN mx USING (neuron_id) GROUP BY dim
        UNION ALL SELECT it.k + 1, dim, CASE WHEN poor[it.k + 1] THEN ws[1:it.k] || [list_sum(list_transform(range(1, len(js) + 1), lambda i: ws[js[i] + 1] * hs[i])) / list_sum(hs)] || ws[it.k + 2:] ELSE ws END, poor FROM it JOIN nb ON nb.k = it.k)
    SELECT (unnest(range(16)))::INT AS neuron_id, dim::INT AS dim, round(unnest(ws), 6) AS weight FROM it WHERE k = 16""",
    recursive=True,
)
_VALLEYS = sql(
    "us adj",
    """, thr AS (SELECT quantile_cont(ustar, 0.6) AS t FROM us), low AS (SELECT neuron_id FROM us, thr WHERE ustar <= t),
    reach AS (SELECT neuron_id AS a, neuron_id AS b FROM low UNION SELECT a, dst_id FROM reach JOIN adj ON src_id = b JOIN low ON low.neuron_id = dst_id),
    comp AS (SELECT a AS neuron_id, dense_rank() OVER (ORDER BY min(b)) AS c FROM reach GROUP BY a),
    nb AS (SELECT src_id AS k, list(dst_id ORDER BY k) AS js FROM adj GROUP BY src_id),
    it AS (SELECT 0 AS k, list(coalesce(c, 0) ORDER BY us.neuron_id) AS ls FROM us LEFT JOIN comp ON comp.neuron_id = us.neuron_id
        UNION ALL SELECT it.k + 1, CASE WHEN ls[it.k + 1] > 0 THEN ls ELSE ls[1:it.k] || [coalesce(list_filter(list_transform(js, lambda j: ls[j + 1]), lambda v: v > 0)[1], list_max(ls) + 1)] || ls[it.k + 2:] END FROM it JOIN nb ON nb.k = it.k)
    SELECT (unnest(range(16)))::INT AS neuron_id, (unnest(ls))::INT AS cluster FROM it WHERE k = 16""",
    recursive=True,
)
_STRICT = sql(
    "n",
    f""", l AS ({_POINTS}), it AS (SELECT 0 AS step, neuron_id AS i, neuron_id AS c FROM n
        UNION ALL (WITH cen AS (SELECT c, dim, avg(v) AS m FROM it JOIN l USING (i) GROUP BY ALL),
        best AS (SELECT a.c AS a, b.c AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM cen a JOIN cen b ON a.dim = b.dim AND a.c < b.c GROUP BY a.c, b.c ORDER BY d, a.c, b.c LIMIT 1)
        SELECT step + 1, i, CASE WHEN c = a THEN b ELSE c END FROM it, best WHERE step < 12)),
    f AS (SELECT i, min(i) OVER (PARTITION BY c) AS first FROM it WHERE step = 12)
    SELECT i AS neuron_id, (dense_rank() OVER (ORDER BY first))::INT AS cluster FROM f""",
    recursive=True,
)
_EVENTS = ", e AS (SELECT row_number() OVER () AS r, ts, value FROM events), s AS (SELECT r, any_value(ts) AS ts, min({'d': abs(value - 25.0 * k), 'k': k}) AS b FROM e, range(4) t(k) GROUP BY r)"
_PANEL = """, o AS (SELECT o_custkey, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS total, CASE WHEN count(*) > 1 THEN count(*)::DOUBLE END AS n_orders FROM orders GROUP BY 1, 2),
    kept AS (SELECT o_custkey, year, total, CASE WHEN year >= 1994 THEN n_orders END AS n FROM o WHERE o_custkey NOT IN (1, 2, 4) AND o_custkey IN (SELECT o_custkey FROM o GROUP BY 1 HAVING (2 * count(*) - count(total) - count(n_orders)) * 100.0::DOUBLE / (2 * count(*)) <= 30)),
    m AS (SELECT min(ln(total)) AS t0, max(ln(total)) AS t1, min(n) AS n0, max(n) AS n1 FROM kept)"""
_LINES = "SELECT i::INT AS line, text FROM (VALUES {}) v(i, text)"
_LINE_NO = "CASE WHEN y & 1 = 1 THEN ' ' ELSE '' END || string_agg({}, ' ' ORDER BY x)"
_Z = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in _LINE)
_SCORED_X = "SELECT x AS cluster, label FROM b"

SQL: dict[str, str] = {
    "fit_fine_epoch": _fitted([0.6]),
    "fit_two_phases": _fitted([2.0, 0.6, 0.5]),
    "fit_two_phases_local": _fitted([2.0, 0.6, 0.5]),
    "coarse_epoch": sql(
        "n r gd adj",
        _epochs([2.0])
        + """, h AS (SELECT neuron_id, sum(d) AS error, count(*) AS hits FROM (SELECT rl.row_id, b.neuron_id, sqrt(sum((rl.v - u.v) ** 2)) AS d FROM rl JOIN best0 b USING (row_id) JOIN w1 u ON u.neuron_id = b.neuron_id AND u.dim = rl.dim GROUP BY ALL) GROUP BY 1),
        e AS (SELECT n.neuron_id, coalesce(error, 0) AS error, coalesce(hits, 0)::BIGINT AS hits, (SELECT count(*) FROM adj WHERE src_id = n.neuron_id) < 6 AS edge FROM n LEFT JOIN h ON h.neuron_id = n.neuron_id),
        t AS (SELECT avg(error) AS t FROM e),
        g AS (SELECT src_id, dst_id, d.error FROM adj JOIN e d ON d.neuron_id = src_id AND NOT d.edge JOIN e o ON o.neuron_id = dst_id AND o.edge, t WHERE d.error >= t),
        a AS (SELECT neuron_id, CASE WHEN neuron_id IN (SELECT src_id FROM g) THEN error / 2 ELSE error END + coalesce((SELECT sum(g.error / 12) FROM g WHERE dst_id = neuron_id), 0) AS error, hits, edge FROM e)
        SELECT neuron_id, round(error, 6) AS error, hits, edge AND error > t AS candidate FROM a, t""",
    ),
    "growth_directions": sql(
        "hn off",
        _directions("SELECT neuron_id, x, y, w[1] AS w1, list_sum(w) AS ws, (neuron_id * 37 % 23)::DOUBLE AS error FROM hn UNION ALL SELECT 16, 10, 10, w[1], list_sum(w), (16 * 37 % 23)::DOUBLE FROM hn WHERE neuron_id = 0")
        + " SELECT neuron_id, c::INT AS n_occupied, x::INT AS x, y::INT AS y, round(w1, 6) AS first_weight, round(ws, 6) AS weight_sum FROM dirs",
    ),
    "grow_directed": sql("n off", _directions(_CORNER) + _grown("dirs WHERE neuron_id = 3")),
    "grow_reflected": sql("n off", _directions(_CORNER) + ", new AS (SELECT a.x, a.y, 2 * g.w1 - o.w1 AS w1, 2 * g.ws - o.ws AS ws FROM g JOIN free a USING (neuron_id) JOIN occ o USING (neuron_id) WHERE neuron_id = 3 QUALIFY row_number() OVER (ORDER BY a.k, o.k) = 1) " + _grown("new")),
    "prune_map": sql("hits", ", d AS (SELECT *, hits < (SELECT floor(median(hits)) FROM hits) AS dead FROM hits) SELECT neuron_id, x, y FROM d QUALIFY NOT dead OR row_number() OVER (PARTITION BY dead ORDER BY neuron_id) > 12"),
    "batch_update_impute": _IMPUTE,
    "grid_add_remove": sql("n", "SELECT neuron_id, x, y, round(list_sum(w), 6) AS weight_sum FROM n WHERE neuron_id NOT IN (5, 14) UNION ALL SELECT 16, -1, 0, round(list_sum(w), 6) FROM n WHERE neuron_id = 0 UNION ALL SELECT 17, 4, 4, round(list_sum(w), 6) FROM n WHERE neuron_id = 15"),
    "initial_map": "SELECT k::INT AS neuron_id, (k % 3)::INT AS x, (k // 3)::INT AS y, (2 * k)::DOUBLE AS a, (2 * k + 1)::DOUBLE AS b, 0::DOUBLE AS error, 0::BIGINT AS hits FROM range(6) t(k)",
    "presets": "SELECT name, spread::DOUBLE AS spread, factor::DOUBLE AS error_factor, scale::VARCHAR AS scale FROM (VALUES ('standard', NULL, 1.0, NULL), ('legacy', 0.5, NULL, 'zscore'), ('both', 0.3, NULL, NULL), ('neither', 0.5, NULL, NULL), ('factor', NULL, 2.0, NULL)) v(name, spread, factor, scale)",
    "sigma_schedule": "SELECT n::INT AS epochs, e::INT AS epoch, round(4.5::DOUBLE + CASE WHEN n > 1 THEN (0.9 - 4.5) * (e - 1)::DOUBLE / (n - 1) ELSE 0 END, 9) AS coarse, round(1.35::DOUBLE + CASE WHEN n > 1 THEN (0.5 - 1.35) * (e - 1)::DOUBLE / (n - 1) ELSE 0 END, 9) AS fine FROM (VALUES (1), (2), (7)) v(n), range(1, 8) t(e) WHERE e <= n",
    "model_transform": sql("b", "SELECT row_id, neuron_id, x, y FROM b"),
    "model_predict_nan": BASE["weighted_nan_bmu"],
    "model_quality": sql("ranked adj", "SELECT round(avg(a.distance), 6) AS qe, round(avg(CASE WHEN adj.k IS NULL THEN 1.0 ELSE 0.0 END), 6) AS te FROM ranked a JOIN ranked c ON a.row_id = c.row_id AND a.rank = 1 AND c.rank = 2 LEFT JOIN adj ON src_id = a.neuron_id AND dst_id = c.neuron_id"),
    "model_accessors": sql("n", "SELECT gx.v::INT AS x, gy.v::INT AS y, n.neuron_id IS NOT NULL AS present, n.neuron_id, round(list_sum(w), 6) AS weight_sum, 16 AS n_neurons, 64 AS input_dim FROM range(-1, 5) gx(v) CROSS JOIN range(-1, 5) gy(v) LEFT JOIN n ON n.x = gx.v AND n.y = gy.v"),
    "model_evaluate": sql("b n", _metrics(_SCORED_X, f" UNION ALL SELECT 'silhouette', silhouette FROM ({BASE['silhouette'][BASE['silhouette'].index(', d AS') + 2:].join(('WITH ', ''))})")),
    "all_metrics": sql("b", _metrics("SELECT neuron_id AS cluster, label FROM b")),
    "model_on_columns": sql("line", f", z AS (SELECT row_number() OVER () AS i, l_orderkey, l_linenumber, {_Z} FROM line, {_STATS}), d AS (SELECT i, l_orderkey, l_linenumber, k, sqrt({' + '.join(f'(z_{c} - (k - 1)) ** 2' for c in _LINE)}) AS d FROM z, range(3) t(k)) SELECT l_orderkey, l_linenumber, k::INT AS neuron_id, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, k) = 1"),
    "find_bmu": sql("r n", ", m AS (SELECT dim, avg(v) AS v FROM (SELECT unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM r) GROUP BY 1), u AS (SELECT neuron_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS dim FROM n) SELECT neuron_id, round(sqrt(sum((m.v - u.v) ** 2)), 6) AS distance FROM m JOIN u USING (dim) GROUP BY 1 ORDER BY sqrt(sum((m.v - u.v) ** 2)), 1 LIMIT 1"),
    "nan_distances": sql("rn n", ", u AS (SELECT unnest(w) AS u, unnest(range(1, len(w) + 1)) AS dim FROM n WHERE neuron_id = 0), l AS (SELECT row_id, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM rn), p AS (SELECT row_id, v, u, CASE WHEN (dim - 1) % 5 = 0 THEN 0 ELSE 1.0::DOUBLE / dim END AS wt FROM l JOIN u USING (dim)) SELECT row_id, round(sqrt(sum((v - u) ** 2) * count(*) / count(v)), 6) AS distance, round(sqrt(sum(wt * (v - u) ** 2) * sum(wt) / sum(wt) FILTER (v IS NOT NULL)), 6) AS weighted FROM p GROUP BY 1"),
    "plotting_tables": sql("n adj", "SELECT name, k::BIGINT AS n_rows FROM (SELECT unnest(['positions', 'weights', 'umatrix', 'expanded_umatrix', 'ustar', 'hits', 'edges', 'bounds']) AS name, unnest([16, 16 * 64, 16, (SELECT count(*) // 2 FROM adj), 16, 16, (SELECT count(*) // 2 FROM adj), 1]) AS k)"),
    "grid_ascii": sql("n hn", "SELECT y AS line, " + _LINE_NO.format("CASE WHEN neuron_id = 5 THEN '·' ELSE '●' END") + " AS text FROM n GROUP BY y"),
    "grid_ascii_hits": sql("hits", ", h AS (SELECT *, hits - min(hits) OVER () AS m FROM hits) SELECT y AS line, " + _LINE_NO.format("CASE WHEN m > 9 THEN '+' ELSE m::VARCHAR END") + " AS text FROM h GROUP BY y"),
    "umatrix_ascii": sql("hu n", f", m AS (SELECT min(u) AS lo, max(u) AS hi FROM hu), c AS (SELECT n.x, n.y, CASE WHEN hu.neuron_id IS NULL THEN '·' ELSE substr('{SHADES}', round((u - lo) / (hi - lo) * 4)::INT + 1, 1) END AS c FROM n LEFT JOIN hu ON hu.neuron_id = n.neuron_id, m) SELECT y AS line, " + _LINE_NO.format("c") + " AS text FROM c GROUP BY y"),
    "model_summary": _LINES.format("(0, 'neurons: 16 of at most 100'), (1, 'dimensions: 64'), (2, 'grid: x 0..3, y 0..3'), (3, 'growth threshold: None'), (4, 'missing values: no')"),
    "coordinate_arrays": sql("n", "SELECT string_agg(x::VARCHAR, ' ' ORDER BY neuron_id) AS xs, string_agg(y::VARCHAR, ' ' ORDER BY neuron_id) AS ys, string_agg((x * 10 + y)::VARCHAR, ' ' ORDER BY neuron_id) AS \"values\" FROM n"),
    "k_profile": sql("n", _ward(_NEURONS, _POINTS, 2, 6) + " SELECT k::INT AS k, round(davies_bouldin, 6) AS davies_bouldin, round(silhouette, 6) AS silhouette FROM prof", recursive=True),
    "ward_clusters": sql("n", _ward(_NEURONS, _POINTS, 2, 10) + " SELECT n.neuron_id, x, y, cluster FROM picked JOIN n ON n.neuron_id = i", recursive=True),
    "ward_dendrogram": sql("n", _ward(_NEURONS, _POINTS, 2, 10) + " SELECT (step - 1)::INT AS step, any_value(ma)::INT AS a, any_value(mb)::INT AS b, round(any_value(height), 6) AS height, (count(*) FILTER (c = 15 + step))::INT AS size FROM wd WHERE step > 0 GROUP BY step", recursive=True),
    "model_two_level": sql("n", _ward(_NEURONS, _POINTS, 2, 10) + " SELECT n.neuron_id, x, y, cluster FROM picked JOIN n ON n.neuron_id = i", recursive=True),
    "kmeans_three": _kmeans(3, 3),
    "kmeans_chosen": _kmeans(2, 4),
    "umatrix_clusters": _VALLEYS,
    "cluster_n_strict": _STRICT,
    "active_clusters": sql("tr", _ward("SELECT DISTINCT 0 AS g, neuron_id AS i FROM tr", _UNEVEN, 2, 4) + " SELECT i::INT AS neuron_id, cluster FROM picked", recursive=True),
    "decade_clusters": sql("tr", _ward("SELECT DISTINCT ((end_time + 1990) // 10 * 10)::INT AS g, neuron_id AS i FROM tr", _UNEVEN, 2, 4) + " SELECT g AS decade, i::INT AS neuron_id, cluster FROM picked", recursive=True),
    "silhouette_neurons": BASE["silhouette"],
    "davies_bouldin_neurons": BASE["davies_bouldin"].replace(CTE["r"], "SELECT neuron_id AS row_id, x AS label, w AS f FROM n").replace("WITH ", f"WITH n AS ({CTE['n']}), ", 1),
    "row_silhouette": sql("r", ", d AS (SELECT a.row_id AS i, a.label AS c, b.label AS oc, avg(CASE WHEN a.row_id <> b.row_id THEN sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END) AS m FROM r a, r b GROUP BY ALL), s AS (SELECT i, max(m) FILTER (c = oc) AS a, min(m) FILTER (c <> oc) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s"),
    "panel_from_matrices": "SELECT 'r' || n_regionkey AS entity, i::INT AS time_index, v0, v1, v2, v3 FROM (SELECT n_regionkey, row_number() OVER w AS i, lag(n_nationkey::DOUBLE) OVER w AS v0, lag((n_nationkey * n_nationkey)::DOUBLE) OVER w AS v1, n_nationkey::DOUBLE AS v2, (n_nationkey * n_nationkey)::DOUBLE AS v3 FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHERE i >= 2",
    "window_names": "SELECT (k - 1)::INT AS position, names[k] AS name FROM (SELECT ['a_t-2', 'b_t-2', 'a_t-1', 'b_t-1', 'a_t0', 'b_t0', 'f1_t-1', 'f2_t-1', 'f1_t0', 'f2_t0'] AS names), range(1, 11) t(k)",
    "trajectory_union": sql("tr", "SELECT user_id, time_index, neuron_id, x, y FROM tr"),
    "prepared_panel": "WITH " + _PANEL[2:] + " SELECT o_custkey, year, round((ln(total) - t0) / (t1 - t0) * 100, 6) AS total, round((n - n0) / (n1 - n0) * 100, 6) AS n_orders FROM kept, m",
    "zscore_at_once": BASE["zscore"],
    "scaler_summary": _LINES.format("(0, '3 columns, 1 binary'), (1, 'odd: binary, none'), (2, 'p_size: continuous, minmax'), (3, 'p_retailprice: continuous, minmax')"),
    "stream_scores": "WITH " + _EVENTS[2:] + " SELECT b.k::INT AS neuron_id, count(*)::BIGINT AS n, round(avg(b.d), 4) AS mean_distance FROM s GROUP BY 1",
    "stream_drift": "WITH " + _EVENTS[2:] + " SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, round(avg(b.d), 4) AS qe FROM s WHERE ts < TIMESTAMP '2024-01-28' GROUP BY 1",
    "sink_umatrix": BASE["umatrix"],
    "sink_weights": sql("n", "SELECT neuron_id, x, y, round(w[1], 6) AS first_weight, round(list_sum(w), 6) AS weight_sum FROM n"),
    "sink_mappings": sql("b", "SELECT row_id, neuron_id, CASE WHEN neuron_id = 3 THEN 0 ELSE x END AS cluster, round(f[64], 6) AS last_feature FROM b"),
    "sink_clusters": sql("n", "SELECT neuron_id, x AS cluster FROM n"),
    "sink_trajectories": sql("tr", "SELECT user_id, time_index, neuron_id, round(distance, 4) AS distance FROM tr"),
    "sink_windows": sql("nb", "SELECT user_id, i::INT AS time_index, round(total, 6) AS total FROM nb WHERE i >= 2"),
    "sink_all": sql("n b adj", "SELECT name, k::BIGINT AS n_rows FROM (SELECT unnest(['umatrix', 'mappings', 'weights', 'edges', 'hits', 'clusters', 'distribution']) AS name, unnest([16, (SELECT count(*) FROM b), 16, (SELECT count(*) // 2 FROM adj), 16, 16, (SELECT count(*) FROM (SELECT DISTINCT x, label FROM b))]) AS k)"),
    "sink_panel": sql("tr", "SELECT name, k::BIGINT AS n_rows FROM (SELECT unnest(['snapshots', 'trajectories', 'summary', 'weights', 'clusters', 'names']) AS name, unnest([count(*), count(*), count(DISTINCT user_id), 9, 9, count(DISTINCT neuron_id % 4)]) AS k FROM tr)"),
    "source_countries": "SELECT 'N' || n_nationkey AS code, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "source_indicators": "SELECT 'N' || n_nationkey AS code, n_name AS name, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS total, CASE WHEN count(*) > 3 THEN count(*)::DOUBLE END AS many FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "source_csv": "WITH d AS (SELECT p_partkey, k, sqrt((p_size - 12.0::DOUBLE * k) ** 2 + (p_retailprice - 500.0::DOUBLE * k) ** 2) AS d FROM part, range(4) t(k)) SELECT p_partkey::BIGINT AS p_partkey, k::INT AS neuron_id, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, k) = 1",
    "source_in_memory": "SELECT p_partkey::BIGINT AS p_partkey, p_size::DOUBLE AS f0, p_retailprice::DOUBLE AS f1 FROM part",
}
