"""DuckDB statements of the queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

CTE = {
    "n": "SELECT vec_id::INT AS neuron_id, (vec_id % 4)::INT AS x, (vec_id // 4)::INT AS y, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < 16",
    "hn": "SELECT * FROM n WHERE neuron_id <> 5",
    "r": "SELECT vec_id AS row_id, label, embedding::DOUBLE[] AS f FROM embeddings",
    "rn": "SELECT vec_id AS row_id, label, list_transform(embedding::DOUBLE[], lambda v, k: CASE WHEN (vec_id + k - 1) % 7 <> 0 THEN v END) AS f FROM embeddings",
    "dist": "SELECT row_id, label, neuron_id, x, y, f, sqrt(list_sum(list_transform(list_zip(f, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM r, n",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, neuron_id) AS rank FROM dist",
    "b": "SELECT * FROM ranked WHERE rank = 1",
    "off": "SELECT * FROM (VALUES (0,0,1,0),(0,1,0,-1),(0,2,-1,-1),(0,3,-1,0),(0,4,-1,1),(0,5,0,1),(1,0,1,0),(1,1,1,-1),(1,2,0,-1),(1,3,-1,0),(1,4,0,1),(1,5,1,1)) v(odd, k, dx, dy)",
    "adj": "SELECT s.neuron_id AS src_id, t.neuron_id AS dst_id, k FROM n s JOIN off ON odd = (s.y & 1) JOIN n t ON t.x = s.x + dx AND t.y = s.y + dy",
    "hadj": "SELECT s.neuron_id AS src_id, t.neuron_id AS dst_id, k FROM hn s JOIN off ON odd = (s.y & 1) JOIN hn t ON t.x = s.x + dx AND t.y = s.y + dy",
    "hd": "SELECT src_id, dst_id, s.x AS sx, s.y AS sy, t.x AS tx, t.y AS ty, sqrt(list_sum(list_transform(list_zip(s.w, t.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM hadj JOIN hn s ON s.neuron_id = src_id JOIN hn t ON t.neuron_id = dst_id",
    "hu": "SELECT neuron_id, x, y, coalesce(avg(d), 0) AS u FROM hn LEFT JOIN hd ON src_id = neuron_id GROUP BY ALL",
    "ad": "SELECT src_id, sqrt(list_sum(list_transform(list_zip(s.w, t.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM adj JOIN n s ON s.neuron_id = src_id JOIN n t ON t.neuron_id = dst_id",
    "hits": "SELECT n.neuron_id, n.x, n.y, count(b.row_id)::BIGINT AS hits FROM n LEFT JOIN b ON b.neuron_id = n.neuron_id GROUP BY ALL",
    "us": "SELECT h.neuron_id, x, y, coalesce(u, 0) * (1 - hits / (SELECT max(hits) FROM hits)) AS ustar FROM hits h LEFT JOIN (SELECT src_id, avg(d) AS u FROM ad GROUP BY 1) ON src_id = neuron_id",
    "cube": "SELECT neuron_id, x, y, x - (y - (y & 1)) // 2 AS cx, y AS cz, w FROM n",
    "gd": "SELECT a.neuron_id AS src_id, b.neuron_id AS dst_id, greatest(abs(a.cx - b.cx), abs(a.cz - b.cz), abs(a.cx + a.cz - b.cx - b.cz))::INT AS hops, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS euclidean FROM cube a, cube b",
    "line": "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem",
    "daily": "SELECT user_id, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS day, sum(value) AS total, count(*)::DOUBLE AS n FROM events GROUP BY ALL",
    "nb": "SELECT user_id, day, row_number() OVER w AS i, lag(total) OVER w AS t1, lag(n) OVER w AS n1, total, n FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)",
    "rule": "SELECT k AS neuron_id, k % 3 AS x, k // 3 AS y FROM range(9) v(k)",
    "trd": "SELECT user_id, i, day, neuron_id, x, y, sqrt((t1 - 60.0 * neuron_id) ** 2 + (n1 - 0.5 * neuron_id) ** 2 + (total - 40.0 * neuron_id) ** 2 + (n - 0.7 * neuron_id) ** 2) AS distance FROM nb, rule WHERE i >= 2",
    "tr": "SELECT user_id, i::INT AS time_index, day AS end_time, neuron_id::INT AS neuron_id, x::INT AS x, y::INT AS y, distance FROM trd QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY distance, neuron_id) = 1",
    "oma": "SELECT o_custkey, year(o_orderdate)::INT AS year, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS total_f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS total_o, nullif(count(*) FILTER (coalesce(o_orderstatus NOT IN ('F', 'O'), true)), 0)::BIGINT AS n_other FROM orders GROUP BY 1, 2",
    "cl": "SELECT row_id, label, b.neuron_id, CASE WHEN b.neuron_id = 3 THEN 9 ELSE b.x END AS cluster FROM b",
    "ct": "SELECT cluster, label, count(*)::BIGINT AS n FROM cl GROUP BY ALL",
}
NEEDS = {
    "hn": ["n"], "dist": ["r", "n"], "ranked": ["dist"], "b": ["ranked"], "adj": ["n", "off"], "hadj": ["hn", "off"], "hd": ["hadj", "hn"], "hu": ["hn", "hd"], "ad": ["adj", "n"], "hits": ["n", "b"], "us": ["hits", "ad"],
    "cube": ["n"], "gd": ["cube"], "nb": ["daily"], "trd": ["nb", "rule"], "tr": ["trd"], "cl": ["b"], "ct": ["cl"],
}


def sql(ctes: str, select: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, ()):
            add(dep)
        if name not in order:
            order.append(name)

    for c in ctes.split():
        add(c)
    head = ", ".join(f"{c} AS ({CTE[c]})" for c in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {select}" if head else select


def _update(rows: str) -> str:
    """One epoch at sigma 1, from the definition."""
    return sql(
        f"n {rows} gd",
        f""", best AS (SELECT row_id, neuron_id FROM ({_nan_dist(rows)}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, neuron_id) = 1),
        long AS (SELECT row_id, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM {rows}),
        s AS (SELECT neuron_id, dim, sum(v) AS s, count(v) AS c FROM long JOIN best USING (row_id) GROUP BY ALL)
        SELECT dst_id AS neuron_id, dim::INT AS dim, round(sum(exp(-(hops * hops) / 2.0::DOUBLE) * s) / sum(exp(-(hops * hops) / 2.0::DOUBLE) * c), 6) AS weight FROM gd JOIN s ON s.neuron_id = src_id GROUP BY ALL""",
    )


def _nan_dist(rows: str, weights: str = "") -> str:
    term = "(z[1] - z[2]) * (z[1] - z[2])"
    if weights:
        return f"""SELECT row_id, neuron_id, sqrt(sum(wt * (v - u) * (v - u)) * (SELECT sum(wt) FROM {weights}) / sum(wt) FILTER (v IS NOT NULL)) AS distance
            FROM (SELECT row_id, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM {rows}) l JOIN (SELECT neuron_id, unnest(w) AS u, unnest(range(1, len(w) + 1)) AS dim FROM n) m USING (dim) JOIN {weights} USING (dim) GROUP BY ALL"""
    return f"SELECT row_id, neuron_id, sqrt(list_sum(list_transform(list_zip(f, w), lambda z: {term})) * len(f) / len(list_filter(f, lambda v: v IS NOT NULL))) AS distance FROM {rows}, n"


_STATS = "(SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM line)"
_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = "(SELECT sum(n * (n - 1) / 2.0) AS p FROM {0})"
_BY = "(SELECT {0}, sum(n)::DOUBLE AS n FROM ct GROUP BY 1)"

SQL: dict[str, str] = {
    "bmu_assign": sql("b", "SELECT row_id, neuron_id, x, y, round(distance, 6) AS distance FROM b"),
    "bmu_assign_builtin": sql("b", "SELECT row_id, neuron_id, x, y, round(distance, 6) AS distance FROM b"),
    "bmu_top2": sql("ranked", "SELECT a.row_id, a.neuron_id, c.neuron_id AS neuron_id2, round(a.distance, 6) AS distance, round(c.distance, 6) AS distance2 FROM ranked a JOIN ranked c ON a.row_id = c.row_id AND a.rank = 1 AND c.rank = 2"),
    "bmu_lineitem": sql(
        "line",
        """, p AS (SELECT k AS neuron_id, 6.0 * k + 1 AS a, 11000.0 * k + 500 AS b, 0.0125 * k AS c, 0.01 * k AS d FROM range(8) v(k)),
        l AS (SELECT *, row_number() OVER () AS i FROM line),
        z AS (SELECT l.i AS row, min({'d': (l_quantity - a::DOUBLE) ** 2 + (l_extendedprice - b::DOUBLE) ** 2 + (l_discount - c::DOUBLE) ** 2 + (l_tax - d::DOUBLE) ** 2, 'i': neuron_id}) AS best FROM l, p GROUP BY l.i)
        SELECT best.i::INT AS neuron_id, (best.i % 4)::INT AS x, (best.i // 4)::INT AS y, count(*)::BIGINT AS hits, round(avg(sqrt(best.d)), 4) AS mean_distance FROM z GROUP BY ALL""",
    ),
    "quantization_error": sql("b", "SELECT round(avg(distance), 6) AS qe FROM b"),
    "topographic_error": sql("ranked adj", "SELECT round(avg(CASE WHEN adj.k IS NULL THEN 1.0 ELSE 0.0 END), 6) AS te FROM ranked a JOIN ranked c ON a.row_id = c.row_id AND a.rank = 1 AND c.rank = 2 LEFT JOIN adj ON src_id = a.neuron_id AND dst_id = c.neuron_id"),
    "hit_counts": sql("hits", "SELECT * FROM hits"),
    "empty_neurons": sql(
        "n r",
        """, m AS (SELECT neuron_id, x, y, w FROM n UNION ALL SELECT 16, 0, 4, list_transform(w, lambda v: 10.0::DOUBLE) FROM n WHERE neuron_id = 0),
        d AS (SELECT row_id, neuron_id, row_number() OVER (PARTITION BY row_id ORDER BY list_sum(list_transform(list_zip(f, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), neuron_id) AS rank FROM r, m)
        SELECT neuron_id, x, y FROM m WHERE neuron_id NOT IN (SELECT neuron_id FROM d WHERE rank = 1)""",
    ),
    "neuron_stats": sql("hits", "SELECT count(*)::BIGINT AS total, count(*) FILTER (hits > 0)::BIGINT AS active, count(*) FILTER (hits = 0)::BIGINT AS empty, min(hits) AS min_hits, round(avg(hits), 6) AS mean_hits, max(hits) AS max_hits, round(count(*) FILTER (hits > 0) / count(*), 6) AS active_fraction FROM hits"),
    "hit_histogram": sql("hits", "SELECT hits, count(*)::BIGINT AS n_neurons FROM hits GROUP BY 1"),
    "hex_edges": sql("hadj", "SELECT DISTINCT src_id, dst_id FROM hadj WHERE src_id < dst_id"),
    "hex_adjacency": sql("hadj", "SELECT src_id, dst_id, k::INT AS k FROM hadj"),
    "grid_bounds": sql("n", "SELECT min(x)::INT AS x_min, max(x)::INT AS x_max, min(y)::INT AS y_min, max(y)::INT AS y_max, (greatest(max(x) - min(x), max(y) - min(y)) + 1)::INT AS extent FROM n"),
    "boundary_neurons": sql("hn hadj", "SELECT neuron_id, count(dst_id)::BIGINT AS n_occupied, count(dst_id) < 6 AS is_boundary FROM hn LEFT JOIN hadj ON src_id = neuron_id GROUP BY 1"),
    "empty_slots": sql("hn off", "SELECT s.neuron_id, k::INT AS k, (s.x + dx)::INT AS x, (s.y + dy)::INT AS y FROM hn s JOIN off ON odd = (s.y & 1) WHERE NOT EXISTS (SELECT 1 FROM hn t WHERE t.x = s.x + dx AND t.y = s.y + dy)"),
    "neighbors_at_two": sql("gd", "SELECT src_id, dst_id FROM gd WHERE hops = 2"),
    "grid_distances": sql("gd", "SELECT src_id, dst_id, hops, round(euclidean, 6) AS euclidean FROM gd"),
    "neighborhood_matrix": sql("gd", "SELECT src_id, dst_id, round(exp(-(hops * hops) / 4.5::DOUBLE), 9) AS h FROM gd"),
    "umatrix": sql("hu", "SELECT neuron_id, x, y, round(u, 6) AS u FROM hu"),
    "umatrix_edges": sql("hd", "SELECT src_id, dst_id, round(ln(d + 2.220446049250313e-16), 6) AS distance FROM hd WHERE sx < tx OR sx = tx AND sy < ty"),
    "ustar": sql("us", "SELECT neuron_id, x, y, round(ustar, 6) AS ustar FROM us"),
    "ustar_threshold": sql("us", "SELECT round(quantile_cont(ustar, 0.6), 6) AS threshold FROM us"),
    "component_planes": sql("n", "SELECT neuron_id, x, y, unnest(range(1, len(w) + 1))::INT AS dim, round(unnest(w), 6) AS weight FROM n"),
    "heatmap": sql("hu", "SELECT gx.v::INT AS x, gy.v::INT AS y, round(u, 6) AS u FROM range(4) gx(v) CROSS JOIN range(4) gy(v) LEFT JOIN hu ON hu.x = gx.v AND hu.y = gy.v"),
    "edge_segments": sql("n adj", "SELECT src_id, dst_id, round(sqrt(3) * (s.x + 0.5 * (s.y & 1)), 6) AS x1, round(1.5::DOUBLE * s.y, 6) AS y1, round(sqrt(3) * (t.x + 0.5 * (t.y & 1)), 6) AS x2, round(1.5::DOUBLE * t.y, 6) AS y2 FROM adj JOIN n s ON s.neuron_id = src_id JOIN n t ON t.neuron_id = dst_id WHERE src_id < dst_id"),
    "geodesic": sql("hadj", ", w AS (SELECT 0 AS neuron_id, 0 AS hops UNION ALL SELECT dst_id, hops + 1 FROM w JOIN hadj ON src_id = neuron_id WHERE hops < 7) SELECT neuron_id, min(hops)::INT AS hops FROM w GROUP BY 1", recursive=True),
    "batch_update_epoch": _update("r"),
    "batch_update_nan": _update("rn"),
    "batch_update_builtin": _update("r"),
    "accumulate_errors": sql("hits b", "SELECT h.neuron_id, round(coalesce(sum(distance), 0), 6) AS error, any_value(hits) AS hits FROM hits h LEFT JOIN b ON b.neuron_id = h.neuron_id GROUP BY 1"),
    "distribute_errors": sql(
        "n adj",
        """, e AS (SELECT neuron_id, (neuron_id * 11 % 17 + CASE WHEN neuron_id IN (5, 6, 9, 10) THEN 50 ELSE 0 END)::DOUBLE AS error, (SELECT count(*) FROM adj WHERE src_id = neuron_id) < 6 AS edge FROM n),
        g AS (SELECT src_id, dst_id, d.error FROM adj JOIN e d ON d.neuron_id = src_id AND NOT d.edge AND d.error >= 55 JOIN e t ON t.neuron_id = dst_id AND t.edge)
        SELECT neuron_id, round(CASE WHEN neuron_id IN (SELECT src_id FROM g) THEN error / 2 ELSE error END + coalesce((SELECT sum(g.error / 12) FROM g WHERE dst_id = neuron_id), 0), 6) AS error FROM e""",
    ),
    "distribute_errors_builtin": sql(
        "n adj",
        """, e AS (SELECT neuron_id, (neuron_id * 11 % 17 + CASE WHEN neuron_id IN (5, 6, 9, 10) THEN 50 ELSE 0 END)::DOUBLE AS error, (SELECT count(*) FROM adj WHERE src_id = neuron_id) < 6 AS edge FROM n),
        g AS (SELECT src_id, dst_id, d.error FROM adj JOIN e d ON d.neuron_id = src_id AND NOT d.edge AND d.error >= 55 JOIN e t ON t.neuron_id = dst_id AND t.edge)
        SELECT neuron_id, round(CASE WHEN neuron_id IN (SELECT src_id FROM g) THEN error / 2 ELSE error END + coalesce((SELECT sum(g.error / 12) FROM g WHERE dst_id = neuron_id), 0), 6) AS error FROM e""",
    ),
    "growth_candidates": sql("hn hadj", "SELECT neuron_id, error FROM (SELECT neuron_id, ((neuron_id * 37) % 23 + CASE WHEN neuron_id IN (9, 10) THEN 60 ELSE 0 END)::DOUBLE AS error, (SELECT count(*) FROM hadj WHERE src_id = neuron_id) AS c FROM hn) WHERE error > 12 AND c < 6"),
    "growth_candidates_builtin": sql("hn hadj", "SELECT neuron_id, error FROM (SELECT neuron_id, ((neuron_id * 37) % 23 + CASE WHEN neuron_id IN (9, 10) THEN 60 ELSE 0 END)::DOUBLE AS error, (SELECT count(*) FROM hadj WHERE src_id = neuron_id) AS c FROM hn) WHERE error > 12 AND c < 6"),
    "growth_threshold_se": sql("r", "SELECT round(0.8::DOUBLE * sqrt(sum(v)), 6) AS gt FROM (SELECT var_samp(v) AS v FROM (SELECT unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM r) GROUP BY dim)"),
    "growth_threshold_sf": sql("r", "SELECT round(-ln(0.3::DOUBLE) * max(len(f)), 6) AS gt FROM r"),
    "missingness_info": sql("rn", "SELECT dim::INT AS dim, round(avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate, round((1 - avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)) ** 2, 6) AS weight FROM (SELECT unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM rn) GROUP BY dim"),
    "nan_distance_bmu": sql("n rn", f"SELECT row_id, neuron_id, round(distance, 6) AS distance FROM ({_nan_dist('rn')}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, neuron_id) = 1"),
    "weighted_nan_bmu": sql("n rn", f", wt AS (SELECT dim, (1 - avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)) ** 2 AS wt FROM (SELECT unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM rn) GROUP BY dim) SELECT row_id, neuron_id, round(distance, 6) AS distance FROM ({_nan_dist('rn', 'wt')}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, neuron_id) = 1"),
    "impute_neighbors": sql("n gd", ", l AS (SELECT neuron_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS dim FROM n) SELECT 5 AS neuron_id, dim::INT AS dim, round(CASE WHEN dim % 2 = 0 THEN any_value(v) FILTER (dst_id = 5) ELSE sum(v / hops) FILTER (hops BETWEEN 1 AND 2) / sum(1.0::DOUBLE / hops) FILTER (hops BETWEEN 1 AND 2) END, 6) AS weight FROM l JOIN gd ON dst_id = neuron_id AND src_id = 5 GROUP BY dim"),
    "scaler_fit": sql("line", " UNION ALL ".join(f"SELECT '{c}' AS name, 'continuous' AS kind, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS std FROM line" for c in _LINE)),
    "zscore": sql("line", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in _LINE)} FROM line, {_STATS}"),
    "minmax": sql("line", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - lo_{c}) / (hi_{c} - lo_{c}), 6) AS {c}' for c in _LINE)} FROM line, {_STATS}"),
    "inverse_scale": sql("line", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({c}, 6) AS {c}' for c in _LINE)} FROM line"),
    "binary_detect": "SELECT * FROM (VALUES ('odd', true), ('big', true), ('p_size', false), ('p_retailprice', false), ('nothing', false)) v(name, is_binary)",
    "log_rescale": "SELECT p_partkey, round((ln(p_retailprice) - lo) / (hi - lo) * 100, 6) AS p_retailprice, round((p_size - 25)::DOUBLE, 6) AS offset_size FROM part, (SELECT min(ln(p_retailprice)) AS lo, max(ln(p_retailprice)) AS hi FROM part)",
    "signed_log_rescale": "WITH s AS (SELECT p_partkey, sign(p_size - 25) * ln(1 + abs(p_size - 25)::DOUBLE) AS v FROM part) SELECT p_partkey, round((v - lo) / (hi - lo) * 100, 6) AS offset_size FROM s, (SELECT min(v) AS lo, max(v) AS hi FROM s)",
    "minmax_rescale": "SELECT p_partkey, round((p_size - lo) / (hi - lo)::DOUBLE * 100, 6) AS p_size FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)",
    "sliding_windows": sql("daily", ", w AS (SELECT user_id, row_number() OVER o AS time_index, day AS end_time, lag(total, 2) OVER o AS v0, lag(n, 2) OVER o AS v1, lag(total) OVER o AS v2, lag(n) OVER o AS v3, total AS v4, n AS v5 FROM daily WINDOW o AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, time_index::INT AS time_index, end_time, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2, round(v3, 6) AS v3, round(v4, 6) AS v4, round(v5, 6) AS v5 FROM w WHERE time_index >= 3 AND (time_index - 3) % 2 = 0"),
    "entity_zscores": sql("daily", "SELECT user_id, day, round((total - avg(total) OVER w) / CASE WHEN stddev_samp(total) OVER w = 0 THEN 1 ELSE stddev_samp(total) OVER w END, 6) AS total, round((n - avg(n) OVER w) / CASE WHEN stddev_samp(n) OVER w = 0 THEN 1 ELSE stddev_samp(n) OVER w END, 6) AS n FROM daily WINDOW w AS (PARTITION BY user_id)"),
    "entity_counts": sql("daily", "SELECT user_id, ((count(*) - 3) // 2 + 1)::BIGINT AS n_windows FROM daily GROUP BY 1 HAVING count(*) >= 3"),
    "trajectory": sql("tr", "SELECT time_index, neuron_id, x, y, round(distance, 4) AS distance FROM tr WHERE user_id = 7"),
    "entity_summary": sql("tr", ", c AS (SELECT *, neuron_id % 4 AS cluster, time_index // 10 AS era FROM tr), l AS (SELECT *, lag(cluster) OVER w AS pc, lag(era) OVER w AS pe FROM c WINDOW w AS (PARTITION BY user_id ORDER BY time_index)), q AS (SELECT user_id, cluster, count(*) AS c FROM c GROUP BY user_id, cluster), m AS (SELECT user_id, cluster FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, cluster) = 1) SELECT l.user_id, count(*)::BIGINT AS n_snapshots, min(time_index) AS first_time, max(time_index) AS last_time, arg_min(neuron_id, time_index) AS first_neuron, arg_max(neuron_id, time_index) AS last_neuron, any_value(m.cluster) AS main_cluster, (count(*) FILTER (l.cluster <> pc AND era = pe))::BIGINT AS n_changes FROM l JOIN m ON m.user_id = l.user_id GROUP BY 1"),
    "decade_bucket": "SELECT (year(o_orderdate) // 10 * 10)::INT AS decade, (CASE WHEN year(o_orderdate) >= 1995 THEN 1995 WHEN year(o_orderdate) >= 1990 THEN 1990 WHEN year(o_orderdate) >= 1980 THEN 1980 END)::INT AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2",
    "snapshot_clusters": sql("tr", ", s AS (SELECT *, end_time + 1990 AS year, count(*) OVER (PARTITION BY end_time) AS c FROM tr) SELECT ((year // 10) * 10)::INT AS decade, (CASE WHEN c < 2 OR neuron_id = 1 OR year // 10 NOT IN (199, 200) THEN 1 ELSE neuron_id % 3 + 2 END)::INT AS cluster, count(*)::BIGINT AS n FROM s GROUP BY 1, 2"),
    "name_clusters": "WITH m AS (SELECT (c_custkey % 9)::INT AS cluster, avg(c_acctbal) AS v FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v, cluster) - 1 AS r FROM m) SELECT cluster, round(v, 6) AS mean_value, ['low', 'middle', 'high'][(r // 3 + 1)::INT] || CASE WHEN r % 3 > 0 THEN ' (2)' ELSE '' END AS name FROM r",
    "outer_merge": sql("oma", "SELECT * FROM oma"),
    "missing_filter": sql("oma", ", m AS (SELECT o_custkey, count(*)::BIGINT AS n_rows, (3 * count(*) - count(total_f) - count(total_o) - count(n_other)) * 100.0::DOUBLE / (3 * count(*)) AS pct FROM oma GROUP BY 1) SELECT o_custkey, n_rows, round(pct, 6) AS missing_pct FROM m WHERE pct <= 50"),
    "anti_filter": "SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('FRANCE', 'GERMANY')",
    "conditional_null": "SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN year(o_orderdate) >= 1995 THEN o_totalprice END AS o_totalprice FROM orders",
    "label_encode": "SELECT event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS code, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "first_names": "SELECT user_id, arg_min(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1",
    "range_filter": "SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996",
    "assign_labels": sql("cl", "SELECT row_id, neuron_id, cluster FROM cl"),
    "cluster_info": sql("hits", "SELECT x AS cluster, count(*)::BIGINT AS n_neurons, sum(hits)::BIGINT AS n_samples, '[' || string_agg('{\"x\":' || x || ',\"y\":' || y || '}', ',' ORDER BY x, y) || ']' AS positions FROM hits GROUP BY 1"),
    "contingency": sql("ct", "SELECT * FROM ct"),
    "crosstab": sql("ct", f"SELECT cluster, {', '.join(f'coalesce(sum(n) FILTER (label = {k}), 0)::BIGINT AS label_{k}' for k in range(10))} FROM ct GROUP BY 1"),
    "purity": sql("ct", "SELECT round(sum(m) / sum(n)::DOUBLE, 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS n FROM ct GROUP BY cluster)"),
    "nmi": sql("ct", f", t AS (SELECT sum(n)::DOUBLE AS n FROM ct), h AS (SELECT (SELECT -sum(c.n / t.n * ln(c.n / t.n)) FROM {_BY.format('cluster')} c, t) AS hu, (SELECT -sum(c.n / t.n * ln(c.n / t.n)) FROM {_BY.format('label')} c, t) AS hv, (SELECT -sum(c.n / t.n * ln(c.n / t.n)) FROM ct c, t) AS huv) SELECT round(2 * (hu + hv - huv) / (hu + hv), 6) AS nmi FROM h"),
    "ari": sql("ct", f", p AS (SELECT (SELECT p FROM {_PAIRS.format('ct')}) AS ij, (SELECT p FROM {_PAIRS.format(_BY.format('cluster'))}) AS i, (SELECT p FROM {_PAIRS.format(_BY.format('label'))}) AS j, (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE FROM ct) AS a) SELECT round((ij - i * j / a) / ((i + j) / 2 - i * j / a), 6) AS ari FROM p"),
    "per_cluster_purity": sql("ct", "SELECT cluster, arg_min(label, (-n, label)) AS dominant, round(max(n) / sum(n)::DOUBLE, 6) AS purity, sum(n)::BIGINT AS size FROM ct GROUP BY 1"),
    "count_clusters": sql("cl", "SELECT count(DISTINCT cluster)::BIGINT AS n_clusters FROM cl"),
    "distribution": sql("ct", "SELECT cluster, label, n, round(n * 100 / sum(n) OVER ()::DOUBLE, 6) AS percent, round(n * 100 / sum(n) OVER (PARTITION BY cluster)::DOUBLE, 6) AS percent_of_cluster FROM ct"),
    "neuron_classes": sql("n b", ", t AS (SELECT neuron_id, label, count(*) AS n FROM b GROUP BY ALL) SELECT n.neuron_id, count(t.label)::BIGINT AS n_classes, coalesce(arg_min(t.label, (-t.n, t.label)), -1)::INT AS dominant, round(coalesce(max(t.n) / sum(t.n)::DOUBLE, 0), 6) AS purity, CASE count(t.label) WHEN 0 THEN 'empty' WHEN 1 THEN 'pure' ELSE 'mixed' END AS kind FROM n LEFT JOIN t ON t.neuron_id = n.neuron_id GROUP BY 1"),
    "class_stats": sql("b", ", t AS (SELECT neuron_id, label, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY neuron_id) AS k FROM t) SELECT label, sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_neurons, (count(*) FILTER (k = 1))::BIGINT AS n_pure FROM k GROUP BY 1"),
    "silhouette": sql("n", ", d AS (SELECT a.neuron_id AS i, a.x AS c, b.x AS oc, avg(CASE WHEN a.neuron_id <> b.neuron_id THEN sqrt(list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END) AS m FROM n a, n b GROUP BY ALL), s AS (SELECT i, max(m) FILTER (c = oc) AS a, min(m) FILTER (c <> oc) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s"),
    "davies_bouldin": sql("r", ", l AS (SELECT row_id, label, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS dim FROM r), c AS (SELECT label, dim, avg(v) AS m FROM l GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM (SELECT l.label, row_id, sqrt(sum((v - m) ** 2)) AS d FROM l JOIN c ON c.label = l.label AND c.dim = l.dim GROUP BY ALL) GROUP BY 1), p AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL) SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS w FROM p JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY 1)"),
    "pairwise_distances": sql("n", "SELECT a.neuron_id AS row_id, b.neuron_id, round(sqrt(list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM n a, n b"),
    "has_missing": sql("r rn", "SELECT 'plain' AS name, bool_or(len(list_filter(f, lambda v: v IS NULL)) > 0) AS missing FROM r UNION ALL SELECT 'holed', bool_or(len(list_filter(f, lambda v: v IS NULL)) > 0) FROM rn"),
    "dead_neurons": sql("hits", "SELECT neuron_id, hits FROM hits WHERE hits < 30"),
    "unique_entities": sql("daily", "SELECT user_id FROM daily GROUP BY 1 HAVING count(*) >= 3"),
    "count_distinct": "SELECT count(DISTINCT o_custkey)::BIGINT AS n_customers, count(DISTINCT year(o_orderdate))::BIGINT AS n_years FROM orders",
    "transform_features": "WITH s AS (SELECT p_partkey, ln(p_retailprice) AS a, sign(p_size - 25) * ln(1 + abs(p_size - 25)::DOUBLE) AS b, p_size::DOUBLE AS c FROM part), m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM s) SELECT p_partkey, round((a - a0) / (a1 - a0) * 100, 6) AS p_retailprice, round((b - b0) / (b1 - b0) * 100, 6) AS offset_size, round((c - c0) / (c1 - c0) * 100, 6) AS p_size FROM s, m",
    "mean_positions": sql("tr", "SELECT end_time, count(*)::BIGINT AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM tr GROUP BY 1"),
}
