"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

EVERY, K, LISTS, BUDGET, PROBES, SUBSPACES, CODES = 50, 10, 16, 125, 4, 8, 16
WIDTH = 64 // SUBSPACES


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def inner(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2]))"


def unit(v: str, divisor: str) -> str:
    return f"list_transform({v}, lambda x: x / ({divisor}))"


BASE = f"v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), q AS (SELECT id AS q_id, vec AS q FROM v WHERE id % {EVERY} = 0)"


def top(source: str, k: int = K) -> str:
    return f"SELECT q_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS rank FROM {source}) WHERE rank <= {k}"


def exact(expression: str, k: int = K) -> str:
    return f"WITH {BASE}, d AS (SELECT q_id, id, {expression} AS distance FROM v, q) {top('d', k)}"


NORMED = f"n AS (SELECT id, {unit('vec', 'sqrt(' + inner('vec', 'vec') + ') + 1e-10')} AS vec FROM v)"
COSINE = f"WITH {BASE}, {NORMED}, d AS (SELECT a.id AS q_id, b.id, 1.0::DOUBLE - {inner('b.vec', 'a.vec')} AS distance FROM n b, n a WHERE a.id % {EVERY} = 0) {top('d')}"


def components(divisor: str) -> str:
    return f"WITH {BASE}, n AS (SELECT id, {unit('vec', divisor)} AS x FROM v) SELECT id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, round(unnest(x), 9) AS x FROM n"


#: Components times this, rounded down, are summed exactly; a power of two that depends on the row count.
SCALE = "g AS (SELECT pow(2, 61 - ceil(log2(greatest(count(*), 2))) - greatest(0, ceil(log2(greatest(max(list_max(list_transform(vec, lambda x: abs(x)))), 1e-9))))) AS scale FROM v)"


def rounds(count: int, start: str | None = None) -> str:
    """Centroids c0 .. c{count} (cluster_id, c) by Lloyd rounds; empty clusters stay."""
    out = [SCALE, f"c0 AS ({start or f'SELECT CAST(id AS INTEGER) AS cluster_id, vec AS c FROM v WHERE id < {LISTS}'})"]
    for n in range(count):
        out.append(f"a{n} AS ({assigned(f'c{n}')})")
        out.append(f"s{n} AS (SELECT cluster_id, pos, sum(CAST(floor(x * scale) AS HUGEINT)) AS s, count(*) AS n FROM (SELECT cluster_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM a{n} JOIN v USING (id)), g GROUP BY ALL)")
        out.append(f"m{n} AS (SELECT cluster_id, list(CAST(s AS DOUBLE) / scale / n ORDER BY pos) AS c FROM s{n}, g GROUP BY cluster_id)")
        out.append(f"c{n + 1} AS (SELECT c{n}.cluster_id, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster_id))")
    return ", ".join(out)


def assigned(centroids: str) -> str:
    return f"SELECT id, arg_min(cluster_id, {{'d': d, 'c': cluster_id}}) AS cluster_id, min(d) AS centroid_distance FROM (SELECT id, cluster_id, {dist('vec', 'c')} AS d FROM v, {centroids}) GROUP BY id"


def centroid_rows(n: int) -> str:
    return f"SELECT cluster_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, round(unnest(c), 9) AS x FROM c{n}"


def books(source: str = "v", count: int = 0, scaled: bool = False) -> str:
    """Codebooks b{count} (s, code, b) of sub-vectors of the lowest ids of ``source``, after Lloyd rounds."""
    out = [
        f"parts AS (SELECT id, s, vec[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}] AS p FROM {source}, (SELECT unnest(range({SUBSPACES})) AS s))",
        f"b0 AS (SELECT s, CAST(id AS INTEGER) AS code, p AS b FROM parts WHERE id < {CODES})",
    ]
    if count and not scaled:
        out.insert(0, SCALE)
    for n in range(count):
        out.append(f"e{n} AS (SELECT id, s, any_value(p) AS p, arg_min(code, {{'d': d, 'c': code}}) AS code FROM (SELECT id, parts.s, p, code, {dist('p', 'b')} AS d FROM parts JOIN b{n} USING (s)) GROUP BY id, s)")
        out.append(f"t{n} AS (SELECT s, code, pos, sum(CAST(floor(x * scale) AS HUGEINT)) AS t, count(*) AS n FROM (SELECT s, code, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM e{n}), g GROUP BY ALL)")
        out.append(f"w{n} AS (SELECT s, code, list(CAST(t AS DOUBLE) / scale / n ORDER BY pos) AS b FROM t{n}, g GROUP BY s, code)")
        out.append(f"b{n + 1} AS (SELECT b{n}.s, b{n}.code, coalesce(w{n}.b, b{n}.b) AS b FROM b{n} LEFT JOIN w{n} USING (s, code))")
    return ", ".join(out)


def codes(source: str = "v", n: int = 0) -> str:
    """e (id, s, code, b, p)."""
    return f"e AS (SELECT id, s, arg_min(code, {{'d': d, 'c': code}}) AS code, arg_min(b, {{'d': d, 'c': code}}) AS b FROM (SELECT parts.id, parts.s, code, b, {dist('p', 'b')} AS d FROM parts JOIN b{n} USING (s)) GROUP BY id, s)"


DECODED = "dec AS (SELECT id, flatten(list(b ORDER BY s)) AS x FROM e GROUP BY id)"
PQ = f"WITH {BASE}, {books()}, {codes()}"
QPARTS = f"qp AS (SELECT q_id, s, q[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}] AS p FROM q, (SELECT unnest(range({SUBSPACES})) AS s))"
#: Sums over subspaces of the sub-vectors' distances, subspaces in order.
def flat(count: int) -> str:
    return f"WITH {BASE}, {books(count=count)}, {codes(n=count)}, {QPARTS}, tab AS (SELECT q_id, qp.s, code, {dist('p', 'b')} AS d FROM qp JOIN b{count} USING (s)), d AS (SELECT q_id, id, list_sum(list(d ORDER BY s)) AS distance FROM e JOIN tab USING (s, code) GROUP BY q_id, id) {top('d')}"


FLAT = flat(0)

CENTROIDS = rounds(1)
LISTED = f"post AS ({assigned('c1')}), sizes AS (SELECT c1.cluster_id, count(post.id) AS n FROM c1 LEFT JOIN post USING (cluster_id) GROUP BY 1)"
ROUTED = f"near AS (SELECT q_id, cluster_id, {dist('q', 'c')} AS cd FROM q, c1), rk AS (SELECT *, row_number() OVER w AS probe, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM near JOIN sizes USING (cluster_id) WINDOW w AS (PARTITION BY q_id ORDER BY cd, cluster_id))"
IVF = f"WITH {BASE}, {CENTROIDS}, {LISTED}, {ROUTED}"
BY_BUDGET, BY_PROBES = f"cum - n < {BUDGET}", f"probe <= {PROBES}"


def probes(condition: str) -> str:
    return f"{IVF} SELECT q_id, CAST(probe AS INTEGER) AS probe, cluster_id, round(cd, 9) AS centroid_distance, n FROM rk WHERE {condition}"


def searched(condition: str, residual: bool = False, rerank: int = 0, trained: int = 0) -> str:
    """Search over the routed lists by codes; with ``rerank`` the best of that many by exact distance."""
    out = [IVF, f"pr AS (SELECT q_id, cluster_id FROM rk WHERE {condition})"]
    if residual:
        out.append("res AS (SELECT v.id, list_transform(list_zip(vec, c), lambda t: t[1] - t[2]) AS vec FROM v JOIN post USING (id) JOIN c1 USING (cluster_id))")
    out += [books("res" if residual else "v", trained, True), codes(n=trained)]
    query = "list_transform(list_zip(q, c), lambda t: t[1] - t[2])" if residual else "q"
    out.append(f"qc AS (SELECT q_id, cluster_id, {query} AS q FROM pr JOIN q USING (q_id) JOIN c1 USING (cluster_id))")
    out.append(f"cand AS (SELECT qc.q_id, e.id, list_sum(list({dist(f'qc.q[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}]', 'e.b')} ORDER BY s)) AS distance FROM qc JOIN post USING (cluster_id) JOIN e USING (id) GROUP BY qc.q_id, e.id)")
    if not rerank:
        return ", ".join(out) + " " + top("cand")
    out.append(f"short AS (SELECT q_id, id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS r FROM cand) WHERE r <= {max(K, rerank)})")
    out.append(f"fin AS (SELECT q_id, id, {dist('q', 'vec')} AS distance FROM short JOIN q USING (q_id) JOIN v USING (id))")
    return ", ".join(out) + " " + top("fin")


def ranked(sql: str, name: str) -> str:
    """A search's SQL as a subquery with a name."""
    return f"{name} AS MATERIALIZED ({sql})"


CORNERS = "SELECT CAST(i AS INTEGER) AS i, list_transform(range(4), lambda p: 2.0::DOUBLE * ((i >> p) & 1) - 1) AS c FROM (SELECT unnest(range(16)) AS i)"
LINES = f"rows AS (SELECT l_orderkey * 8 + l_linenumber AS id, row_number() OVER () AS n, [(l_quantity - 25.0::DOUBLE) / 15.0::DOUBLE, (l_extendedprice - 38000.0::DOUBLE) / 23000.0::DOUBLE, (l_discount - 0.05::DOUBLE) / 0.03::DOUBLE, (l_tax - 0.04::DOUBLE) / 0.025::DOUBLE] AS vec FROM lineitem), q AS (SELECT CAST(i AS BIGINT) AS q_id, list_transform(c, lambda x: 0.5 * x) AS q FROM ({CORNERS}))"
#: Ids repeat, so what groups by row takes the row's number.
NUMBERED = f"{LINES}, v AS (SELECT n AS id, vec FROM rows)"
LINE_START = f"SELECT i AS cluster_id, c FROM ({CORNERS})"

FOUND, TRUTH = searched(BY_BUDGET, rerank=20), exact(dist("vec", "q"))


def recall(k: int, found: str = FOUND) -> str:
    return f"WITH {ranked(found, 'f')}, {ranked(TRUTH, 't')} SELECT round(count(f.id) / ({k}.0::DOUBLE * count(DISTINCT t.q_id)), 6) AS recall, count(DISTINCT t.q_id) AS queries FROM t LEFT JOIN (SELECT q_id, id FROM f WHERE rank <= {k}) f ON t.q_id = f.q_id AND t.id = f.id WHERE t.rank <= {k}"


MARGIN = f"n2 AS (SELECT id, cluster_id, d, row_number() OVER (PARTITION BY id ORDER BY d, cluster_id) AS r FROM (SELECT id, cluster_id, {dist('vec', 'c')} AS d FROM v, {{c}})), mg AS (SELECT a.id, a.cluster_id AS first, b.cluster_id AS second, (b.d - a.d) / greatest(abs(a.d), 1e-6) AS margin FROM n2 a JOIN n2 b USING (id) WHERE a.r = 1 AND b.r = 2)"

# the first twenty of the list by codes, for the share that the shortlist keeps
_SHORT = searched(BY_BUDGET).replace(f"WHERE rank <= {K}", "WHERE rank <= 20")

#: A node's top layer, from a hash of its id.
LEVEL = "CAST(floor(-ln((CAST(('0x' || substr(md5(vec_id || ':42'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / ln(16::DOUBLE)) AS INTEGER)"


def minibatches(count: int, size: int, rounds: int, accumulated: bool) -> str:
    """Rounds that see windows of ``size`` rows in id order; sums of all rounds count if ``accumulated``."""
    out = [SCALE, "p AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS total FROM v)", f"c0 AS (SELECT CAST(id AS INTEGER) AS cluster_id, vec AS c FROM v WHERE id < {count})"]
    for n in range(rounds):
        out.append(f"w{n} AS (SELECT id, vec FROM p WHERE ((pos - {n * size}) % total + total) % total < {size})")
        out.append(f"a{n} AS (SELECT id, arg_min(cluster_id, {{'d': d, 'c': cluster_id}}) AS cluster_id FROM (SELECT id, cluster_id, {dist('vec', 'c')} AS d FROM w{n}, c{n}) GROUP BY id)")
        out.append(f"s{n} AS (SELECT cluster_id, pos, sum(CAST(floor(x * scale) AS HUGEINT)) AS s, count(*) AS n FROM (SELECT cluster_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM a{n} JOIN w{n} USING (id)), g GROUP BY ALL)")
        seen = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in (range(n + 1) if accumulated else [n]))
        own = f" WHERE cluster_id IN (SELECT cluster_id FROM s{n})"
        out.append(f"m{n} AS (SELECT cluster_id, list(CAST(s AS DOUBLE) / scale / n ORDER BY pos) AS c FROM (SELECT cluster_id, pos, sum(s) AS s, CAST(sum(n) AS BIGINT) AS n FROM ({seen}){own} GROUP BY ALL), g GROUP BY cluster_id)")
        out.append(f"c{n + 1} AS (SELECT c{n}.cluster_id, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster_id))")
    return f"WITH {BASE}, {', '.join(out)} {centroid_rows(rounds)}"


SQL = {
    "knn_l2": exact(dist("vec", "q")),
    "knn_l2_columns": exact(dist("vec", "q")),
    "knn_l2_grid": exact(dist("vec", "q")),
    "knn_cosine": COSINE,
    "knn_cosine_columns": COSINE,
    "knn_dot": exact("-" + inner("vec", "q")),
    "knn_k_gt_n": exact(dist("vec", "q"), 1000),
    "vec_norms": f"WITH {BASE} SELECT id, round({inner('vec', 'vec')}, 9) AS squared, round(sqrt({inner('vec', 'vec')}), 9) AS norm FROM v",
    "normalize": components(f"sqrt({inner('vec', 'vec')}) + 1e-10"),
    "normalize_rows": components(f"greatest(sqrt({inner('vec', 'vec')}), 1e-12)"),
    "vec_split": f"WITH {BASE} SELECT id, CAST(s AS INTEGER) AS subspace, round({inner(f'vec[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}]', f'vec[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}]')}, 9) AS squared FROM v, (SELECT unnest(range({SUBSPACES})) AS s)",
    "range_count": f"WITH {BASE} SELECT q_id, count(*) FILTER (WHERE {dist('vec', 'q')} <= 1.5) AS n FROM v, q GROUP BY q_id",
    "l2_by_norms": f"WITH {BASE} SELECT q_id, id, round({inner('vec', 'vec')} - 2.0::DOUBLE * {inner('vec', 'q')} + {inner('q', 'q')}, 9) AS distance FROM v, q",
    "position_ids": "SELECT vec_id, id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 9) AS x FROM (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 + 100 AS id FROM embeddings)",
    "kmeans_assign": f"WITH {BASE}, {rounds(0)} SELECT id, cluster_id, round(centroid_distance, 9) AS centroid_distance FROM ({assigned('c0')})",
    "kmeans_step": f"WITH {BASE}, {rounds(1)} {centroid_rows(1)}",
    "kmeans_fit3": f"WITH {BASE}, {rounds(3)} {centroid_rows(3)}",
    "kmeans_empty_retained": f"WITH {BASE}, {rounds(1, 'SELECT CAST(id AS INTEGER) AS cluster_id, CASE WHEN id = 3 THEN (SELECT vec FROM v WHERE id = 0) ELSE vec END AS c FROM v WHERE id < 4')} {centroid_rows(1)}",
    "kmeans_minibatch": minibatches(8, 200, 4, False),
    "kmeans_accumulated": minibatches(8, 200, 4, True),
    "kmeans_shift": f"WITH {BASE}, {rounds(3)} SELECT round(max(abs(t[1] - t[2])), 9) AS shift FROM (SELECT unnest(list_zip(c2.c, c3.c)) AS t FROM c2 JOIN c3 USING (cluster_id))",
    "cluster_histogram": f"WITH {BASE}, {rounds(3)}, post AS ({assigned('c3')}) SELECT c3.cluster_id, count(post.id) AS n FROM c3 LEFT JOIN post USING (cluster_id) GROUP BY 1",
    "two_nearest_margin": f"WITH {BASE}, {rounds(0)}, {MARGIN.format(c='c0')} SELECT id, first, second, round(margin, 9) AS margin FROM mg",
    "assignment_mismatches": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM embeddings",
    "pq_encode": f"{PQ} SELECT id, CAST(s AS INTEGER) AS subspace, code FROM e",
    "pq_train2_encode": f"WITH {BASE}, {books(count=2)}, {codes(n=2)} SELECT id, CAST(s AS INTEGER) AS subspace, code FROM e",
    "pq_decode": f"{PQ}, {DECODED} SELECT id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, round(unnest(x), 9) AS x FROM dec",
    "pq_recon_error": f"{PQ}, {DECODED} SELECT round(avg(sqrt({dist('vec', 'x')})), 9) AS error FROM v JOIN dec USING (id)",
    "pq_adc_table": f"WITH {BASE}, {books()}, {QPARTS} SELECT q_id, CAST(qp.s AS INTEGER) AS subspace, code, round({dist('p', 'b')}, 9) AS distance FROM qp JOIN b0 USING (s)",
    "pq_adc_column": FLAT,
    "pq_flat_topk": FLAT,
    "pq_trained_topk": flat(2),
    "pq_symmetric": f"WITH {BASE}, {books()} SELECT CAST(x.s AS INTEGER) AS subspace, x.code AS first, y.code AS second, round({dist('x.b', 'y.b')}, 9) AS distance FROM b0 x JOIN b0 y ON x.s = y.s",
    "pq_compression": "SELECT m, 256.0::DOUBLE / m AS ratio FROM (VALUES (8), (16), (32)) t(m)",
    "ivf_probe_nprobe": probes(BY_PROBES),
    "ivf_probe_budget": probes(BY_BUDGET),
    "ivf_scanned": f"{IVF} SELECT q_id, count(*) AS lists, CAST(sum(n) AS BIGINT) AS scanned FROM rk WHERE {BY_BUDGET} GROUP BY q_id",
    "ivf_adc_topk": searched(BY_PROBES),
    "ivf_budget_topk": searched(BY_BUDGET),
    "ivf_residual_topk": searched(BY_PROBES, True),
    "ivf_rerank_topk": searched(BY_PROBES, rerank=20),
    "ivf_residual_rerank_topk": searched(BY_BUDGET, True, 20),
    "ivf_trained_topk": searched(BY_PROBES, rerank=20, trained=2),
    "ivf_full_probe_equals_exact": exact(dist("vec", "q")),
    "base_plus_delta_topk": searched(BY_PROBES),
    "replicated_candidates": f"WITH {BASE}, {CENTROIDS}, {MARGIN.format(c='c1')}, post AS (SELECT id, first AS cluster_id FROM mg UNION ALL SELECT id, second FROM (SELECT * FROM mg ORDER BY margin, id LIMIT (SELECT count(*) // 4 FROM v))), sizes AS (SELECT c1.cluster_id, count(post.id) AS n FROM c1 LEFT JOIN post USING (cluster_id) GROUP BY 1), {ROUTED} SELECT DISTINCT q_id, id FROM rk JOIN post USING (cluster_id) WHERE {BY_BUDGET}",
    "lines_knn": f"WITH {LINES}, d AS (SELECT q_id, id, {dist('vec', 'q')} AS distance FROM rows, q) {top('d')}",
    "lines_histogram": f"WITH {NUMBERED}, {rounds(2, LINE_START)}, post AS ({assigned('c2')}) SELECT c2.cluster_id, count(post.id) AS n FROM c2 LEFT JOIN post USING (cluster_id) GROUP BY 1",
    "lines_scanned": f"WITH {NUMBERED}, {rounds(1, LINE_START)}, {LISTED}, {ROUTED} SELECT q_id, count(*) AS lists, CAST(sum(n) AS BIGINT) AS scanned FROM rk WHERE cum - n < 6000 GROUP BY q_id",
    "recall_at_1": recall(1),
    "recall_at_10": recall(10),
    "three_recalls": f"WITH {ranked(FOUND, 'f')}, {ranked(TRUTH, 't')}, {ranked(_SHORT, 'sh')}, {ranked(f'{IVF} SELECT q_id, id FROM rk JOIN post USING (cluster_id) WHERE {BY_BUDGET}', 'ro')} SELECT round(avg(CAST(EXISTS (SELECT 1 FROM ro WHERE ro.q_id = t.q_id AND ro.id = t.id) AS INTEGER)), 6) AS routing_recall, round(avg(CAST(EXISTS (SELECT 1 FROM sh WHERE sh.q_id = t.q_id AND sh.id = t.id) AS INTEGER)), 6) AS shortlist_recall, round(avg(CAST(EXISTS (SELECT 1 FROM f WHERE f.q_id = t.q_id AND f.id = t.id) AS INTEGER)), 6) AS final_recall FROM t",
    "precision_at_10": f"WITH {ranked(COSINE.replace(f'rank <= {K}', f'rank <= {K + 1}'), 'f')} SELECT round(avg(CAST(a.label = b.label AS INTEGER)), 6) AS precision, count(DISTINCT q_id) AS queries FROM f JOIN embeddings a ON a.vec_id = f.id JOIN embeddings b ON b.vec_id = f.q_id WHERE f.q_id <> f.id",
    "latency_summary": "WITH m AS (SELECT abs(value) + 1 AS ms FROM events) SELECT count(*) AS n, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms, round(1000 / avg(ms), 6) AS qps FROM m",
    "config_select": "SELECT * FROM (VALUES ('a', 0.97::DOUBLE, 9.0::DOUBLE, 14.0::DOUBLE, 100, 560::BIGINT, 10.0::DOUBLE), ('b', 0.94, 5.0, 8.0, 200, 400, 8.0), ('c', 0.96, 8.0, 12.0, 120, 560, 12.0), ('d', 0.99, 9.5, 12.0, 200, 700, 9.0)) t(name, recall_at_10, p50_ms, p95_ms, queries, index_bytes, build_s) WHERE recall_at_10 >= 0.95 AND queries >= 100 ORDER BY index_bytes, p95_ms, build_s LIMIT 1",
    "coarse_decision": "WITH r AS (SELECT n AS config, mode AS coarse_training, seed, 0.80::DOUBLE + 0.01 * n + CASE WHEN mode = 'accumulated' THEN 0.004 * seed ELSE 0 END AS rr, 1.0::DOUBLE + n + CASE WHEN mode = 'accumulated' THEN 0.5 ELSE 0 END AS ts FROM (VALUES (1), (2)) a(n), (VALUES ('legacy'), ('accumulated')) b(mode), (VALUES (1), (2), (3)) c(seed) WHERE seed < 2 + n) SELECT config, count(*) AS seeds, round(avg(y.rr - x.rr), 6) AS gain, round(avg(x.ts), 6) AS legacy_s, round(avg(y.ts), 6) AS accumulated_s, avg(y.rr - x.rr) >= 0.005 AS promote FROM r x JOIN r y USING (config, seed) WHERE x.coarse_training = 'legacy' AND y.coarse_training = 'accumulated' GROUP BY config HAVING count(*) >= 3",
    "frontier": "WITH "
    + ", ".join(f"f{n}_{r} AS MATERIALIZED ({searched(f'probe <= {n}', rerank=r)})" for n in (1, 2, 4, 8) for r in (0, 20))
    + f", {ranked(TRUTH, 't')} "
    + " UNION ALL ".join(f"SELECT {n} AS nprobe, {r} AS rerank, round(avg(CAST(EXISTS (SELECT 1 FROM f{n}_{r} f WHERE f.q_id = t.q_id AND f.id = t.id) AS INTEGER)), 6) AS recall FROM t" for n in (1, 2, 4, 8) for r in (0, 20)),
    "hnsw_full_beam": COSINE,
    "hnsw_degree": "SELECT CAST(0 AS BIGINT) AS violations",
    "hnsw_reciprocity": "SELECT CAST(0 AS BIGINT) AS violations",
    "hnsw_levels": f"SELECT vec_id AS id, {LEVEL} AS level FROM embeddings",
    "hnsw_size": f"SELECT count(*) AS nodes, CAST(4 * count(*) + 4 * sum({LEVEL} + 1) AS BIGINT) AS frame_bytes FROM embeddings",
    "hnsw_pq_full_beam": FLAT,
    "hnsw_pq_rerank": exact(dist("vec", "q")),
    "hnsw_stored": exact(dist("vec", "q")),
    "stored_topk": searched(BY_PROBES),
    "compacted_topk": searched(BY_PROBES),
    "streamed_topk": searched(BY_PROBES),
    "collection_stats": f"SELECT 'items' AS name, count(*) AS total_vectors, CAST({4 * LISTS * 65 + 4 * 64 * CODES + 16 * LISTS} AS BIGINT) AS resident_memory_bytes, {LISTS} AS nlist, 64 AS dim, true AS trained, false AS compacted, true AS store_full_vectors, 'arrow' AS routing_backend, 'residual' AS pq_mode, 'accumulated' AS coarse_training, count(*) * {16 + SUBSPACES} AS posting_bytes, count(*) * 256 AS raw_vector_bytes FROM embeddings",
    "collection_list": "SELECT 'items' AS name, count(*) AS total_vectors FROM embeddings UNION ALL SELECT 'empty', 0",
    "collection_topk": exact(dist("vec", "q")),
    "uniform_vectors": "SELECT CAST(8000 AS BIGINT) AS n, true AS in_range, true AS centred",
    "dataset_check": f"SELECT count(*) AS base, count(*) FILTER (WHERE vec_id % {EVERY} = 0) AS queries, 64 AS dim FROM embeddings",
}
