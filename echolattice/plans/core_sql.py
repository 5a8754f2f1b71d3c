"""The results of the engine's queries in plain SQL."""

from __future__ import annotations

_T = "' ' || chr(9)"
_FRAMES = "frames AS (SELECT label AS resource_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS t, embedding FROM embeddings)"
_SPEC = _FRAMES + ", spec AS (SELECT resource_id, t, CAST(g.f AS INT) AS f, abs(CAST(embedding[g.f + 1] AS DOUBLE)) AS m FROM frames, range(64) g(f))"
_POINTS = _SPEC + """,
vmax AS (SELECT *, max(m) OVER (PARTITION BY resource_id, t ORDER BY f RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS vm, sum(m) OVER (PARTITION BY resource_id, t ORDER BY f RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS vs FROM spec),
hmax AS (SELECT *, max(vm) OVER (PARTITION BY resource_id, f ORDER BY t RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS hm, sum(vs) OVER (PARTITION BY resource_id, f ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m9, max(t) OVER (PARTITION BY resource_id, f) AS final FROM vmax),
ep AS (SELECT resource_id, t, f, m9 AS m FROM hmax WHERE m = vm AND m = hm AND m <> 0 AND f BETWEEN 2 AND 62 AND t BETWEEN 4 AND final - 4)"""
_VOLUME = "vol AS (SELECT user_id AS resource_id, CAST((epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-01') // 1000000) // 3600 AS INT) AS t, CAST(floor(value) AS INT) AS f, value AS m FROM events)"


def _pack(points: str, name: str, two: bool = False) -> str:
    near = lambda a, b: f"{a}.resource_id = {b}.resource_id AND {b}.t - {a}.t BETWEEN 2 AND 33 AND abs({a}.f - {b}.f) BETWEEN 1 AND 128"
    third = "b" if two else "c"
    cols = ", ".join(f"{x}.{v} AS {v}{i}" for x, i in (("a", 1), ("b", 2), (third, 3)) for v in "tfm")
    return f"{name} AS (SELECT a.resource_id, {cols} FROM {points} a JOIN {points} b ON {near('a', 'b')}" + ("" if two else f" JOIN {points} c ON {near('b', 'c')}") + ")"


def _flags(shift: int) -> str:
    tests = ["f1 > f2", "f2 > f3", "f3 > f1", "m1 > m2", "m2 > m3", "m3 > m1", "t2 - t1 > t3 - t2", "abs(f2 - f1) > abs(f3 - f2)"]
    bits = [f"(CASE WHEN {x} THEN {1 << (6 + i)} ELSE 0 END)" for i, x in enumerate(tests)]
    return " + ".join([*bits, f"((f1 >> {shift}) & 255) * {1 << 14}", f"((abs(f2 - f1) >> 2) & 63) * {1 << 22}", f"CAST((abs(f3 - f2) >> 2) & 63 AS BIGINT) * {1 << 28}"])


HASH_A = f"CAST(((64 * (t2 - t1) // (t3 - t1)) & 63) + {_flags(5)} AS BIGINT)"
HASH_B = f"CAST(((t3 - t1) & 63) + {_flags(1)} AS BIGINT)"
_PERTURBED = """pert AS (SELECT resource_id, t, f, m FROM ep UNION ALL SELECT 100 + resource_id, t - 10, f, m FROM ep WHERE t BETWEEN 10 AND 34
  UNION ALL SELECT 200 + resource_id, t, f + 3, m FROM ep UNION ALL SELECT 300 + resource_id, (t * 20) // 21, f, m FROM ep)"""
_INDEX = ", ".join([_POINTS, _pack("ep", "fp"), f"idx AS (SELECT {HASH_A} AS hash, resource_id, t1, f1 FROM fp)"])


def _chain(asked: str, spb: str = "1") -> str:
    """From query prints ``asked (query_id, hash, t1, f1)`` and ``idx`` to ``found``; a frame has ``spb`` seconds."""
    return f"""
qa AS (SELECT query_id, hash, count(*) AS times, max(struct_pack(t1 := t1, f1 := coalesce(f1, -1))) AS fin FROM {asked} GROUP BY query_id, hash),
qn AS (SELECT query_id, hash, times, fin.t1 AS query_time, nullif(fin.f1, -1) AS query_f1, unnest([hash - 2, hash - 1, hash, hash + 1, hash + 2]) AS near_hash FROM qa),
h1 AS (SELECT query_id, resource_id AS ref_id, query_time, query_f1, i.t1 AS match_time, i.f1 AS match_f1, qn.hash, near_hash, i.t1 - query_time AS delta_t, unnest(range(times)) AS again FROM qn JOIN idx i ON near_hash = i.hash /*AVOID*/),
hits AS (SELECT * EXCLUDE (again) FROM h1),
kept AS (SELECT *, count(*) OVER (PARTITION BY query_id, ref_id) AS n_hits, row_number() OVER (PARTITION BY query_id, ref_id ORDER BY query_time, match_time, hash, near_hash, match_f1 NULLS FIRST) AS rn FROM hits QUALIFY n_hits >= 10),
parts AS (SELECT *, rn <= part_size AS in_first, rn > n_hits - part_size AS in_last FROM (SELECT *, CAST(least(250, greatest(10, n_hits // 5)) AS INT) AS part_size FROM kept)),
d1 AS (SELECT query_id, ref_id, delta_t, count(*) AS n, min(rn) AS rn FROM parts WHERE in_first GROUP BY query_id, ref_id, delta_t QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY n DESC, delta_t) = 1),
d2 AS (SELECT query_id, ref_id, delta_t, count(*) AS n, max(rn) AS rn FROM parts WHERE in_last GROUP BY query_id, ref_id, delta_t QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY n DESC, delta_t) = 1),
modes AS (SELECT d1.query_id, d1.ref_id, d1.delta_t AS y1, p1.query_time AS x1, d2.delta_t AS y2, p2.query_time AS x2, p1.match_f1 AS first_f1, p1.query_f1 AS first_query_f1
  FROM d1 JOIN d2 ON d1.query_id = d2.query_id AND d1.ref_id = d2.ref_id JOIN parts p1 ON p1.query_id = d1.query_id AND p1.ref_id = d1.ref_id AND p1.rn = d1.rn
  JOIN parts p2 ON p2.query_id = d2.query_id AND p2.ref_id = d2.ref_id AND p2.rn = d2.rn),
lines AS (SELECT *, CAST(y2 - y1 AS DOUBLE) / nullif(x2 - x1, 0) AS slope FROM modes),
aligned AS (SELECT *, y1 - x1 * slope AS "offset", 1 / nullif(1 - slope, 0) AS time_factor, pow(2, (first_f1 - first_query_f1) / 85.0) AS freq_factor FROM lines),
online AS (SELECT k.*, time_factor, freq_factor FROM kept k JOIN aligned a ON k.query_id = a.query_id AND k.ref_id = a.ref_id
  WHERE time_factor > 0.8 AND time_factor < 1.2 AND freq_factor > 0.8 AND freq_factor < 1.2 AND abs(delta_t - (slope * query_time + a."offset")) <= 2),
{_summary("online", "found", spb)}"""


def _summary(source: str, name: str, spb: str = "1") -> str:
    return f"""{name}_s AS (SELECT *, first_value(match_time) OVER w AS a0, last_value(match_time) OVER w AS z0 FROM {source}
  WINDOW w AS (PARTITION BY query_id, ref_id ORDER BY query_time, match_time, hash, near_hash, match_f1 NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name}_t AS (SELECT *, query_time * {spb}::DOUBLE AS q, a0 * {spb}::DOUBLE AS a, z0 * {spb}::DOUBLE AS z, match_time * {spb}::DOUBLE AS r FROM {name}_s),
{name} AS (SELECT query_id, ref_id, min(q) AS query_start, max(q) AS query_stop, min(a) AS ref_start, min(z) AS ref_stop, count(*) AS score,
  min(time_factor) AS time_factor, min(freq_factor) AS freq_factor, 1 - CAST(ceil(min(z) - min(a)) - count(DISTINCT trunc(r - a)) AS DOUBLE) / nullif(ceil(min(z) - min(a)), 0) AS coverage
  FROM {name}_t GROUP BY query_id, ref_id HAVING count(*) > 5 AND max(q) - min(q) >= 5 AND coverage >= 0.2)"""


_QUERY = ", ".join([_INDEX, _PERTURBED, _pack("pert", "qfp"), f"asked AS (SELECT resource_id AS query_id, {HASH_A} AS hash, t1, f1 FROM qfp)"])
_MATCH = f"WITH {_QUERY}, {_chain('asked')}"
_RANKED = ", ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS INT) AS rank FROM found)"
_R6 = "round(query_start, 6) AS query_start, round(query_stop, 6) AS query_stop, round(ref_start, 6) AS ref_start, round(ref_stop, 6) AS ref_stop, score, round(time_factor, 6) AS time_factor, round(freq_factor, 6) AS freq_factor, round(coverage, 6) AS coverage"
#: The stored postings as index, and those of the resources whose id is divisible by 50 as queries.
_WHOLE = f"""WITH idx AS (SELECT DISTINCT hash, resource_id, t1, f1 FROM postings WHERE hash IS NOT NULL AND resource_id IS NOT NULL), asked AS (SELECT resource_id AS query_id, hash, t1, f1 FROM idx WHERE resource_id % 50 = 0), {_chain('asked', '0.008')}"""
_DURATION = "lasting AS (SELECT resource_id, CAST(max(t) + 1 AS DOUBLE) AS duration FROM spec GROUP BY resource_id)"
_SPANS = "starts AS (SELECT resource_id, duration, unnest(range(0, greatest(0, CAST(ceil((duration - 25) / 20) AS INT)))) * 20.0 AS start FROM {0}), spans AS (SELECT resource_id, CAST(start AS DOUBLE) AS start, CAST(start + 25 AS DOUBLE) AS stop FROM starts WHERE duration IS NOT NULL)"


def _monitor(avoid: bool) -> str:
    asked = "asked AS (SELECT struct_pack(resource_id := i.resource_id, start := start) AS query_id, hash, t1, f1 FROM idx i JOIN spans s ON i.resource_id = s.resource_id AND t1 BETWEEN start AND stop)"
    chain = _chain("asked").replace("/*AVOID*/", "WHERE i.resource_id <> query_id.resource_id" if avoid else "")
    return f"WITH {_INDEX}, {_DURATION}, {_SPANS.format('lasting')}, {asked}, {chain}{_RANKED}"




def _windows(bins: int, width: float, low: int) -> str:
    """``win (f, f_start, f_stop)``: halving a sorted list of keys, step by step, for the key half a filter below and above each bin's."""
    return f"""keys AS (SELECT CAST(f AS INT) AS f, CASE WHEN f >= {low} THEN CAST(floor(12 * log2((f * {width}::DOUBLE + {width / 2}::DOUBLE) / 440) + 69.5) AS INT) ELSE 0 END AS k FROM range({bins}) r(f)),
aim AS (SELECT f, side, k + 10 * side AS key FROM keys, (VALUES (-1), (1)) v(side) WHERE f >= {low}),
halve AS (SELECT f, side, key, 0 AS a, {bins - 1} AS b, CAST(NULL AS INT) AS hit FROM aim UNION ALL
  SELECT h.f, side, key, CASE WHEN k < key THEN (a + b) // 2 + 1 ELSE a END, CASE WHEN k > key THEN (a + b) // 2 - 1 ELSE b END, CASE WHEN k = key THEN (a + b) // 2 END FROM halve h JOIN keys ON keys.f = (a + b) // 2 WHERE hit IS NULL AND a <= b),
ends AS (SELECT f, side, coalesce(hit, CASE WHEN side < 0 THEN a ELSE a + 1 END) AS pos FROM halve WHERE hit IS NOT NULL OR a > b),
win AS (SELECT f, greatest({low}, min(pos) FILTER (WHERE side < 0)) AS f_start, least({bins}, min(pos) FILTER (WHERE side > 0)) AS f_stop FROM ends GROUP BY f)"""


def _log_max(spec: str) -> str:
    return f"lmax AS (SELECT a.resource_id, a.t, a.f, a.m, max(b.m) AS vm FROM {spec} a JOIN win USING (f) LEFT JOIN {spec} b ON a.resource_id = b.resource_id AND a.t = b.t AND b.f >= f_start AND b.f < f_stop GROUP BY ALL)"


_LOG = f"RECURSIVE {_SPEC}, {_windows(64, 125.0, 2)}, {_log_max('spec')}"
_LOG_POINTS = """x AS (SELECT *, max(vm) OVER (PARTITION BY resource_id, f ORDER BY t RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS hm, max(t) OVER (PARTITION BY resource_id, f) AS final FROM lmax)"""
# a discrete Fourier transform of each window of 1,024 samples, 128 apart
_STFT = """pcm AS (SELECT resource_id, t * 64 + g.i AS n, CAST(embedding[g.i + 1] AS DOUBLE) AS v FROM frames, range(64) g(i)),
long AS (SELECT resource_id, max(n) + 1 AS samples FROM pcm GROUP BY 1),
steps AS (SELECT resource_id, CAST(unnest(range(0, greatest(0, (samples - 1024) // 128 + 1))) AS INT) AS t FROM long),
windowed AS (SELECT s.resource_id, t, n - t * 128 AS i, v * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * (n - t * 128) / 1023)) AS v FROM steps s JOIN pcm p ON p.resource_id = s.resource_id AND n BETWEEN t * 128 AND t * 128 + 1023),
power AS (SELECT resource_id, t, CAST(g.f AS INT) AS f, pow(sum(v * cos(2 * pi() * ((i * g.f) % 1024) / 1024)), 2) + pow(sum(v * sin(2 * pi() * ((i * g.f) % 1024) / 1024)), 2) AS m FROM windowed, range(9, 512) g(f) GROUP BY ALL),
full_power AS (SELECT * FROM power UNION ALL SELECT resource_id, t, CAST(g.f AS INT), 0.0 FROM steps, range(9) g(f))"""
# the 32-bit murmur hash over the words of a text in hex
_ROTL = lambda x, r: f"((({x}) << {r} & 4294967295) | (({x}) >> {32 - r}))"
_MIX = lambda k: f"(({_ROTL(f'(({k}) * 3432918353 & 4294967295)', 15)}) * 461845907 & 4294967295)"
_LITTLE = lambda w: f"CAST('0x' || {w}[7:8] || {w}[5:6] || {w}[3:4] || {w}[1:2] AS UBIGINT)"


def _murmur(data: str) -> str:
    """Of a column of hex digits in ``h`` with ``n`` bytes."""
    words = f"list_transform(regexp_extract_all({data}, '[0-9A-F]{{8}}'), lambda w: {_MIX(_LITTLE('w'))})"
    chain = f"list_reduce(list_prepend(CAST(0 AS UBIGINT), {words}), lambda a, k: (({_ROTL('xor(a, k)', 13)}) * 5 + 3864292196) & 4294967295)"
    last = f"right({data}, 2 * (n % 4))"
    rest = f"CASE n % 4 WHEN 0 THEN 0::UBIGINT WHEN 1 THEN CAST('0x' || {last} AS UBIGINT) WHEN 2 THEN CAST('0x' || {last}[3:4] || {last}[1:2] AS UBIGINT) ELSE CAST('0x' || {last}[5:6] || {last}[3:4] || {last}[1:2] AS UBIGINT) END"
    return f"xor(xor({chain}, {_MIX(rest)}), CAST(n AS UBIGINT))"


def _avalanche(x: str) -> str:
    return f"""(SELECT CAST(CASE WHEN c >= 2147483648 THEN CAST(c AS BIGINT) - 4294967296 ELSE CAST(c AS BIGINT) END AS INT) FROM (SELECT xor(b, b >> 16) AS c FROM (SELECT (xor(a, a >> 13) * 3266489909) & 4294967295 AS b FROM (SELECT (xor(x, x >> 16) * 2246822507) & 4294967295 AS a FROM (SELECT {x} AS x)))))"""


_IN_SPANS = "asked AS (SELECT struct_pack(resource_id := i.resource_id, start := start) AS query_id, hash, t1, f1 FROM {0} i JOIN spans s ON i.resource_id = s.resource_id AND t1 BETWEEN start AND stop {1})"
_EVERY = f"WITH {_INDEX}, {_DURATION}, {_SPANS.format('lasting')}, {_IN_SPANS.format('idx', 'WHERE i.resource_id % 2 = 0')}, {_chain('asked').replace('/*AVOID*/', 'WHERE i.resource_id % 4 = 0')}{_RANKED}"
_VERSIONS = f"""WITH {_POINTS}, {_PERTURBED}, {_pack('pert', 'qfp')}, idx AS (SELECT {HASH_A} AS hash, resource_id, t1, f1 FROM qfp), {_DURATION}, each AS (SELECT resource_id + 100 * k AS resource_id, duration FROM lasting, range(4) v(k)),
{_SPANS.format('each')}, {_IN_SPANS.format('idx', '')}, {_chain('asked').replace('/*AVOID*/', 'WHERE i.resource_id <> query_id.resource_id')}{_RANKED}"""
_STATS_RATE = "CASE WHEN duration > 0 AND num_fingerprints / duration > 0 THEN num_fingerprints / duration END"
_BASE = lambda c: f"regexp_extract({c}, '([^/]*?)(?:\\.[^./]*)?$', 1)"
_LINES = f"lines AS (SELECT * REPLACE (trim(query_path, {_T}) AS query_path, trim(ref_path, {_T}) AS ref_path) FROM result_lines WHERE query_path IS NOT NULL AND ref_path IS NOT NULL)"
_PCH = """cents AS (SELECT CAST(user_id AS INT) AS resource_id, 1200 * log2((value + 20) / 8.17579892) AS c FROM events),
pch AS (SELECT resource_id, CAST(floor(c - floor(c / 1200) * 1200 + 0.5) AS INT) AS bin, count(*) AS cnt FROM cents GROUP BY 1, 2 HAVING bin BETWEEN 0 AND 1199)"""
#: In all 1,200 bins, of the queries whose id is divisible by 50: each pair of filled bins adds to the one shift that lays them over each other.
_SHIFTED = f"""WITH {_PCH}, tot AS (SELECT resource_id, sum(cnt) AS total FROM pch GROUP BY 1),
over AS (SELECT q.resource_id AS query_id, r.resource_id AS ref_id, CAST((r.bin - q.bin + 1200) % 1200 AS INT) AS shift, sum(least(q.cnt, r.cnt)) AS v FROM pch q CROSS JOIN pch r WHERE q.resource_id % 50 = 0 GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY v DESC, shift) = 1),
best AS (SELECT query_id, ref_id, shift, CAST(v AS DOUBLE) / greatest(a.total, z.total) AS match FROM over JOIN tot a ON a.resource_id = query_id JOIN tot z ON z.resource_id = ref_id)"""
_ROBUST = lambda a, b, lo, hi: f"CAST(floor((ln(abs(CAST({a} AS DOUBLE) / nullif({b}, 0))) - ln({lo}/{hi})) / (ln({hi}/{lo}) - ln({lo}/{hi})) * 512 + 0.5) AS BIGINT)"
_MORTON = lambda x, y: "(" + " + ".join(f"(((({x}) >> {i}) & 1) << {2 * i}) + (((({y}) >> {i}) & 1) << {2 * i + 1})" for i in range(16)) + ")"
_ROBUST_FLAGS = " + ".join(f"(CASE WHEN {x} THEN {1 << (18 + i)} ELSE 0 END)" for i, x in enumerate(["f1 > f2", "f2 > f3", "f3 > f1", "m1 > m2", "m2 > m3", "m3 > m1"]))

ORACLE = {
    "spectrogram_scan": f"WITH {_SPEC} SELECT resource_id, t, f, round(m, 6) AS m FROM spec",
    "vertical_max_filter": f"WITH {_POINTS} SELECT resource_id, t, f, round(m, 6) AS m, round(vm, 6) AS vm FROM vmax",
    "horizontal_max_filter": f"WITH {_POINTS} SELECT resource_id, t, f, round(m, 6) AS m, round(vm, 6) AS vm, round(hm, 6) AS hm FROM hmax",
    "min_max_filter": f"WITH {_SPEC} SELECT resource_id, t, f, round(m, 6) AS m, round(min(m) OVER w, 6) AS low, round(max(m) OVER w, 6) AS high FROM spec WINDOW w AS (PARTITION BY resource_id, t ORDER BY f ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)",
    "min_max_filter_whole_windows": f"WITH {_SPEC}, x AS (SELECT *, min(m) OVER w AS low, max(m) OVER w AS high FROM spec WINDOW w AS (PARTITION BY resource_id, t ORDER BY f ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) SELECT resource_id, t, f, round(m, 6) AS m, round(low, 6) AS low, round(high, 6) AS high FROM x WHERE f BETWEEN 10 AND 53",
    "log_freq_filter": f"WITH {_LOG} SELECT resource_id, t, f, round(m, 6) AS m, round(vm, 6) AS vm FROM lmax",
    "event_points": f"WITH {_POINTS} SELECT resource_id, t, f FROM ep",
    "event_points_fft": f"WITH {_LOG}, {_LOG_POINTS} SELECT resource_id, t, f FROM x WHERE m = vm AND m = hm AND m <> 0 AND f BETWEEN 2 AND 62 AND t BETWEEN 4 AND final - 4",
    "event_point_print_fft": f"""WITH {_LOG}, {_LOG_POINTS} SELECT x.resource_id, x.t, round(x.t * 0.008::DOUBLE, 6) AS seconds, x.f, x.f * 125 + 62.5::DOUBLE AS hertz, round(sum(s.m), 6) AS m
FROM x JOIN lmax s ON s.resource_id = x.resource_id AND s.t BETWEEN x.t - 1 AND x.t + 1 AND s.f BETWEEN x.f - 1 AND x.f + 1 WHERE x.m = x.vm AND x.m = hm AND x.m <> 0 AND x.f BETWEEN 2 AND 62 AND x.t BETWEEN 4 AND final - 4 GROUP BY ALL""",
    "stft_peaks": f"""WITH RECURSIVE {_FRAMES}, {_STFT}, {_windows(512, 15.625, 9)}, {_log_max('full_power')}, {_LOG_POINTS} SELECT x.resource_id, x.t, x.f, round(sum(s.m), 3) AS m
FROM x JOIN lmax s ON s.resource_id = x.resource_id AND s.t BETWEEN x.t - 1 AND x.t + 1 AND s.f BETWEEN x.f - 1 AND x.f + 1 WHERE x.m = x.vm AND x.m = hm AND x.m <> 0 AND x.f BETWEEN 9 AND 510 AND x.t BETWEEN 4 AND final - 4 GROUP BY ALL""",
    "murmur_file_hash": f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS all_hex, octet_length(encode(text)) AS size, hex(encode(source)) AS s, octet_length(encode(source)) AS s_n FROM documents),
w AS (SELECT doc_id, all_hex IS NULL AS gone, coalesce(all_hex[2 * (size // 2 // 8192 * 8192) + 1 : 2 * (size // 2 // 8192 * 8192) + 131072], '') AS h, s, s_n FROM d),
t AS (SELECT doc_id, gone, h, length(h) // 2 AS n FROM w), u AS (SELECT doc_id, s AS h, s_n AS n FROM w WHERE s IS NOT NULL),
a AS (SELECT doc_id, CASE WHEN gone THEN 0 ELSE {_avalanche(_murmur('h'))} END AS file_hash FROM t), b AS (SELECT doc_id, {_avalanche(_murmur('h'))} AS source_hash FROM u)
SELECT doc_id, file_hash, source_hash FROM a LEFT JOIN b USING (doc_id)""",
    "prints_text": f"WITH {_INDEX} SELECT concat_ws(' ', hash, resource_id, t1, f1) AS line FROM idx",
    "hamming_forms": """WITH x AS (SELECT DISTINCT resource_id, t1, f1 FROM postings WHERE resource_id IS NOT NULL AND f1 IS NOT NULL AND t1 IS NOT NULL)
SELECT resource_id, t1, f1, CAST(bit_count(xor(-resource_id, t1)) AS INT) AS ints, CAST(bit_count(xor(resource_id & 511, f1 & 511)) AS INT) AS bits FROM x""",
    "event_point_magnitude_3x3": f"WITH {_POINTS} SELECT resource_id, t, f, round(m, 6) AS m, round(m9, 6) AS m9 FROM hmax",
    "event_point_print": f"WITH {_POINTS} SELECT resource_id, t, CAST(t AS DOUBLE) AS seconds, f, round(110 * pow(2, f / 85.0), 6) AS hertz, round(m, 6) AS m FROM ep",
    "spectrum_print": f"""WITH {_POINTS}, {_pack('ep', 'fp')}, c AS (SELECT DISTINCT resource_id, unnest([struct_pack(t := t1, f := f1), struct_pack(t := t2, f := f2), struct_pack(t := t3, f := f3)]) AS p FROM fp),
n AS (SELECT resource_id, p.t AS t, count(DISTINCT p.f) AS points FROM c GROUP BY ALL), e AS (SELECT resource_id, CAST(unnest(range(0, max(t) + 1)) AS INT) AS t FROM n GROUP BY resource_id)
SELECT resource_id, t, 64 * 3 + 63 AS width, CAST(coalesce(points, 0) AS INT) AS points FROM e LEFT JOIN n USING (resource_id, t)""",
    "fingerprints_three_point": f"WITH {_POINTS}, {_pack('ep', 'fp')} SELECT resource_id, t1, f1, t2, f2, t3, f3 FROM fp",
    "fingerprints_two_point": f"WITH {_POINTS}, {_pack('ep', 'fp', True)} SELECT resource_id, t1, f1, t2, f2, t3, f3 FROM fp",
    "fingerprints_volume": f"WITH {_VOLUME}, {_pack('vol', 'fp')}, h AS (SELECT resource_id, {HASH_A} AS hash FROM fp) SELECT resource_id, count(*) AS prints, min(hash) AS least, max(hash) AS most, CAST(sum(hash % 1009) AS BIGINT) AS \"check\" FROM h GROUP BY resource_id",
    "hash_constant_q": f"WITH {_VOLUME}, {_pack('vol', 'fp')} SELECT resource_id, {HASH_A} AS hash, count(*) AS prints FROM fp GROUP BY 1, 2",
    "hash_fft": f"WITH {_VOLUME}, {_pack('vol', 'fp')} SELECT resource_id, {HASH_B} AS hash, count(*) AS prints FROM fp GROUP BY 1, 2",
    "hash_robust": f"""WITH {_VOLUME}, {_pack('vol', 'fp')}, x AS (SELECT *, {_ROBUST('t2 - t1', 't3 - t2', '2.0', '30.0')} AS tr, {_ROBUST('f2 - f1', 'f3 - f2', '1.0', '126.0')} AS fr FROM fp)
SELECT resource_id, CAST(({_MORTON('fr', 'tr')} & {(1 << 18) - 1}) + {_ROBUST_FLAGS} + ((f1 >> 7) & 3) * {1 << 24} + ((f2 >> 7) & 3) * {1 << 26} + ((f3 >> 7) & 3) * {1 << 28} + (CASE WHEN t2 - t1 > t3 - t2 THEN {1 << 29} ELSE 0 END) AS BIGINT) AS hash, count(*) AS prints FROM x GROUP BY 1, 2""",
    "same_prints": f"WITH {_INDEX} SELECT a.resource_id AS a_resource_id, b.resource_id AS b_resource_id, a.hash AS a_hash, a.t1 AS a_t1, b.t1 AS b_t1 FROM idx a JOIN idx b ON a.hash = b.hash AND a.resource_id < b.resource_id AND abs(a.t1 - b.t1) < 100",
    "morton_encode": f"SELECT DISTINCT hash, f1, CAST({_MORTON('hash % 65536', 'CAST(f1 AS BIGINT)')} AS BIGINT) AS code, hash % 65536 AS x, CAST(f1 & 65535 AS BIGINT) AS y FROM postings WHERE hash IS NOT NULL AND f1 IS NOT NULL",
    "hamming_distance": "SELECT DISTINCT hash, resource_id, CAST(bit_count(xor(hash, CAST(resource_id AS BIGINT))) AS INT) AS distance FROM postings WHERE hash IS NOT NULL AND resource_id IS NOT NULL",
    "near_hash_join": f"{_MATCH} SELECT query_id, ref_id, query_time, query_f1, match_time, match_f1, hash, near_hash, delta_t FROM hits",
    "near_hash_avoid": f"{_MATCH} SELECT query_id, ref_id, count(*) AS hits FROM hits WHERE ref_id <> query_id % 100 GROUP BY 1, 2",
    "index_candidates": """WITH q AS (SELECT resource_id AS query_id, hash, count(*) AS a FROM postings WHERE resource_id % 50 = 0 AND hash IS NOT NULL GROUP BY 1, 2), n AS (SELECT query_id, unnest([hash - 2, hash - 1, hash, hash + 1, hash + 2]) AS hash, a FROM q),
i AS (SELECT hash, resource_id AS ref_id, count(*) AS b FROM postings WHERE hash IS NOT NULL AND resource_id IS NOT NULL GROUP BY 1, 2)
SELECT query_id, ref_id, CAST(sum(a * b) AS BIGINT) AS hits FROM n JOIN i USING (hash) GROUP BY 1, 2 HAVING sum(a * b) >= 10""",
    "postings_matches": f"{_WHOLE}{_RANKED} SELECT query_id, ref_id, {_R6}, rank FROM ranked WHERE rank <= 1000",
    "hits_per_reference": f"{_MATCH} SELECT query_id, ref_id, count(*) AS hits FROM kept GROUP BY 1, 2",
    "hit_parts": f"{_MATCH} SELECT query_id, ref_id, CAST(rn AS INT) AS rn, n_hits, part_size, in_first, in_last, query_time, delta_t FROM parts",
    "modal_delta": f"{_MATCH} SELECT query_id, ref_id, y1, x1, y2, x2 FROM modes",
    "time_factor": f'{_MATCH} SELECT query_id, ref_id, round(slope, 6) AS slope, round("offset", 6) AS "offset", round(time_factor, 6) AS time_factor, round(freq_factor, 6) AS freq_factor, round(1 + slope, 6) AS exact_speed_ratio FROM aligned',
    "linear_filter": f"{_MATCH} SELECT query_id, ref_id, query_time, match_time, hash, near_hash FROM online",
    "coverage_histogram": f"{_MATCH} SELECT query_id, ref_id, score, round(coverage, 6) AS coverage FROM found",
    "match_results": f"{_MATCH}{_RANKED} SELECT query_id, ref_id, {_R6}, rank FROM ranked",
    "topk_results": f"{_MATCH}{_RANKED} SELECT query_id, ref_id, score, rank FROM ranked WHERE rank = 1",
    "histogram_fallback": f"""{_MATCH}, open AS (SELECT *, delta_t // 5 AS slot FROM kept WHERE query_id NOT IN (SELECT query_id FROM found)),
best AS (SELECT query_id, ref_id, slot, count(*) AS n FROM open GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY n DESC, slot) = 1),
near AS (SELECT o.*, 1::DOUBLE AS time_factor, 1::DOUBLE AS freq_factor FROM open o JOIN best b ON o.query_id = b.query_id AND o.ref_id = b.ref_id WHERE n > 10 AND abs(b.slot * 5 - delta_t) <= 5), {_summary('near', 'back')}
SELECT query_id, ref_id, {_R6} FROM back""",
    "metadata_join": f"{_WHOLE}{_RANKED} SELECT query_id, ref_id, coalesce(path, 'metadata unavailable!') AS ref_path, rank FROM ranked LEFT JOIN (SELECT * FROM resource_metadata WHERE num_fingerprints > 0) m ON m.resource_id = ref_id WHERE rank <= 1000",
    "empty_results": f"""{_MATCH}{_RANKED}, r AS (SELECT * FROM ranked WHERE ref_id <> query_id % 100), q AS (SELECT DISTINCT query_id FROM asked)
SELECT q.query_id, 'query/' || q.query_id || '.wav' AS query_path, ref_id, {', '.join(f"round(coalesce({c}, {d}), 6) AS {c}" for c, d in (('query_start', -1), ('query_stop', -1), ('ref_start', -1), ('ref_stop', -1), ('time_factor', -1), ('freq_factor', -1), ('coverage', 0)))}, coalesce(score, -1) AS score, coalesce(rank, 1) AS rank FROM q LEFT JOIN r ON q.query_id = r.query_id""",
    "monitor_windows": f"WITH {_SPANS.format('resource_metadata')} SELECT resource_id, start, stop FROM spans",
    "monitor_matches": f"{_monitor(False)} SELECT query_id.resource_id AS resource_id, query_id.start AS start, query_id.start + 25 AS stop, query_id.resource_id || '-' || format('{{:.1f}}', query_id.start) || '_' || format('{{:.1f}}', query_id.start + 25) AS label, ref_id, score FROM ranked WHERE rank <= 1",
    "monitor_all_windows": f"""{_EVERY}, every AS (SELECT struct_pack(resource_id := resource_id, start := start) AS query_id FROM spans)
SELECT e.query_id.resource_id AS resource_id, e.query_id.start AS start, e.query_id.start + 25 AS stop, e.query_id.resource_id || '-' || format('{{:.1f}}', e.query_id.start) || '_' || format('{{:.1f}}', e.query_id.start + 25) AS label, ref_id, coalesce(score, -1) AS score, coalesce(rank, 1) AS rank,
  {', '.join(f"round(coalesce({c}, {d}), 6) AS {c}" for c, d in (('query_start', -1), ('query_stop', -1), ('ref_start', -1), ('ref_stop', -1), ('time_factor', -1), ('freq_factor', -1), ('coverage', 0)))} FROM every e LEFT JOIN ranked r ON e.query_id = r.query_id""",
    "streaming_monitor": f"{_monitor(False)} SELECT query_id.resource_id AS resource_id, query_id.start AS start, ref_id, score, rank FROM ranked WHERE rank <= 1",
    "dedup_fingerprint": f"{_VERSIONS} SELECT query_id.resource_id AS resource_id, query_id.start AS start, ref_id, score, rank FROM ranked WHERE rank <= 10",
    "dedup_exact_documents": "SELECT md5(text) AS content_hash, min(doc_id) AS first_key, count(*) AS members FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "dedup_exact_members": "SELECT doc_id, md5(text) AS content_hash, min(doc_id) OVER w AS first_key, count(*) OVER w AS members FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY md5(text)) QUALIFY count(*) OVER w >= 2",
    "same_score": f"""WITH {_INDEX}, pairs AS (SELECT label AS first_id, label AS second_id FROM embeddings UNION SELECT label, (label + 1) % 10 FROM embeddings),
asked AS (SELECT struct_pack(a := first_id, b := second_id) AS query_id, hash, t1, f1 FROM idx JOIN pairs ON resource_id = second_id), {_chain('asked').replace('/*AVOID*/', 'WHERE i.resource_id = query_id.a')}
SELECT first_id, second_id, CAST(coalesce(round(coverage * 100), 0) AS INT) AS percent FROM pairs LEFT JOIN found ON query_id = struct_pack(a := first_id, b := second_id)""",
    "index_set_insert": "SELECT DISTINCT hash, resource_id, t1, f1 FROM postings WHERE batch_no IS NOT NULL",
    "index_bag_insert": "SELECT resource_id, count(*) AS postings FROM postings WHERE batch_no IS NOT NULL GROUP BY 1",
    "index_delete": "SELECT resource_id, count(*) AS postings FROM postings WHERE t1 % 3 <> 0 OR t1 IS NULL GROUP BY 1",
    "store_skip_existing": "SELECT resource_id, path FROM resource_metadata WHERE resource_id NOT IN (SELECT ref_id FROM dedup_lines WHERE ref_id IS NOT NULL)",
    "metadata_lookup": "SELECT s.resource_id, path, duration, num_fingerprints FROM (SELECT DISTINCT ref_id AS resource_id FROM dedup_lines WHERE ref_id IS NOT NULL) s LEFT JOIN resource_metadata m USING (resource_id)",
    "metadata_delete": "SELECT * FROM resource_metadata WHERE resource_id NOT IN (SELECT ref_id FROM dedup_lines WHERE ref_id IS NOT NULL)",
    "metadata_upsert": "SELECT m.resource_id, path, duration, coalesce(n, num_fingerprints) AS num_fingerprints FROM resource_metadata m LEFT JOIN (SELECT resource_id, count(*) AS n FROM postings GROUP BY 1) p USING (resource_id)",
    "index_stats": f"""WITH r AS (SELECT *, {_STATS_RATE} AS rate FROM resource_metadata)
SELECT count(*) AS resources, round(sum(duration), 6) AS total_duration, CAST(sum(num_fingerprints) AS BIGINT) AS total_prints, round(sum(num_fingerprints) / sum(duration), 6) AS avg_prints_per_second, round(max(rate), 6) AS max_prints_per_second, round(min(rate), 6) AS min_prints_per_second,
  (SELECT path FROM r WHERE rate IS NOT NULL ORDER BY rate DESC, path LIMIT 1) AS max_path, (SELECT path FROM r WHERE rate IS NOT NULL ORDER BY rate, path LIMIT 1) AS min_path, (SELECT count(*) FROM postings) AS postings FROM r""",
    "prints_per_second": "SELECT resource_id, round(CASE WHEN duration > 0 THEN num_fingerprints / duration END, 6) AS prints_per_second FROM resource_metadata",
    "print_counts": f"WITH {_VOLUME}, {_pack('vol', 'fp')} SELECT resource_id, count(*) AS num_fingerprints, max(t3) * 3600.0::DOUBLE AS duration FROM fp GROUP BY 1",
    "cached_prints_range": "SELECT resource_id, count(*) AS prints FROM postings WHERE t1 * (128 / 16000.0::DOUBLE) BETWEEN 1 AND 5 GROUP BY 1",
    "pitch_class_histogram": f"WITH {_PCH} SELECT resource_id, bin, cnt FROM pch",
    "pch_best_shift": f"{_SHIFTED} SELECT query_id, ref_id, round(match, 6) AS match, shift, CAST(row_number() OVER (PARTITION BY query_id ORDER BY match DESC, ref_id) AS INT) AS rank FROM best",
    "pch_matches": f"{_SHIFTED} SELECT query_id, ref_id, round(match, 6) AS match, shift, round(100 * pow(2, shift / 1200.0::DOUBLE), 6) AS ratio, CAST(row_number() OVER (PARTITION BY query_id ORDER BY match DESC, ref_id) AS INT) AS rank FROM best",
    "result_filter": f"WITH {_LINES} SELECT line_id, match_score FROM lines WHERE {_BASE('query_path')} <> {_BASE('ref_path')} AND match_score >= 15 AND query_stop - query_start BETWEEN 3 AND 500000 AND match_score / (query_stop - query_start) > 5 AND coverage <= 0.7",
    "symmetric_pairs": f"""WITH p AS (SELECT line_id, {_BASE(f'trim(query_path, {_T})')} AS a, {_BASE(f'trim(ref_path, {_T})')} AS b FROM dedup_lines WHERE query_path IS NOT NULL AND ref_path IS NOT NULL)
SELECT line_id, count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) = 2 AS symmetric FROM p""",
    "evaluation_matrix": f"""WITH x AS (SELECT trim(query_path, {_T}) AS q, trim(ref_path, {_T}) AS r, coalesce(match_score, -1) AS s, line_id FROM result_lines WHERE regexp_matches(query_path, '_\\d+s-\\d+s')),
f AS (SELECT * FROM x WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, line_id) = 1),
o AS (SELECT a.q, f.r FROM (SELECT DISTINCT q FROM x) a LEFT JOIN f USING (q)), known AS (SELECT DISTINCT {_BASE(f'trim(path, {_T})')} AS base FROM resource_metadata WHERE path IS NOT NULL), n AS (SELECT {_BASE('q')} AS n, r FROM o),
g AS (SELECT nullif(regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s', 1), '') AS base, coalesce(nullif(regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s___(.+?)(?:_(\\d+(?:\\.\\d+)?))?$', 4), ''), 'reference') AS modification,
  try_cast(nullif(regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s___(.+?)(?:_(\\d+(?:\\.\\d+)?))?$', 5), '') AS DOUBLE) AS factor, CASE WHEN r IS NULL THEN CASE WHEN regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s', 1) IN (SELECT base FROM known) THEN 'fn' ELSE 'tn' END WHEN {_BASE('r')} = regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s', 1) THEN 'tp' ELSE 'fp' END AS k FROM n),
e AS (SELECT modification, factor, k FROM g UNION ALL SELECT m, 1.0, k FROM g, (VALUES ('pitch_shift'), ('time_stretched'), ('speed_up')) v(m) WHERE modification = 'reference')
SELECT modification, factor, count(*) AS queries, {', '.join(f"round(avg(CASE WHEN k = '{k}' THEN 1.0 ELSE 0.0 END), 6) AS {k}" for k in ('tp', 'fp', 'fn', 'tn'))} FROM e GROUP BY 1, 2""",
    "evaluation_plan": f"""WITH v AS (SELECT * FROM (VALUES ('reference'), ('flanger'), ('band_passed_2000Hz'), ('chorus'), ('echo'), ('tremolo')) e(modification), (SELECT CAST(NULL AS DOUBLE) AS factor)
  UNION ALL SELECT m, (84 + 2 * i) / 100.0::DOUBLE FROM (VALUES ('pitch_shift'), ('time_stretched'), ('speed_up')) g(m), range(17) r(i) WHERE i <> 8),
x AS (SELECT resource_id, resource_id % 5 <> 0 AS in_index, {_BASE('path')} AS base, CAST(floor(duration) AS BIGINT) AS d, n FROM resource_metadata, (VALUES (10), (20)) l(n) WHERE duration >= n),
y AS (SELECT *, resource_id % greatest(d - n, 1) AS start FROM x)
SELECT resource_id, in_index, base || '_' || start || 's-' || (start + n) || 's' || CASE WHEN modification = 'reference' THEN '' ELSE '___' || modification || coalesce('_' || CAST(factor AS VARCHAR), '') END || '.mp3' AS query_name, modification, factor,
  CASE WHEN modification = 'pitch_shift' THEN CAST(round(1200 * log2(factor)) AS INT) END AS cents FROM y, v""",
    "evaluation_run": f"""{_MATCH.replace('/*AVOID*/', 'WHERE i.resource_id % 5 <> 0')}{_RANKED}, q AS (SELECT DISTINCT query_id, query_id % 100 AS rec, query_id // 100 AS kind FROM asked), a AS (SELECT q.*, ref_id FROM q LEFT JOIN ranked r ON r.query_id = q.query_id AND rank = 1),
k AS (SELECT rec, kind, CASE kind WHEN 2 THEN 'pitch_shift' WHEN 3 THEN 'time_stretched' ELSE 'reference' END AS modification, CASE kind WHEN 2 THEN 1.02::DOUBLE WHEN 3 THEN 0.96::DOUBLE END AS factor,
  CASE WHEN ref_id IS NULL THEN CASE WHEN rec IN (SELECT resource_id FROM idx WHERE resource_id % 5 <> 0) THEN 'fn' ELSE 'tn' END WHEN ref_id = rec THEN 'tp' ELSE 'fp' END AS k FROM a),
e AS (SELECT modification, factor, k FROM k UNION ALL SELECT m, 1.0, k FROM k, (VALUES ('pitch_shift'), ('time_stretched'), ('speed_up')) v(m) WHERE modification = 'reference')
SELECT modification, factor, count(*) AS queries, {', '.join(f"round(avg(CASE WHEN k = '{k}' THEN 1.0 ELSE 0.0 END), 6) AS {k}" for k in ('tp', 'fp', 'fn', 'tn'))} FROM e GROUP BY 1, 2""",
    "benchmark_speed": """WITH r AS (SELECT CAST(run_at AS DATE) AS step, query_index % 2 = 0 AS store, sum(greatest(CAST(round(query_stop * 1000) AS BIGINT) - CAST(round(query_start * 1000) AS BIGINT), 0)) / 1000.0::DOUBLE AS a, sum(epoch_us(loaded_at) - epoch_us(run_at)) / 1000000.0::DOUBLE AS w
  FROM result_lines WHERE run_at IS NOT NULL AND loaded_at IS NOT NULL AND query_index IS NOT NULL GROUP BY 1, 2),
s AS (SELECT step, sum(CASE WHEN store THEN a END) AS a, sum(CASE WHEN store THEN w END) AS w, sum(CASE WHEN NOT store THEN a END) AS qa, sum(CASE WHEN NOT store THEN w END) AS qw FROM r GROUP BY step)
SELECT step, round(sum(a) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS cumulative_seconds, round(a / nullif(w, 0), 6) AS store_speed, round(qa / nullif(qw, 0), 6) AS query_speed FROM s""",
    # fixed values: the printed form of a result, as in sources/cachefiles.py
    "result_line_print": "SELECT line_id, printf('%s ; %s ; %s ; %.3f ; %.3f ; %s ; %s ; %.3f ; %.3f ; %d ; %.3f %% ; %.3f %%; %.2f', '1', '1', query_path, query_start, query_stop, coalesce(ref_path, 'null'), coalesce(CAST(ref_id AS VARCHAR), 'null'), ref_start, ref_stop, match_score, time_factor, frequency_factor, coverage) AS line FROM dedup_lines WHERE query_path IS NOT NULL",
    "identifier_from_name": f"""WITH x AS (SELECT CASE WHEN resource_id % 3 = 0 THEN {_BASE('path')} ELSE path END AS name, (coalesce(num_fingerprints, 0) * CASE WHEN resource_id % 2 = 0 THEN 100003 ELSE -99991 END) % 2000000000 AS h FROM resource_metadata),
w AS (SELECT name, CASE WHEN h = 0 THEN abs(list_reduce(list_prepend(0::BIGINT, [CAST(unicode(c) AS BIGINT) FOR c IN string_split(name, '')]), lambda a, c: (a * 31 + c + 2147483648) % 4294967296 - CASE WHEN (a * 31 + c + 2147483648) % 4294967296 < 0 THEN -4294967296 ELSE 0 END - 2147483648)) ELSE h END AS h FROM x)
SELECT name, CASE WHEN regexp_full_match(regexp_extract(name, '([^/]*)$', 1), '[0-9]+\\.[^.]+') AND try_cast({_BASE('name')} AS INT) IS NOT NULL THEN CAST({_BASE('name')} AS INT) ELSE CAST(1073741823 + trunc(h / 2.0) AS INT) END AS identifier,
  {_BASE('name')} AS base, regexp_extract(name, '\\.([^./]*)$', 1) AS ext, regexp_extract(name, '^(.*)/[^/]*$', 1) AS folder FROM w""",
    "stopwatch_format": """WITH x AS (SELECT resource_id, num_fingerprints * [1, 1000, 1000000, 1000000000][resource_id % 4 + 1] AS nanos FROM resource_metadata WHERE num_fingerprints IS NOT NULL)
SELECT resource_id, nanos, CASE WHEN nanos >= 1000000000 THEN printf('%d.%02d s', (nanos // 1000000 + 5) // 1000, (nanos // 1000000 + 5) // 10 % 100) WHEN nanos >= 1000000 THEN printf('%d.00 ms', nanos // 1000000)
  WHEN nanos >= 1000 THEN printf('%d.%02d micros', (nanos + 5) // 1000, (nanos + 5) // 10 % 100) ELSE printf('%d.00 ns', nanos) END AS shown FROM x""",
    "parse_query_name": f"""WITH x AS (SELECT DISTINCT trim(query_path, {_T}) AS query_path FROM result_lines WHERE query_path IS NOT NULL), y AS (SELECT query_path, regexp_extract(query_path, '([^/]*)$', 1) AS f, {_BASE('query_path')} AS n FROM x)
SELECT query_path, try_cast(nullif(regexp_extract(f, '^(\\d+).*mp3$', 1), '') AS INT) AS id, try_cast(nullif(regexp_extract(f, '^(\\d+)_(\\d+)s-(\\d+)s.*mp3$', 2), '') AS INT) AS start, try_cast(nullif(regexp_extract(f, '^(\\d+)_(\\d+)s-(\\d+)s.*mp3$', 3), '') AS INT) AS stop,
  nullif(regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s', 1), '') AS base, coalesce(nullif(regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s___(.+?)(?:_(\\d+(?:\\.\\d+)?))?$', 4), ''), 'reference') AS modification,
  try_cast(nullif(regexp_extract(n, '^(.+)_(\\d+)s-(\\d+)s___(.+?)(?:_(\\d+(?:\\.\\d+)?))?$', 5), '') AS DOUBLE) AS factor FROM y""",
    "pitch_units": """WITH x AS (SELECT event_id, value + 20 AS hz FROM events), y AS (SELECT *, 1200 * log2(hz / 8.17579892) AS c FROM x)
SELECT event_id, round(c, 6) AS absolute_cent, round(c - floor(c / 1200) * 1200, 6) AS relative_cent, round(12 * log2(hz / 440) + 69, 6) AS midi_cent, CAST(floor(12 * log2(hz / 440) + 69.5) AS INT) AS midi_key, round(1200 * log2(hz / 440), 6) AS cents, round(8.17579892 * pow(2, c / 1200), 6) AS back FROM y""",
    "time_format": """WITH x AS (SELECT resource_id, duration, CAST(floor(duration) AS INT) AS s, (86390 + CAST(floor(duration) AS INT)) % 86400 AS c FROM resource_metadata WHERE duration IS NOT NULL)
SELECT resource_id, printf('%02d:%02d:%02d', c // 3600, c // 60 % 60, c % 60) AS clock, (CASE WHEN s >= 3600 THEN (s // 3600) || 'h:' ELSE '' END) || (CASE WHEN s >= 60 THEN (s // 60 % 60) || 'm:' ELSE '' END) || (CASE WHEN s > 0 THEN (s % 60) || 's' ELSE '' END) AS span, round(duration / 60, 6) AS minutes FROM x""",
    "prefix_completion": f"""WITH w AS (SELECT {_BASE('path')} AS word FROM resource_metadata WHERE path IS NOT NULL), p AS (SELECT DISTINCT left(word, n) AS prefix FROM w, range(1, 9) r(n))
SELECT prefix, CASE WHEN count(DISTINCT word) = 1 THEN max(word) END AS word FROM p JOIN w ON starts_with(word, prefix) GROUP BY prefix""",
}
ORACLE = {k: v.replace(" /*AVOID*/", "") for k, v in ORACLE.items()}
