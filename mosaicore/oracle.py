"""SQL for DuckDB that gives the rows of the image queries, written out independently of the engine (but for the values of the s sets, which the query s_sets checks by its own SQL).

Queries are put together from common table expressions: the mosaic's pixels, blocks as lists of
values, the domain pool, candidates and their errors.
"""

from __future__ import annotations

from mosaicore.functions.pixels import s_sets

MOSAIC = """mosaic AS (SELECT CAST(vec_id // 64 AS BIGINT) AS image_id, CAST(((vec_id % 64) // 8) * 8 + p // 8 AS INT) AS y, CAST((vec_id % 8) * 8 + p % 8 AS INT) AS x,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(e AS DOUBLE) + 0.5)) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, 64)) AS p FROM embeddings WHERE vec_id // 64 IN (SELECT vec_id // 64 FROM embeddings GROUP BY 1 HAVING count(*) = 64)))"""
RGB = """rgb AS (SELECT image_id // 3 AS image_id, CAST(image_id % 3 AS INT) AS ch, y, x, v FROM mosaic WHERE image_id // 3 IN (SELECT image_id // 3 FROM mosaic GROUP BY 1 HAVING count(DISTINCT image_id) = 3))"""
LUMA = """luma AS (SELECT image_id, y, x, sum(v * CASE ch WHEN 0 THEN 0.2989 WHEN 1 THEN 0.5870 ELSE 0.1140 END::DOUBLE) AS v FROM rgb GROUP BY 1, 2, 3)"""


def half(source: str, name: str = "half", more: str = "") -> str:
    return f"{name} AS (SELECT image_id{more}, y // 2 AS y, x // 2 AS x, sum(v) * 0.25 AS v FROM {source} GROUP BY ALL)"


def ranges(source: str, b: int, name: str, more: str = "") -> str:
    return f"{name} AS (SELECT image_id{more}, (y // {b}) * {b} AS oy, (x // {b}) * {b} AS ox, list(v ORDER BY (y % {b}) * {b} + x % {b}) AS a FROM {source} GROUP BY ALL)"


def domains(source: str, b: int, stride: int, name: str, more: str = "") -> str:
    """From an image of half size, for even strides."""
    n, s = (64 - 2 * b) // stride + 1, stride // 2
    return f"""{name} AS (SELECT image_id{more}, CAST(wy * {n} + wx AS BIGINT) AS dom, CAST(wy * {stride} AS INT) AS oy, CAST(wx * {stride} AS INT) AS ox, list(v ORDER BY (y - wy * {s}) * {b} + x - wx * {s}) AS a
  FROM {source}, range(0, {n}) AS t(wy), range(0, {n}) AS u(wx) WHERE y >= wy * {s} AND y < wy * {s} + {b} AND x >= wx * {s} AND x < wx * {s} + {b} GROUP BY ALL)"""


def sources(b: int, tfs: list[int], name: str = "src") -> str:
    """tf, pos and, for each place of the result, the place it is taken from (-1: zero)."""
    r, c, e = f"(p // {b})", f"(p % {b})", b - 1
    place = {0: (r, c), 1: (f"{e} - {c}", r), 2: (f"{e} - {r}", f"{e} - {c}"), 3: (c, f"{e} - {r}"), 4: (r, f"{e} - {c}"), 5: (f"{e} - {c}", f"{e} - {r}"), 6: (f"{e} - {r}", c), 7: (c, r)}
    place |= {8: place[7], 9: place[4], 10: place[5], 11: place[6], 13: place[0]}
    flat = {t: f"({y}) * {b} + {x}" for t, (y, x) in place.items()}
    for t, alpha in ((12, -0.25), (14, 0.25)):
        x = f"({c} - CAST(round_even({alpha} * {r}, 0) AS BIGINT))"
        flat[t] = f"CASE WHEN {x} BETWEEN 0 AND {e} THEN {r} * {b} + {x} ELSE -1 END"
    parts = [f"SELECT {t} AS tf, {k} AS pos, list({flat[t]} ORDER BY p) AS s FROM range(0, {b * b}) AS g(p)" for k, t in enumerate(tfs)]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


MOVED = "[CASE WHEN i < 0 THEN 0.0::DOUBLE ELSE a[i + 1] END FOR i IN s]"
RAMP = "list_dot_product({0}, [CAST(i + 1 AS DOUBLE) FOR i IN range(0, len({0}))])"
SUM = "list_sum({0})"
SQ = "list_dot_product({0}, {0})"


def normalised(a: str) -> str:
    """Of a list column, through nested selects over one row: expects to be used as a scalar on small lists."""
    mean = f"(list_sum({a}) / len({a}))"
    c = f"[x - {mean} FOR x IN {a}]"
    dev = f"sqrt({SQ.format(c)} / len({a}) + 1e-12)"
    return f"[x / {dev} FOR x IN {c}]"


def entropy(a: str) -> str:
    return f"(SELECT entropy(CAST(floor(least(1.0, greatest(0.0, z)) * 255) AS INT)) / 8 FROM (SELECT unnest({a}) AS z))"


def variance(a: str) -> str:
    return f"greatest(0.0, {SQ.format(a)} / len({a}) - (list_sum({a}) / len({a})) ^ 2)"


def described(source: str, name: str, keys: str, n: int = 1) -> str:
    """source (keys, a) with ent, var and bucket."""
    score = "0.5 * least(1.0, greatest(0.0, ent)) + 0.5 * least(1.0, greatest(0.0, var / 0.25))"
    return f"""{name} AS (SELECT *, CAST(greatest(0, least({n - 1}, floor(({score}) * {n}))) AS INT) AS bucket FROM (SELECT *, {variance("a")} AS var FROM {source}
  JOIN (SELECT {keys}, entropy(CAST(floor(least(1.0, greatest(0.0, z)) * 255) AS INT)) / 8 AS ent FROM (SELECT {keys}, unnest(a) AS z FROM {source}) GROUP BY ALL) USING ({keys})))"""


def pool(b: int, tfs: list[int], plane: str, chans: str, name: str = "pool", n: int = 1) -> str:
    """image_id, entry, dom, tf, bucket, proxy and d (lists by channel) from domains of the luma plane and of channels (with ch)."""
    return f"""{sources(b, tfs, f"{name}_src")},
{described(plane, f"{name}_dom", "image_id, dom", n)},
{name}_moved AS (SELECT image_id, dom, tf, pos, bucket, {MOVED} AS m FROM {name}_dom, {name}_src),
{name}_centred AS (SELECT image_id, dom, tf, pos, bucket, [x - list_sum(m) / len(m) FOR x IN m] AS m FROM {name}_moved),
{name}_scaled AS (SELECT image_id, dom, tf, pos, bucket, [x / sqrt({SQ.format("m")} / len(m) + 1e-12) FOR x IN m] AS m FROM {name}_centred),
{name}_ch AS (SELECT image_id, dom, tf, list(m ORDER BY ch) AS d FROM (SELECT image_id, ch, dom, tf, {MOVED} AS m FROM {chans}, {name}_src) GROUP BY 1, 2, 3),
{name} AS (SELECT image_id, dom * {len(tfs)} + pos AS entry, dom, tf, bucket, [x / sqrt({SQ.format("m")} + 1e-12) FOR x IN m] AS proxy, d FROM {name}_scaled JOIN {name}_ch USING (image_id, dom, tf))"""


def queries(b: int, plane: str, chans: str, name: str = "q", n: int = 1) -> str:
    """image_id, oy, ox, bucket, q and r from ranges of the luma plane and of channels."""
    return f"""{described(plane, f"{name}_range", "image_id, oy, ox", n)},
{name}_ch AS (SELECT image_id, oy, ox, list(a ORDER BY ch) AS r FROM {chans} GROUP BY 1, 2, 3),
{name} AS (SELECT image_id, oy, ox, bucket, CASE WHEN {SQ.format("a")} > 1e-24 THEN [x / sqrt({SQ.format("a")}) FOR x IN a] ELSE a END AS q, r FROM {name}_range JOIN {name}_ch USING (image_id, oy, ox))"""


def topk(k: int, by_bucket: bool, q: str = "q", p: str = "pool", name: str = "cand") -> str:
    keys = "image_id, bucket" if by_bucket else "image_id"
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, oy, ox ORDER BY score DESC, entry) AS rank FROM (
  SELECT {q}.image_id, oy, ox, entry, dom, tf, d, r, {q}.bucket, list_dot_product(q, proxy) AS score FROM {q} JOIN {p} USING ({keys}))) WHERE rank <= {k})"""


def matched(b: int, cand: str = "cand", q: str = "q", name: str = "leaf", quantized: bool = False, sets: bool = False) -> str:
    """image_id, oy, ox, block, dom, tf, codes (s, o by channel) and mse of the best candidate of every range."""
    n = float(b * b)
    s, o = "least(0.99, greatest(-0.99, s0))", "least(1.5, greatest(-0.5, o0))"
    if sets:
        own = "[" + ", ".join(str(x) for x in s_sets(8, 0.99)) + "]"
        s = f"(SELECT arg_min(z, (abs(z - s0), i)) FROM (SELECT unnest({own}[bucket + 1]) AS z, unnest(range(0, len({own}[bucket + 1]))) AS i))"
        s = f"list_sort([{{'d': abs(z - s0), 'i': i, 'z': z}} FOR z, i IN {own}[bucket + 1]])[1].z"
    if quantized:
        s = f"(round(({s} + 0.99) * 255.0 / 1.98)) * 1.98 / 255.0 - 0.99"
        o = f"-0.5 + (round(({o} + 0.5) * 255.0 / 2.0)) * 2.0 / 255.0"
    none = "{'s': -0.99::DOUBLE, 'o': -0.5::DOUBLE}" if quantized else "{'s': 0.0::DOUBLE, 'o': 0.0::DOUBLE}"
    return f"""{name}_sums AS (SELECT image_id, oy, ox, rank, dom, tf, bucket, ch, {SUM.format("dd1")} AS sd, {SUM.format("rr1")} AS sr, {SQ.format("dd1")} AS sdd, {SQ.format("rr1")} AS srr, list_dot_product(rr1, dd1) AS srd
  FROM (SELECT image_id, oy, ox, rank, dom, tf, bucket, unnest(range(0, len(d))) AS ch, unnest(d) AS dd1, unnest(r) AS rr1 FROM {cand})),
{name}_ls AS (SELECT *, CASE WHEN flat THEN sr / {n} ELSE (sr - s0 * sd) / {n} END AS o0 FROM (SELECT *, abs({n} * sdd - sd * sd) < 1e-18 AS flat, CASE WHEN abs({n} * sdd - sd * sd) < 1e-18 THEN 0.0 ELSE ({n} * srd - sd * sr) / ({n} * sdd - sd * sd) END AS s0 FROM {name}_sums)),
{name}_code AS (SELECT *, {s} AS s, {o} AS o FROM {name}_ls),
{name}_err AS (SELECT image_id, oy, ox, rank, dom, tf, list({{'s': s, 'o': o}} ORDER BY ch) AS codes, sum(srr + s * s * sdd + {n} * o * o - 2 * s * srd - 2 * o * sr + 2 * s * o * sd) / {n} / count(*) AS mse FROM {name}_code GROUP BY 1, 2, 3, 4, 5, 6),
{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, oy, ox ORDER BY mse, rank) AS k FROM {name}_err) WHERE k = 1),
{name} AS (SELECT image_id, oy, ox, {b} AS block, coalesce(dom, 0) AS dom, coalesce(tf, 0) AS tf, coalesce(codes, [{none} FOR z IN r]) AS codes, mse FROM {q} LEFT JOIN {name}_best USING (image_id, oy, ox))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


LEAF_COLUMNS = """SELECT image_id, leaf_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(block AS INT) AS block, CAST(dom AS BIGINT) AS dom, CAST(tf AS INT) AS tf, CAST(ch AS INT) AS ch, round(code.s, 6) AS s, round(code.o, 6) AS o, round(mse, 6) AS mse
FROM (SELECT image_id, leaf_id, oy, ox, block, dom, tf, mse, unnest(codes) AS code, unnest(range(0, len(codes))) AS ch FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) - 1 AS leaf_id FROM leaf))"""
GRAY_CH = "gray AS (SELECT image_id, 0 AS ch, y, x, v FROM mosaic)"


def gray_blocks(b: int = 8, stride: int = 8, tfs: list[int] | None = None, n: int = 1, tag: str = "") -> list[str]:
    """Pool and queries of grey images (names end in tag)."""
    return [
        domains("half", b, stride, f"dl{tag}"), domains("halfch", b, stride, f"dc{tag}", ", ch"), ranges("mosaic", b, f"rl{tag}"), ranges("gray", b, f"rc{tag}", ", ch"),
        pool(b, tfs or list(range(8)), f"dl{tag}", f"dc{tag}", f"pool{tag}", n), queries(b, f"rl{tag}", f"rc{tag}", f"q{tag}", n),
    ]


GRAY = [MOSAIC, GRAY_CH, half("mosaic"), half("gray", "halfch", ", ch")]
IDENTITY = [*GRAY, *gray_blocks(tfs=[0]), topk(4096, False), matched(8)]
QUADTREE = [
    *GRAY, *gray_blocks(16, 8, [0], tag="16"), topk(4096, False, "q16", "pool16", "cand16"), matched(16, "cand16", "q16", "leaf16"), *gray_blocks(8, 8, [0], tag="8"),
    "open8 AS (SELECT q8.* FROM q8 SEMI JOIN (SELECT image_id, oy AS y0, ox AS x0 FROM leaf16 WHERE mse > 0.0153) s ON q8.image_id = s.image_id AND (q8.oy // 16) * 16 = s.y0 AND (q8.ox // 16) * 16 = s.x0)",
    topk(4096, False, "open8", "pool8", "cand8"), matched(8, "cand8", "open8", "leaf8"), "leaf AS (SELECT * FROM leaf16 WHERE mse <= 0.0153 UNION ALL SELECT * FROM leaf8)",
]


def decoded(steps: int) -> list[str]:
    """Tables v1, v2, ... of pixels after each step from black, by the identity leaves."""
    out = ["px AS (SELECT image_id, oy + p // 8 AS y, ox + p % 8 AS x, 4 * (dom // 7) + p // 8 AS sy, 4 * (dom % 7) + p % 8 AS sx, codes[1].s AS s, codes[1].o AS o FROM leaf, range(0, 64) AS g(p))", "v0 AS (SELECT image_id, y, x, 0.0::DOUBLE AS v FROM px)"]
    for k in range(1, steps + 1):
        out += [half(f"v{k - 1}", f"h{k}"), f"v{k} AS (SELECT px.image_id, px.y, px.x, least(1.0, greatest(0.0, s * h{k}.v + o)) AS v FROM px JOIN h{k} ON h{k}.image_id = px.image_id AND h{k}.y = sy AND h{k}.x = sx)"]
    return out


MASK = """m0 AS (SELECT image_id, y, x FROM (SELECT image_id, oy + e * block AS y, ox + k AS x FROM leaf, range(0, 2) AS t(e), range(0, 16) AS u(k) WHERE k < block
  UNION SELECT image_id, oy + k AS y, ox + e * block AS x FROM leaf, range(0, 2) AS t(e), range(0, 16) AS u(k) WHERE k < block) WHERE y < 64 AND x < 64)"""
MORTON = "oy // {m}, ox // {m}, " + " + ".join(f"((oy >> {k}) & 1) * {2 << 2 * k} + ((ox >> {k}) & 1) * {1 << 2 * k}" for k in range(4))
INTS = "CAST(y AS INT) AS y, CAST(x AS INT) AS x"
LSH_BITS = " + ".join(f"CASE WHEN list_dot_product({{0}}, [CAST((({i} * 31 + j * 17 + ({i} * j) % 7) % 2) * 2 - 1 AS DOUBLE) FOR j IN range(0, 64)]) > 0 THEN {1 << i} ELSE 0 END" for i in range(10))
S_SETS = "SELECT unnest([" + ", ".join(f"{{'bucket': {b}, 'ord': {k}, 'v': {v!r}::DOUBLE}}" for b, own in enumerate(s_sets(8, 0.99)) for k, v in enumerate(own)) + "]) AS e"
RGB_BLOCKS = [
    MOSAIC, RGB, LUMA, half("luma"), half("rgb", "halfch", ", ch"), domains("half", 8, 8, "dl"), domains("halfch", 8, 8, "dc", ", ch"), ranges("luma", 8, "rl"), ranges("rgb", 8, "rc", ", ch"),
    pool(8, [0], "dl", "dc"), queries(8, "rl", "rc"), topk(4096, False), matched(8),
]

ORACLE_SQL: dict[str, str] = {
    "mosaic_pixels": with_(MOSAIC) + "SELECT image_id, y, x, round(v, 6) AS v FROM mosaic",
    "luma_rgb": with_(MOSAIC, RGB, LUMA) + "SELECT image_id, y, x, round(v, 6) AS luma FROM luma",
    "gray_u8": with_(MOSAIC, RGB) + "SELECT image_id, y, x, CAST(floor(round(sum(floor(v * 255) * CASE ch WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END::DOUBLE), 9)) AS INT) AS g FROM rgb GROUP BY 1, 2, 3",
    "clamp_u8": with_(MOSAIC) + "SELECT image_id, y, x, CAST(floor(v * 255) AS INT) AS clamped, CAST(round_even(v * 255, 0) AS INT) AS rounded, CAST(floor(least(255.0, greatest(0.0, (v * 2 - 0.5) * 255))) AS INT) AS saved FROM mosaic",
    "pad_edge": with_(MOSAIC) + "SELECT m.image_id, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, round(v, 6) AS v FROM range(0, 96) AS t(yy), range(0, 96) AS u(xx) JOIN mosaic m ON m.y = least(yy, 63) AND m.x = least(xx, 63)",
    "range_grid": with_(MOSAIC) + "SELECT image_id, CAST(a * 8 + b AS BIGINT) AS idx, CAST(a * 8 AS INT) AS y, CAST(b * 8 AS INT) AS x FROM (SELECT DISTINCT image_id FROM mosaic), range(0, 8) AS t(a), range(0, 8) AS u(b)",
    "domain_grid_even": with_(MOSAIC) + "SELECT image_id, CAST(a * 7 + b AS BIGINT) AS idx, CAST(a * 8 AS INT) AS y, CAST(b * 8 AS INT) AS x FROM (SELECT DISTINCT image_id FROM mosaic), range(0, 7) AS t(a), range(0, 7) AS u(b)",
    "domain_grid_odd": with_(MOSAIC) + "SELECT image_id, CAST(a * 10 + b AS BIGINT) AS idx, CAST(a * 5 AS INT) AS y, CAST(b * 5 AS INT) AS x FROM (SELECT DISTINCT image_id FROM mosaic), range(0, 10) AS t(a), range(0, 10) AS u(b)",
    "downsample2x2": with_(MOSAIC, half("mosaic")) + f"SELECT image_id, {INTS}, round(v, 6) AS v FROM half",
    "domains_odd": with_(MOSAIC, "w AS (SELECT image_id, wy, wx, ((y - 5 * wy) // 2) * 8 + (x - 5 * wx) // 2 AS p, sum(v) * 0.25 AS v FROM mosaic, range(0, 10) AS t(wy), range(0, 10) AS u(wx) WHERE y >= 5 * wy AND y < 5 * wy + 16 AND x >= 5 * wx AND x < 5 * wx + 16 GROUP BY ALL)")
    + "SELECT image_id, CAST(wy * 10 + wx AS BIGINT) AS dom, CAST(wy * 5 AS INT) AS y, CAST(wx * 5 AS INT) AS x, round(sum((p + 1) * v), 6) AS ramp FROM w GROUP BY ALL",
    **{name: with_(MOSAIC, ranges("mosaic", 8, "r"), sources(8, tfs)) + f"SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(tf AS INT) AS tf, round({RAMP.format('m')}, 6) AS ramp FROM (SELECT image_id, oy, ox, tf, {MOVED} AS m FROM r, src)"
       for name, tfs in (("transform_d4", list(range(8))), ("transform_shear", [12, 13, 14]), ("transform_all15", list(range(15))))},
    "entropy_blocks": with_(MOSAIC, ranges("mosaic", 8, "r"), described("r", "e", "image_id, oy, ox")) + "SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, round(ent, 6) AS ent FROM e",
    "variance_blocks": with_(MOSAIC, half("mosaic"), domains("half", 8, 8, "d")) + f"SELECT image_id, dom, round({variance('a')}, 6) AS var FROM d",
    "bucket_ids": with_(MOSAIC, ranges("mosaic", 8, "r"), described("r", "e", "image_id, oy, ox", 8)) + "SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, bucket FROM e",
    "bucket_hist": with_(MOSAIC, half("mosaic"), domains("half", 8, 8, "d"), described("d", "e", "image_id, dom", 16)) + "SELECT image_id, bucket, count(*) AS n FROM e GROUP BY 1, 2",
    "entropy_filter": with_(MOSAIC, half("mosaic"), domains("half", 8, 8, "d"), described("d", "e", "image_id, dom")) + "SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY dom) - 1 AS dom, oy AS y, ox AS x, round(ent, 6) AS ent FROM e WHERE ent >= 0.64",
    "max_domains": with_(MOSAIC, half("mosaic"), domains("half", 8, 8, "d"), "k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5('8:' || dom), dom) AS place FROM d)") + "SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY dom) - 1 AS dom, oy AS y, ox AS x FROM k WHERE place <= 20",
    "normalize_rows": with_(MOSAIC, half("mosaic"), domains("half", 8, 8, "d"), f"n AS (SELECT image_id, dom, {normalised('a')} AS m FROM d)", f"u AS (SELECT image_id, dom, [x / sqrt({SQ.format('m')} + 1e-12) FOR x IN m] AS m FROM n)")
    + f"SELECT image_id, dom, round({RAMP.format('m')}, 6) AS ramp, round({SQ.format('m')}, 6) AS norm2 FROM u",
    "query_l2": with_(MOSAIC, ranges("mosaic", 8, "r"), f"u AS (SELECT image_id, oy, ox, [x / sqrt({SQ.format('a')}) FOR x IN a] AS m FROM r)") + f"SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, round({RAMP.format('m')}, 6) AS ramp, round({SQ.format('m')}, 6) AS norm2 FROM u",
    "linreg_pairs": with_(MOSAIC, half("mosaic"), domains("half", 8, 8, "d"), ranges("mosaic", 8, "r"),
        f"p AS (SELECT r.image_id, (r.oy // 8) * 8 + r.ox // 8 AS rng, dom, {SUM.format('d.a')} AS sd, {SUM.format('r.a')} AS sr, {SQ.format('d.a')} AS sdd, {SQ.format('r.a')} AS srr, list_dot_product(d.a, r.a) AS srd FROM r JOIN d ON d.image_id = r.image_id AND d.dom = ((r.oy // 8) * 8 + r.ox // 8) % 49)",
        "s AS (SELECT *, (64 * srd - sd * sr) / (64 * sdd - sd * sd) AS s FROM p)", "o AS (SELECT *, (sr - s * sd) / 64 AS o FROM s)")
    + "SELECT image_id, CAST(rng AS BIGINT) AS rng, dom, round(s, 6) AS s, round(o, 6) AS o, round(srr + s * s * sdd + 64 * o * o - 2 * s * srd - 2 * o * sr + 2 * s * o * sd, 6) AS err FROM o",
    "tf_sums": with_(MOSAIC, half("mosaic"), domains("half", 8, 8, "d"), sources(8, list(range(15)))) + f"SELECT image_id, dom, CAST(tf AS INT) AS tf, round({SUM.format('m')}, 6) AS sum_d, round({SQ.format('m')}, 6) AS sum_dd FROM (SELECT image_id, dom, tf, {MOVED} AS m FROM d, src)",
    "topk_dot": with_(*GRAY, *gray_blocks(), topk(4, False)) + "SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(rank AS INT) AS rank, CAST(entry AS BIGINT) AS entry, round(score, 6) AS score FROM cand",
    "topk_dot_bucketed": with_(*GRAY, *gray_blocks(n=8), topk(4, True)) + "SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(rank AS INT) AS rank, CAST(entry AS BIGINT) AS entry, round(score, 6) AS score FROM cand",
    "best_match_identity": with_(*IDENTITY) + LEAF_COLUMNS.format(order="oy, ox"),
    "best_match_quantized": with_(*GRAY, *gray_blocks(tfs=[0]), topk(4096, False), matched(8, quantized=True)) + LEAF_COLUMNS.format(order="oy, ox"),
    "best_match_rgb": with_(*RGB_BLOCKS) + LEAF_COLUMNS.format(order="oy, ox"),
    "best_match_topk": with_(*GRAY, *gray_blocks(), topk(16, False), matched(8)) + LEAF_COLUMNS.format(order="oy, ox"),
    "best_match_bucketed": with_(*GRAY, *gray_blocks(n=8), topk(16, True), matched(8)) + LEAF_COLUMNS.format(order="oy, ox"),
    "best_match_snapped": with_(*GRAY, *gray_blocks(n=8), topk(16, True), matched(8, sets=True)) + LEAF_COLUMNS.format(order="oy, ox"),
    "quant_dequant": with_(MOSAIC, "q AS (SELECT image_id, y, x, CAST(round((least(0.99, greatest(-0.99, v * 3 - 1.5)) + 0.99) * 255.0 / 1.98) AS INT) AS qs, CAST(round((least(1.5, greatest(-0.5, v * 4 - 1.5)) + 0.5) * 255.0 / 2.0) AS INT) AS qo FROM mosaic)")
    + "SELECT image_id, y, x, qs, qo, round(qs * 1.98::DOUBLE / 255.0 - 0.99, 6) AS s, round(-0.5 + qo * 2.0::DOUBLE / 255.0, 6) AS o FROM q",
    "s_sets": """WITH b AS (SELECT i, least(0.99, 0.2 + 0.79 * i / 7.0) AS mx FROM range(0, 8) AS t(i)),
l AS (SELECT i, CASE WHEN i >= 4 THEN [-mx / 4, -mx / 2, 0, mx / 4, mx / 2, mx * 3 / 4, mx] ELSE [0, mx / 4, mx / 2, mx * 3 / 4, mx] END AS s FROM b)
SELECT CAST(i AS INT) AS bucket, CAST(unnest(range(0, len(s))) AS INT) AS ord, round(unnest([CAST(z AS DOUBLE) FOR z IN s]), 6) AS v FROM l""",
    "s_snap": with_(MOSAIC, f"s AS (SELECT e.bucket, e.ord, e.v AS z FROM ({S_SETS}))") + "SELECT image_id, y, x, CAST((y + x) % 8 AS INT) AS bucket, round(arg_min(z, {'d': abs(z - (m.v * 3 - 1.5)), 'o': ord}), 6) AS s FROM mosaic m JOIN s ON s.bucket = (y + x) % 8 GROUP BY image_id, y, x, m.v",
    "lsh_probe": with_(*GRAY, *gray_blocks(tfs=[0]), f"sq AS (SELECT image_id, oy, ox, {LSH_BITS.format('q')} AS sig FROM q)", f"sp AS (SELECT image_id, entry, {LSH_BITS.format('proxy')} AS sig FROM pool)",
        "pr AS (SELECT image_id, oy, ox, k AS probe, CASE WHEN k = 0 THEN sig ELSE xor(sig, 1 << (k - 1)) END AS sig FROM sq, range(0, 11) AS t(k))",
        "f AS (SELECT pr.*, entry, row_number() OVER (PARTITION BY pr.image_id, oy, ox ORDER BY probe, entry) AS place FROM pr JOIN sp ON sp.image_id = pr.image_id AND sp.sig = pr.sig)")
    + "SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(entry AS BIGINT) AS entry, CAST(probe AS INT) AS probe, CAST(place AS INT) AS place FROM f WHERE place <= 5",
    "quadtree_leaves": with_(*QUADTREE) + LEAF_COLUMNS.format(order=MORTON.format(m=16)),
    "decode_iter1": with_(*IDENTITY, *decoded(1)) + f"SELECT image_id, {INTS}, round(v, 6) AS v FROM v1",
    "decode_iter2": with_(*IDENTITY, *decoded(2)) + f"SELECT image_id, {INTS}, round(v, 6) AS v FROM v2",
    "mse_psnr": with_(*IDENTITY, *decoded(2), "e AS (SELECT m.image_id, avg((m.v - v2.v) ^ 2) AS mse FROM mosaic m JOIN v2 ON v2.image_id = m.image_id AND v2.y = m.y AND v2.x = m.x GROUP BY 1)") + "SELECT image_id, round(mse, 6) AS mse, round(CASE WHEN mse <= 0 THEN 99.0 ELSE -10 * log10(mse) END, 6) AS psnr FROM e",
    "code_size": with_(*QUADTREE, "n AS (SELECT image_id, 48 + 16 + 4 * (25 + 49) + count(*) * 12 AS n_bytes FROM leaf GROUP BY 1)") + "SELECT image_id, CAST(n_bytes AS BIGINT) AS n_bytes, round(4096.0::DOUBLE / n_bytes, 6) AS ratio FROM n",
    "edge_mask": with_(*QUADTREE, MASK) + f"SELECT image_id, {INTS} FROM m0",
    "edge_mask_thick2": with_(*QUADTREE, MASK) + f"SELECT image_id, {INTS} FROM (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM m0, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS t(dy, dx)) WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63",
    "overlay_blend": with_(*QUADTREE, MASK) + "SELECT m.image_id, m.y, m.x, CAST(CASE WHEN m0.y IS NULL THEN floor(v * 255) ELSE floor(round(floor(v * 255) * 0.25 + 150, 9)) END AS INT) AS g FROM mosaic m LEFT JOIN m0 ON m0.image_id = m.image_id AND m0.y = m.y AND m0.x = m.x",
    "overlay_upscaled": with_(*QUADTREE, MASK) + "SELECT m.image_id, CAST(m.y * 2 + a AS INT) AS y, CAST(m.x * 2 + b AS INT) AS x, CAST(CASE WHEN m0.y IS NULL THEN 0 ELSE 255 END AS INT) AS g FROM mosaic m LEFT JOIN m0 ON m0.image_id = m.image_id AND m0.y = m.y AND m0.x = m.x, range(0, 2) AS t(a), range(0, 2) AS u(b)",
    "synthetic_smooth": """WITH g AS (SELECT y, x, 0.6::DOUBLE * y / 127 + 0.4::DOUBLE * x / 127 AS b FROM range(0, 128) AS t(y), range(0, 128) AS u(x))
SELECT CAST(0 AS BIGINT) AS image_id, CAST(ch AS INT) AS ch, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(least(1.0, CASE ch WHEN 0 THEN b WHEN 1 THEN 0.9 * b + 0.05 ELSE 0.8 * b + 0.1 END), 6) AS v FROM g, range(0, 3) AS c(ch)""",
    "synthetic_edges": """SELECT CAST(0 AS BIGINT) AS image_id, CAST(ch AS INT) AS ch, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN (x + 128 - CASE WHEN ch = 2 THEN 4 ELSE 0 END) % 128 % 8 < 4 THEN 1.0::DOUBLE ELSE 0.0 END AS v
FROM range(0, 128) AS t(y), range(0, 128) AS u(x), range(0, 3) AS c(ch)""",
    "param_grid": """SELECT row_number() OVER (ORDER BY stride, topk) - 1 AS point, 'backend=dot__stride=' || stride || '__topk=' || topk AS name, 'dot' AS backend, CAST(stride AS BIGINT) AS stride, CAST(topk AS BIGINT) AS topk
FROM range(4, 9, 2) AS t(stride), (VALUES (16), (64)) AS u(topk) ORDER BY stride, topk LIMIT 5""",
    "encode_arrow": with_(*IDENTITY) + "SELECT image_id, count(*) AS n_leaves, CAST(48 + 8 + 4 * 49 + count(*) * 18 AS BIGINT) AS n_bytes, round(avg(mse), 6) AS mse FROM leaf GROUP BY 1",
    "ffc2_roundtrip": with_(*GRAY, *gray_blocks(tfs=[0]), topk(4096, False), matched(8, quantized=True))
    + "SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY oy, ox) - 1 AS leaf_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, 8 AS block, CAST(dom AS BIGINT) AS dom, CAST(tf AS INT) AS tf, 0 AS ch, CAST(round((codes[1].s + 0.99) * 255 / 1.98) AS INT) AS qs, CAST(round((codes[1].o + 0.5) * 255 / 2.0) AS INT) AS qo FROM leaf",
    "size_identity": with_(*QUADTREE, "n AS (SELECT image_id, CAST(48 + 16 + 4 * (25 + 49) + count(*) * 18 AS BIGINT) AS n FROM leaf GROUP BY 1)") + "SELECT image_id, n AS n_bytes, n AS expected FROM n",
}
