"""The same answers in DuckDB SQL, written on their own and put together from common table expressions."""

from __future__ import annotations

from ..config import BANDS, CALIBRATION


def linear(c: str) -> str:
    """Linear light of an 8-bit level."""
    x = f"({c}/255.0e0)"
    return f"(CASE WHEN {x} <= 0.04045e0 THEN {x}/12.92e0 ELSE pow(({x}+0.055e0)/1.055e0, 2.4e0) END)"


def _pixels(name: str, shift: int, gain: float) -> str:
    e = lambda k: f"CAST(embedding[(p+{k + shift})%64+1] AS DOUBLE)"
    level = lambda v: f"CAST(least(255, greatest(0, floor(({gain}e0*({v})+0.5e0)*255.0e0))) AS INTEGER)"
    return f"""{name} AS (SELECT vec_id AS photo_id, CAST(p AS INTEGER) AS pos, CAST(p%8 AS INTEGER) AS x, CAST(p//8 AS INTEGER) AS y,
  {level(e(0))} AS r, {level(f"{e(21)}+8.0e0*{e(0)}*{e(13)}")} AS g, {level(f"{e(42)}-8.0e0*{e(0)}*{e(29)}")} AS b
  FROM embeddings, range(64) t(p))"""


def _lab(source: str, name: str) -> str:
    f = lambda t: f"(CASE WHEN {t} > pow(6.0e0/29,3) THEN pow({t}, 1.0e0/3) ELSE {t}/(3*pow(6.0e0/29,2))+4.0e0/29 END)"
    return f"""{name}_lin AS (SELECT *, {linear("r")} AS lr, {linear("g")} AS lg, {linear("b")} AS lb FROM {source}),
{name}_xyz AS (SELECT *, (0.4124564e0*lr+0.3575761e0*lg+0.1804375e0*lb)/0.95047e0 AS tx, (0.2126729e0*lr+0.7151522e0*lg+0.0721750e0*lb) AS ty, (0.0193339e0*lr+0.1191920e0*lg+0.9503041e0*lb)/1.08883e0 AS tz,
  greatest(r,g,b)/255.0e0 AS mx, (greatest(r,g,b)/255.0e0-least(r,g,b)/255.0e0) AS d FROM {name}_lin),
{name} AS (SELECT photo_id, pos, x, y, r, g, b, lr, lg, lb, 116*{f("ty")}-16 AS l, 500*({f("tx")}-{f("ty")}) AS a, 200*({f("ty")}-{f("tz")}) AS b_,
  CASE WHEN mx > 1e-6 THEN d/(mx+1e-9) ELSE 0 END AS sat,
  CASE WHEN d <= 1e-6 THEN 0 ELSE h6*60-360*floor(h6*60/360) END AS hue FROM (SELECT *, CASE
     WHEN r=greatest(r,g,b) THEN (g/255.0e0-b/255.0e0)/(d+1e-9)-6*floor((g/255.0e0-b/255.0e0)/(d+1e-9)/6)
     WHEN g=greatest(r,g,b) THEN (b/255.0e0-r/255.0e0)/(d+1e-9)+2 ELSE (r/255.0e0-g/255.0e0)/(d+1e-9)+4 END AS h6 FROM {name}_xyz))"""


def _sharp(source: str, name: str) -> str:
    near = lambda f, by, order: f"coalesce({f}(l) OVER (PARTITION BY photo_id, {by} ORDER BY {order}), l)"
    return f"""{name}_mag AS (SELECT *, abs(4*l-{near("lag", "x", "y")}-{near("lead", "x", "y")}-{near("lag", "y", "x")}-{near("lead", "y", "x")}) AS mag FROM {source}),
{name} AS (SELECT m.*, mag >= q OR most = 0 AS sharp FROM {name}_mag m JOIN (SELECT photo_id, quantile_cont(mag, 0.75) AS q, max(mag) AS most FROM {name}_mag GROUP BY 1) USING (photo_id))"""


PX, PT = _pixels("px", 0, 2.0), _pixels("pt", 7, 1.6)
LAB, PTLAB = _lab("px", "lab"), _lab("pt", "ptlab")
SH, PTSH = _sharp("lab", "sh"), _sharp("ptlab", "ptsh")
SCOPE = "scope AS (SELECT * FROM (VALUES ('global'), ('sharp')) v(scope))"


def tone(source: str, name: str) -> str:
    """Tone statistics of a table of analysed pixels."""
    ok = "(scope='global' OR sharp) AND greatest(r,g,b) < 250 AND l > 5"
    return f"""{name} AS (SELECT photo_id, scope,
  coalesce(median(l) FILTER ({ok}), median(l)) AS median_l, coalesce(avg(l) FILTER ({ok}), avg(l)) AS mean_l,
  coalesce(quantile_cont(l, 0.05) FILTER ({ok}), quantile_cont(l, 0.05)) AS p05_l, coalesce(quantile_cont(l, 0.95) FILTER ({ok}), quantile_cont(l, 0.95)) AS p95_l,
  avg(CASE WHEN greatest(r,g,b) >= 250 THEN 1.0e0 ELSE 0 END) AS clipped_hi, avg(CASE WHEN l <= 5 THEN 1.0e0 ELSE 0 END) AS clipped_lo,
  avg(CASE WHEN {ok} THEN 1.0e0 ELSE 0 END) AS tonal_frac FROM {source}, scope GROUP BY 1, 2)"""


def neutral(source: str, name: str) -> str:
    """Cast of near-grey pixels."""
    ok = "(scope='global' OR sharp) AND sqrt(a*a+b_*b_) < 10 AND l BETWEEN 20 AND 92"
    return f"""{name} AS (SELECT photo_id, scope, coalesce(median(a) FILTER ({ok}), 0) AS a_bias, coalesce(median(b_) FILTER ({ok}), 0) AS b_bias,
  coalesce(median(sqrt(a*a+b_*b_)) FILTER ({ok}), 0) AS chroma, count(*) FILTER ({ok}) / CAST(count(*) AS DOUBLE) AS neutral_frac, count(*) FILTER ({ok}) AS n_neutral FROM {source}, scope GROUP BY 1, 2)"""


CENTRES = "centres AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {c}e0)" for i, (n, c) in enumerate(BANDS)) + ") v(band_no, band, centre))"


def bands(source: str, name: str) -> str:
    """Hue bands, dense."""
    return f"""{name}_c AS (SELECT p.*, sqrt(a*a+b_*b_) AS chroma, (SELECT arg_min(band_no, struct_pack(v := abs((hue-centre+180)-360*floor((hue-centre+180)/360)-180), n := band_no)) FROM centres) AS band_no FROM {source} p),
{name} AS (SELECT t.photo_id, s.scope, c.band_no, c.band, coalesce(frac, 0) AS frac, coalesce(f.median_hue, centre) AS median_hue, coalesce(f.median_chroma, 0) AS median_chroma, coalesce(f.median_sat, 0) AS median_sat, coalesce(f.sat_clip_frac, 0) AS sat_clip_frac, coalesce(f.median_l, 0) AS median_l
  FROM (SELECT DISTINCT photo_id FROM {source}) t CROSS JOIN scope s CROSS JOIN centres c LEFT JOIN (
   SELECT b.photo_id, scope, band_no, count(*)/CAST(any_value(total) AS DOUBLE) AS frac, median(hue) AS median_hue, median(chroma) AS median_chroma, median(sat) AS median_sat, avg(CASE WHEN sat >= 0.97 THEN 1.0e0 ELSE 0 END) AS sat_clip_frac, median(l) AS median_l
   FROM {name}_c b JOIN (SELECT photo_id, count(*) AS total FROM {source} GROUP BY 1) USING (photo_id), scope WHERE chroma >= 10 AND (scope='global' OR sharp) GROUP BY 1, 2, 3) f
  ON f.photo_id=t.photo_id AND f.scope=s.scope AND f.band_no=c.band_no)"""


_SECONDS = """CASE WHEN contains(s, '/') THEN TRY_CAST(trim(split_part(s,'/',1)) AS DOUBLE) / nullif(TRY_CAST(trim(split_part(s,'/',2)) AS DOUBLE), 0) WHEN TRY_CAST(s AS DOUBLE) > 0 THEN TRY_CAST(s AS DOUBLE) END"""
PHOTO = f"""photo0 AS (SELECT vec_id AS photo_id, CAST(label AS VARCHAR) AS profile, vec_id % 10 = 0 AS is_seed, CAST(100 * pow(2, vec_id % 6) AS INTEGER) AS iso,
  CAST([1.8, 2.8, 4.0, 5.6][vec_id % 4 + 1] AS DOUBLE) AS aperture,
  CASE vec_id % 13 WHEN 0 THEN '0,4 s' WHEN 1 THEN '1"' WHEN 2 THEN 'x' WHEN 3 THEN NULL ELSE '1/' || CAST(50 * (vec_id % 8 + 1) AS VARCHAR) END AS shutter,
  {", ".join(f"CASE WHEN (vec_id+{i}) % 3 <> 0 THEN CAST((vec_id*37+{i * 11}) % 201 - 100 AS DOUBLE) END AS {n}" for i, (n, _) in enumerate(CALIBRATION))},
  3000.0e0 + (vec_id*53) % 5000 AS temperature, CAST((vec_id*29) % 61 - 30 AS DOUBLE) AS tint, ((vec_id*17) % 41 - 20) / 10.0e0 AS exposure FROM embeddings),
feat AS (SELECT photo_id, avg(lr)/avg(lg) AS rg, avg(lb)/avg(lg) AS bg, median(l) AS median_l FROM lab GROUP BY 1),
photo1 AS (SELECT p.*, rg, bg, median_l, {_SECONDS} AS seconds FROM (SELECT *, replace(regexp_replace(trim(shutter), '["s ]+$', ''), ',', '.') AS s FROM photo0) p JOIN feat USING (photo_id)),
photo AS (SELECT *, CASE WHEN iso > 0 AND aperture > 0 AND seconds > 0 THEN log2(aperture*aperture/seconds) - log2(iso/100.0e0) END AS ev100 FROM photo1)"""
_D = "+".join(f"coalesce(pow((t.{c}-s.{c})/s_{c}, 2), 0)" for c in ("rg", "bg", "median_l"))
_SIGMA = ", ".join(f"CASE WHEN count({c}) >= 2 THEN coalesce(nullif(stddev_pop({c}), 0), 1) ELSE 1 END AS s_{c}" for c in ("rg", "bg", "median_l"))
KNN = f"""seeds AS (SELECT * FROM photo WHERE is_seed), wanted AS (SELECT * FROM photo WHERE NOT is_seed),
pool AS (SELECT t.photo_id, s.photo_id AS seed_id FROM wanted t JOIN seeds s ON t.profile = s.profile OR NOT EXISTS (SELECT 1 FROM seeds x WHERE x.profile = t.profile)),
sigma AS (SELECT pool.photo_id, count(*) AS n, {_SIGMA} FROM pool JOIN seeds s ON s.photo_id = seed_id GROUP BY 1),
dist AS (SELECT pool.photo_id, seed_id, n, sqrt({_D}) AS d FROM pool JOIN wanted t ON t.photo_id=pool.photo_id JOIN seeds s ON s.photo_id=seed_id JOIN sigma ON sigma.photo_id=pool.photo_id),
rnk AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY d, seed_id) AS rank, min(d) OVER (PARTITION BY photo_id) AS first FROM dist),
knn AS (SELECT photo_id, seed_id, d, CAST(rank AS INTEGER) AS rank FROM rnk WHERE rank <= CASE WHEN first < 1e-6 THEN 1 ELSE least(3, greatest(1, n//2)) END)"""
_W = lambda c: f"sum(s.{c}*(1/(d+1e-6))) / sum(1/(d+1e-6)) FILTER (s.{c} IS NOT NULL)"
_G = lambda c: f"CASE WHEN count(s.{c}) > 1 AND max(s.{c})-min(s.{c}) > 25 THEN arg_min(s.{c}, rank) FILTER (s.{c} IS NOT NULL) ELSE {_W(c)} END AS {c}"
TARGET = f"""target AS (SELECT k.photo_id, {_W("temperature")} AS temperature, {_W("tint")} AS tint, {_W("median_l")} AS target_l, {", ".join(_G(n) for n, _ in CALIBRATION)}, count(*) AS n_matched, list(seed_id ORDER BY rank) AS seed_ids
  FROM knn k JOIN seeds s ON s.photo_id = seed_id GROUP BY 1)"""
JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS worker, CASE WHEN event_type IN ('click','view') THEN 'submit' WHEN event_type='signup' THEN 'poll' ELSE 'result' END AS kind,
  CASE WHEN event_type='purchase' THEN 'ok' WHEN event_type NOT IN ('click','view','signup') THEN 'error' END AS status, ts FROM events)"""


def with_(*parts: str) -> str:
    """A WITH clause."""
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(*names: str) -> str:
    """Columns rounded to six digits."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
