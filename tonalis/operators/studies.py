"""Offline studies: regressions with leave-one-out error, calibration from references, generalisation, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def guarded_slope(y: str, x: str) -> Column:
    """Least-squares slope; 0 for fewer than two points or no spread in ``x``."""
    flat = (F.count(x) < 2) | (F.var_pop(x) * F.count(x) < 1e-9)
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.regr_slope(y, x), F.lit(0.0)))


def regress(df: DataFrame, by: str, x: str, y: str, least: int = 20) -> DataFrame:
    """``slope``, ``intercept``, ``r2``, leave-one-out error ``loo`` and ``base`` deviation for each group.

    The second pass needs each row's leverage, hence a join with a row for each group.
    """
    rows = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    fit = rows.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.avg("x").alias("mx"), F.var_pop("x").alias("vx"), F.stddev_pop("y").alias("base")).where(F.col("n") >= least)
    error = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
    leverage = F.lit(1.0) / F.col("n") + F.pow(F.col("x") - F.col("mx"), 2) / (F.col("vx") * F.col("n"))
    out = error / F.greatest(F.lit(1e-6), F.lit(1.0) - leverage)
    loo = rows.join(fit, by).groupBy(by).agg(F.sqrt(F.avg(out * out)).alias("loo"))
    return fit.join(loo, by).select(by, "n", "slope", "intercept", "r2", "loo", "base")


def moments(df: DataFrame, by: str, x1: str, x2: str, y: str) -> DataFrame:
    """What a two-variable fit needs of each group: means and covariances."""
    pairs = [(a, b) for i, a in enumerate((x1, x2, y)) for b in (x1, x2, y)[i:]]
    names = {x1: "1", x2: "2", y: "y"}
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{names[c]}") for c in (x1, x2, y)], *[F.covar_pop(a, b).alias(f"s{names[a]}{names[b]}") for a, b in pairs])


def plane(m: DataFrame) -> DataFrame:
    """Coefficients ``a``, ``b``, ``c`` of the least-squares plane of each row of ``moments``."""
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    fit = m.withColumn("a", (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det).withColumn("b", (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det)
    return fit.withColumn("c", F.col("my") - F.col("a") * F.col("m1") - F.col("b") * F.col("m2"))


def plane_error(fit: DataFrame, on: DataFrame) -> DataFrame:
    """Error of every fitted plane (``fit_on``, ``a``, ``b``, ``c``) on every group's ``moments`` (``tested_on``): the matrix that is asked for, from moments alone."""
    square = (
        F.col("syy") - F.col("a") * F.col("s1y") * 2 - F.col("b") * F.col("s2y") * 2 + F.col("a") * F.col("a") * F.col("s11") + F.col("b") * F.col("b") * F.col("s22") + F.col("a") * F.col("b") * F.col("s12") * 2
        + F.pow(F.col("my") - F.col("a") * F.col("m1") - F.col("b") * F.col("m2") - F.col("c"), 2)
    )
    return fit.join(on).select("fit_on", "tested_on", F.sqrt(F.greatest(F.lit(0.0), square)).alias("rmse"))


def white_balance(seeds: DataFrame, by: str, slope: float = 2450.0) -> DataFrame:
    """Fixed-slope calibration of temperature on ``rg`` for each group, and its regime."""
    z = F.col("temperature") - F.lit(slope) * F.col("rg")
    first = seeds.withColumn("z", z).groupBy(by).agg(F.count("*").alias("n"), F.median("z").alias("intercept"), F.avg("z").alias("mz"), F.var_pop("z").alias("vz"), F.stddev_pop("temperature").alias("spread"), F.median("tint").alias("tint"), F.median("exposure").alias("exposure"))
    residual = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.sqrt(F.col("vz") + F.pow(F.col("mz") - F.col("intercept"), 2)))
    ratio = F.col("residual") / F.col("spread")
    regime = F.when((F.col("n") < 4) | (F.col("spread") < 150), "uncertain").when(ratio <= 0.5, "physics").when(ratio >= 0.7, "artistic").otherwise("uncertain")
    return first.withColumn("residual", residual).withColumn("regime", regime).select(by, "n", "intercept", "residual", "spread", "tint", "exposure", "regime")


#: Kelvin for each unit of the as-shot ratio, by camera; others have the default.
SLOPES, SLOPE = {"ILCE-7M4": 2450.0}, 2450.0


def camera_slope(camera: Column) -> Column:
    """The slope of a camera, the default for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in SLOPES.items() for x in kv])
    return F.coalesce(F.element_at(known, camera), F.lit(SLOPE))


def predicted_temperature(slope: Column, intercept: Column, rg: Column) -> Column:
    """Temperature of an as-shot ratio, within what can be set."""
    return F.greatest(F.lit(2000.0), F.least(F.lit(12000.0), slope * rg + intercept))


def exposure_follows(regime: Column) -> Column:
    """Whether exposure may be planned in a regime: all but the artistic one."""
    return regime != "artistic"


def regress_plane(df: DataFrame, by: str, x1: str, x2: str, y: str, least: int = 31) -> DataFrame:
    """``a``, ``b``, ``c``, ``r2``, leave-one-out error ``loo`` and ``base`` deviation of ``y`` on two variables, for each group of at least ``least`` whole rows."""
    rows = df.select(by, *[F.col(c).cast("double").alias(c) for c in (x1, x2, y)]).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (x1, x2, y)))
    fit = plane(moments(rows, by, x1, x2, y).where(F.col("n") >= least))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    d1, d2 = F.col(x1) - F.col("m1"), F.col(x2) - F.col("m2")
    leverage = F.lit(1.0) / F.col("n") + (d1 * d1 * F.col("s22") - d1 * d2 * F.col("s12") * 2 + d2 * d2 * F.col("s11")) / (det * F.col("n"))
    error = F.col(y) - F.col("a") * F.col(x1) - F.col("b") * F.col(x2) - F.col("c")
    out = error / F.greatest(F.lit(1e-6), F.lit(1.0) - leverage)
    found = rows.join(fit, by).groupBy(by).agg(F.sqrt(F.avg(out * out)).alias("loo"), F.sum(error * error).alias("sse"))
    return fit.join(found, by).select(by, "n", "a", "b", "c", (F.lit(1.0) - F.col("sse") / (F.col("syy") * F.col("n"))).alias("r2"), "loo", F.sqrt("syy").alias("base"))


def helps(loo: Column, base: Column, share: float = 0.9) -> Column:
    """Whether a fit foretells better than the mean does: its leave-one-out error is under ``share`` of the deviation."""
    return loo < base * share


def report_line(name: Column, r2: Column, loo: Column, base: Column, n: Column, unit: str, share: float = 0.9) -> Column:
    """A fit as a line of text; too few rows where there is no fit."""
    text = F.format_string(f"%s R2=%.3f LOO=%.3f{unit} base=%.3f n=%d", name, r2, loo, base, n)
    return F.when(r2.isNull(), F.concat(name, F.lit(" (too few)"))).otherwise(F.concat(text, F.when(helps(loo, base, share), " HELPS").otherwise("")))


def chosen_settings(rows: DataFrame, by: str, names: tuple[str, ...] = ("exposure", "temperature", "tint")) -> DataFrame:
    """Median, deviation, least and largest of each chosen setting of each group, nulls left out."""
    each = F.array(*[F.struct(F.lit(n).alias("setting"), F.col(n).cast("double").alias("v")) for n in names])
    long = rows.select(by, F.explode(each).alias("e")).select(by, "e.setting", "e.v")
    return long.groupBy(by, "setting").agg(F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n"))


def white_balance_modes(rows: DataFrame, by: str, mode: Column) -> DataFrame:
    """Photos of each white-balance mode; an unset one counts as a mode."""
    return rows.groupBy(by, mode.alias("mode")).agg(F.count("*").alias("n"))


def coherence(rows: DataFrame, by: str) -> DataFrame:
    """How warm and cool the photos of each group are, and whether temperature follows the as-shot ratio, is constant, or neither."""
    t = F.col("temperature")
    share = lambda c: F.avg(c.cast("double")) * 100.0
    both = F.col("rg").isNotNull() & t.isNotNull()
    fit = F.when(F.count_if(both) >= 20, F.coalesce(F.regr_r2("temperature", "rg"), F.lit(0.0)))
    found = rows.groupBy(by).agg(share(t > 5500).alias("warm"), share(t < 4500).alias("cool"), F.stddev_pop("temperature").alias("std"), fit.alias("r2"))
    return found.withColumn("verdict", F.when(F.col("r2").isNull(), "too few").when(F.col("r2") > 0.4, "followable").when(F.col("std") < 250, "constant").otherwise("mixed"))


def with_features(features: DataFrame, develop: DataFrame, key: str, needed: tuple[str, ...], least: int = 50) -> DataFrame:
    """Features and settings of the photos that have both and every one of ``needed``; none at all if they are under ``least``."""
    joined = features.join(develop, key).dropna(subset=list(needed))
    return joined if joined.limit(least).count() == least else joined.where("false")


def baseline(df: DataFrame, by: str, y: str) -> DataFrame:
    """Error of the median of each group, ``by`` and ``baseline``, and its size ``n``: what knowing nothing costs."""
    middle = df.groupBy(by).agg(F.median(y).alias("_m"))
    return df.join(middle, by).groupBy(by).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col("_m"), 2))).alias("baseline"), F.count("*").alias("n"))


def drawn(df: DataFrame, most: int, trials: int) -> DataFrame:
    """The first ``most`` rows of each trial's own order, by a hash of ``trial`` and ``photo_id``, with their ``rank``.

    Spark keeps only that many rows a trial and partition before it shuffles.
    """
    dealt = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_h", F.md5(F.concat_ws("-", F.col("trial").cast("string"), F.col("photo_id").cast("string"))))
    return dealt.withColumn("rank", F.row_number().over(W.partitionBy("trial").orderBy("_h", "photo_id"))).where(F.col("rank") <= most).drop("_h")


_SUMS = ("rg", "bg", "temperature", "tint", "exposure")


def _sums(prefix: str) -> list[Column]:
    """Sums and sums of products, from which the squared error of any plane, slope or constant follows."""
    pairs = [(a, b) for i, a in enumerate(_SUMS[:3]) for b in _SUMS[:3][i:]] + [("tint", "tint"), ("exposure", "exposure")]
    return [F.count("*").cast("double").alias(f"{prefix}n"), *[F.sum(c).alias(f"{prefix}{c}") for c in _SUMS], *[F.sum(F.col(a) * F.col(b)).alias(f"{prefix}{a}_{b}") for a, b in pairs]]


def _plane_sse(p: str, a: Column, b: Column, c: Column) -> Column:
    """Squared error of ``temperature ~ a rg + b bg + c`` from the sums of prefix ``p``."""
    s = lambda name: F.col(f"{p}{name}")
    return (
        s("temperature_temperature") - (a * s("rg_temperature") + b * s("bg_temperature") + c * s("temperature")) * 2
        + a * a * s("rg_rg") + b * b * s("bg_bg") + a * b * s("rg_bg") * 2 + (a * s("rg") + b * s("bg")) * c * 2 + c * c * s("n")
    )


def seed_curve(df: DataFrame, sizes: tuple[int, ...] = (3, 5, 8, 12, 20, 40), trials: int = 200, slope: float = SLOPE) -> DataFrame:
    """Mean errors on the other photos of what ``k`` random references foretell, for each k below the number of photos.

    ``full``: temperature by a plane through the references; ``slope``: by the
    fixed slope and their median intercept; ``tint`` and ``exposure``: by their
    medians.  Errors on the others are those on all less those on the chosen, both
    from sums, so only the chosen rows of a trial are gathered.
    """
    rows = df.select("photo_id", *[F.col(c).cast("double").alias(c) for c in _SUMS]).dropna()
    total = rows.agg(*_sums("all_")).first()
    if not total["all_n"]:
        return df.sparkSession.createDataFrame([], "k int, full double, slope double, tint double, exposure double, trials long")
    z = F.col("temperature") - F.lit(slope) * F.col("rg")
    ranked = drawn(rows, max(sizes), trials).withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= k")
    each = ranked.groupBy("k", "trial").agg(*_sums("own_"), F.median(z).alias("i"), F.median("tint").alias("t"), F.median("exposure").alias("e")).where(F.col("k") < total["all_n"])
    each = each.withColumns({name: F.lit(float(total[name])) for name in total.asDict()})
    m = lambda a, b: F.col(f"own_{a}_{b}") - F.col(f"own_{a}") * F.col(f"own_{b}") / F.col("own_n")
    det = m("rg", "rg") * m("bg", "bg") - m("rg", "bg") * m("rg", "bg")
    fit = each.withColumn("a", (m("rg", "temperature") * m("bg", "bg") - m("bg", "temperature") * m("rg", "bg")) / F.nullif(det, F.lit(0.0))).withColumn("b", (m("bg", "temperature") * m("rg", "rg") - m("rg", "temperature") * m("rg", "bg")) / F.nullif(det, F.lit(0.0)))
    fit = fit.withColumn("c", (F.col("own_temperature") - F.col("a") * F.col("own_rg") - F.col("b") * F.col("own_bg")) / F.col("own_n"))
    left = F.col("all_n") - F.col("own_n")
    error = lambda sse: F.sqrt(F.greatest(F.lit(0.0), sse) / left)
    planar = _plane_sse("all_", F.col("a"), F.col("b"), F.col("c")) - _plane_sse("own_", F.col("a"), F.col("b"), F.col("c"))
    fixed = _plane_sse("all_", F.lit(slope), F.lit(0.0), F.col("i")) - _plane_sse("own_", F.lit(slope), F.lit(0.0), F.col("i"))
    constant = lambda c, v: sum((sign * (F.col(f"{p}{c}_{c}") - v * F.col(f"{p}{c}") * 2 + v * v * F.col(f"{p}n")) for p, sign in (("all_", 1), ("own_", -1))), F.lit(0.0))
    return fit.groupBy("k").agg(F.avg(error(planar)).alias("full"), F.avg(error(fixed)).alias("slope"), F.avg(error(constant("tint", F.col("t")))).alias("tint"), F.avg(error(constant("exposure", F.col("e")))).alias("exposure"), F.count("*").alias("trials"))


def seed_trials(df: DataFrame, k: int = 6, trials: int = 300, slope: float = SLOPE) -> DataFrame:
    """For each trial of ``k`` random references: the calibration's ``residual`` and ``regime``, and the errors of ``temperature`` (within what can be set) and ``tint`` on the other photos."""
    rows = df.select("photo_id", *[F.col(c).cast("double").alias(c) for c in _SUMS]).dropna()
    chosen = drawn(rows, k, trials)
    cal = white_balance(chosen, "trial", slope).select("trial", "intercept", "residual", "regime", F.col("tint").alias("t"))
    picked = chosen.groupBy("trial").agg(F.collect_set("photo_id").alias("own"))
    # a trial is k numbers and its calibration, and there are as many as were asked for
    both = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).join(F.broadcast(cal.join(picked, "trial")), "trial").where(~F.array_contains("own", F.col("photo_id")))
    miss = predicted_temperature(F.lit(slope), F.col("intercept"), F.col("rg")) - F.col("temperature")
    return both.groupBy("trial", "residual", "regime").agg(F.sqrt(F.avg(miss * miss)).alias("temperature"), F.sqrt(F.avg(F.pow(F.col("t") - F.col("tint"), 2))).alias("tint"))


def trial_summary(trials: DataFrame, base: float) -> DataFrame:
    """Mean, deviation and 90th percentile of the trials' error, the gain over the ``base`` error in percent, and the share of each regime."""
    share = lambda r: F.avg((F.col("regime") == r).cast("double")) * 100.0
    return trials.agg(F.avg("temperature").alias("mean"), F.stddev_pop("temperature").alias("std"), F.percentile("temperature", F.lit(0.9)).alias("p90"), ((F.lit(1.0) - F.avg("temperature") / F.lit(base)) * 100.0).alias("gain"), F.avg("tint").alias("tint"), F.median("residual").alias("residual"), *[share(r).alias(r) for r in ("physics", "uncertain", "artistic")])


def hue_near(hue: Column, ref: Column) -> Column:
    """A hue as the angle within half a turn of another."""
    turn = hue - ref + 180.0
    return ref + (turn - F.floor(turn / 360.0) * 360.0) - 180.0


def band_axis_response(probes: DataFrame) -> DataFrame:
    """Slope of a band's statistic on a slider, for each ``band`` and ``axis``, from probes (``band``, ``axis``, ``delta``, ``frac``, ``value``).

    Unreliable probes are left out; hues are unwrapped around that of the smallest
    change that is reliable.
    """
    good = probes.where("frac >= 0.01")
    first = good.groupBy("band", "axis").agg(F.min_by("value", "delta").alias("ref"))
    near = good.join(first, ["band", "axis"]).withColumn("y", F.when(F.col("axis") == "hue", hue_near(F.col("value"), F.col("ref"))).otherwise(F.col("value")))
    return near.groupBy("band", "axis").agg(guarded_slope("y", "delta").alias("slope"))
