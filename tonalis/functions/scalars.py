"""Exposure, text and settings functions over columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: how a setting is written in a develop text.
SETTING = r'(\w+)\s*=\s*("[^"]*"|true|false|-?[\d.]+)'


def shutter_seconds(shutter: Column) -> Column:
    """Seconds of a shutter text such as ``1/250``, ``0,4 s`` or ``2"``; null if it can't be read.

    A zero denominator, a second slash and times of zero or less are null; a
    negative fraction is not.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(shutter), r'["s ]+$', ""), ",", ".")
    parts = F.split(text, "/")
    up, down = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    plain = text.try_cast("double")
    return F.when(F.size(parts) == 2, up / F.nullif(down, F.lit(0.0))).when((F.size(parts) == 1) & (plain > 0), plain)


def ev100(iso: Column, aperture: Column, seconds: Column) -> Column:
    """Exposure value at ISO 100; null where a part is missing or not above zero."""
    ok = (iso > 0) & (aperture > 0) & (seconds > 0)
    return F.when(ok, F.log2(aperture * aperture / seconds) - F.log2(iso / F.lit(100.0)))


def develop_map(text: Column) -> Column:
    """``map<string,string>`` of the settings in a develop text; of repeated keys the last counts."""
    return F.transform_values(_written(text), lambda _, v: F.trim(v, F.lit('"')))


def _written(text: Column) -> Column:
    """The settings as they are written, texts in quotes."""
    pattern = F.lit(SETTING)
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.aggregate(pairs, none, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def develop_typed(text: Column) -> Column:
    """``map<string, struct<kind, text, number, flag>>`` of the settings: a text in quotes, true or false, a number with a point (float) or without (integer)."""

    def typed(_: Column, v: Column) -> Column:
        quoted, flag = v.startswith('"'), v.isin("true", "false")
        kind = F.when(quoted, "text").when(flag, "flag").when(v.contains("."), "float").otherwise("integer")
        return F.struct(kind.alias("kind"), F.when(quoted, F.trim(v, F.lit('"'))).alias("text"), F.when(~quoted & ~flag, v.try_cast("double")).alias("number"), F.when(flag, v == "true").alias("flag"))

    return F.transform_values(_written(text), typed)


# What settings of a style begin with.
STYLES = ("HueAdjustment", "SaturationAdjustment", "LuminanceAdjustment", "ColorGrade", "ToneCurvePV2012")


def style_flags(text: Column, prefixes: tuple[str, ...] = STYLES) -> Column:
    """``map<string,boolean>``: for each prefix whether a number or a flag of that name isn't zero; and ``Look``, whether the text names one."""
    entries = F.map_entries(develop_typed(text))
    value = lambda e: F.coalesce(e["value"]["number"], e["value"]["flag"].cast("double"))
    used = lambda p: F.exists(entries, lambda e: e["key"].startswith(p) & F.coalesce(F.abs(value(e)) > 1e-6, F.lit(False)))
    pairs = [x for p in prefixes for x in (F.lit(p), used(p))]
    return F.create_map(*pairs, F.lit("Look"), text.contains('Name = "'))


def canonical_json(settings: Column) -> Column:
    """Compact JSON of a ``map<string,string>`` or of numbers with sorted keys; null is the empty map.

    A text value that reads as a number, true, false, or a list of numbers is
    written as that, so equal settings have one text whatever their type was.
    """
    escaped = lambda s: F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"')
    plain = r"^(-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?|true|false|null|\[[-+0-9.eE, ]*\])$"
    value = lambda v: F.when(v.rlike(plain), F.replace(v, F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit('"'), escaped(v), F.lit('"')))
    entries = F.array_sort(F.map_entries(settings))
    parts = F.transform(entries, lambda e: F.concat(F.lit('"'), escaped(e["key"]), F.lit('":'), F.coalesce(value(e["value"].cast("string")), F.lit("null"))))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("}"))


def develop_hash(settings: Column) -> Column:
    """SHA-1 of the canonical JSON."""
    return F.sha1(canonical_json(settings))


def style_hash(settings: Column, style_keys: list[str], version: str) -> Column:
    """SHA-1 of the settings that change a neutral render, and the version of the measurement."""
    style = F.map_filter(settings, lambda k, _: k.isin(style_keys))
    return F.sha1(F.concat(canonical_json(style), F.lit(version)))


def raw_signature(length: Column, modified: Column, version: str) -> Column:
    """``size:mtime:version`` of a file; ``0:0`` where it is missing."""
    return F.concat_ws(":", F.coalesce(length, F.lit(0)).cast("string"), F.coalesce(F.unix_micros(modified), F.lit(0)).cast("string"), F.lit(version))


def model_key(camera: Column, profile: Column) -> Column:
    """``camera|profile`` with bars replaced; null and empty are unknown."""
    part = lambda c: F.coalesce(F.nullif(F.translate(c, "|", "_"), F.lit("")), F.lit("unknown"))
    return F.concat_ws("|", part(camera), part(profile))


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds, null where it is null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def whole(x: Column) -> Column:
    """Rounded half to even."""
    return F.bround(x, 0).cast("int")


def circular_mean(sines: Column, cosines: Column) -> Column:
    """Mean direction in degrees of summed sines and cosines."""
    turn = F.degrees(F.atan2(sines, cosines))
    return turn - 360.0 * F.floor(turn / 360.0)


def log_light(light: Column) -> Column:
    """Light in stops, the darkest that counts being a millionth."""
    return F.log2(F.greatest(light, F.lit(1e-6)))


def kept_settings(settings: Column, keys: list[str]) -> Column:
    """The settings of the given names that are set."""
    return F.map_filter(settings, lambda k, v: k.isin(keys) & v.isNotNull())


def setting_names(settings: Column) -> Column:
    """The names of settings in order, as a line."""
    return F.array_join(F.array_sort(F.map_keys(settings)), ", ")


def decoded(text: Column, kind: str) -> Column:
    """JSON as a value of a type; null where it can't be read."""
    return F.when(F.is_valid_utf8(text) & F.try_parse_json(text).isNotNull(), F.from_json(text, kind))
