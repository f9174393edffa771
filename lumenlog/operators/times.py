"""Mixed timestamp formats and time zones to one UTC instant (problem 3).

Every raw value is read under each layout that fits it and, within a layout,
under each meaning it may have: the zone stated, the host's zone or UTC where
none is, each zone of an abbreviation that several share, the first or second
of a wall time that occurs twice, either side of one that the clocks skipped,
a neighbouring unit of a number that is no likely time in its own. All values
of a source take part in an expectation-maximisation over the mixture of these
layouts and meanings: they are counted per source and set of fitting readings,
the weights are estimated on these few counts, and each value takes the reading
with the highest posterior. A value whose best posterior stays below
``min_posterior`` is marked ambiguous, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenlog.session import cut, free

# Month names, and zone abbreviations with their offset in minutes.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "COT": -300,
}
# Abbreviations that other zones share, with the other offsets in minutes.
SHARED = {"CST": (480, -300), "IST": (120, 60), "BST": (360,), "EST": (600,), "MST": (480,), "AMT": (240,)}
#: Meaning of a reading -> (how far it is trusted before the mixture is seen, doubt it leaves).
MEANINGS = {
    "stated": (1.0, None), "named": (1.0, None), "unit": (1.0, None), "host": (0.999, None), "not_host": (0.001, "zone"), "abbreviation": (0.95, "shared_zone"), "other_abbreviation": (0.025, "shared_zone"),
    "no_zone": (0.7, "no_zone"), "unknown_zone": (0.6, "unknown_zone"), "elsewhere": (0.3, "no_zone"), "first": (0.6, "fold"), "second": (0.4, "fold"), "after_gap": (0.6, "gap"), "before_gap": (0.4, "gap"),
    "unlikely_unit": (0.6, "unit"), "other_unit": (0.4, "unit"),
}
SUMMER = ("WEST", "BST", "CEST", "EEST", "ACDT", "AEDT", "NZDT", "EDT", "CDT", "MDT", "PDT")

_ZONE = r"\s*(z|[+-]\d{2}:?(?:\d{2})?(?:\s*(?:utc|gmt))?|[a-z]{2,5})?(?:\s*\[([a-z_]+(?:/[a-z_+-]+)*[0-9]*)\])?"
_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2}))?(?:[.,](\d{1,9})\d*)?"
#: layout -> (pattern, group numbers of year, month, day, hour, minute, second, fraction, am/pm, zone, zone name)
LAYOUTS: dict[str, tuple[str, tuple[int, ...]]] = {
    "ymd": (rf"^(\d{{4}})([-/.])(\d{{2}})\2(\d{{2}})[t\s]\s*{_CLOCK}{_ZONE}$", (1, 3, 4, 5, 6, 7, 8, 0, 9, 10)),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}})\d*)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    "clf": (rf"^(\d{{1,2}})/([a-z]{{3}})/(\d{{4}})[:\s]{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 9)),
    "asctime": (rf"^(?:[a-z]{{3,9}},?\s+)?([a-z]{{3}})\s+(\d{{1,2}})\s+{_CLOCK}\s+(?:([a-z]{{3,4}})\s+)?(\d{{4}})$", (8, 1, 2, 3, 4, 5, 6, 0, 7, 0)),
    "rfc": (rf"^(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([a-z]{{3}})[a-z]*[\s-](\d{{4}})\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 9)),
    "twelve": (rf"^([a-z]{{3}})[a-z]*\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,9}})\d*)?\s*([ap]m){_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    "yearless": (rf"^([a-z]{{3}})\s+(\d{{1,2}})\s+{_CLOCK}{_ZONE}$", (0, 1, 2, 3, 4, 5, 6, 0, 7, 8)),
    "dmy": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})[,t\s]\s*{_CLOCK}{_ZONE}$", (4, 3, 1, 5, 6, 7, 8, 0, 9, 10)),
    "mdy": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})[,t\s]\s*{_CLOCK}{_ZONE}$", (4, 1, 3, 5, 6, 7, 8, 0, 9, 10)),
}
#: Layouts whose values begin with a digit, and with a letter.
WITH_DIGIT, WITH_LETTER = ("ymd", "basic", "clf", "rfc", "dmy", "mdy"), ("asctime", "rfc", "twelve", "yearless")
#: Years back that a time without year may lie (29 February needs up to eight).
YEARS_BACK = 8


def micros(ntz: Column) -> Column:
    """Microseconds from 1970 to a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def wall_to_utc(wall: Column, zone: Column, later: Column | None = None) -> Column:
    """Microseconds UTC of a wall time in a named zone.

    A wall time that occurs twice means the first, or the second where
    ``later`` holds; one that the clocks skipped moves on by the gap.
    """
    first = micros(F.convert_timezone(zone, F.lit("UTC"), wall))
    if later is None:
        return first
    hour = F.lit(3_600_000_000)
    again = F.convert_timezone(F.lit("UTC"), zone, from_micros(first + hour))
    return F.when(later & (again == wall), first + hour).otherwise(first)


def known_zone(c: Column) -> Column:
    """The zone name if the time-zone database has it, else NULL."""
    return F.when(F.array_contains(F.array(*(F.lit(z) for z in sorted(available_timezones()))), c), c)


def _parts(text: Column, layout: str) -> Column:
    """layout|year|month|day|hour|minute|second|fraction|half|zone|zone name, or NULL."""
    pattern, at = LAYOUTS[layout]
    groups = "|".join(f"${n}" if n else "" for n in at)
    return F.when(text.rlike(f"(?i){pattern}"), F.concat(F.lit(f"{layout}|"), F.regexp_replace(text, f"(?i){pattern}", groups)))


def _tail(p: Column) -> Column:
    """Split parts to layout, year, '-MM-DD hh:mm:ss.ffffff', zone text and zone name."""
    month = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS) for x in (m, f"{k + 1:02d}"))), F.lower(p[2])), F.lpad(p[2], 2, "0"))
    hour = p[4].try_cast("int")
    hour12 = F.when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(F.lower(p[8]) == "pm", 12).otherwise(0))
    hh = F.when(p[8] == "", F.lpad(p[4], 2, "0")).otherwise(F.lpad(F.coalesce(hour12, F.lit(99)).cast("string"), 2, "0"))
    tail = F.concat(
        F.lit("-"), month, F.lit("-"), F.lpad(p[3], 2, "0"), F.lit(" "), hh, F.lit(":"), p[5], F.lit(":"),
        F.when(p[6] == "", "00").otherwise(p[6]), F.lit("."), F.rpad(p[7], 6, "0"),
    )
    zone = F.regexp_replace(F.upper(p[9]), r"\s*(UTC|GMT|Z)$", "")
    zone = F.when((zone == "") & (p[9] != ""), "UTC").otherwise(zone)
    return F.struct(p[0].alias("layout"), p[1].alias("year"), tail.alias("tail"), zone.alias("zone"), known_zone(F.nullif(p[10], F.lit(""))).alias("named"))


def _offset(r: Column) -> Column:
    """The reading with its numeric offset and its abbreviation's offset in minutes."""
    digits = F.regexp_replace(r["zone"], "[^0-9]", "")
    sign = F.when(r["zone"].startswith("-"), -1).otherwise(1)
    signed = F.when(
        r["zone"].rlike(r"^[+-]\d"),
        sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))),
    ).when(r["zone"] == "UTC", 0)
    table = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)))
    return F.struct(
        r["layout"].alias("layout"), r["year"].alias("year"), r["tail"].alias("tail"), r["named"].alias("named"), r["zone"].alias("zone"),
        signed.alias("offset"), F.element_at(table, r["zone"]).alias("usual"), ((r["zone"] != "") & ~r["zone"].isin(*SUMMER)).alias("winter"),
    )


def _instant(r: Column, wall: Column, host_zone: Column) -> Column:
    minute = F.lit(60_000_000)
    abbreviated = F.when((r["zone"] != "") & F.coalesce(host_zone == "UTC", F.lit(True)), micros(wall) - r["usual"].cast("bigint") * minute)
    return F.coalesce(
        micros(wall) - r["offset"].cast("bigint") * minute,
        abbreviated,
        wall_to_utc(wall, F.coalesce(r["named"], host_zone, F.lit("UTC")), r["winter"]),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


_READING = "array<struct<layout:string,meaning:string,utc_us:bigint>>"


def _reading(layout: Column, meaning: str, us: Column) -> Column:
    return F.struct(layout.alias("layout"), F.lit(meaning).alias("meaning"), us.cast("bigint").alias("utc_us"))


def _in_zone(r: Column, wall: Column, zone: Column, meaning: str) -> Column:
    """Readings of a wall time in a named zone: one, or two where it occurs twice or never."""
    hour = F.lit(3_600_000_000)
    first = micros(F.convert_timezone(zone, F.lit("UTC"), wall))
    back = lambda us: F.convert_timezone(F.lit("UTC"), zone, from_micros(us))
    pair = lambda a, us, b, us2: F.array(_reading(r["layout"], a, us), _reading(r["layout"], b, us2))
    one = lambda us: F.when(back(us) != wall, pair("after_gap", us, "before_gap", us - hour)).when(back(us + hour) == wall, pair("first", us, "second", us + hour)).otherwise(F.array(_reading(r["layout"], meaning, us)))
    return F.flatten(F.transform(F.array(first), one)).cast(_READING)


def _meanings(r: Column, wall: Column, host_zone: Column) -> Column:
    """All readings of one layout's wall time."""
    minute, known = F.lit(60_000_000), F.coalesce(host_zone, F.lit("UTC")) != "UTC"
    at = lambda minutes: micros(wall) - minutes.cast("bigint") * minute
    only = lambda meaning, us: F.array(_reading(r["layout"], meaning, us)).cast(_READING)
    none = F.array(_reading(r["layout"], "elsewhere", F.lit(None))).cast(_READING)
    others = F.coalesce(F.element_at(F.create_map(*(x for k, v in SHARED.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), r["zone"]), F.array().cast("array<int>"))
    shared = F.concat(only("abbreviation", at(r["usual"])), F.transform(others, lambda m: _reading(r["layout"], "other_abbreviation", at(m))).cast(_READING))
    either = lambda h: F.when(micros(wall) != h[0]["utc_us"], F.concat(h, only("not_host", micros(wall)))).otherwise(h)
    in_host = _let(_in_zone(r, wall, host_zone, "host"), either)
    return (
        F.when(r["offset"].isNotNull(), only("stated", at(r["offset"])))
        .when(r["named"].isNotNull(), F.when(r["zone"] != "", only("named", wall_to_utc(wall, r["named"], r["winter"]))).otherwise(_in_zone(r, wall, r["named"], "named")))
        .when((r["zone"] != "") & r["usual"].isNotNull() & known, only("host", wall_to_utc(wall, host_zone, r["winter"])))
        .when((r["zone"] != "") & r["usual"].isNotNull(), F.when(F.size(others) > 0, shared).otherwise(only("stated", at(r["usual"]))))
        .when(r["zone"] != "", F.concat(only("unknown_zone", F.when(known, wall_to_utc(wall, host_zone, r["winter"])).otherwise(micros(wall))), none))
        .when(known, in_host)
        # a host whose clock is known to run in UTC leaves no doubt
        .when(host_zone.isNotNull(), only("host", micros(wall)))
        .otherwise(F.concat(only("no_zone", micros(wall)), none))
    )


def _resolve(r: Column, host_zone: Column, received: Column) -> Column:
    """Readings under one layout; a time without year is the latest such not after the arrival."""
    stamp = lambda y: F.concat(y, r["tail"]).try_cast("timestamp_ntz")
    years = F.transform(F.sequence(F.lit(-1), F.lit(YEARS_BACK)), lambda k: stamp((F.year(received) - k).cast("string")))
    past = F.try_element_at(F.filter(years, lambda w: _instant(r, w, host_zone) <= micros(received)), F.lit(1))
    wall = F.when(r["year"] != "", stamp(F.lpad(r["year"], 4, "0"))).otherwise(past)
    return F.flatten(F.transform(F.filter(F.array(wall), lambda w: w.isNotNull()), lambda w: _meanings(r, w, host_zone)))


def readings(value: Column, host_zone: Column, received: Column) -> Column:
    """array<struct<layout, meaning, utc_us>> of every reading that fits the raw value.

    NULL, blank and unusable values give an empty array, so do zero and
    calendar dates that do not exist. Plain numbers are read by magnitude:
    below 1e11 seconds, 1e14 milliseconds, 1e17 microseconds, else nanoseconds;
    one that then lies outside of mid-1970 to 2100 is also read in the other units
    that bring it there. The reading "elsewhere" has no instant: it stands for
    the zones that a time without a known zone may be in.
    """
    text = plain_text(value)
    return _readings(text, plain_number(text), host_zone, received)


def plain_text(value: Column) -> Column:
    """The value without blanks, quotes and brackets around it; '' for NULL."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(value, r"(?U)^[\s\[\"']+|[\s\"']+$", ""), r"^([^\[]*)\]$", "$1"), F.lit(""))


def plain_number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d{1,20}(\.\d*)?([eE][+-]?\d{1,2})?$"), text.try_cast("decimal(38,9)"))


def _readings(text: Column, number: Column, host_zone: Column, received: Column) -> Column:
    size = F.abs(number)
    units = ("epoch_s", number * 1_000_000), ("epoch_ms", number * 1_000), ("epoch_us", number), ("epoch_ns", number / 1_000)
    place = F.when(size < 100_000_000_000, 0).when(size < 100_000_000_000_000, 1).when(size < 100_000_000_000_000_000, 2).otherwise(3)
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(u).alias("layout"), F.floor(us).try_cast("bigint").alias("us")) for k, (u, us) in enumerate(units)))
    likely = lambda us: us.between(15_552_000_000_000, 4_102_444_800_000_000)
    own = F.filter(every, lambda x: x["k"] == place)
    rest = F.filter(every, lambda x: (x["k"] != place) & likely(x["us"]))
    doubtful = ~F.coalesce(likely(own[0]["us"]), F.lit(False)) & (F.size(rest) > 0)
    as_reading = lambda meaning: lambda x: _reading(x["layout"], meaning, x["us"])
    plain = F.when(doubtful, F.concat(F.transform(own, as_reading("unlikely_unit")), F.transform(rest, as_reading("other_unit")))).otherwise(F.transform(own, as_reading("unit"))).cast(_READING)
    tried = lambda begin: F.array(*(_parts(text, k) for k in LAYOUTS if k in begin))
    fitting = F.filter(F.when(text.rlike(r"^\d"), tried(WITH_DIGIT)).otherwise(tried(WITH_LETTER)), lambda x: x.isNotNull())
    steps = F.transform(fitting, lambda x: F.split(x, r"\|"))
    steps = F.transform(F.transform(steps, _tail), _offset)
    dated = F.flatten(F.transform(steps, lambda r: _resolve(r, host_zone, received)))
    got = F.when(number.isNotNull(), F.when(number != 0, plain).otherwise(F.slice(plain, 1, 0))).otherwise(dated)
    return _let(got, lambda g: F.when(F.exists(g, lambda r: r["utc_us"].isNotNull()), g).otherwise(F.array().cast(_READING)))


def mixture(counts: list[tuple[list[str], list[str], list[float], int]], rounds: int = 30, prior: float = 0.5, trust: float = 10.0) -> dict[str, float]:
    """EM over one source: (layouts, meanings, lags, n) rows to the weights of layouts and of meanings.

    The likelihood of a reading falls with the distance between the instant
    and the arrival, in decades of hours. Layouts start equal, with a small
    prior that keeps every weight positive; meanings have the trust that
    MEANINGS gives them as a prior worth ``trust`` times the values themselves.
    """
    layouts = sorted({x for row in counts for x in row[0]})
    meanings = sorted({x for row in counts for x in row[1]})
    size = float(sum(row[3] for row in counts))
    layout = dict.fromkeys(layouts, 1 / len(layouts))
    belief = {m: MEANINGS[m][0] for m in meanings}
    meaning = dict(belief)
    for _ in range(rounds):
        by_layout, by_meaning, asked = dict.fromkeys(layouts, prior), dict.fromkeys(meanings, 0.0), dict.fromkeys(meanings, 0.0)
        for ls, ms, lags, n in counts:
            mass = [layout[x] * meaning[m] * 10.0 ** -g for x, m, g in zip(ls, ms, lags, strict=True)]
            z = sum(mass) or 1.0
            for x, m, v in zip(ls, ms, mass, strict=True):
                by_layout[x] += n * v / z
                by_meaning[m] += n * v / z
                asked[m] += n
        z = sum(by_layout.values())
        layout = {k: v / z for k, v in by_layout.items()}
        # a meaning competes only where a value may have it
        meaning = {m: (by_meaning[m] + trust * size * belief[m]) / (asked[m] + trust * size) for m in meanings}
    return {**{f"l:{k}": v for k, v in layout.items()}, **{f"m:{k}": v for k, v in meaning.items()}}


def normalise_times(
    df: DataFrame, *, value: str, source: Column, host_zone: Column, received: str, min_posterior: float = 0.8
) -> DataFrame:
    """Add utc_us, layout, meaning, posterior, ambiguous and doubt to every row.

    utc_us is NULL where the value denotes no instant. All values take part in
    the mixture of their source; the readings are made once and kept in the
    shared folder, so pass only the columns that are needed. ambiguous is true
    where the best posterior is below min_posterior, doubt then says why; the
    best reading is still given. An unknown arrival time leaves times without
    year unresolved. Input columns named like results get a trailing underscore.
    """
    results = ("utc_us", "layout", "meaning", "posterior", "ambiguous", "doubt")
    df = free(df, *results, "_source", "_t", "_n", "_r", "_g", "_s", "_w", "_m", "_z", "_b")
    hours = lambda r: F.abs(F.coalesce(micros(F.col(received)) - r["utc_us"], F.lit(0))) / 3.6e9
    lag = lambda r: F.floor(F.log10(hours(r) + 1) * 2) / 2 + F.when(r["utc_us"] > micros(F.col(received)) + 60_000_000, 1.0).otherwise(0.0)
    # both sides of a fold, a gap, a unit or an unknown zone are equally far from the arrival
    tied = F.exists("_r", lambda r: r["meaning"].isin("second", "before_gap", "other_unit"))
    lags = F.when(F.size("_r") > 1, F.transform("_r", lambda r: F.when(tied | r["utc_us"].isNull(), lag(F.col("_r")[0])).otherwise(lag(r)))).otherwise(F.transform("_r", lambda r: F.lit(0.0)))
    # a generator keeps later filters from being moved down and reading the values a second time
    read = df.withColumns({"_source": F.coalesce(source, F.lit("")), "_t": plain_text(F.col(value))}).withColumn("_n", plain_number(F.col("_t")))
    read = read.select("*", F.explode(F.array(_readings(F.col("_t"), F.col("_n"), host_zone, F.col(received)))).alias("_r")).drop("_t", "_n")
    read = cut(read.withColumn("_g", lags))
    labels = lambda k: F.transform("_r", lambda r: r[k])
    counts = (
        read.filter(F.size("_r") > 0)
        .groupBy("_source", labels("layout").alias("l"), labels("meaning").alias("m"), "_g")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("_source")
        .agg(F.collect_list(F.struct("l", "m", F.col("_g").alias("g"), "n")).alias("rows"))
    )

    @F.pandas_udf("map<string,double>")
    def fit(rows: pd.Series) -> pd.Series:
        return pd.Series([mixture([(list(x["l"]), list(x["m"]), list(x["g"]), x["n"]) for x in r]) for r in rows])

    weights = counts.select(F.col("_source").alias("_s"), fit("rows").alias("_w"))
    scored = read.join(weights, F.col("_source") == F.col("_s"), "left")
    weight = lambda k: F.coalesce(F.element_at("_w", k), F.lit(0.0))
    mass = F.zip_with("_r", "_g", lambda r, g: weight(F.concat(F.lit("l:"), r["layout"])) * weight(F.concat(F.lit("m:"), r["meaning"])) * F.pow(F.lit(10.0), -g))
    scored = scored.withColumn("_m", mass)
    best = F.array_max(F.filter(F.zip_with("_m", "_r", lambda m, r: F.struct(m.alias("m"), (-r["utc_us"]).alias("k"), r["layout"].alias("layout"), r["meaning"].alias("meaning"), r["utc_us"].alias("utc_us"))), lambda x: x["utc_us"].isNotNull()))
    scored = scored.withColumns({"_z": F.aggregate("_m", F.lit(0.0), lambda a, x: a + x), "_b": best})
    doubts = F.create_map(*(F.lit(x) for k, (_, d) in MEANINGS.items() if d for x in (k, d)))
    scored = scored.withColumns({"utc_us": F.col("_b.utc_us"), "layout": F.col("_b.layout"), "meaning": F.col("_b.meaning"), "posterior": F.when(F.col("_z") > 0, F.col("_b.m") / F.col("_z"))})
    ambiguous = F.col("utc_us").isNotNull() & (F.coalesce(F.col("posterior"), F.lit(0.0)) < min_posterior)
    scored = scored.withColumn("ambiguous", ambiguous).withColumn("doubt", F.when(F.col("ambiguous"), F.coalesce(F.element_at(doubts, F.col("meaning")), F.lit("day_or_month"))))
    return scored.select(*(F.col(f"`{c}`") for c in (*df.columns, *results)))
