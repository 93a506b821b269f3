"""Mixed timestamp notations, precisions and zones brought to one instant in UTC.

Everything is an expression over columns: a notation is recognised by a pattern and rewritten to one list of
fields, the fields become a local clock reading, and a zone turns that into an instant. Zones missing from a
value are estimated per source by aligning its local readings with the ingestion times: of the candidate zones
(whole offset histories, daylight saving included) the one with the fewest and smallest violations is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import bounded_broadcast, materialise, spread

#: Minutes east of UTC of zone abbreviations that name one offset.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NPT": 345, "ICT": 420, "WIB": 420, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Zones tried for a source whose clock is not known, besides those the table of sources names.
CANDIDATES = ("UTC", "Asia/Ho_Chi_Minh", "Asia/Tokyo", "Asia/Kathmandu", "Australia/Sydney", "Europe/Berlin", "Europe/London", "America/New_York", "America/Los_Angeles")

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AMPM = r"(?:\s*([AaPp][Mm]|SA|CH))?"
_ZONE = r"(?:\s*\(?((?:UTC|GMT)?\s?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,4})\)?)?"
_REGION = r"(?:\[([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)*)\])?"
_MONTH = r"([A-Za-z]{3})[a-z]*\.?"
#: (pattern, fields) with fields = order|year|p|q|hour|minute|second|fraction|am-pm|zone|region. Order ymd: p, q are month, day;
#: dmy: day, month; src: as the source writes dates.
NOTATIONS = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:T|\s+){_CLOCK}{_AMPM}{_ZONE}{_REGION}$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_AMPM}{_ZONE}{_REGION}$", "src|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_CLOCK}{_AMPM}{_ZONE},?\s+(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})$", "src|$9|$7|$8|$1|$2|$3|$4|$5|$6|"),
    (rf"^(?i:lúc)\s+{_CLOCK}{_AMPM}{_ZONE},?\s+(?:ngày\s+)?(\d{{1,2}})\s+(?i:tháng)\s+(\d{{1,2}}),?\s+(\d{{4}})$", "dmy|$9|$7|$8|$1|$2|$3|$4|$5|$6|"),
    (rf"^(?i:ngày\s+)?(\d{{1,2}})\s+(?i:tháng)\s+(\d{{1,2}}),?\s+(\d{{4}})\s+(?i:lúc)\s+{_CLOCK}{_AMPM}{_ZONE}$", "dmy|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"^(?i:thứ\s+\S+|chủ\s+nhật),\s*(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}$", "dmy|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+{_MONTH},?\s+(\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}$", "dmy|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}$", "dmy|$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
)
#: Hours that a delay counts at most, and what a reading later than its ingestion counts.
MOST_HOURS = 24.0
#: A zone other than the declared one must lower the cost by so many hours a reading, and so many in all.
PRIOR_EACH, PRIOR_ALL = 0.25, 48.0
#: Without a declared zone, the readings that an estimate needs, and the hours that they may be late on average.
LEAST_READINGS, MOST_MEAN = 20, 12.0


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC that the text of a zone says, else null."""
    name = F.regexp_extract(zone, r"^([A-Za-z]+)$", 1)
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    r = r"^(?:UTC|GMT)?\s?([+-])(\d{1,2}):?(\d{2})?$"
    hours, minutes = _int(F.regexp_extract(zone, r, 2)), F.coalesce(_int(F.regexp_extract(zone, r, 3)), F.lit(0))
    sign = F.when(F.regexp_extract(zone, r, 1) == "-", -1).otherwise(1)
    return F.when(name != "", F.try_element_at(table, name)).when((hours * 60 + minutes <= 14 * 60) & (minutes < 60), sign * (hours * 60 + minutes))


#: How a value of each notation begins; no value of another notation does.
BEGINNINGS = (
    r"^\d{4}[-/]", r"^\d{1,2}[-/.]", r"^\d{1,2}:", r"^(?i:lúc)\s", r"^(?i:ngày\s+)?\d{1,2}\s+(?i:tháng)", r"^(?i:thứ|chủ)\s",
    r"^(?:[A-Za-z]{3,9},?\s+)?\d{1,2}\s+[A-Za-z]", r"^[A-Za-z]{3}",
)


def cleaned(value: Column) -> Column:
    """A value with single blanks."""
    return F.trim(F.regexp_replace(value, r"[\s\p{Z}]+", " "))


def rewritten(x: Column) -> Column:
    """The fields of a cleaned value in one string, divided by bars; any other text if no notation fits."""
    out = F.when(F.lit(False), x)
    for begins, (pattern, fields) in zip(BEGINNINGS, NOTATIONS):  # the beginning tells which one pattern is worth a try
        out = out.when(x.rlike(begins), F.regexp_replace(x, pattern, fields))
    return out


def _epoch_us(x: Column) -> Column:
    n = x.try_cast("bigint")
    size = F.length(x)
    whole = (
        F.when(size == 10, n * 1_000_000).when(size == 13, n * 1_000).when(size == 16, n).when(size == 19, F.floor(n / F.lit(1000).cast("decimal(20,0)")).cast("bigint"))
    )
    parts = r"^(\d{10})\.(\d{1,9})$"
    frac = _int(F.substring(F.rpad(F.regexp_extract(x, parts, 2), 6, "0"), 1, 6))
    return F.when(x.rlike(r"^\d+$"), whole).when(x.rlike(parts), F.regexp_extract(x, parts, 1).try_cast("bigint") * 1_000_000 + frac)


def readings(df: DataFrame, value: str, date_order: str) -> DataFrame:
    """Adds ``__epoch_us``, ``__local_us`` (the clock reading as if it were UTC), ``__offset_min`` and ``__region`` of a cleaned value whose fields are in ``__f``."""
    f = F.col("__f")
    hour, ampm = _int(f[4]), F.upper(f[8])
    hour = F.when(ampm == "", hour).when(hour.between(1, 12), hour % 12 + F.when(ampm.isin("PM", "CH"), 12).otherwise(0))
    year = F.when(F.length(f[1]) == 2, 2000 + _int(f[1])).otherwise(_int(f[1]))
    number = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    p, q = _int(f[2]), F.coalesce(_int(f[3]), F.try_element_at(number, F.lower(f[3])))
    day_first = (f[0] == "dmy") | ((f[0] == "src") & (F.col(date_order) == "dmy"))
    month_first = (f[0] == "ymd") | ((f[0] == "src") & (F.col(date_order) == "mdy"))
    month, day = F.when(day_first, q).when(month_first, p), F.when(day_first, p).when(month_first, q)
    df = df.withColumns({"__epoch_us": _epoch_us(F.col(value)), "__y": year, "__mo": month, "__d": day, "__h": hour, "__mi": _int(f[5]), "__s": F.coalesce(_int(f[6]), F.lit(0)), "__us": F.coalesce(_int(F.substring(F.rpad(f[7], 6, "0"), 1, 6)), F.lit(0)), "__offset_min": _zone_minutes(f[9]), "__zone": f[9], "__region": F.when(f[10] != "", f[10])})
    whole = F.unix_micros(F.expr("try_make_timestamp(__y, __mo, __d, __h, __mi, CAST(__s AS DECIMAL(8,6)), 'UTC')"))
    df = df.withColumn("__local_us", F.when(F.col("__s") < 60, whole + F.col("__us")))
    # a zone that is written but not understood leaves no instant
    bad = (F.col("__zone") != "") & F.col("__offset_min").isNull()
    return df.withColumn("__local_us", F.when(~F.coalesce(bad, F.lit(False)), F.col("__local_us"))).drop("__f", "__y", "__mo", "__d", "__h", "__mi", "__s", "__us", "__zone")


def to_instant(local_us: Column, zone: Column) -> Column:
    """Microseconds UTC of a clock reading in a zone, or null if the reading fits two instants or none."""
    at = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))
    back = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) == local_us
    shifts = F.array(*[F.lit(m * 60_000_000) for m in (30, -30, 60, -60, 120, -120)])
    return F.when(back(at) & ~F.exists(shifts, lambda m: back(at + m)), at)


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names that the JVM knows."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z or z == "UTC")


def estimate_zones(df: DataFrame, sites: DataFrame, source: str, local_us: str, ingested_us: str, candidates: Sequence[str] = CANDIDATES) -> DataFrame:
    """``source, declared_tz, tz, readings, declared_cost, cost``: the zone of each source's clock.

    ``df`` has the readings without zone, ``sites`` the columns ``source`` and ``tz`` (declared, may be null).
    The cost of a zone is the sum over readings of the hours from reading to ingestion, at most ``MOST_HOURS``,
    which a reading later than its ingestion counts too. The declared zone stays unless another one is better by
    ``PRIOR_EACH`` hours a reading and ``PRIOR_ALL`` in all; equal zones are taken by name. A source without
    readings keeps the declared zone; one without a declared zone gets none from few or very late readings. Rows are multiplied by the fixed list of candidates and summed before the
    shuffle, so a hot source costs one row a task.
    """
    spark = df.sparkSession
    known = known_zones(spark)
    named = sites.select("tz").where(F.col("tz").isin(known)).distinct().collect()  # at most the zones there are
    zones = sorted({*candidates, *(r[0] for r in named)} & set(known))
    one = df.where(F.col(source).isNotNull() & F.col(local_us).isNotNull() & F.col(ingested_us).isNotNull())
    each = one.select(F.col(source).alias("source"), F.col(local_us).alias("l"), F.col(ingested_us).alias("i"), F.explode(F.array(*map(F.lit, zones))).alias("z"))
    lag = (F.col("i") - F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("l"), F.col("z")))) / 3.6e9
    cost = each.groupBy("source", "z").agg(F.count("*").alias("n"), F.sum(F.when(lag < 0, MOST_HOURS).otherwise(F.least(lag, F.lit(MOST_HOURS)))).alias("c"))
    cost = cost.join(sites.select("source", F.col("tz").alias("declared")), "source", "left")
    prior = F.when(F.col("declared").isNull() | (F.col("z") == F.col("declared")), 0.0).otherwise(F.col("n") * PRIOR_EACH + PRIOR_ALL)
    best = cost.groupBy("source").agg(F.min_by("z", F.struct(F.round(F.col("c") + prior, 6), "z")).alias("best"), F.min_by("c", F.struct(F.round(F.col("c") + prior, 6), "z")).alias("cost"), F.max("n").alias("readings"), F.max(F.when(F.col("z") == F.col("declared"), F.col("c"))).alias("declared_cost"))
    declared = sites.select("source", F.col("tz").alias("declared_tz"))
    return declared.join(best, "source", "full").select("source", "declared_tz", F.coalesce(F.when(F.col("declared_tz").isNotNull() | ((F.col("readings") >= LEAST_READINGS) & (F.col("cost") <= MOST_MEAN * F.col("readings"))), F.col("best")), F.col("declared_tz")).alias("tz"), F.coalesce("readings", F.lit(0)).alias("readings"), "declared_cost", "cost")


def normalise_timestamps(df: DataFrame, sites: DataFrame, id_col: str, fields: Sequence[str], source: str = "source", ingested: str = "ingested_at", max_sites: int = 100_000) -> DataFrame:
    """``id_col, field, value, utc_us`` for each row and each of ``fields``; ``utc_us`` is null where the value names no single instant.

    ``sites`` has ``source, tz, date_order``. Defined cases: a null, empty or unknown text gives null, so does a
    date without time, a time without date and a relative phrase; a value with a zone, an offset or an epoch needs
    no source; a value without one is the clock of its source, and null without a source; a reading that the zone
    has twice or never gives null; digits past microseconds are dropped; repeated rows stay repeated; other
    columns are not looked at. A figures-only date without a source has no order and gives null.
    """
    spark = df.sparkSession
    sites = sites.select(F.col("source").cast("string").alias("__s_source"), "tz", "date_order").dropDuplicates(["__s_source"]).where("__s_source is not null")
    each = spread(df.select(id_col, *dict.fromkeys([*fields, source, ingested]))).select(
        F.col(id_col), F.col(source).cast("string").alias("__source"), F.unix_micros(F.col(ingested).cast("timestamp_ntz").cast("timestamp")).alias("__ingested_us"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("__x"),
    )
    each = each.select(id_col, "__source", "__ingested_us", "__x.field", "__x.value", cleaned(F.col("__x.value")).alias("__t")).withColumn("__r", rewritten(F.col("__t")))
    each = each.withColumn("__f", F.when(F.col("__r").rlike(r"^(?:ymd|dmy|src)\|"), F.split("__r", r"\|", -1))).drop("__r")
    order = bounded_broadcast(sites.select("__s_source", "date_order"), max_sites)
    long = each.join(order, F.col("__source") == F.col("__s_source"), "left").drop("__s_source")
    long = materialise(readings(long, "__t", "date_order").drop("__t", "date_order"))  # every value is parsed once
    plain = long.where(F.col("__offset_min").isNull() & F.col("__region").isNull())
    zones = estimate_zones(plain, sites.select(F.col("__s_source").alias("source"), "tz"), "__source", "__local_us", "__ingested_us")
    # written once: counting and joining it would estimate it twice
    zones = bounded_broadcast(materialise(zones.select(F.col("source").alias("__s_source"), F.col("tz").alias("__tz"))), max_sites)
    long = long.join(zones, F.col("__source") == F.col("__s_source"), "left")
    zone = F.when(F.col("__region").isNotNull(), F.when(F.col("__region").isin(known_zones(spark)), F.col("__region"))).otherwise(F.col("__tz"))
    utc = F.coalesce(F.col("__epoch_us"), F.when(F.col("__offset_min").isNotNull(), F.col("__local_us") - F.col("__offset_min") * F.lit(60_000_000).cast("bigint")).otherwise(to_instant(F.col("__local_us"), zone)))
    return long.select(id_col, "field", "value", utc.cast("bigint").alias("utc_us"))
