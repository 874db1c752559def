"""Problem 4: one UTC moment for timestamps of mixed formats, precisions and zones.

Everything is JVM-side: a text is rewritten by one pattern per notation into common parts, the parts
give a wall-clock time, and an explicit offset, a named zone, a zone abbreviation or the source's own
zone turns it into an instant. Sources whose zone is not stated get the zone whose offset history
contradicts the other evidence least (``estimate_zones``).
"""

from __future__ import annotations

import functools
import zoneinfo
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import WHITE, ascii_digits, let, nfkc

_TIME = r"(?:(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?)"
_ZONE = r"\s*(?:(AM|PM|am|pm)\b)?\s*(Z|z|[+-]\d{2}:?\d{2}(?=\[|$)|[A-Z]{2,5}(?=$))?\s*\[?([A-Za-z_]+/[A-Za-z_/+-]+)?\]?$"
_TAIL = rf"(?:[T\s,]*{_TIME})?{_ZONE}"


def _form(y: int, m: int, d: int, tail: int) -> str:
    """Replacement text that brings groups y, m, d and the tail's groups into the common order."""
    return "|".join(f"${n}" for n in (y, m, d, *range(tail, tail + 7)))


#: (pattern, replacement) by notation; the numeric day-month ones are chosen by the source's order.
_YEAR_FIRST = rf"^(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?{_TAIL}"
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:T?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?)?{_ZONE}"
_NUMERIC = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{1,2}})(?=\D|$){_TAIL}"
_DAY_NAME = rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})[\s,-]+(\d{{4}}|\d{{2}})(?=\D|$){_TAIL}"
_NAME_DAY = rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?=\D|$){_TAIL}"
_EPOCH = r"^(?:\d{10}(?:\.\d+)?|\d{13}|\d{16}|\d{19})$"

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _parts(text: Column, date_order: Column) -> Column:
    numeric = (
        F.when(date_order == "DMY", F.regexp_replace(text, _NUMERIC, _form(3, 2, 1, 4)))
        .when(date_order == "MDY", F.regexp_replace(text, _NUMERIC, _form(3, 1, 2, 4)))
        .when(date_order == "YMD", F.when(text.rlike(r"^\d+\D\d+\D\d{4}"), F.regexp_replace(text, _NUMERIC, _form(3, 1, 2, 4))).otherwise(F.regexp_replace(text, _NUMERIC, _form(1, 2, 3, 4))))
    )
    return (
        F.when(text.rlike(_EPOCH), None)
        .when(text.rlike(_YEAR_FIRST), F.regexp_replace(text, _YEAR_FIRST, _form(1, 2, 3, 4)))
        .when(text.rlike(_COMPACT), F.regexp_replace(text, _COMPACT, _form(1, 2, 3, 4)))
        .when(text.rlike(_NUMERIC), numeric)
        .when(text.rlike(_DAY_NAME), F.regexp_replace(text, _DAY_NAME, _form(3, 2, 1, 4)))
        .when(text.rlike(_NAME_DAY), F.regexp_replace(text, _NAME_DAY, _form(3, 1, 2, 4)))
    )


def _iso(p: Column) -> Column:
    """ISO text of the wall-clock time, with Z only so that no session zone is read into it."""
    part = [F.get(p, F.lit(k)) for k in range(10)]
    year = F.when(F.length(part[0]) == 4, part[0]).otherwise(F.concat(F.lit("20"), F.lpad(part[0], 2, "0")))
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(part[1], 1, 3)))
    month = F.when(part[1].rlike(r"^\d+$"), part[1]).when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))
    clock = F.upper(part[7])
    hour = F.when(clock == "", part[3]).when(part[3].try_cast("int").between(1, 12), ((part[3].try_cast("int") % 12) + F.when(clock == "PM", 12).otherwise(0)).cast("string")).otherwise("no hour")
    two = lambda c: F.lpad(F.coalesce(F.nullif(c, F.lit("")), F.lit("0")), 2, "0")
    time = F.concat(two(hour), F.lit(":"), two(part[4]), F.lit(":"), two(part[5]), F.lit("."), F.rpad(F.substring(part[6], 1, 6), 6, "0"), F.lit("Z"))
    return F.when(year != "0000", F.concat(year, F.lit("-"), two(month), F.lit("-"), two(part[2]), F.lit("T"), time))


def _epoch_micros(text: Column) -> Column:
    whole, fraction = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    whole = whole.try_cast("bigint")
    return (
        F.when(F.length(text) == 13, whole * 1000)
        .when(F.length(text) == 16, whole)
        .when(F.length(text) == 19, F.floor(whole / 1000))
        .when(text.rlike(r"^\d{10}(\.\d+)?$"), whole * 1_000_000 + F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("bigint"))
    )


#: Offsets are looked up so far apart; where an abbreviation's offset changed in between, the moment is found to the second.
PROBE = 28 * 86_400
_FIRST, _LAST = datetime(1970, 1, 1, tzinfo=UTC), datetime(2038, 1, 1, tzinfo=UTC)
_FOREVER = (1 << 63) - 1


@functools.cache
def zone_abbreviations() -> list[tuple[str, dict[str, list[tuple[int, int]]]]]:
    """(zone, {abbreviation: [(until, seconds east of UTC), ...]}) of every IANA zone since 1970.

    An abbreviation mostly stands for one offset. Where a zone gave it another one, as Moscow's in 2011 and
    2014, each holds until the zone left it, in microseconds of the wall clock; the last one holds for ever.
    """
    probes = range(int(_FIRST.timestamp()), int(_LAST.timestamp()), PROBE)
    out = []
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)

        def at(second: int, zone: zoneinfo.ZoneInfo = zone) -> tuple[str, int]:
            local = datetime.fromtimestamp(second, zone)
            return local.tzname() or "", int(local.utcoffset().total_seconds())

        offsets: dict[str, list[tuple[int, int]]] = {}  # (last probe with it, offset)
        for second in probes:
            abbreviation, offset = at(second)
            if abbreviation.isalpha():
                seen = offsets.setdefault(abbreviation, [])
                if seen and seen[-1][1] == offset:
                    seen[-1] = (second, offset)
                else:
                    seen.append((second, offset))
        found = {}
        for abbreviation, seen in offsets.items():
            spans = []
            for last, offset in seen[:-1]:
                low, high = last, last + PROBE
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if at(middle) == (abbreviation, offset) else (low, middle)
                spans.append(((high + offset) * 1_000_000, offset))
            found[abbreviation] = [*spans, (_FOREVER, seen[-1][1])]
        out.append((name, found))
    return out


def zone_table(spark: SparkSession) -> DataFrame:
    """zone_name, abbreviations MAP<STRING, ARRAY<STRUCT<until, seconds>>> of the zones that both the zone database and the JVM know: some 600 rows, whatever the data."""
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    rows = [(name, found) for name, found in zone_abbreviations() if name in known]
    return spark.createDataFrame(rows, "zone_name string, abbreviations map<string,array<struct<until:bigint,seconds:int>>>")


def parse_moments(values: DataFrame, spark: SparkSession, text: str = "text", zone: str = "tz_name", order: str = "date_order") -> DataFrame:
    """Add to each row: local_micros (wall clock as if it were UTC), has_zone (the text itself says its zone) and utc_micros.

    values holds a text, the source's IANA zone and its numeric date order; other columns pass through.
    Null, blank, impossible or meaningless text gives nulls. A text without zone whose source has none
    has local_micros but no utc_micros. A time that occurs twice is the earlier one, a skipped one moves
    forward by the gap; digits beyond microseconds are cut, missing ones are zero; a date alone is the
    start of its day. An abbreviation unknown to the source's zone, and an unknown zone name, are unreadable.
    """
    zones = zone_table(spark)
    clean = F.regexp_replace(ascii_digits(nfkc(F.col(text))), f"^{WHITE}+|{WHITE}+$", "")

    def read(t: Column) -> Column:
        return let(
            F.split(_parts(t, F.col(order)), r"\|"),
            lambda p: F.struct(
                t.alias("t"),
                _iso(p).try_cast("timestamp").alias("at"),
                F.get(p, F.lit(8)).alias("zone"),
                F.nullif(F.get(p, F.lit(9)), F.lit("")).alias("region"),
            ),
        )

    df = values.withColumn("_m", let(clean, read))
    df = df.select("*", F.col("_m.t").alias("_t"), F.col("_m.at").alias("_at"), F.col("_m.zone").alias("_zone"), F.col("_m.region").alias("_region"))

    own = zones.select(F.col("zone_name").alias("_own"), "abbreviations")
    named = zones.select(F.col("zone_name").alias("_named"))
    df = df.join(F.broadcast(own), F.col(zone) == F.col("_own"), "left")  # about 600 rows, fixed by the zone database
    df = df.join(F.broadcast(named), F.col("_region") == F.col("_named"), "left")

    sign = F.when(F.startswith("_zone", F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace("_zone", r"\D", "")
    offset = F.when(F.upper("_zone").isin("Z", "UTC", "GMT"), F.lit(0)).when(
        F.col("_zone").rlike(r"^[+-]\d{2}:?\d{2}$"),
        sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60),
    ).when(F.col("_zone") != "", F.get(F.filter(F.try_element_at("abbreviations", F.col("_zone")), lambda s: F.unix_micros("_at") < s["until"]), F.lit(0))["seconds"])
    local = F.unix_micros("_at")
    utc = (
        F.when(F.col("_zone") != "", F.when(F.abs(offset) <= 18 * 3600, local - offset.cast("bigint") * 1_000_000))
        .when(F.col("_region").isNotNull(), F.when(F.col("_named").isNotNull(), F.unix_micros(F.to_utc_timestamp("_at", F.coalesce("_named", F.lit("UTC"))))))
        .when(F.col("_own").isNotNull(), F.unix_micros(F.to_utc_timestamp("_at", F.coalesce("_own", F.lit("UTC")))))
    )
    epoch = F.col("_t").rlike(_EPOCH)
    return df.select(
        *[values[c] for c in values.columns],
        local.alias("local_micros"),
        (epoch | (F.col("_zone") != "") | F.col("_region").isNotNull()).alias("has_zone"),
        F.when(epoch, _epoch_micros(F.col("_t"))).otherwise(utc).alias("utc_micros"),
    )


def zone_evidence(left: DataFrame, right: DataFrame, on: str = "candidate_id") -> DataFrame:
    """Wall-clock times without zone beside what is known of their instants: (account_number, local_micros, instant_micros, low_micros, high_micros).

    Both inputs come from parse_moments and hold account_number, the key and ingested_at. The record's
    time in the other table is the instant where that one states its zone, else there is none; nothing can
    have happened after it was ingested. There is no lower bound.
    """

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        said = b.where("has_zone and utc_micros is not null").groupBy(on).agg(F.min("utc_micros").alias("instant_micros"))
        bare = a.where("not has_zone and local_micros is not null")
        bounds = [F.lit(None).cast("bigint").alias("low_micros"), F.unix_micros("ingested_at").alias("high_micros")]
        return bare.join(said, on, "left").select("account_number", "local_micros", "instant_micros", *bounds)

    return pairs(left, right).unionByName(pairs(right, left))


def order_evidence(moments: DataFrame, sequence: list[str], order: list[str]) -> DataFrame:
    """zone_evidence from sequence order: a time without zone lies between the nearest known instants before and after it in its sequence.

    moments come from parse_moments with account_number and the named columns. For sources whose rows are
    written in the order of their times, as logs are.
    """
    known = F.when(F.col("has_zone"), F.col("utc_micros"))
    w = Window.partitionBy("account_number", *sequence).orderBy(*order)
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    bare = moments.select("*", before.alias("low_micros"), after.alias("high_micros")).where("not has_zone and local_micros is not null")
    return bare.select("account_number", "local_micros", F.lit(None).cast("bigint").alias("instant_micros"), "low_micros", "high_micros")


def estimate_zones(evidence: DataFrame, candidates: list[str], tolerance_s: int = 86_400) -> DataFrame:
    """The zone of each source whose offset history violates its evidence least.

    A candidate history is violated by a row where the wall-clock time, read in that zone, lies outside of
    the row's bounds, or differs from the known instant of its record by a minute or more; the total misfit
    to instants breaks ties. Rows further off than ``tolerance_s`` are another event or a wrong date and
    weigh the same for every zone. Result: account_number, zone_name, violations, evidence, instants; the
    smallest zone name wins a full tie. A source without known instants has a row only if its bounds leave
    one candidate alone with the least violations, and one without evidence has none.
    """
    zones = F.explode(F.array(*[F.lit(z) for z in candidates]).cast("array<string>")).alias("zone_name")
    # Equal offsets are one piece of evidence with a weight: the wall clock cut to hours decides the offset in force.
    hour = lambda c: F.floor(F.col(c) / 3_600_000_000)
    rows = evidence.withColumn("hour", hour("local_micros")).withColumn("shift", F.round((F.col("local_micros") - F.col("instant_micros")) / 60_000_000))
    rows = rows.withColumns({"low_hour": hour("low_micros"), "high_hour": hour("high_micros")})
    rows = rows.groupBy("account_number", "hour", "shift", "low_hour", "high_hour").agg(F.count(F.lit(1)).alias("n"))
    at = F.timestamp_seconds(F.col("hour") * 3600)
    rows = rows.select("*", zones).withColumn("utc", F.unix_micros(F.to_utc_timestamp(at, F.col("zone_name"))))
    off = (F.unix_micros(at) - F.col("utc")) / 60_000_000 - F.col("shift")
    utc_hour = F.floor(F.col("utc") / 3_600_000_000)
    outside = F.coalesce(utc_hour > F.col("high_hour"), F.lit(False)) | F.coalesce(utc_hour < F.col("low_hour"), F.lit(False))
    misfit = F.coalesce(F.least(F.abs(off) * 60, F.lit(float(tolerance_s))), F.lit(0.0))
    bad = F.when(F.coalesce(F.abs(off) >= 1, F.lit(False)) | outside, F.col("n")).otherwise(0)
    scored = rows.groupBy("account_number", "zone_name").agg(
        F.sum(bad).alias("violations"), F.sum(misfit * F.col("n")).alias("misfit"), F.sum("n").alias("evidence"), F.sum(F.when(F.col("shift").isNotNull(), F.col("n")).otherwise(0)).alias("instants")
    )
    # How many zones are as good as the best one: an aggregate of all scores of a source, one for each candidate.
    scores = F.collect_list("violations")
    best = scored.groupBy("account_number").agg(F.min(F.struct("violations", "misfit", "zone_name", "evidence", "instants")).alias("b"), scores.alias("all"))
    alone = F.size(F.filter("all", lambda v: v == F.col("b.violations"))) == 1
    return best.where((F.col("b.instants") > 0) | alone).select("account_number", "b.zone_name", "b.violations", "b.evidence", "b.instants")


def candidate_zones(accounts: DataFrame) -> list[str]:
    """The distinct stated zones: at most the some 600 of the zone database."""
    return sorted(r[0] for r in accounts.join(zone_table(accounts.sparkSession), accounts["tz_name"] == F.col("zone_name"), "left_semi").select("tz_name").distinct().collect())


def account_moments(accounts: DataFrame, ledger: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parse_moments over the ledger's transaction dates and the transaction_time fields, each with the zone its account states."""
    spark = accounts.sparkSession
    # An account stated twice counts by its smallest statement, so the result does not depend on row order.
    source = accounts.groupBy("account_number").agg(F.min(F.struct("tz_name", "date_order")).alias("s")).select("account_number", "s.*")
    a = ledger.where("transaction_date is not null").select("account_number", "candidate_id", F.col("record_id").alias("row_id"), F.col("transaction_date").alias("text"), "ingested_at")
    b = fields.where("field_name = 'transaction_time' and raw_text is not null").select("account_number", "candidate_id", F.col("field_id").alias("row_id"), F.col("raw_text").alias("text"), "ingested_at")
    return tuple(parse_moments(x.join(source, "account_number", "left"), spark) for x in (a, b))


def utc_moments(accounts: DataFrame, ledger: DataFrame, fields: DataFrame) -> DataFrame:
    """One UTC moment per readable value: (source_table, row_id, utc_micros).

    Accounts that state no zone known to the zone database, and those of the data that are not stated at
    all, get the estimated zone, from evidence over all rows; where all state one, as their statement is
    authoritative, there is nothing to estimate. Which of both holds is asked while the plan is built. An
    account without estimate has moments only where the text states its zone.
    """
    spark = accounts.sparkSession
    known = zone_table(spark).select(F.col("zone_name").alias("tz_name"))
    seen = ledger.select("account_number").union(fields.select("account_number")).where("account_number is not null").distinct()
    if not seen.join(accounts.join(known, "tz_name", "left_semi"), "account_number", "left_anti").isEmpty():
        lost = seen.join(accounts, "account_number", "left_anti")
        accounts = accounts.select("account_number", "tz_name", "date_order").unionByName(lost, allowMissingColumns=True)
        at, bt = account_moments(accounts, ledger, fields)
        guess = estimate_zones(zone_evidence(at, bt), candidate_zones(accounts)).select("account_number", F.col("zone_name").alias("guess"))
        stated = accounts.join(known.withColumn("ok", F.lit(True)), "tz_name", "left").join(guess, "account_number", "left")
        accounts = stated.withColumn("tz_name", F.when(F.col("ok"), F.col("tz_name")).otherwise(F.col("guess")))
    at, bt = account_moments(accounts, ledger, fields)
    done = at.select(F.lit("ledger_transactions").alias("source_table"), "row_id", "utc_micros").unionByName(bt.select(F.lit("field_values").alias("source_table"), "row_id", "utc_micros"))
    return done.where("utc_micros is not null")
