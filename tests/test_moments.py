"""UTC moments: notations, zones and daylight saving, against zoneinfo; zone estimation."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from ledgerloom.operators import moments

US = lambda d: round((d - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def at(*parts, zone="UTC", fold=0):
    return US(datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC))


def read(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, tz_name string, date_order string")
    return [r["utc_micros"] for r in moments.parse_moments(df, spark).orderBy("k").collect()]


B, N, S = "Europe/Berlin", "America/New_York", "Asia/Shanghai"
NOTATIONS = [
    ("2026-05-11T15:16:33+01:00", B, "DMY", at(2026, 5, 11, 14, 16, 33)),
    ("2026-05-06 17:02:38.5+0130", B, "DMY", at(2026, 5, 6, 15, 32, 38, 500000)),
    ("2026-01-27T09:28:37.512399620Z", B, "DMY", at(2026, 1, 27, 9, 28, 37, 512399)),
    ("2025-07-07t14:20:56z", B, "DMY", None),
    ("2025-07-07T14:20:56z", B, "DMY", at(2025, 7, 7, 14, 20, 56)),
    ("20260510T155549Z", B, "DMY", at(2026, 5, 10, 15, 55, 49)),
    ("20260501062317", B, "DMY", at(2026, 5, 1, 6, 23, 17, zone=B)),
    ("20241204", B, "DMY", at(2024, 12, 4, zone=B)),
    ("1770887964", B, "DMY", 1770887964000000),
    ("1770887964.150", B, "DMY", 1770887964150000),
    ("1770887964150", B, "DMY", 1770887964150000),
    ("2024年4月2日 17:05:05", S, "YMD", at(2024, 4, 2, 17, 5, 5, zone=S)),
    ("2024年04月02日", S, "YMD", at(2024, 4, 2, zone=S)),
    ("2025/10/03 2:27", S, "YMD", at(2025, 10, 3, 2, 27, zone=S)),
    ("25-03-12 06:18", S, "YMD", at(2025, 3, 12, 6, 18, zone=S)),
    ("03/04/2025 10:00", B, "DMY", at(2025, 4, 3, 10, zone=B)),
    ("03/04/2025 10:00", N, "MDY", at(2025, 3, 4, 10, zone=N)),
    ("6.5.24 10:57", B, "DMY", at(2024, 5, 6, 10, 57, zone=B)),
    ("27-JAN-2026 09.28.37", B, "DMY", at(2026, 1, 27, 9, 28, 37, zone=B)),
    ("Jul 27, 2025 6:32 PM", N, "MDY", at(2025, 7, 27, 18, 32, zone=N)),
    ("Jul 27, 2025 12:05 AM", N, "MDY", at(2025, 7, 27, 0, 5, zone=N)),
    ("Tue, 26 May 2026 10:14:49 +0100", N, "MDY", at(2026, 5, 26, 9, 14, 49)),
    ("9 Mar 2025 01:52 EST", N, "MDY", at(2025, 3, 9, 6, 52)),
    ("20 Jul 2025 18:05 CST", S, "YMD", at(2025, 7, 20, 10, 5)),
    ("20 Jul 2025 18:05 CST", "America/Chicago", "MDY", at(2025, 7, 21, 0, 5)),
    ("2025-08-09T22:10:52[America/Chicago]", B, "DMY", at(2025, 8, 9, 22, 10, 52, zone="America/Chicago")),
    ("2025-02-23 21:41:33.548 Asia/Kolkata", B, "DMY", at(2025, 2, 23, 21, 41, 33, 548000, zone="Asia/Kolkata")),
    ("2025-10-26 02:30", B, "DMY", at(2025, 10, 26, 2, 30, zone=B)),  # occurs twice: the earlier
    ("30-03-2025 02:18", B, "DMY", at(2025, 3, 30, 3, 18, zone=B)),  # skipped: an hour later
    ("  2025-04-06　10:00 ", B, "DMY", at(2025, 4, 6, 10, zone=B)),
    ("２０２５-04-06 10:00", B, "DMY", at(2025, 4, 6, 10, zone=B)),
    ("20 Jan 2009 10:00 MSK", "Europe/Moscow", "DMY", at(2009, 1, 20, 7)),  # +3 until 2011, +4 until 2014, +3 again
    ("20 Jan 2012 10:00 MSK", "Europe/Moscow", "DMY", at(2012, 1, 20, 6)),
    ("26 Oct 2014 00:59 MSK", "Europe/Moscow", "DMY", at(2014, 10, 25, 20, 59)),
    ("27 Oct 2014 10:00 MSK", "Europe/Moscow", "DMY", at(2014, 10, 27, 7)),
    ("20 Jul 2025 10:00 MSK", "Europe/Moscow", "DMY", at(2025, 7, 20, 7)),
    ("2025-06-01 10:00", None, "DMY", None),
    ("2025-06-01T10:00:00Z", None, None, at(2025, 6, 1, 10)),
]
JUNK = ["2025-13-04T09:00:00Z", "2024-11-31", "2026-02-30 10:15:00", "2025-06-15 27:10:00", "31.04.2025 12:00", "13/13/2025 10:00", "T+1", "N/A", "see slip", "--", "25/2025", "1O/12/2025?", "", " ", None,
        "2025-06-01 10:00 XYZ", "2025-06-01 10:00 Mars/Olympus", "Jul 27, 2025 13:05 PM", "0000-01-01", "123", "x" * 50_000]


def test_notations(spark):
    assert read(spark, [n[:3] for n in NOTATIONS]) == [n[3] for n in NOTATIONS]
    assert read(spark, [(j, B, "DMY") for j in JUNK]) == [None] * len(JUNK)


def test_session_zone_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert read(spark, [n[:3] for n in NOTATIONS[5:15]]) == [n[3] for n in NOTATIONS[5:15]]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_random_local_times(spark):
    rng = random.Random(5)
    rows, expected = [], []
    for _ in range(600):
        zone = rng.choice([B, N, S, "Australia/Sydney", "Europe/London", "America/Sao_Paulo", "Asia/Kolkata"])
        d = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 900))
        if rng.random() < 0.4:  # around changes of the clock
            d = rng.choice([datetime(2025, 3, 30), datetime(2025, 10, 26), datetime(2025, 3, 9), datetime(2025, 11, 2), datetime(2025, 4, 6), datetime(2025, 10, 5)]) + timedelta(minutes=rng.randrange(240))
        rows.append((d.strftime("%Y-%m-%d %H:%M:%S"), zone, "DMY"))
        expected.append(US(d.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)))
    assert read(spark, rows) == expected


@pytest.fixture
def tables(spark):
    rng = random.Random(3)
    zones = {"a": B, "b": N, "c": S, "d": None}
    accounts = spark.createDataFrame([(k, z, "DMY", 1) for k, z in zones.items()], "account_number string, tz_name string, date_order string, text int")
    ledger, fields = [], []
    for k in range(240):
        account = "abcd"[k % 4]
        zone = zones[account] or N
        d = datetime(2025, 1, 1, tzinfo=UTC) + timedelta(minutes=rng.randrange(60 * 24 * 300))
        local, instant = d.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), d.strftime("%Y-%m-%dT%H:%M:%SZ")
        pair = (local, instant) if k % 3 else (instant, local)
        ledger.append((k, k, account, pair[0], d + timedelta(days=9)))
        fields.append((k, k, account, "transaction_time", pair[1], d + timedelta(days=9)))
    fields.append((999, None, "a", "channel", "2025-01-01", None))
    return (
        accounts,
        spark.createDataFrame(ledger, "record_id bigint, candidate_id bigint, account_number string, transaction_date string, ingested_at timestamp"),
        spark.createDataFrame(fields, "field_id bigint, candidate_id bigint, account_number string, field_name string, raw_text string, ingested_at timestamp"),
    )


def test_estimated_zone_is_used_where_none_is_stated(spark, tables):
    accounts, ledger, fields = tables
    at_, bt = moments.account_moments(accounts, ledger, fields)
    found = {r["account_number"]: r["zone_name"] for r in moments.estimate_zones(moments.zone_evidence(at_, bt), moments.candidate_zones(accounts)).collect()}
    assert found == {"a": B, "b": N, "c": S, "d": N}
    done = moments.utc_moments(accounts, ledger, fields).collect()
    assert len(done) == 480
    by = {}
    for r in done:
        by.setdefault(r["row_id"], set()).add(r["utc_micros"])
    assert all(len(v) == 1 for v in by.values())


def test_empty_tables(spark, tables):
    accounts, ledger, fields = (t.limit(0) for t in tables)
    assert moments.utc_moments(accounts, ledger, fields).count() == 0
    assert moments.utc_moments(tables[0], ledger, fields).count() == 0


def test_account_that_is_not_stated_is_estimated(spark, tables):
    accounts, ledger, fields = tables
    lost = moments.utc_moments(accounts.where("account_number in ('a', 'b')"), ledger, fields).collect()
    whole = moments.utc_moments(accounts, ledger, fields)
    stated = whole.join(ledger.select("record_id", "account_number"), whole["row_id"] == ledger["record_id"]).where("account_number <> 'c'").select(*whole.columns)
    assert {tuple(r) for r in stated.collect()} <= {tuple(r) for r in lost}  # 'd' is read in the zone of 'b', 'c' has no candidate
    assert moments.utc_moments(accounts.limit(0), ledger, fields).count() == 240  # zones the text states


def test_zone_from_bounds_alone(spark):
    """Times that were ingested within the hour, or stand between known instants, leave one zone; loose bounds leave none."""
    zones = [B, N, S]
    base = datetime(2025, 5, 1, tzinfo=UTC)
    rows = []
    for account, zone, slack in (("east", S, 0.5), ("west", N, 0.5), ("loose", B, 500)):
        for k in range(20):
            d = base + timedelta(hours=7 * k)
            local = US(d.astimezone(ZoneInfo(zone)).replace(tzinfo=UTC))
            rows.append((account, local, None, US(d - timedelta(hours=slack)), US(d + timedelta(hours=slack))))
    df = spark.createDataFrame(rows, "account_number string, local_micros bigint, instant_micros bigint, low_micros bigint, high_micros bigint")
    assert {r["account_number"]: r["zone_name"] for r in moments.estimate_zones(df, zones).collect()} == {"east": S, "west": N}
    log = []
    for k in range(40):
        d = base + timedelta(minutes=20 * k)
        text = d.strftime("%Y-%m-%dT%H:%M:%SZ") if k % 2 else d.astimezone(ZoneInfo(N)).strftime("%Y-%m-%d %H:%M:%S")
        log.append((k, "log", text, "DMY", None))
    read_log = moments.parse_moments(spark.createDataFrame(log, "k int, account_number string, text string, date_order string, tz_name string"), spark)
    found = moments.estimate_zones(moments.order_evidence(read_log, [], ["k"]), zones).collect()
    assert [(r["zone_name"], r["violations"], r["instants"]) for r in found] == [(N, 0, 0)]
