from pyspark.sql import functions as F

from quillstone.functions import records
from quillstone.operators import mining


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_names_and_texts(spark):
    lit = F.lit
    assert one(spark, records.source_name(lit("claude"), lit(True))) == "claude_transcript_backfill"
    assert one(spark, records.source_name(lit("other"), lit(False))) == "codex_transcript_scan"
    assert one(spark, records.scorer_source(lit("hook"), lit("/x/Codex/a"))) == "codex"
    assert one(spark, records.scorer_source(lit("hook"), lit(None).cast("string"))) == "claude"
    assert one(spark, records.scorer_source(lit(None).cast("string"), lit(""))) == "unknown"
    assert one(spark, records.mentions(lit("HTTP 401 denied"), ["401", "quota"])) and not one(spark, records.mentions(lit(None).cast("string"), ["x"]))
    assert not one(spark, records.in_categories(F.array(lit("a")), ["b"]))
    assert not one(spark, records.short_unquoted(lit("a\n> b"), mining.QUOTED)) and one(spark, records.short_unquoted(lit("a b"), mining.QUOTED))
    assert [one(spark, records.bar(lit(v), lit(10), 5)) for v in (0, 0.1, 10)] == ["", "#", "#####"]
    assert one(spark, records.prompt_view(["id"])) == '{"id":0}'


def test_minutes_since_previous(spark):
    rows = spark.createDataFrame([(1, "s", "2024-01-01 00:00:00"), (2, "s", "2024-01-01 00:02:30"), (3, "t", "2024-01-01 00:00:00")], "event_id int, session string, ts string")
    assert [r.minutes for r in mining.minutes_since_previous(rows, "session", "ts").orderBy("event_id").collect()] == [None, 2.5, None]


def test_claim_within_the_cooldown_goes_back(spark):
    queue = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 3, False)], "k string, seq int, keep boolean")
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    for last, ran in (("2024-01-01 00:00:30", 0), ("2024-01-01 00:00:00", 1)):
        run, back = mining.claimed(queue, "k", "seq", F.col("keep"), F.lit(last).cast("timestamp"), now)
        assert (run.count(), back.count()) == (ran, 1 - ran)
