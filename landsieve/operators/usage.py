"""Cost of model usage and spending caps (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsieve import constants as K

TEXT_USAGE = "struct<input_tokens:string,request_tokens:string,output_tokens:string,response_tokens:string,cache_read_tokens:string>"
VOICE_USAGE = (
    "struct<input_tokens:string,output_tokens:string,"
    "input_token_details:struct<audio_tokens:string,text_tokens:string,cached_tokens:string,cached_tokens_details:struct<audio_tokens:string>>,"
    "output_token_details:struct<audio_tokens:string,text_tokens:string>>"
)


#: Money is kept in whole billionths of a dollar, so that sums don't depend on their order.
NANO = 1_000_000_000


def nano_rate(usd_per_million: float) -> Column:
    """Price of one token in nano-dollars; the published prices are whole numbers of these."""
    nano = round(usd_per_million * 1000)
    if abs(nano - usd_per_million * 1000) > 1e-9:
        raise ValueError(f"{usd_per_million} USD per million is no whole number of nano-dollars per token")
    return F.lit(nano).cast("long")


def count_of(c: Column) -> Column:
    """Token count: whole, not negative, anything unreadable is zero."""
    return F.greatest(F.coalesce(F.floor(c.try_cast("double")).cast("long"), F.lit(0)), F.lit(0))


def text_rate(model: Column, which: int) -> Column:
    """Rate (nano-dollars a token) of the longest known name contained in the model id."""
    low, out = F.lower(F.coalesce(model, F.lit(""))), None
    for name in sorted(K.TEXT_RATES, key=len, reverse=True):
        hit, rate = low.contains(name), nano_rate(K.TEXT_RATES[name][which])
        out = F.when(hit, rate) if out is None else out.when(hit, rate)
    return out.otherwise(nano_rate(K.DEFAULT_TEXT_RATE[which]))


def text_cost(usage: Column, model: Column) -> Column:
    """Nano-dollars of one text turn; a missing usage costs nothing."""
    def either(a, b):
        first = usage[a].try_cast("double")
        return F.when(F.coalesce(first, F.lit(0.0)) != 0, count_of(usage[a])).otherwise(count_of(usage[b]))

    fresh_total, out = either("input_tokens", "request_tokens"), either("output_tokens", "response_tokens")
    cached = F.least(count_of(usage["cache_read_tokens"]), fresh_total)
    nano = (fresh_total - cached) * text_rate(model, 0) + cached * text_rate(model, 2) + out * text_rate(model, 1)
    return F.when(usage.isNull(), F.lit(0).cast("long")).otherwise(nano)


def voice_cost(usage: Column) -> Column:
    """Nano-dollars of one voice turn. A side without a modality split counts as audio."""
    i, o = usage["input_token_details"], usage["output_token_details"]
    cached = F.when(i["cached_tokens_details"].isNotNull(), count_of(i["cached_tokens_details"]["audio_tokens"])).otherwise(
        count_of(i["cached_tokens"]))
    in_text, out_text = count_of(i["text_tokens"]), count_of(o["text_tokens"])
    in_audio = F.when((count_of(i["audio_tokens"]) == 0) & (in_text == 0), count_of(usage["input_tokens"])).otherwise(count_of(i["audio_tokens"]))
    out_audio = F.when((count_of(o["audio_tokens"]) == 0) & (out_text == 0), count_of(usage["output_tokens"])).otherwise(count_of(o["audio_tokens"]))
    fresh = F.greatest(in_audio - cached, F.lit(0))
    nano = (
        fresh * nano_rate(K.VOICE_AUDIO_IN + K.TRANSCRIBE_AUDIO_IN) + cached * nano_rate(K.VOICE_AUDIO_CACHED)
        + in_text * nano_rate(K.VOICE_TEXT_IN) + out_audio * nano_rate(K.VOICE_AUDIO_OUT)
        + out_text * nano_rate(K.VOICE_TEXT_OUT))
    return F.when(usage.isNull(), F.lit(0).cast("long")).otherwise(nano)


def price_events(events: DataFrame) -> DataFrame:
    """Add ``cost_nano`` and ``cost_usd`` to events with mode (text/voice), model and usage JSON."""
    text = text_cost(F.from_json("usage", TEXT_USAGE), F.col("model"))
    voice = voice_cost(F.from_json("usage", VOICE_USAGE))
    priced = events.withColumn("cost_nano", F.when(F.col("mode") == "voice", voice).otherwise(text))
    return priced.withColumn("cost_usd", F.col("cost_nano") / F.lit(NANO))


def chargeable(priced: DataFrame) -> DataFrame:
    return priced.filter((F.col("cost_nano") > 0) & F.coalesce(F.col("client") != "", F.lit(False)))


def spend_ledger(priced: DataFrame) -> DataFrame:
    """Spend per client and mode; a repeated event id is charged once."""
    named = priced.filter(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    once = named.unionByName(priced.filter(F.col("event_id").isNull()))
    sums = chargeable(once).groupBy("client", "mode").agg(F.sum("cost_nano").alias("spent_nano"))
    return sums.withColumn("spent_usd", F.col("spent_nano") / F.lit(NANO))


def effective_cap(cap: float | None) -> float:
    """Default when unset; zero or less turns the cap off."""
    if cap is None:
        return K.DEFAULT_BUDGET_USD
    return cap if cap > 0 else 0.0


def cap_status(ledger: DataFrame, cap: float | None = None) -> DataFrame:
    limit = effective_cap(cap)
    reached = (F.col("spent_nano") >= F.lit(round(limit * NANO))) if limit > 0 else F.lit(False)
    return ledger.withColumn("limit_usd", F.lit(limit)).withColumn("limit_reached", reached)


def cap_crossings(priced: DataFrame, cap: float | None = None, bucket: str = "day") -> DataFrame:
    """First event at which each client's running spend reaches the cap.

    Spend is first summed per time bucket; a running sum over those sums finds
    the bucket in which the cap is reached, and only that bucket's events are
    then ordered one by one. A client with a third of all events is therefore
    never sorted as a whole.
    """
    limit = round(effective_cap(cap) * NANO)
    named = priced.filter(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    once = named.unionByName(priced.filter(F.col("event_id").isNull()))
    paid = chargeable(once).withColumn("_b", F.date_trunc(bucket, "ts"))
    if limit <= 0:
        return paid.select("client", "mode", "event_id", "ts", F.lit(0.0).alias("spent_usd")).filter(F.lit(False))
    sums = paid.groupBy("client", "mode", "_b").agg(F.sum("cost_nano").alias("s"))
    upto = Window.partitionBy("client", "mode").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        sums.withColumn("run", F.sum("s").over(upto)).withColumn("before", F.col("run") - F.col("s"))
        .filter((F.col("run") >= limit) & (F.col("before") < limit)).select("client", "mode", "_b", "before"))
    inner = Window.partitionBy("client", "mode", "_b").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("client", "mode").orderBy("ts", "event_id")
    return (
        paid.join(hit, ["client", "mode", "_b"]).withColumn("spent", F.col("before") + F.sum("cost_nano").over(inner))
        .filter(F.col("spent") >= limit).withColumn("_r", F.row_number().over(first)).filter("_r = 1")
        .select("client", "mode", "event_id", "ts", (F.col("spent") / F.lit(NANO)).alias("spent_usd")))
