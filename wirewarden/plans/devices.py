"""Device messages -> messages per day and device."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import device_day_key, device_name, message_field
from ..functions.messages import epoch_ms_day


def split_lines(df: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """One row per line of a text value, next to the columns in ``keep``."""
    return df.select(*keep, F.explode_outer(F.split(value, "\n")).alias("message")).where("message is not null")


def message_millis(message: Column) -> Column:
    return message_field(message, 0).try_cast("double").cast("bigint")


def with_device_fields(messages: DataFrame) -> DataFrame:
    millis = message_millis(F.col("message"))
    return messages.select("message", epoch_ms_day(millis).alias("day"), device_name(F.col("message")).alias("device"))


def with_day_number(messages: DataFrame) -> DataFrame:
    """Messages that can be counted, with ``day_number``, the days since 1970 by which days are compared."""
    number = F.unix_date(F.timestamp_millis(message_millis(F.col("message"))).cast("date"))
    fields = with_device_fields(messages.where(device_day_key(F.col("message")).isNotNull()))
    return fields.withColumn("day_number", number)


def count_day_device(messages: DataFrame) -> DataFrame:
    keyed = messages.select(device_day_key(F.col("message")).alias("day_device"))
    return keyed.where("day_device is not null").groupBy("day_device").agg(F.count("*").alias("n"))


def rejected_messages(messages: DataFrame) -> DataFrame:
    """Messages without a readable time or device, which ``count_day_device`` can't count."""
    return messages.where(F.col("message").isNull() | device_day_key(F.col("message")).isNull())
