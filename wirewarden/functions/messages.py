"""Control-character separated device messages."""

from pyspark.sql import Column, functions as F

FIELD_SEPARATOR, VALUE_SEPARATOR = "\u0001", "\u0002"


def message_field(message: Column, index: int) -> Column:
    """Value of the ``index``-th ``key<02>value`` field; null when it is missing."""
    field = F.try_element_at(F.split(message, FIELD_SEPARATOR), F.lit(index + 1))
    return F.try_element_at(F.split(field, VALUE_SEPARATOR), F.lit(2))


def epoch_ms_day(millis: Column) -> Column:
    """Epoch milliseconds -> yyyy-MM-dd in the session time zone."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


def device_name(message: Column) -> Column:
    return message_field(message, 1)


def device_day_key(message: Column) -> Column:
    """``day|device``, the counting key of a device message."""
    millis = message_field(message, 0).try_cast("double").cast("bigint")
    return F.concat(epoch_ms_day(millis), F.lit("|"), device_name(message))
