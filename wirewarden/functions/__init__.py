"""Column -> Column building blocks; everything here stays in the JVM."""

from .ids import param_key, text_id
from .messages import device_day_key, device_name, epoch_ms_day, message_field
from .symbols import encode_symbols, is_cjk, symbol_states
from .text import (
    kv_name,
    kv_value,
    strip_text,
    url_quote,
    url_unquote,
)
from .urls import with_url_parts

__all__ = [
    "device_day_key", "device_name", "encode_symbols", "epoch_ms_day", "is_cjk", "kv_name",
    "kv_value", "message_field", "param_key", "strip_text", "symbol_states", "text_id",
    "url_quote", "url_unquote", "with_url_parts",
]
