"""Scalar functions as Spark column expressions."""

from .scalars import (  # noqa: F401
    bankers_round, blend, channel_mask, config_key, dequantize_int8, format_elapsed, format_or_na, log_loss, magnitude, offset_policy,
    parse_fraction, patient_id, quantize_int8, rms, second_field_class, select_channels, wilson, zscore,
)
