from .scalar import (advice, band, clip, col, day_number, decision, epoch_seconds, is_missing,
                     mask, nan_to_null, percent_text, r6, rule_label, safe_log1p)

__all__ = ["advice", "band", "clip", "col", "day_number", "decision", "epoch_seconds", "is_missing",
           "mask", "nan_to_null", "percent_text", "r6", "rule_label", "safe_log1p"]
