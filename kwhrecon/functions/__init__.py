"""Column builders (``Column -> Column``), all native Spark expressions."""

from kwhrecon.functions.text import strip, is_blank, lower_strip
from kwhrecon.functions.dates import (
    parse_full_date, parse_reference_period, format_full_date,
    format_reference_period, normalize_period_value, period_month,
    period_sort_key,
)
from kwhrecon.functions.keys import (
    uc_key, portal_uc, uc_text, doc_digits, identity_key, contains_letter,
    account_text, strip_decimal_suffix, group_key_text,
)
from kwhrecon.functions.money import br_number, charge_money, clamp_non_negative

__all__ = [
    "strip", "is_blank", "lower_strip",
    "parse_full_date", "parse_reference_period", "format_full_date",
    "format_reference_period", "normalize_period_value", "period_month",
    "period_sort_key",
    "uc_key", "portal_uc", "uc_text", "doc_digits", "identity_key",
    "contains_letter", "account_text", "strip_decimal_suffix", "group_key_text",
    "br_number", "charge_money", "clamp_non_negative",
]
