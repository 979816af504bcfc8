"""Email and phone predicates for whole string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenant import contract


# Search patterns that find a match exactly where the contract's full patterns do, at less cost: a
# search needs only the last character of an email's local part, and the shortest form of a
# phone's optional and variable ends. The full email pattern rescans every long word.
EMAIL_PROBE = "[a-zA-Z0-9._%+-]@" + contract.EMAIL_PATTERN.split("@")[1]
PHONE_PROBE = (
    rf"[0-9]{{2}}\)?[{contract.WHITESPACE_CLASS}.-]?[0-9]{{3,4}}"
    rf"[{contract.WHITESPACE_CLASS}.-]?[0-9]{{3}}"
)


def has_email(text: Column) -> Column:
    return F.coalesce(text.contains("@") & text.rlike(EMAIL_PROBE), F.lit(False))


def has_phone(text: Column) -> Column:
    """Phone test; the pattern already needs eight digits, so no digit count is added."""
    return F.coalesce(text.rlike(PHONE_PROBE), F.lit(False))
