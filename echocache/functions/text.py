"""Prompt and response cleaning and validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echocache import schema as S

# The characters that count as whitespace when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean(text: Column | str) -> Column:
    """Strip surrounding whitespace; linear in the text, unlike an anchored regex."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_filled(text: Column | str) -> Column:
    """True when the text has something left after stripping; NULL counts as empty."""
    return F.coalesce(F.length(clean(text)) > 0, F.lit(False))


def prompt_reason(prompt: Column | str) -> Column:
    return F.when(~is_filled(prompt), F.lit(S.PROMPT_BLANK))


def response_reason(response: Column | str) -> Column:
    return F.when(~is_filled(response), F.lit(S.RESPONSE_BLANK))

