"""Exact money parsing as JVM column expressions.

The accepted spellings are a fixed contract (SURVEY F17, F18, Q5); nothing is guessed, and a text
outside of it gives null. Every function is null on null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import WHITE, ascii_digits, let, nfkc, no_space

PLAIN = r"^[+-]?\d+(\.\d{1,2})?$"
GROUPED_FRACTION = r"^[+-]?\d{1,3}(,\d{3})+\.\d{1,2}$"
GROUPED_MANY = r"^[+-]?\d{1,3}(,\d{3}){2,}$"
#: A text that is its own canonical form, as most are.
CANONICAL = r"^(?!-0\.00\z)-?(?:0|[1-9]\d*)\.\d\d\z"
#: A text that is canonical but for a plus sign and groups of thousands.
NEARLY_CANONICAL = r"^[+-]?[1-9]\d{0,2}(?:,\d{3})*\.\d\d\z"
COMMA_DECIMAL = r"^[+-]?\d+,\d{1,2}$"
COMMA_THOUSAND = r"^[+-]?\d+,\d{3}$"


def parse_amount_text(raw: Column | str) -> Column:
    """The exact value as canonical text (no leading zeros, two decimals, no negative zero), else null.

    Integer digits are unbounded, so equality on this text is equality of exact decimals.
    """

    def canonical(number: Column, flipped: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(number, r"^[+-]?(\d+)", 1), "^0+(?=\\d)", "")
        value = F.concat(whole, F.lit("."), F.rpad(F.regexp_extract(number, r"\.(\d+)$", 1), 2, "0"))
        negative = F.startswith(number, F.lit("-")) != flipped
        return F.when(number.isNotNull(), let(value, lambda v: F.when(negative & (v != "0.00"), F.concat(F.lit("-"), v)).otherwise(v)))

    def number(bare: Column) -> Column:
        return (
            F.when(bare.rlike(PLAIN), bare)
            .when(bare.rlike(f"{GROUPED_FRACTION}|{GROUPED_MANY}|{COMMA_THOUSAND}"), F.replace(bare, F.lit(","), F.lit("")))
            .when(bare.rlike(COMMA_DECIMAL), F.replace(bare, F.lit(","), F.lit(".")))
        )

    def unwrapped(text: Column) -> Column:
        wrapped = text.rlike(r"^\(.*\)$")
        bare = F.when(wrapped, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
        return let(let(F.regexp_replace(bare, "^¥?(CNY)?", ""), number), lambda n: canonical(n, wrapped))

    def read(text: Column) -> Column:
        return F.when(text.rlike(CANONICAL), text).when(text.rlike(NEARLY_CANONICAL), F.translate(text, "+,", "")).otherwise(let(ascii_digits(no_space(nfkc(text))), unwrapped))

    return read(F.col(raw)) if isinstance(raw, str) else let(raw, read)


def parse_amount(raw: Column | str) -> Column:
    """The exact value as DECIMAL(38,2); null where unreadable or beyond 36 integer digits."""
    return parse_amount_text(raw).try_cast("decimal(38,2)")


def net_amount(income: Column, expense: Column) -> Column:
    """Income less expense; a missing side is zero, both missing is null."""
    zero = F.lit(0).cast("decimal(18,2)")
    return F.when(income.isNotNull() | expense.isNotNull(), F.try_subtract(F.coalesce(income, zero), F.coalesce(expense, zero)))


def account_ok(text: Column) -> Column:
    """6 to 30 digits once white space and hyphens are dropped."""
    return ascii_digits(F.regexp_replace(text, f"(?:{WHITE}|-)+", "")).rlike(r"^\d{6,30}$")


def currency_ok(text: Column) -> Column:
    """Three capital letters, or one of the accepted spellings of renminbi."""
    code = F.upper(no_space(text))
    return code.isin("RMB", "人民币", "人民币元") | code.rlike("^[A-Z]{3}$")
