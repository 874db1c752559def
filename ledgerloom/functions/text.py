"""Text functions as JVM column expressions.

Spark has no SQL builtin for compatibility normalisation or full case folding, but ships ICU4J for
its collations; ``reflect`` reaches ICU's static string functions, so no row leaves the JVM.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_ASCII = "[^\\x00-\\x7f]"
#: White space as Python's str.split() and strip() see it.
WHITE = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(text: Column | str, body: Callable[[Column], Column]) -> Column:
    """body of a column by name, or of an expression that is bound once."""
    return body(F.col(text)) if isinstance(text, str) else let(text, body)


def _by_icu(text: Column | str, owner: str, method: str, plain: Callable[[Column], Column], option: bool = True) -> Column:
    """A static string function of ICU where the text goes beyond ASCII, else its plain equivalent; null stays null."""

    def body(t: Column) -> Column:
        call = F.call_function("reflect", F.lit(owner), F.lit(method), F.coalesce(t, F.lit("")), F.lit(option))
        return F.when(t.isNull(), F.lit(None).cast("string")).when(t.rlike(NON_ASCII), call).otherwise(plain(t))

    return _bound(text, body)


def nfkc(text: Column | str) -> Column:
    """NFKC form; null stays null."""
    return _by_icu(text, "com.ibm.icu.text.Normalizer", "compose", lambda t: t)


def nfc(text: Column | str) -> Column:
    """NFC form, which only unites ways to write the same characters; null stays null."""
    return _by_icu(text, "com.ibm.icu.text.Normalizer", "compose", lambda t: t, option=False)


def casefold(text: Column | str) -> Column:
    """Full Unicode case folding (ß → ss), unlike lower(); null stays null."""
    return _by_icu(text, "com.ibm.icu.lang.UCharacter", "foldCase", F.lower)


def squeeze(text: Column | str) -> Column:
    """Collapse each run of Unicode white space to one space and trim."""
    return F.trim(F.regexp_replace(_col(text), f"{WHITE}+", " "))


def no_space(text: Column | str) -> Column:
    """Drop all Unicode white space."""
    return F.regexp_replace(_col(text), f"{WHITE}+", "")


def normalize_text(text: Column | str) -> Column:
    """NFKC, then collapse and trim white space (F1)."""
    return squeeze(nfkc(text))


def normalize_token(text: Column | str) -> Column:
    """NFKC, keep letters, digits and U+3400-9FFF, case-fold (F2)."""
    return casefold(F.regexp_replace(nfkc(text), "[^\\p{L}\\p{N}\\u3400-\\u9fff]", ""))


def normalize_header(text: Column | str) -> Column:
    """NFKC, case-fold, keep only 0-9, a-z and U+3400-9FFF."""
    return F.regexp_replace(casefold(nfkc(text)), "[^0-9a-z\\u3400-\\u9fff]", "")


def normalize_block(text: Column | str) -> Column:
    """NFKC, drop white space, case-fold."""
    return casefold(no_space(nfkc(text)))


def compact(text: Column | str) -> Column:
    """Drop white space and case-fold."""
    return casefold(no_space(_col(text)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: nested uses of a column expression would otherwise multiply the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@functools.cache
def _digits() -> tuple[str, str]:
    """Every decimal digit beyond ASCII and the ASCII digit it stands for."""
    found = [(chr(o), str(unicodedata.decimal(chr(o)))) for o in range(128, sys.maxunicode + 1) if unicodedata.category(chr(o)) == "Nd" and o < 0x10000]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def ascii_digits(text: Column | str) -> Column:
    """Decimal digits of any script as ASCII digits."""
    return _bound(text, lambda t: F.when(t.rlike(NON_ASCII), F.translate(t, *_digits())).otherwise(t))


def present(text: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(_col(text), F.lit(""))


def suggested_text(name: Column | str, raw: Column | str) -> Column:
    """Machine suggestion by field name (F20): fixed two-decimal money, ISO date, else tidy text."""
    from ledgerloom.functions.dates import parse_date
    from ledgerloom.functions.money import parse_amount_text

    lowered = F.lower(_col(name))
    money = lowered.contains("amount") | lowered.contains("balance")
    return F.when(lowered.contains("date"), parse_date(raw).cast("string")).when(money, parse_amount_text(raw)).otherwise(normalize_text(raw))


def safe_name(name: Column | str, default: str = "results") -> Column:
    """A name fit for a file (F15): reserved and control characters become '_', outer blanks and dots go; the default where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(_col(name), r'[<>:"/\\|?*\x00-\x1f]+', "_"), "^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))


def needs_wide_font(text: Column | str) -> Column:
    """Whether a text holds characters beyond Latin-1 (F16)."""
    return F.coalesce(_col(text).rlike("[^\\x00-\\xff]"), F.lit(False))
