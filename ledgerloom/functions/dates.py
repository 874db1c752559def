"""Calendar dates from text as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import ascii_digits, let, normalize_text

#: A day written in parts, year first; the parts may be set apart by different signs.
_DAY = "[0-9]{4}(?:[-./][0-9]{1,2}){2}"
#: The whole text is a day, in parts or as eight digits; or one day somewhere in a text.
_WHOLE, _INSIDE = f"^(?:{_DAY}|[0-9]{{8}})$", f"(?<![0-9]){_DAY}(?![0-9])"


def parse_date(raw: Column | str) -> Column:
    """DATE of a readable text, else null: separated or compact, else the single date token inside the text.

    Two possible dates in one text, an impossible day and the year 0000 give null.
    """

    def iso(found: Column) -> Column:
        parts = [F.regexp_extract(found, r"^(\d{4})\D?(\d{1,2})\D?(\d{1,2})$", k) for k in (1, 2, 3)]
        return F.when(found.isNotNull() & (parts[0] != "0000"), F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))

    def token(text: Column) -> Column:
        inside = let(F.regexp_extract_all(text, F.lit(_INSIDE), F.lit(0)), lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0))))
        return F.when(text.rlike(_WHOLE), text).otherwise(inside)

    return let(let(F.translate(ascii_digits(normalize_text(raw)), "年月日", "//"), token), iso).try_cast("date")
