"""Phone numbers as E.164, by a table of numbering plans.

The plans of India and North America are checked in detail, those of some other countries by their leading digits and lengths,
and any other country code by length alone. Numbers without a country code are read in a default region.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluo.functions.text import let

#: Valid national numbers by country code (fixed values).
_PLANS = {
    "91": (
        r"[6-9]\d{9}|(?:11|2[02]|33|4[04]|79|80)[2-7]\d{7}"
        r"|(?:1(?:2[0-24]|3[0-25]|4[145]|[59][14]|6[1-9]|7[1257]|8[1-57-9])|2(?:1[257]|3[013]|4[01]|5[0137]|6[058]|78|8[1568]|9[14])"
        r"|3(?:26|4[1-3]|5[34]|6[01489]|7[02-46]|8[159])|4(?:1[36]|2[1-47]|3[15]|5[12]|6[0-26-9]|7[0-24-9]|8[013-57]|9[014-7])"
        r"|5(?:1[025]|22|[36][25]|4[28]|[578]1|9[15])|6(?:12|[2-47]1|5[17]|6[13]|80)|7(?:12|2[14]|3[134]|4[47]|5[15]|[67]1)"
        r"|8(?:16|2[014]|3[126]|6[136]|7[078]|8[34]|91))[2-7]\d{6}|1800\d{6,7}"
    ),
    "1": r"(?!555|[2-9]11|37|96)[2-9][0-8]\d[2-9]\d{6}",
    "44": r"[1-35789]\d{8,9}",
    "49": r"[1-9]\d{5,13}",
    "33": r"[1-9]\d{8}",
    "61": r"[2-478]\d{8}|1[38]00\d{6}|13\d{4}",
    "81": r"[1-9]\d{8,9}",
    "86": r"1[3-9]\d{9}|[2-9]\d{8,10}",
    "65": r"[3689]\d{7}",
    "971": r"[2-79]\d{7,8}",
}
#: Country code and national prefix of the regions a number without a code can be read in (fixed values).
_REGIONS = {"IN": ("91", "0"), "US": ("1", "1"), "CA": ("1", "1"), "GB": ("44", "0"), "DE": ("49", "0"), "FR": ("33", "0"), "AU": ("61", "0")}
_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d"


#: Plans as one pattern over country code and national number; any other code takes 6 to 12 digits.
_KNOWN = "|".join(f"{c}(?:{plan})" for c, plan in _PLANS.items())
_OTHER = rf"(?!(?:{'|'.join(_PLANS)}))(?:{_CODE})[1-9]\d{{5,11}}"


def _valid(digits: Column) -> Column:
    """+digits where they are a country code and a valid national number of at most 15 digits together."""
    return F.when(digits.rlike(rf"^(?=\d{{7,15}}$)(?:{_KNOWN}|{_OTHER})$"), F.concat(F.lit("+"), digits))


def normalize_phone(raw: Column, region: str = "IN") -> Column:
    """E.164 or null. A leading + or 00 (011 in North America) gives the country code; else the region's, which may also be written bare."""
    code, prefix = _REGIONS[region]
    idd = "011" if code == "1" else "00"

    def read(body: Column) -> Column:
        def of(digits: Column) -> Column:
            bare = F.regexp_replace(digits, f"^{prefix}", "")
            local = F.coalesce(_valid(F.concat(F.lit(code), digits)), F.when(digits != bare, _valid(F.concat(F.lit(code), bare))), F.when(F.startswith(digits, F.lit(code)), _valid(digits)))
            dialled = F.when(F.startswith(digits, F.lit(idd)), _valid(F.substr(digits, F.lit(len(idd) + 1))))
            return F.when(body.rlike(r"^[+＋]"), _valid(digits)).otherwise(F.coalesce(dialled, local))

        viable = ~body.rlike(r"(?U)[^\d\s+＋().\-/–—]") & (body != "")
        return F.when(viable, let(F.regexp_replace(body, r"(?U)\D+", ""), of))

    return let(F.regexp_replace(F.regexp_extract(raw, r"(?U)([+＋(\d].*)", 1), r"(?iU)\s*(?:;ext=|ext\.?|extn\.?|x|#)\s*\d{1,7}\s*$", ""), read)


def phone_key(raw: Column) -> Column:
    """E.164 where valid, else the last ten digits, or all of seven to nine; null for fewer."""
    tail = let(F.regexp_replace(raw, r"(?U)\D+", ""), lambda d: F.when(F.length(d) >= 10, F.right(d, F.lit(10))).when(F.length(d) >= 7, d))
    return F.coalesce(normalize_phone(raw), tail)
