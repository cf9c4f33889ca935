"""Routines of the row-expression language as Spark columns, by group and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\x00-\x20]+"


class StringHandling:
    """Text routines; positions from 1, INDEX from 0."""

    ALPHA = staticmethod(lambda s: F.coalesce(F.split(s, "") == F.array_sort(F.split(s, "")), F.lit(False)))
    IS_ALPHA = staticmethod(lambda s: F.coalesce(s.rlike(r"^\p{L}*$"), F.lit(False)))
    CHANGE = EREPLACE = staticmethod(lambda s, regex, to: F.regexp_replace(s, F.lit(regex), F.lit(to)))
    COUNT = staticmethod(lambda s, part: F.coalesce(F.regexp_count(s, F.lit(r"(?=\Q" + part + r"\E)")), F.lit(0)))
    DOWNCASE, UPCASE = staticmethod(F.lower), staticmethod(F.upper)
    DQUOTE = staticmethod(lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    SQUOTE = staticmethod(lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    INDEX = staticmethod(lambda s, part: F.coalesce(F.instr(s, part) - 1, F.lit(-1)))
    LEFT = staticmethod(lambda s, n: F.left(s, F.lit(n)))
    RIGHT = staticmethod(lambda s, n: F.right(s, F.lit(n)))
    LEN = staticmethod(lambda s: F.coalesce(F.length(s), F.lit(-1)))
    SPACE = staticmethod(lambda n: F.repeat(F.lit(" "), F.lit(n)))
    STR = staticmethod(lambda c, n: F.repeat(F.lit(c), F.lit(n)))
    TRIM = staticmethod(lambda s: F.regexp_replace(F.regexp_replace(s, f"^{_BLANKS}", ""), f"{_BLANKS}$", ""))
    BTRIM = staticmethod(lambda s: F.regexp_replace(s, f"{_BLANKS}$", ""))
    FTRIM = staticmethod(lambda s: F.regexp_replace(s, f"^{_BLANKS}", ""))

    @staticmethod
    def SUBSTR(s: Column, start: int, length: int | None = None) -> Column:
        """From start (from the end if negative); blank texts give null."""
        part = F.substring(s, start, length if length is not None else 2**31 - 1)
        return F.when(F.trim(s) != "", part)

    @staticmethod
    def _pad(pad, s: Column, n: int, fill: str) -> Column:
        return F.when(F.lit(n >= 1) & (F.trim(s) != ""), F.when(F.length(s) >= n, s).otherwise(pad(s, n, fill or " ")))

    @staticmethod
    def INSTR(s: Column, search: str, start: int = 1, occurrence: int = 1) -> Column:
        """The place of an occurrence of search from start on, 0 if there is none; a negative start counts from the end and goes back."""
        size = F.length(s)
        places = F.when(size >= abs(start), F.sequence(F.lit(start), size) if start > 0 else F.reverse(F.sequence(F.lit(1), size + 1 + start)))
        found = F.filter(places, lambda i: F.substring(s, i, F.lit(len(search))) == F.lit(search))
        return F.when(s.isNotNull(), F.coalesce(F.get(found, F.lit(occurrence - 1)), F.lit(0)))

    LTRIM = staticmethod(lambda s, some=" ": F.ltrim(s, F.lit(some)))
    RTRIM = staticmethod(lambda s, some=" ": F.rtrim(s, F.lit(some)))
    LPAD = staticmethod(lambda s, n, fill=" ": StringHandling._pad(F.lpad, s, n, fill))
    RPAD = staticmethod(lambda s, n, fill=" ": StringHandling._pad(F.rpad, s, n, fill))
    TO_CHAR = staticmethod(lambda n: n.cast("decimal(38,16)").cast("string"))


class Mathematical:
    """Numbers; MOD has the sign of the dividend."""

    ABS, ACOS, ASIN, ATAN, COS, COSH = map(staticmethod, (F.abs, F.acos, F.asin, F.atan, F.cos, F.cosh))
    EXP, LN, SIN, SINH, SQRT, TAN, TANH = map(staticmethod, (F.exp, F.ln, F.sin, F.sinh, F.sqrt, F.tan, F.tanh))
    DIV = staticmethod(lambda a, b: F.when(b != 0, (a / b).cast("bigint")))
    MOD = staticmethod(lambda a, b: F.when(b != 0, a % b))
    NEG = staticmethod(lambda a: -a)
    INT = NUM = staticmethod(lambda s: F.trim(s.cast("string")).try_cast("double").try_cast("bigint"))
    REAL = staticmethod(lambda s: F.trim(s.cast("string")).try_cast("double"))
    RND = staticmethod(lambda a, seed=0: F.rand(seed) * a)
    BITAND = staticmethod(lambda a, b: a.bitwiseAND(b))
    BITOR = staticmethod(lambda a, b: a.bitwiseOR(b))
    BITXOR = staticmethod(lambda a, b: a.bitwiseXOR(b))
    BITNOT = staticmethod(F.bitwise_not)
    SADD = staticmethod(lambda a, b: a.try_cast("double") + b.try_cast("double"))
    SSUB = staticmethod(lambda a, b: a.try_cast("double") - b.try_cast("double"))
    SMUL = staticmethod(lambda a, b: a.try_cast("double") * b.try_cast("double"))
    SDIV = staticmethod(lambda a, b: F.try_divide(a.try_cast("double"), b.try_cast("double")))
    SCMP = staticmethod(lambda a, b: F.signum(a.try_cast("double") - b.try_cast("double")).cast("int"))


class Numeric:
    """Numbers out of text, and random ones; sequences are order.number_rows and order.sequence."""

    random = staticmethod(lambda least, most, seed=None: F.floor(least + (F.rand() if seed is None else F.rand(seed)) * (most - least + 1)).cast("bigint"))

    @staticmethod
    def convertImpliedDecimalFormat(pattern: str, s: Column) -> Column:
        """Digits as a number with as many decimals as pattern has places behind its V; no number gives null."""
        _, _, behind = pattern.upper().partition("V")
        return (F.trim(s).try_cast("decimal(28,0)") / F.lit(10 ** len(behind)).cast("decimal(20,0)")).cast(f"decimal(38,{len(behind)})")


class Relational:
    """Null tests."""

    ISNULL = isNull = staticmethod(lambda c: c.isNull())
    NOT = staticmethod(lambda c: ~c)


class DataOperation:
    """Small conversions."""

    DTX = staticmethod(lambda i: F.lower(F.hex(i)))
    XTD = staticmethod(lambda s: F.conv(s, 16, 10).cast("bigint"))
    FIX = staticmethod(lambda n: F.round(n, 0).cast("bigint"))


class Text:
    """XML escapes, accents, joins and decoding."""

    replaceSpecialCharForXML = staticmethod(lambda s: F.replace(F.replace(F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("'"), F.lit("&apos;")), F.lit('"'), F.lit("&quot;")))
    removeAccents = staticmethod(lambda s: F.translate(s, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"))
    unionString = staticmethod(lambda delimiter, *parts: F.concat_ws(delimiter, *parts))
    trimCharacter = staticmethod(lambda s, c: F.btrim(s, F.lit(c)))

    @staticmethod
    def DECODE(value: Column, default: Column, *pairs) -> Column:
        """The partner of the first equal key, else default."""
        out = default
        for key, to in reversed(list(zip(pairs[::2], pairs[1::2], strict=True))):
            out = F.when(value == key, to).otherwise(out)
        return out


_UNITS = {"yyyy": "YEAR", "MM": "MONTH", "dd": "DAY", "HH": "HOUR", "mm": "MINUTE", "ss": "SECOND", "SSS": "MILLISECOND"}
_ADDED = {"Y": "YEAR", "MONTH": "MONTH", "DAY": "DAY", "HH": "HOUR", "MI": "MINUTE", "SS": "SECOND", "MS": "MILLISECOND", "US": "MICROSECOND"}
_PARTS = {
    "YEAR": F.year, "MONTH": lambda d: F.month(d) - 1, "HOUR": lambda d: F.hour(d) % 12, "MINUTE": F.minute, "SECOND": F.second, "DAY_OF_MONTH": F.dayofmonth,
    "DAY_OF_YEAR": F.dayofyear, "DAY_OF_WEEK": F.dayofweek, "WEEK_OF_YEAR": F.weekofyear,
    "DAY_OF_WEEK_IN_MONTH": lambda d: F.ceil(F.dayofmonth(d) / 7), "WEEK_OF_MONTH": lambda d: F.ceil((F.dayofmonth(d) + F.dayofweek(F.trunc(d, "month")) - 1) / 7),
}


class Dates:
    """Date routines; MONTH counts from 0 and HOUR on a 12-hour clock."""

    parseDate = staticmethod(lambda pattern, s: F.to_timestamp(s, pattern))
    tryParseDate = staticmethod(lambda pattern, s: F.try_to_timestamp(s, F.lit(pattern)))
    formatDate = staticmethod(lambda pattern, d: F.date_format(d, pattern))
    isDate = staticmethod(lambda s, pattern: F.try_to_timestamp(s, F.lit(pattern)).isNotNull())
    getFirstDayOfMonth = staticmethod(lambda d: F.date_trunc("month", d))
    getLastDayOfMonth = staticmethod(F.last_day)
    getCurrentDate = staticmethod(F.current_timestamp)
    getPartOfDate = staticmethod(lambda part, d: F.coalesce(_PARTS[part](d).cast("int"), F.lit(0)))

    TO_CHAR = staticmethod(lambda d, pattern: F.date_format(d, pattern))

    @staticmethod
    def TO_DATE(s: Column, pattern: str = "MM/dd/yyyy HH:mm:ss.SSS") -> Column:
        """Text by pattern, J: milliseconds since 1970; blank and unparseable text gives null."""
        text = F.when(F.trim(s) != "", F.trim(s))
        return F.timestamp_millis(text.try_cast("bigint")) if pattern == "J" else F.try_to_timestamp(text, F.lit(pattern))

    @staticmethod
    def ADD_TO_DATE(d: Column, unit: str, n: int) -> Column:
        """d moved by n Y, MONTH, DAY, HH, MI, SS, MS, US or NS (whole thousands count)."""
        unit, n = ("US", int(n / 1000)) if unit.upper() == "NS" else (unit.upper(), n)
        return F.timestamp_add(_ADDED[unit], F.lit(n), d.cast("timestamp"))

    @staticmethod
    def setDate(d: Column, n: int, unit: str) -> Column:
        """d with its yyyy, MM, dd, HH, mm or ss set to n; a day that the month lacks gives null."""
        parts = {"yyyy": F.year, "MM": F.month, "dd": F.dayofmonth, "HH": F.hour, "mm": F.minute, "ss": F.second}
        made = [F.lit(n) if k == unit else part(d) for k, part in parts.items()]
        return F.try_make_timestamp(*made)

    @staticmethod
    def diffDateFloor(a: Column, b: Column, unit: str = "MM") -> Column:
        """Whole months, or years (yyyy), from b to a; negative if a is earlier."""
        months = F.months_between(a, b).cast("bigint")
        return months if unit == "MM" else (months / 12).cast("bigint")

    @staticmethod
    def compareDate(a: Column, b: Column, pattern: str | None = None) -> Column:
        """-1, 0 or 1, by pattern if given; null is least."""
        a, b = (F.date_format(a, pattern), F.date_format(b, pattern)) if pattern else (a, b)
        return F.when(a.isNull() & b.isNull(), 0).when(b.isNull(), 1).when(a.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0)

    @staticmethod
    def addDate(d: Column, n: int, unit: str) -> Column:
        return F.timestamp_add(_UNITS[unit], F.lit(n), d.cast("timestamp"))

    @staticmethod
    def diffDate(a: Column, b: Column, unit: str = "dd") -> Column:
        """a less b: years and months by the calendar, other units whole ones of the time between."""
        years, months = F.year(a) - F.year(b), F.month(a) - F.month(b)
        if unit in ("yyyy", "MM"):
            return (years if unit == "yyyy" else years * 12 + months).cast("bigint")
        millis = F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))
        return (millis / {"dd": 86_400_000, "HH": 3_600_000, "mm": 60_000, "ss": 1000, "SSS": 1}[unit]).cast("bigint")
