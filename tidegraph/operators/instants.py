"""Timestamps of many formats and zones brought to UTC microseconds.

All formats are one alternation with named groups. One replacement pass over a text yields all
its components; calendar ranges are checked on integers and the instant is put together by
day arithmetic. Only a text without zone information needs the zone rules of its feed.
Everything is a built-in expression, so a scan of any size takes one pass and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let

# Month names by language (English, German, French, Spanish), in calendar order.
MONTHS = (
    ("january", "jan", "januar", "janvier", "janv", "enero", "ene", "jänner"),
    ("february", "feb", "februar", "février", "fevrier", "févr", "febrero"),
    ("march", "mar", "märz", "maerz", "mrz", "mars", "marzo"),
    ("april", "apr", "avril", "avr", "abril", "abr"),
    ("may", "mai", "mayo"),
    ("june", "jun", "juni", "juin", "junio"),
    ("july", "jul", "juli", "juillet", "juil", "julio"),
    ("august", "aug", "août", "aout", "agosto", "ago"),
    ("september", "sep", "sept", "septembre", "septiembre", "setiembre"),
    ("october", "oct", "oktober", "okt", "octobre", "octubre"),
    ("november", "nov", "novembre", "noviembre"),
    ("december", "dec", "dezember", "dez", "décembre", "decembre", "déc", "diciembre", "dic"),
)
# Zone abbreviations and their minutes from UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "aest": 600, "acdt": 630, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}

_MONTH = "|".join(sorted({n for row in MONTHS for n in row}, key=lambda n: (-len(n), n)))
_ZONE = "|".join(sorted(ZONES, key=lambda n: (-len(n), n)))
_DAYNAME = r"(?:\p{L}{2,10}\.?,? )?"
_LEAD = r"(?:(?:updated|published|posted on|posted|last updated|on)\s*:?\s*)?"
_CLOCK = r"(?<h#>\d{1,2}):(?<n#>\d{2})(?::(?<s#>\d{2})(?:[.,](?<f#>\d{1,12}))?)?(?:\s*(?<a#>[ap]\.?m\.?))?"
_WHERE = r"(?:\s*(?<z#>" + _ZONE + r"|[+-]\d{2}:?\d{2}|[+-]\d{2}))?(?:\[[^\]]*\])?"
_TIME = r"(?:(?:,|\s+at)?[t\s]\s*" + _CLOCK + r"(?:\s*uhr)?" + _WHERE + ")?"

#: Each format: named groups y year, m month in figures, w month word, d day, p and q figures of unclear
#: order, h n s f a clock, z zone, x separator, e seconds and i milliseconds since 1970. # is the number of the format.
FORMATS = (
    r"(?<y#>\d{4})(?<x#>[-/.])(?<m#>\d{1,2})\k<x#>(?<d#>\d{1,2})" + _TIME,
    r"(?<y#>\d{4})(?<m#>\d{2})(?<d#>\d{2})(?:[t ](?<h#>\d{2})(?<n#>\d{2})(?:(?<s#>\d{2})(?:[.,](?<f#>\d{1,12}))?)?" + _WHERE + ")?",
    r"(?<i#>-?\d{12,13})",
    r"(?<e#>-?\d{9,10})(?:\.(?<f#>\d{1,12}))?",
    r"(?<p#>\d{1,2})(?<x#>[-/.])(?<q#>\d{1,2})\k<x#>(?<y#>\d{4}|\d{2})" + _TIME,
    _LEAD + _DAYNAME + r"(?:le )?(?<d#>\d{1,2})(?:st|nd|rd|th|er|\.)?[ -](?:de |of )?(?<w#>" + _MONTH + r")\.?[ -](?:de |del )?(?<y#>\d{4}|\d{2})" + _TIME,
    _LEAD + r"(?:le )?(?<d#>\d{1,2})(?:er)? (?<w#>" + _MONTH + r")\.? (?<y#>\d{4}),? (?:à |a )?(?<h#>\d{1,2}) ?h ?(?<n#>\d{2})?" + _WHERE,
    _LEAD + _DAYNAME + r"(?<w#>" + _MONTH + r")\.? (?<d#>\d{1,2})(?:st|nd|rd|th)?,? (?<y#>\d{4})" + _TIME,
    r"(?<y#>\d{4}) ?[年년] ?(?<m#>\d{1,2}) ?[月월] ?(?<d#>\d{1,2}) ?[日일](?:\s*(?<a#>午前|午後|上午|下午|오전|오후)?\s*(?<h#>\d{1,2})(?::|時|时|点|시 ?)(?<n#>\d{2})?分?(?::(?<s#>\d{2}))?" + _WHERE + ")?",
)

_PARTS = "ymwdpqhnsfazei"
_MARK = "\x01"


def _build() -> tuple[str, str, list[dict[str, int]]]:
    """The alternation, its replacement, and the place of each component among the pieces."""
    out, places = [], []
    for k, form in enumerate(FORMATS):
        own = [p for p in _PARTS if f"(?<{p}#>" in form]
        places.append({p: len(out) + i for i, p in enumerate(own)})
        out += [f"${{{p}{k}}}" for p in own]
    # Java names of groups are letters and digits, so "y#" becomes "y0", "y1" ...
    forms = [form.replace("#", str(k)) for k, form in enumerate(FORMATS)]
    return "^(?:" + "|".join(f"(?:{x})" for x in forms) + ")$", _MARK.join(["", "", "ok", *out]), places


PATTERN, REPLACEMENT, PLACES = _build()


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, on integers alone."""
    yy = y - (m <= 2).cast("int")
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _pieces(text: Column) -> Column:
    """The components of a text that has one of the formats; else the text as the one element."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[\s\x{a0}\x{202f}\x{2009}\x{3000}]+", " "))
    return F.split(F.regexp_replace(clean, PATTERN, REPLACEMENT), _MARK)


def _raw(parts: Column, p: str) -> Column:
    got = [F.nullif(F.get(parts, F.lit(own[p] + 3)), F.lit("")) for own in PLACES if p in own]
    return F.coalesce(*got) if len(got) > 1 else got[0]


def add_instants(rows: DataFrame, text: str, tz_name: str, day_first: str, out: str = "utc_us") -> DataFrame:
    """rows with `out`, bigint: microseconds since 1970-01-01 UTC that the text names, or null.

    Zone information in the text holds; else the time is local in tz_name, the earlier of two if it
    occurs twice, none if it is skipped. A text with neither zone nor known tz_name is null. Figures
    with the year last are read by day_first (null: false). Years of two figures are 2000 to 2099.
    24:00 is the midnight that ends the day. Finer digits are cut off; missing parts are zero.
    Null, empty, unknown and impossible texts are null. A column named `out` is replaced."""
    months = F.create_map(*[F.lit(x) for k, row in enumerate(MONTHS) for n in row for x in (n, k + 1)])
    zones = F.create_map(*[F.lit(x) for n, k in ZONES.items() for x in (n, k)])
    c = lambda n: F.col("__t_" + n)
    num = lambda p: _raw(c("parts"), p).cast("int")
    df = let(rows, {"__t_parts": _pieces(F.col(text))})
    df = let(
        df,
        {f"__t_{p}": num(p) for p in "ymdpqhns"}
        | {f"__t_{p}": _raw(c("parts"), p) for p in "wzf"}
        | {
            "__t_y2": F.length(_raw(c("parts"), "y")) == 2,
            "__t_half": F.regexp_replace(_raw(c("parts"), "a"), r"\.", ""),
            "__t_i": _raw(c("parts"), "i").cast("long"),
            "__t_e": _raw(c("parts"), "e").cast("long"),
            "__t_ok": F.get(c("parts"), F.lit(2)) == "ok",
        },
    ).drop("__t_parts")
    first = F.coalesce(F.col(day_first), F.lit(False))
    late, early = c("half").isin("pm", "午後", "下午", "오후"), c("half").isin("am", "午前", "上午", "오전")
    h0 = F.coalesce(c("h"), F.lit(0))
    digits = F.regexp_replace(c("z"), "[^0-9]", "")
    df = let(
        df,
        {
            "__t_uY": F.when(c("y2"), c("y") + 2000).otherwise(c("y")),
            "__t_uD": F.coalesce(c("d"), F.when(first, c("p")).otherwise(c("q"))),
            "__t_uM": F.coalesce(c("m"), F.element_at(months, c("w")), F.when(first, c("q")).otherwise(c("p"))),
            "__t_uH": F.when(late, h0 % 12 + 12).when(early, h0 % 12).otherwise(h0),
            "__t_uN": F.coalesce(c("n"), F.lit(0)),
            "__t_uS": F.coalesce(c("s"), F.lit(0)),
            "__t_uF": F.coalesce(F.rpad(F.substring(c("f"), 1, 6), 6, "0").cast("long"), F.lit(0).cast("long")),
            "__t_h12": F.when(c("half").isNotNull(), h0 <= 12).otherwise(F.lit(True)),
            "__t_off": F.when(
                c("z").rlike(r"^[+-]"),
                F.when(c("z").startswith("-"), -1).otherwise(1)
                * (F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))),
            ).otherwise(F.element_at(zones, c("z"))),
        },
    )
    y, m, d, h, n, s, f = (c("u" + k) for k in "YMDHNSF")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    fine = (
        (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest) & n.between(0, 59) & s.between(0, 59) & c("h12")
        & (h.between(0, 23) | ((h == 24) & (n == 0) & (s == 0) & (f == 0)))
    )
    df = let(df, {"__t_local": F.when(fine, (((_days(y, m, d) * 24 + h) * 60 + n) * 60 + s) * F.lit(1_000_000).cast("long") + f)})
    tz = F.col(tz_name)
    df = let(df, {"__t_zoned": F.when(c("z").isNull() & tz.isNotNull(), F.to_utc_timestamp(F.timestamp_micros(c("local")), tz))})
    civil = F.when(c("z").isNotNull(), c("local") - c("off").cast("long") * 60_000_000).otherwise(
        F.when(F.unix_micros(F.from_utc_timestamp(c("zoned"), tz)) == c("local"), F.unix_micros(c("zoned")))
    )
    got = F.when(c("ok"), F.coalesce(c("i") * 1000, c("e") * 1_000_000 + f, civil))
    return df.select(*[F.col(f"`{x}`") for x in rows.columns if x != out], got.alias(out))


def normalize_instants(
    rows: DataFrame, feeds: DataFrame, text: str = "published_date", feed: str = "feed", out: str = "utc_us"
) -> DataFrame:
    """rows with `out`, the UTC microseconds named by `text` (see add_instants).

    feeds (feed, tz_name, day_first) is small reference data keyed by feed; of a repeated key the
    smallest tz_name counts. Rows of an unknown or null feed keep what their own zone information gives."""
    own = feeds.groupBy(F.col("feed").alias("__feed")).agg(
        F.min("tz_name").alias("__tz"), F.min_by("day_first", "tz_name").alias("__df")
    )
    joined = rows.join(own, rows[feed] == own["__feed"], "left")
    return add_instants(joined, text, "__tz", "__df", out).drop("__feed", "__tz", "__df")
