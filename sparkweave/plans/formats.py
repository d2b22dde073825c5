"""Formats of schema texts: what ``:format name`` asks of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats and the pattern of the values they take.
PATTERNS = {
    "email": r"[^@]+@[^@.][^@]*\.[^@]*",
    "url": r"(?s)https?://.*",
    "uri": r"[a-zA-Z][a-zA-Z0-9+.-]*:\S*",
    "uuid": r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "hostname": r"[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*",
    "datetime": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.*",
    "date-iso": r"\d{4}-\d{2}-\d{2}",
    "ipv4": r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}",
    "phone": r"(?=(\D*\d){7})[\d+\- ().]+",
    "zip": r"\d{5}(-\d{4})?",
    "naic": r"\d{5}",
    "fein": r"\d{2}-\d{7}",
    "vin": r"[A-HJ-NPR-Za-hj-npr-z0-9]{17}",
    "ssn": r"(?!000)(\d{9}|\d{3}-\d{2}-\d{4})",
    "iban": r"[A-Za-z]{2}\d{2}[A-Za-z0-9]{4,30}",
    "bic": r"[A-Za-z]{6}[A-Za-z0-9]{2}([A-Za-z0-9]{3})?",
    "routing": r"\d{9}",
    "cusip": r"[A-Za-z0-9]{9}",
    "isin": r"[A-Za-z]{2}[A-Za-z0-9]{9}\d",
    "lei": r"[A-Za-z0-9]{20}",
    "npi": r"\d{10}",
    "dea": r"[A-Za-z]{2}\d{7}",
    "imei": r"\d{15}",
    "iccid": r"\d{19,20}",
    "creditcard": r"[ -]*(\d[ -]*){13,19}",
}
#: Code lists.
CODES = {
    "currency-code": (
        "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD "
        "HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK "
        "PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL"
    ),
    "country-alpha2": "AE AR AT AU BD BE BG BH BR CA CH CL CN CO CY CZ DE DK EG ES FI FR GB GH GR HK HR HU ID IE IL IN IS IT JO JP KE KR KW LB MA MX MY NG NL NO NZ OM PE PH PK PL PT QA RO RU SA SE SG TH TR TW TZ UA UG US VN ZA",
    "country-alpha3": (
        "ARE ARG AUS AUT BEL BGD BGR BHR BRA CAN CHE CHL CHN COL CYP CZE DEU DNK EGY ESP FIN FRA GBR GHA GRC HKG HRV HUN IDN IND IRL ISL ISR ITA JOR JPN KEN KOR KWT LBN MAR MEX MYS NGA NLD NOR NZL OMN PAK PER PHL POL PRT "
        "QAT ROU RUS SAU SGP SWE THA TUR TWN TZA UGA UKR USA VNM ZAF"
    ),
    "state-us": "AK AL AR AS AZ CA CO CT DC DE FL GA GU HI IA ID IL IN KS KY LA MA MD ME MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR RI SC SD TN TX UT VA VI VT WA WI WV WY",
}
#: Other names of formats, and the formats that an empty value does not meet.
SAME = {"date-time": "datetime", "credit-card": "creditcard", "swift": "bic"}
NOT_EMPTY = ("date-iso", "naic", "country-alpha2", "country-alpha3", "state-us", "routing", "cusip", "isin", "lei", "npi", "dea", "imei", "iccid")

NAMES = frozenset([*PATTERNS, *CODES, *SAME, "ipv6"])


def luhn(s: Column) -> Column:
    """The check sum of the digits of a text holds."""
    digits = F.transform(F.reverse(F.split(F.regexp_replace(s, r"\D", ""), "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _ipv6(v: Column) -> Column:
    """Eight groups, or up to eight with one ``::`` among them."""
    gap = F.contains(v, F.lit("::"))
    halves = F.split(v, "::", -1)
    groups = F.when(gap, F.flatten(F.transform(halves, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))))).otherwise(F.split(v, ":", -1))
    sized = F.when(gap, (F.size(halves) == 2) & ~F.contains(v, F.lit(":::")) & (F.size(groups) <= 8)).otherwise(F.size(groups) == 8)
    return sized & F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))


def meets(v: Column, name: str) -> Column:
    """``v`` is of the format; formats of no known name take everything."""
    name = SAME.get(name, name)
    if name in CODES:
        ok = v.isin(*CODES[name].split())
    elif name == "ipv6":
        ok = _ipv6(v)
    elif name in PATTERNS:
        ok = v.rlike(rf"^(?:{PATTERNS[name]})\z")
        if name == "creditcard":
            ok = ok & luhn(v)
    else:
        return F.lit(True)
    return ok if name in NOT_EMPTY else ok | (v == "")
