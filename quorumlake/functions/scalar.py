"""Column functions: names, money, dates, markets, markup. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that look like tickers but are none.
NOT_TICKERS = ["THE", "NEW", "OLD", "FRANCE", "USA", "USD", "INC", "CORP", "CO", "LTD", "LLC", "AND", "OF", "FUND", "TRUST", "PFD", "ADR", "ETF", "REIT", "GROUP", "MGMT", "CLASS", "SERIES", "DELAWARE", "NEVADA", "TEXAS"]
# Disclosed amount ranges with their bounds in dollars; the last has no upper bound.
AMOUNT_RANGES = [("$1,001 - $15,000", 1001, 15000), ("$15,001 - $50,000", 15001, 50000), ("$50,001 - $100,000", 50001, 100000), ("$100,001 - $250,000", 100001, 250000), ("$250,001 - $500,000", 250001, 500000), ("$500,001 - $1,000,000", 500001, 1000000), ("$1,000,001 - $5,000,000", 1000001, 5000000), ("$5,000,001 - $25,000,000", 5000001, 25000000), ("$25,000,001 - $50,000,000", 25000001, 50000000), ("Over $50,000,000", 50000001, None)]
# Accented letters and what they fold to.
ACCENTED, FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def effective_total(receipts: Column, individual: Column, small: Column, pac: Column) -> Column:
    """Receipts if positive, else the larger individual measure plus PAC money; nulls are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.when(zero(receipts) > 0, receipts).otherwise(F.greatest(zero(individual), zero(small)) + zero(pac)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded 100 * part / whole; 0 where whole is 0 or null."""
    return F.when(whole > 0, F.round(100 * part / whole)).otherwise(0).cast("long")


def fmt_money(x: Column) -> Column:
    """$0, $nK or $x.xM by integer rounding; below a thousand with the plain number."""
    n = F.coalesce(x.cast("long"), F.lit(0))
    tenths, thousands = F.floor((n + 50_000) / 100_000), F.floor((n + 500) / 1000)
    millions = F.concat(F.lit("$"), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("M"))
    return F.when(n >= 1_000_000, millions).when(n >= 1000, F.concat(F.lit("$"), thousands.cast("string"), F.lit("K"))).otherwise(F.concat(F.lit("$"), n.cast("string")))


def fold_name(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, FOLDED)


def strip_suffix(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?i),\s*(jr|sr|i{1,3}|iv|v)\.?$", ""))


def parse_us_date(x: Column) -> Column:
    """M/D/YYYY or M/D/YY (20YY) to a date; anything else null."""
    year = F.regexp_extract(F.trim(x), r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$", 1)
    day = F.regexp_extract(F.trim(x), r"^(\d{1,2}/\d{1,2}/)", 1)
    return F.when(year != "", F.try_to_date(F.concat(day, F.when(F.length(year) == 2, "20").otherwise(""), year), "M/d/yyyy"))


def parse_ballot_date(x: Column) -> Column:
    """``3-Jan-2025`` or ``January 9, 2025, ...``."""
    long = F.regexp_extract(x, r"^\s*([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    short = F.regexp_extract(x, r"^\s*(\d{1,2}-[A-Z][a-z]{2}-\d{4})", 1)
    return F.coalesce(F.when(short != "", F.try_to_date(short, "d-MMM-yyyy")), F.when(long != "", F.try_to_date(long, "MMMM d, yyyy")))


def parse_feed_date(x: Column) -> Column:
    """RFC-822 or ISO time stamps; anything else null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC)$", "+0000"))
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), x.try_cast("timestamp"))


def norm_position(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin("yea", "aye"), "yea").when(v.isin("nay", "no"), "nay").when(v == "present", "present").otherwise("not_voting")


def norm_party(x: Column) -> Column:
    return F.when(x == "Libertarian", "Independent").otherwise(x)


def chamber_from_type(x: Column) -> Column:
    return F.when(x == "sen", "senate").otherwise("house")


def norm_role(x: Column) -> Column:
    return F.when(x.isin("Chair", "Chairman"), "chair").when(x == "Ranking Member", "ranking_member").when(x.isin("Vice Chair", "Vice Chairman"), "vice_chair").otherwise("member")


def map_owner(x: Column) -> Column:
    v = F.lower(x)
    return F.when(v.contains("spouse"), "SP").when(v.contains("dependent") | v.contains("child"), "DC").when(v.contains("joint"), "JT")


def map_tx_type(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.contains("partial"), "S (partial)").when(v.startswith("p") | v.contains("purchase") | v.contains("buy"), "P").when(v.contains("exchange"), "E").otherwise("S")


# Words in an asset's kind and what they mean; the first that is found counts.
ASSET_WORDS = [("stock", "Stock"), ("equity", "Stock"), ("bond", "Bond"), ("note", "Bond"), ("muni", "Bond"), ("option", "Option"), ("fund", "Fund"), ("etf", "Fund"), ("mutual", "Fund"), ("crypto", "Cryptocurrency")]


def map_asset_type(x: Column) -> Column:
    """The kind by its words, else the trimmed text; empty texts are null."""
    v = F.lower(x)
    found = F.when(v.contains(ASSET_WORDS[0][0]), ASSET_WORDS[0][1])
    for word, name in ASSET_WORDS[1:]:
        found = found.when(v.contains(word), name)
    return found.otherwise(F.nullif(F.trim(x), F.lit("")))


def amount_bucket(x: Column) -> Column:
    """struct<label, low, high> of the range that a text names, whatever its case and spaces; others are the lowest, the last has no high."""
    out = None
    for label, low, high in AMOUNT_RANGES:
        pattern = "(?i)" + r"\s*-\s*".join(part.replace("$", r"\$").replace(" ", r"\s*") for part in label.split(" - "))
        value = F.struct(F.lit(label).alias("label"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
        out = F.when(x.rlike(pattern), value) if out is None else out.when(x.rlike(pattern), value)
    label, low, high = AMOUNT_RANGES[0]
    return out.otherwise(F.struct(F.lit(label).alias("label"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")))


def mid_amount(low: Column, high: Column) -> Column:
    """The middle of two bounds, the one there is, else 1000."""
    return F.coalesce((low + high) / 2, low.cast("double"), high.cast("double"), F.lit(1000.0))


def tx_label(x: Column) -> Column:
    return F.when(x == "P", "Purchase").when(x == "S", "Sale").when(x == "S (partial)", "Partial sale").when(x == "E", "Exchange").otherwise(x)


def seat_label(chamber: Column, district: Column) -> Column:
    """``Senator``, ``District n``, or ``At-Large`` for district 0 or none."""
    return F.when(chamber == "senate", "Senator").when(F.coalesce(district, F.lit(0)) > 0, F.concat(F.lit("District "), district.cast("string"))).otherwise("At-Large")


def chamber_label(chamber: Column) -> Column:
    return F.when(chamber == "house", "House").otherwise("Senate")


def source_label(chamber: Column) -> Column:
    """In which form a chamber publishes filings."""
    return F.when(chamber == "senate", "HTML").otherwise("PDF")


def display_last_name(x: Column) -> Column:
    return F.try_element_at(F.split(F.trim(x), r"\s+"), F.lit(-1))


def role_label(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit(" "))


def stats_json(**columns: Column) -> Column:
    """The columns as one JSON object, nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})


def age_label(hours: Column) -> Column:
    return F.when(hours.isNull(), "—").when(hours < 1, "< 1 hour ago").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def clean_ticker(ticker: Column, description: Column) -> Column:
    """The ticker, or the first ``(ABC)`` of the description; null if blacklisted or only a bracketed code."""
    t = F.coalesce(F.nullif(ticker, F.lit("")), F.nullif(F.regexp_extract(description, r"\(([A-Z]{1,6})\)", 1), F.lit("")))
    code = F.contains(description, F.concat(F.lit("["), t, F.lit("]"))) & ~F.contains(description, F.concat(F.lit("("), t, F.lit(")")))
    return F.when(t.isin(NOT_TICKERS) | F.coalesce(code, F.lit(False)), None).otherwise(t)


def valid_ticker(x: Column) -> Column:
    return x.rlike(r"^[A-Z][A-Z0-9.\-]{0,7}$")


def html_text(x: Column) -> Column:
    """Tags to spaces, seven common entities decoded, ``&amp;`` first (so what it spells out is decoded too), white space collapsed."""
    out = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#35;", "#"), ("&#39;", "'"), ("&quot;", '"'), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def xml_tag(x: Column, tag: str) -> Column:
    """The trimmed body of the first such tag, CDATA unwrapped; empty if there is none."""
    body = F.regexp_extract(x, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(body, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))


def item_from_text(x: Column, congress: Column) -> Column:
    """``H R 12``, ``S 5``, ``H J RES 3``, whatever follows, to an item id, else null."""
    compact = F.lower(F.regexp_replace(x, r"[\s.]+", ""))
    pattern = r"^(hr|s|hjres|sjres|hres|sres|hconres|sconres)(\d+)"
    kind, number = F.regexp_extract(compact, pattern, 1), F.regexp_extract(compact, pattern, 2)
    return F.when(kind != "", F.concat_ws("-", kind, number, congress.cast("string")))
