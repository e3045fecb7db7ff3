"""Column functions for factors, forecasts, feeds and landed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of forum titles, hosts by kind, the number of characters kept of a post.
POST_TAGS = {"[標的]": "target", "[請益]": "question", "[心得]": "review", "[新聞]": "news", "[閒聊]": "chat"}
POST_END = "※ 發信站"
STATE_HOSTS = ("rt.com", "sputniknews.com", "xinhua.net", "globaltimes.cn", "presstv.ir")
PARTISAN_HOSTS = ("breitbart.com", "infowars.com", "occupydemocrats.com", "dailykos.com")
PAYWALL_HOSTS = ("wsj.com", "ft.com", "nytimes.com", "bloomberg.com", "economist.com")
POST_CHARS = 2000


def cents(x: Column, digits: int = 2) -> Column:
    """Rounding half up by magnitude, in which the binary neighbours of a half count as the half."""
    return F.round(x + F.signum(x) * 1e-9, digits)


def z_weight(z: Column) -> Column:
    """1 + z for z of 0 or more, 1 / (1 - z) below; null stays null."""
    return F.when(z >= 0, 1 + z).when(z < 0, F.try_divide(F.lit(1.0), 1 - z))


def edge(p: Column, price: Column) -> Column:
    return cents(p - price, 4)


def kelly(p: Column, odds: Column) -> Column:
    """The Kelly share of capital; 0 without odds, for p of 0 or less, and for p of 1 or more."""
    share = F.greatest(F.lit(0.0), F.try_divide(odds * p - (1 - p), odds))
    return F.when((odds <= 0) | (p <= 0) | (p >= 1), F.lit(0.0)).otherwise(share)


def bet_size(p: Column, price: Column, fraction: float = 0.25, most: float = 1.0) -> Column:
    """A fraction of Kelly on the side that the edge favours, ``most`` at most; 0 for a price of 0 or 1."""
    yes = kelly(p, F.try_divide(F.lit(1.0), price) - 1)
    no = kelly(1 - p, F.try_divide(F.lit(1.0), 1 - price) - 1)
    size = F.least(F.when(p > price, yes).otherwise(no) * fraction, F.lit(most))
    return F.when((price <= 0) | (price >= 1), F.lit(0.0)).otherwise(cents(size))


def limit_price(price: Column, direction: Column, offset: float = 0.005) -> Column:
    raw = F.when(direction == "YES", price + offset).otherwise(price - offset)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), cents(raw)))


def trade_cost(size: Column, price: Column, direction: Column) -> Column:
    return cents(F.when(direction == "YES", size * price).otherwise(size * (1 - price)))


def payoff(size: Column, price: Column, direction: Column, outcome: Column) -> Column:
    """What a resolved trade earned; any outcome but 1 is a loss of its cost, an open trade has null."""
    cost = F.when(direction == "YES", size * price).otherwise(size * (1 - price))
    return F.when(outcome == 1.0, size - cost).when(outcome.isNotNull(), -cost)


def open_trade(status: Column, outcome: Column) -> Column:
    return outcome.isNull() & (status != "cancelled")


def bucket_index(p: Column, width: float = 0.1) -> Column:
    return F.floor(p / F.lit(width))


def bucket_label(index: Column, width: float = 0.1) -> Column:
    step = round(100 * width)
    return F.concat((index * step).cast("string"), F.lit("%-"), ((index + 1) * step).cast("string"), F.lit("%"))


def finite(c: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(text: Column) -> Column:
    """A number out of text: thousands commas go, '(1.23)' is negative, what is none is null."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast("double")


def sentinel_null(text: Column, sentinel: str = "不適用") -> Column:
    return F.nullif(text, F.lit(sentinel))


def post_type(title: Column) -> Column:
    found = None
    for tag, name in POST_TAGS.items():
        found = F.when(title.startswith(tag), name) if found is None else found.when(title.startswith(tag), name)
    return found.otherwise("general")


def code_mentions(text: Column) -> Column:
    """All four-digit codes that no letter, digit or underscore touches."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(\d{4})(?![\p{L}\p{N}_])"), F.lit(1))


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def host(url: Column) -> Column:
    """The host of a URL without www."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def source_quality(name: Column) -> Column:
    return F.when(name.isin(*STATE_HOSTS), "state_media").when(name.isin(*PARTISAN_HOSTS), "partisan").when(name.isin(*PAYWALL_HOSTS), "paywall")


def post_body(text: Column, marker: str = POST_END) -> Column:
    """The text before ``marker``, if that is not at its start, trimmed and cut to POST_CHARS."""
    at = F.locate(marker, text)
    body = F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return F.left(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(POST_CHARS))


def ideographic(text: Column) -> Column:
    """Ideographic spaces as spaces, and '2013年第1季' as '2013Q1'."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("　"), F.lit(" ")), "年第", "Q"), "季", "")


def row_id(*keys: Column) -> Column:
    """An id that repeated runs give again."""
    return F.sha2(F.concat_ws("|", *(k.cast("string") for k in keys)), 256)


def market_cap(shares: Column, close: Column) -> Column:
    return shares / 10 * close


def enterprise_value(cap: Column, debt: Column, cash: Column) -> Column:
    return cap + debt - cash


def repurchase_rate(shares: Column, shares_before: Column, close: Column, cap: Column) -> Column:
    """Change in shares at market value, relative to the market cap; more shares count as positive."""
    return F.try_divide((shares - shares_before) * close, cap)


def blend(*parts: tuple[float, Column]) -> Column:
    """A weighted sum; null if any part is null."""
    total = None
    for weight, part in parts:
        total = weight * part if total is None else total + weight * part
    return total
