"""Column rules for the hit log: automation, networks, pages and text filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark automation, hosting networks and relays, and the page patterns.
AUTOMATION_WORDS = (
    "bot", "spider", "crawl", "python", "curl", "wget", "go-http", "scan",
    "okhttp", "java/", "headless", "node-fetch", "axios", "libwww",
)
HOSTING_WORDS = (
    "amazon", "microsoft", "azure", "google cloud", "ovh", "hetzner",
    "digitalocean", "linode", "oracle", "alibaba", "tencent", "leaseweb",
    "datacamp", "m247", "scaleway", "censys", "palo alto", "vultr", "contabo",
    "choopa", "godaddy", "hostinger",
    "code200", "oxylabs", "tesonet", "bright data", "luminati", "smartproxy",
    "iproyal", "packetstream", "webshare",
)
RELAY_WORDS = ("cloudflare", "akamai", "fastly", "vpn")
BROWSER = r"(?i)mozilla/.*(safari|chrome|crios|firefox|fxios|edg|opr|samsungbrowser|version/)"
BARE_COORDINATES = r"^/-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?$"
CONTENT_PAGE = r"^/[^/]+/[^/]+/[^/]+"
PAGE_COORDINATES = r"^/(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)"
PAGE_METRIC = r"/(tmax|tmin|precip|wind)(?:[/?#]|$)"
TIER_FILE = r"/forecast/forecast_(-?\d+\.\d+)_(-?\d+\.\d+)\.csv"
CARD_PAGE = r"^/(-?\d+\.\d+),(-?\d+\.\d+)/(\d{4}-\d{2}-\d{2})/(\w+)"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
METRIC_WORDS = ("tmax", "tmin", "precip", "wind")


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    pattern = "|".join(w.replace(".", r"\.") for w in words)
    return F.coalesce(F.lower(text), F.lit("")).rlike(pattern)


def automation(ua: Column) -> Column:
    """An agent that says it is automated; no behaviour outweighs this."""
    return _any_word(ua, AUTOMATION_WORDS)


def bot_signature(asn_org: Column, ua: Column, page: Column, ts: Column, bare_since: str) -> Column:
    """Hosting network, relay without a browser, or a bare coordinate page after a cutoff."""
    relay = _any_word(asn_org, RELAY_WORDS) & ~F.coalesce(ua, F.lit("")).rlike(BROWSER)
    bare = F.coalesce(page.rlike(BARE_COORDINATES), F.lit(False)) & (ts >= F.lit(bare_since).cast("timestamp_ntz"))
    return _any_word(asn_org, HOSTING_WORDS) | relay | bare


def content_page(page: Column) -> Column:
    return F.coalesce(page.rlike(CONTENT_PAGE), F.lit(False))


def page_metric(page: Column) -> Column:
    found = F.regexp_extract(page, PAGE_METRIC, 1)
    return F.when(found != "", found)


def page_coordinates(page: Column) -> tuple[Column, Column]:
    lat = F.regexp_extract(page, PAGE_COORDINATES, 1)
    lon = F.regexp_extract(page, PAGE_COORDINATES, 2)
    return F.when(lat != "", lat.cast("double")), F.when(lon != "", lon.cast("double"))


def share_path(page: Column) -> Column:
    """A shareable page: coordinates in range, an ISO date and a known metric."""
    parts = F.filter(F.split(page, "/"), lambda s: s != "")
    lat, lon = (F.element_at(F.split(F.get(parts, 0), ","), i).try_cast("double") for i in (1, 2))
    ok = (
        (F.size(parts) >= 3)
        & (F.size(F.split(F.get(parts, 0), ",")) == 2)
        & lat.between(-90, 90)
        & lon.between(-180, 180)
        & F.get(parts, 1).rlike(ISO_DATE)
        & F.get(parts, 2).isin(*METRIC_WORDS)
    )
    return F.coalesce(ok, F.lit(False))


def text_match(value: Column, spec: str) -> Column:
    """``"a, b"`` keeps rows with either word; ``"~x"`` drops rows with the word."""
    include, exclude = [], []
    for term in (t.strip().lower() for t in spec.split(",")):
        if term.startswith("~"):
            exclude += [term[1:].strip()] if term[1:].strip() else []
        elif term:
            include.append(term)
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    ok = F.lit(True)
    for term in exclude:
        ok = ok & ~F.contains(text, F.lit(term))
    if include:
        wanted = F.lit(False)
        for term in include:
            wanted = wanted | F.contains(text, F.lit(term))
        ok = ok & wanted
    return ok
