"""URL rules on plain strings: lenient splitting, comparison keys, source lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.text import bound

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
INTERNAL_NAMES = ["localhost", "metadata.google.internal"]


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")


def host(url: Column) -> Column:
    """Lower-case host name without user and port; empty if the text has none."""
    place = F.regexp_extract(_bare(url), rf"(?s){_SCHEME}//([^/?]*)", 1)
    name = F.regexp_replace(place, r"(?s)^.*@", "")
    return F.lower(F.regexp_extract(name, r"(?s)^\[?((?<=\[)[^\]]*|[^:]*)", 1))


def path(url: Column) -> Column:
    bare = F.regexp_replace(_bare(url), r"(?s)\?.*$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, rf"(?s){_SCHEME}//[^/]*", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!//)", "")
    return F.regexp_replace(rest, r"(?s);[^/]*$", "")


def query_pairs(url: Column) -> Column:
    """Sorted (k, v) pairs with a value, decoded, without tracking parameters."""
    raw = F.regexp_extract(_bare(url), r"(?s)^[^?]*\?(.*)$", 1)
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    pair = lambda x: F.struct(plain(F.regexp_extract(x, r"(?s)^([^=]*)=", 1)).alias("k"), plain(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.transform(F.split(raw, "&"), pair)
    return F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(fixed.TRACKING_PARAMS)))


def url_key(url: Column) -> Column:
    """struct(host, path, query) that is equal for addresses of the same page."""
    name = F.regexp_replace(host(url), r"^(?:www|m|mobile)\.", "")
    place = F.regexp_replace(path(url), r"/+$", "")
    return F.struct(name.alias("host"), F.when(place == "", "/").otherwise(place).alias("path"), query_pairs(url).alias("query"))


def is_site_root(url: Column) -> Column:
    return (F.regexp_replace(path(url), r"/+$", "") == "") & (F.size(query_pairs(url)) == 0)


def under(name: Column, domain: str) -> Column:
    """The domain itself or a subdomain."""
    return (name == domain) | F.endswith(name, F.lit("." + domain))


def source_risk(url: Column) -> Column:
    """high, medium, low or unknown: the first domain of the list that fits."""

    def of(name: Column) -> Column:
        risk = F.lit("unknown")
        for domain, level in reversed(fixed.SOURCE_RISK):
            risk = F.when(under(name, domain), level).otherwise(risk)
        return risk

    return bound(host(url), of)


def is_untrackable(url: Column, http_code: Column, reason: Column) -> Column:
    """Sources whose deletion cannot be seen; a 404 or 410 always can."""
    listed = bound(host(url), lambda h: under(h, fixed.UNTRACKABLE_DOMAINS[0]) | under(h, fixed.UNTRACKABLE_DOMAINS[1]))
    no = F.lit(False)
    hard = F.coalesce(http_code.isin(fixed.HARD_CODES), no)
    refused = F.coalesce(http_code.isin(fixed.BOT_BLOCK_CODES), no) | F.coalesce(reason == fixed.UNTRACKABLE_REASON, no)
    return F.when(hard, False).otherwise(listed | refused)


def host_header(url: Column) -> Column:
    """The host as a request header spells it: IPv6 in brackets, a port that is not the scheme's own."""
    place = F.regexp_replace(F.regexp_extract(_bare(url), rf"(?s){_SCHEME}//([^/?]*)", 1), r"(?s)^.*@", "")
    port = F.regexp_extract(place, r":(\d+)$", 1)
    name = F.when(F.contains(host(url), F.lit(":")), F.concat(F.lit("["), host(url), F.lit("]"))).otherwise(host(url))
    usual = F.when(F.startswith(F.lower(url), F.lit("https:")), "443").otherwise("80")
    return F.when((port == "") | (port == usual), name).otherwise(F.concat(name, F.lit(":"), port))


def is_public_address(url: Column) -> Column:
    """The part of the fetch guard that needs no name lookup: http(s), a host, no internal name, no private literal IP."""

    def of(h: Column) -> Column:
        private = r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(?:22[4-9]|23\d|24\d|25[0-5])\.|^::1?$|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:"
        inner = h.isin(INTERNAL_NAMES) | F.rlike(h, F.lit(r"\.(?:local|internal|localhost)$"))
        return (h != "") & ~inner & ~F.rlike(h, F.lit(private))

    return F.rlike(F.coalesce(url, F.lit("")), F.lit(r"(?i)^https?://")) & bound(host(url), of)
