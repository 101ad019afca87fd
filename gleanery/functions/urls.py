"""Canonical addresses, identities and crawl scope, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track, and signs a path keeps as they are
TRACKING = (
    r"(?i)^(utm_[a-z0-9_]+|gclid|dclid|gbraid|wbraid|fbclid|msclkid|yclid|twclid|igshid|"
    r"mc_cid|mc_eid|_ga|_gl|_hsenc|_hsmi|mkt_tok|ref_src|li_fat_id|s_cid|oly_[a-z_]+)$"
)
SAFE_PATH = "/%:@!$&'()*+,;=-._~"

_ADDRESS = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"
_NO_LINK = r"(?i)^(#|mailto:|tel:|javascript:|data:)"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _ADDRESS, n)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _path(raw: Column) -> Column:
    """One spelling of a path: repeated slashes joined, escapes only where needed."""
    joined = F.regexp_replace(F.when(raw == "", F.lit("/")).otherwise(raw), "/{2,}", "/")
    out = F.replace(F.url_encode(_decoded(F.replace(joined, F.lit("+"), F.lit("%2B")))), F.lit("+"), F.lit("%20"))
    for sign in sorted(SAFE_PATH, key=lambda c: c == "%"):  # the escape sign itself comes last
        if not (sign.isalnum() or sign in "*-._"):
            out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def _query(raw: Column) -> Column:
    """Parameters in order of name and value, without those that only track."""
    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))

    def spelled(c: Column) -> Column:
        return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    return F.array_join(F.transform(kept, lambda p: F.concat(spelled(p["k"]), F.lit("="), spelled(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """http(s) address with lower-case scheme and host, no default port, fragment,
    user or tracking parameter; null for anything else. Hosts keep their letters."""
    scheme = F.lower(_part(url, 1))
    host = F.lower(F.regexp_replace(_part(url, 2), r"\.+$", ""))
    port = _part(url, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    query = _query(_part(url, 5))
    return F.when(
        (scheme != "") & (host != ""),
        F.concat(
            scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
            _path(_part(url, 4)), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def site(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")


def identity(canonical_url: Column) -> Column:
    """What makes two canonical addresses one page: scheme and www do not count."""
    return F.regexp_replace(canonical_url, r"^https?://(www\.)?", "//")


def page_hash(url: Column) -> Column:
    return F.sha2(identity(canonical(url)), 256)


def page_id(url: Column) -> Column:
    return F.concat(F.lit("w-"), F.substring(page_hash(url), 1, 16))


def scope(start: Column) -> Column:
    """Directory a crawl that starts at an address stays under."""
    path = F.when(_part(start, 4) == "", F.lit("/")).otherwise(_part(start, 4))
    last = F.regexp_extract(path, "([^/]*)$", 1)
    return (
        F.when(path.endswith("/"), path)
        .when(last.contains("."), F.regexp_extract(path, "^(.*/)[^/]*$", 1))
        .otherwise(F.concat(path, F.lit("/")))
    )


def in_scope(url: Column, start: Column) -> Column:
    """Same site and under the start's directory."""
    path = F.when(_part(url, 4) == "", F.lit("/")).otherwise(_part(url, 4))
    under = scope(start)
    return (site(url) == site(start)) & (site(url) != "") & (
        (under == "/") | path.startswith(under) | (path == F.regexp_replace(under, "/$", ""))
    )


def absolute(base: Column, href: Column) -> Column:
    """Canonical address of a link on a page; null for fragments and other schemes."""
    h = F.trim(F.coalesce(href, F.lit("")))
    root = F.concat(F.lower(_part(base, 1)), F.lit("://"), _part(base, 2), F.when(_part(base, 3) == "", F.lit("")).otherwise(F.concat(F.lit(":"), _part(base, 3))))
    folder = F.regexp_replace(F.when(_part(base, 4) == "", F.lit("/")).otherwise(_part(base, 4)), "[^/]*$", "")
    full = (
        F.when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(_part(base, 1), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, _part(base, 4), h))
        .otherwise(F.concat(root, folder, F.regexp_replace(h, r"^(\./)+", "")))
    )
    return F.when((h != "") & ~h.rlike(_NO_LINK), canonical(full))
