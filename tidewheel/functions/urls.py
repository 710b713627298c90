"""URL column functions: cleaning, extraction, noise and junk tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, f"(?s){_PARTS}", i)


def netloc(url: Column) -> Column:
    return _part(url, 2)


def _decode(c: Column) -> Column:
    """Form decoding; a percent sign that starts no escape stays."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def is_tracking(name: Column) -> Column:
    n = F.lower(name)
    found = n.isin(V.TRACKING_PARAMS)
    for p in V.TRACKING_PREFIXES:
        found = found | n.startswith(p)
    return found


def clean_query(query: Column) -> Column:
    """Parameters with a value that track nobody, in order, encoded anew."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("=") & (F.length(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)) > 0))
    pairs = F.transform(pairs, lambda p: F.struct(_decode(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"), _decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: ~is_tracking(p["k"]))
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def clean_url(url: Column) -> Column:
    """Canonical form without tracking; ``error`` for a port that is no number, null for null."""
    u = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    scheme = F.when(_part(u, 1) == "", "https").otherwise(F.lower(_part(u, 1)))
    place = F.regexp_replace(netloc(u), "^.*@", "")
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    bad = (port != "") & ((~port.rlike("^[0-9]+$")) | (port.try_cast("int") > 65535))
    number = port.try_cast("int")
    default = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    shown = F.when((port != "") & ~default, F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    host = F.concat(F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), r"^www\.", ""), shown)
    raw_path = F.when(_part(u, 3) == "", "/").otherwise(_part(u, 3))
    path = F.when(raw_path == "/", "/").otherwise(F.regexp_replace(raw_path, "/+$", ""))
    query = clean_query(_part(u, 4))
    done = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.isNull(), None).when(bad, "error").otherwise(done)


def extract_urls(text: Column, extra: Column | None = None) -> Column:
    """http(s) URLs of a text without closing punctuation, then the extra ones; each once, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))
    if extra is not None:
        more = F.filter(F.coalesce(extra, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))
        found = F.concat(found, more)
    return F.array_distinct(found)


def is_junk_url(url: Column) -> Column:
    return (F.length(url) > V.MAX_URL_LENGTH) | (F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit(""))) > V.MAX_URL_SLASHES)


def is_noise_url(url: Column) -> Column:
    """Host among the noise hosts, after all leading ``w`` and ``.`` characters are dropped."""
    return F.regexp_replace(F.lower(netloc(url)), "^[w.]+", "").isin(V.NOISE_HOSTS)
