"""Address columns: tests, parts and resolution against a base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions import constants as C
from webquarry.functions.text import let

_URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//([^/?#\\]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(c: Column, part: str) -> Column:
    """scheme, host (with port), path, query (with ``?``) or fragment (with ``#``)."""
    group = {"scheme": 1, "host": 3, "path": 4, "query": 5, "fragment": 6}[part]
    return F.regexp_extract(c, "(?s)" + _URL, group)


def hostname(c: Column) -> Column:
    host = F.regexp_replace(url_part(c, "host"), "^.*@", "")
    return F.lower(F.regexp_replace(host, r":\d*$", ""))


def origin(c: Column) -> Column:
    return F.lower(F.concat(url_part(c, "scheme"), F.lit("://"), url_part(c, "host")))


def is_http_url(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.coalesce(trimmed.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(
        F.trim(c).rlike(r"(?i)^(?:(?:https?|ftp|wss?):/*[^\s/?#]+|(?!(?:https?|ftp|wss?):)[a-z][a-z0-9+.\-]*:)"),
        F.lit(False),
    )


def is_convertible_url(c: Column, batch: bool = True) -> Column:
    """No address that only a browser can show; a single page is tested on three prefixes."""
    prefixes = C.BROWSER_SCHEMES if batch else C.BROWSER_SCHEMES[:3]
    ok = F.lit(True)
    for p in prefixes:
        ok = ok & ~c.startswith(p)
    return F.coalesce(c.isNotNull() & (c != "") & ok, F.lit(False))


_SAFE = r"!#$%&'()*+,\-./0-9:;=?@A-Z\[\]_a-z~|^\\"


def percent_encode(c: Column) -> Column:
    """UTF-8 percent signs for what an address may not hold."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    # what may stay, the percent sign itself last
    for sign in "!#$&'()+,/:;=?@[]~|^\\%":
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.when(c.rlike(f"[^{_SAFE}]"), out).otherwise(c)


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    return let(path, _without_dots)


def _without_dots(path: Column) -> Column:
    last = F.regexp_extract(path, "([^/]*)$", 1)
    parts = F.slice(F.split(path, "/"), 2, 1_000_000_000)
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    out = F.concat(F.lit("/"), F.array_join(walked, "/"))
    out = F.when(last.isin(".", "..") & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), out).otherwise(path)


def _normal_host(scheme: Column, host: Column) -> Column:
    host = F.lower(host)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    return F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def _resolved(v: Column) -> Column:
    """From ``struct(given, ref, base)`` to ``struct(start, path, tail)``; null: leave it."""
    ref, base = v["ref"], v["base"]
    scheme = F.lower(url_part(base, "scheme"))
    host = url_part(base, "host")
    path = F.when(url_part(base, "path") == "", F.lit("/")).otherwise(url_part(base, "path"))
    own_scheme = F.lower(url_part(ref, "scheme"))
    special = own_scheme.isin("http", "https", "ftp", "ws", "wss")
    rel_path = F.regexp_extract(ref, r"(?s)^(?://[^/?#]*)?([^?#]*)", 1)
    rest = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)

    def parts(s, h, p, tail):
        start = F.concat(s, F.lit("://"), _normal_host(s, h))
        full = F.when(p == "", F.lit("/")).otherwise(p)
        return F.struct(start.alias("start"), full.alias("path"), tail.alias("tail"))

    return (
        F.when(
            special & (url_part(ref, "host") != ""),
            parts(own_scheme, url_part(ref, "host"), url_part(ref, "path"),
                  F.concat(url_part(ref, "query"), url_part(ref, "fragment"))),
        )
        .when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:") | base.isNull() | (host == ""), F.lit(None))
        .when(ref.startswith("//"),
              parts(scheme, F.regexp_extract(ref, "^//([^/?#]*)", 1), rel_path, rest))
        .when(ref == "", parts(scheme, host, path, url_part(base, "query")))
        .when(ref.startswith("#"), parts(scheme, host, path, F.concat(url_part(base, "query"), ref)))
        .when(ref.startswith("?"), parts(scheme, host, path, rest))
        .when(ref.startswith("/"), parts(scheme, host, rel_path, rest))
        .otherwise(parts(scheme, host,
                         F.concat(F.regexp_extract(path, "(?s)^(.*/)", 1), rel_path), rest))
    )


def absolutize(c: Column, base: Column, keep_hash: bool = False) -> Column:
    """Resolve an address against the page's; what cannot be resolved is left as it is."""

    def put(v: Column) -> Column:
        found = let(
            _resolved(v),
            lambda r: F.concat(
                r["start"], percent_encode(_remove_dots(r["path"])), percent_encode(r["tail"])
            ),
        )
        out = F.coalesce(found, F.when(special_without_host(v["ref"]), v["given"])
                         .otherwise(F.coalesce(
                             F.when(v["ref"].rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), v["ref"]),
                             v["given"])))
        if keep_hash:
            out = F.when(v["given"].startswith("#"), v["given"]).otherwise(out)
        return out

    clean = F.regexp_replace(F.btrim(c, F.lit(" \t\r\n\f")), r"[\t\r\n]", "")
    return let(F.struct(c.alias("given"), clean.alias("ref"), base.alias("base")), put)


def special_without_host(ref: Column) -> Column:
    return ref.rlike(r"(?i)^(https?|ftp|wss?):/*([?#]|$)")


def absolutize_srcset(c: Column, base: Column) -> Column:
    """Every address of a ``srcset``, with its descriptor kept."""
    item = r"\S+(?:\s+[\d.]+[xw])?\s*(?:,|$)|\s+"
    pieces = F.regexp_extract_all(c, F.lit(item), F.lit(0))

    def one(p: Column) -> Column:
        url = F.regexp_extract(p, r"^(\S+?)(?:\s+[\d.]+[xw])?\s*,?$", 1)
        rest = F.substring(p, F.length(url) + 1, F.length(p))
        return F.when(url == "", p).otherwise(F.concat(absolutize(url, base), rest))

    return F.array_join(F.transform(pieces, one), "")


def matched_host(host: Column, hosts=C.LAZY_HOSTS) -> Column:
    """The first known host that equals the host or is a parent domain of it."""
    out = F.lit(None).cast("string")
    for h in reversed(list(hosts)):
        out = F.when((host == h) | host.endswith("." + h), F.lit(h)).otherwise(out)
    return out
