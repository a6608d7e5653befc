"""Web and repository URLs as column expressions; Python only spells out hosts beyond ASCII.

A URL is taken apart by the generic syntax of RFC 3986 (appendix B) and put together again:
scheme and host in lower case, no default port, unreserved characters decoded and other
escapes in capitals, no dot or empty segments, no fragment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Repository hosts known from the start.
REPOSITORY_HOSTS = ("github.com", "gitlab.com")
_PARTS = r"(?s)^(?i:(https?)):(?://([^/?#]*))([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_AUTHORITY = r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]@]+)(?::(\d{0,5}))?$"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


@F.pandas_udf(T.StringType())
def _idna(s: pd.Series) -> pd.Series:
    def one(host: str) -> str | None:
        try:
            return host.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return s.map(one, na_action="ignore")


def ascii_host(host: Column) -> Column:
    """The host in lower-case ASCII; names beyond it by IDNA.  Null if a label is empty or too long."""
    plain = host.rlike(r"^\p{ASCII}*$")
    spelled = F.when(plain, F.lower(host)).otherwise(_idna(F.when(~plain, host)))
    return F.when(spelled.rlike(r"^(?:[^.]{1,63}\.)*[^.]{1,63}\.?$"), F.regexp_replace(spelled, r"\.$", ""))


def url_parts(c: Column) -> Column:
    """struct(scheme, host, site, path, query, fragment) of an HTTP(S) URL without user information; null if it isn't one.

    ``site`` is the host with its port where that isn't the scheme's own.
    """
    part = lambda i: F.regexp_extract(c, _PARTS, i)
    authority = part(2)
    name = F.regexp_extract(authority, _AUTHORITY, 1)
    port = F.regexp_extract(authority, _AUTHORITY, 2).try_cast("int")
    fits = c.rlike(_PARTS) & ~c.rlike(r"^\s|\s$") & authority.rlike(_AUTHORITY) & F.coalesce(port <= 65535, F.lit(True))
    scheme = F.lower(part(1))
    host = F.when(name.startswith("["), F.lower(name)).otherwise(ascii_host(name))
    usual = F.when(scheme == "http", 80).otherwise(443)
    site = F.concat(host, F.when(port.isNotNull() & (port != usual), F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    return F.when(fits & host.isNotNull(), F.struct(scheme.alias("scheme"), host.alias("host"), site.alias("site"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment")))


def _escapes(path: Column) -> Column:
    """Escapes of letters, digits, ``-._~`` decoded, all others with capital digits."""
    pieces = F.split(path, "%")

    def one(piece: Column, i: Column) -> Column:
        code = F.substring(piece, 1, 2)
        char = F.chr(F.conv(code, 16, 10).cast("bigint"))
        rest = F.substring(piece, 3, 1 << 30)
        done = F.when(char.rlike(r"^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(code), rest))
        return F.when(i == 0, piece).when(code.rlike("^[0-9A-Fa-f]{2}$"), done).otherwise(F.concat(F.lit("%"), piece))

    return F.array_join(F.transform(pieces, one), "")


def _segments(path: Column) -> Column:
    """The path without dot and empty segments; a slash at its end stays."""
    none = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s.isin("", "."), kept).otherwise(F.array_append(kept, s))
    kept = F.aggregate(F.split(path, "/"), none, step)
    return F.when(F.size(kept) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.endswith("/"), "/").otherwise("")))


def canonicalize_url(c: Column) -> Column:
    """Canonical web URL, null if the text is none."""

    def whole(u: Column) -> Column:
        query = F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise("")
        return F.when(u.isNotNull(), F.concat(u["scheme"], F.lit("://"), u["site"], let(_escapes(u["path"]), _segments), query))

    return let(url_parts(c), whole)


def _public(host: Column) -> Column:
    """The ASCII host if it is a DNS name of several labels and no address."""
    named = host.rlike(rf"^(?:{_LABEL}\.)+{_LABEL}$") & (F.length(host) <= 253) & ~host.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    return F.when(named, host)


def normalize_repository_host(c: Column) -> Column:
    """Lower-case public DNS name, null if the text is none."""
    return let(F.when(~c.rlike(r"[\s/\\@:*]"), ascii_host(c)), _public)


def normalize_repository_url(c: Column, hosts: Sequence[str] = (), explicit: Column | None = None) -> Column:
    """struct(canonical_url, host, path) of a project root; null if it isn't one on a known host (any host if explicit)."""
    known = F.array(*(F.lit(h) for h in (*REPOSITORY_HOSTS, *hosts)))
    grouped = F.array(*(F.lit(h) for h in (*REPOSITORY_HOSTS[1:], *hosts)))
    asked = F.lit(False) if explicit is None else explicit

    def root(x: Column) -> Column:
        host, path, pieces = x["host"], x["path"], F.split(x["path"], "/")
        whole = ~path.rlike(r"[\s\\]") & (F.size(pieces) >= 2) & ~F.exists(pieces, lambda p: p.isin("", ".", ".."))
        own = F.when(host == "github.com", F.size(pieces) == 2).otherwise(~(F.array_contains(grouped, host) & F.array_contains(pieces, "-")))
        fits = whole & own & (F.array_contains(known, host) | asked)
        return F.when(fits, F.struct(F.concat(x["scheme"], F.lit("://"), x["site"], F.lit("/"), path).alias("canonical_url"), host.alias("host"), path.alias("path")))

    def split(u: Column) -> Column:
        path = F.coalesce(F.try_url_decode(F.replace(u["path"], F.lit("+"), F.lit("%2B"))), u["path"])
        path = F.regexp_replace(F.regexp_replace(path, r"(?s)^/?(.*?)/?$", "$1"), r"(?i)\.git$", "")
        plain = u.isNotNull() & (u["query"] == "") & (u["fragment"] == "")
        return let(F.struct(F.when(plain, _public(u["host"])).alias("host"), path.alias("path"), u["scheme"].alias("scheme"), u["site"].alias("site")), root)

    return let(url_parts(c), split)
