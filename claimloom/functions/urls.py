"""URL functions as columns; malformed URLs give null and a reason, never an error."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from claimloom.functions.text import nz

# Hosts of messengers and networks, whose links are no endpoints of a group.
MESSENGERS = (
    "t.me", "telegram.me", "telegram.org", "discord.com", "discord.gg", "wa.me", "whatsapp.com", "signal.me", "session.foundation",
    "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "youtu.be", "reddit.com",
)
#: scheme, user part, host, port, path, query of a URL without its fragment.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]*)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def _trimmed(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), r"""^["'<>.,;]+|["'<>.,;]+$""", "")
    return F.when(F.lower(t).rlike(r"\.onion(?:/|$)") & ~t.contains("://"), F.concat(F.lit("http://"), t)).otherwise(t)


def part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _PARTS, i)


def url_error(c: Column) -> Column:
    """Why a URL isn't usable: ``invalid_url`` or ``unsupported_scheme``; null where it is."""
    t = _trimmed(c)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    port = part(t, 4)
    return (
        F.when(t == "", "invalid_url")
        .when(~scheme.isin("http", "https"), "unsupported_scheme")
        .when((part(t, 3) == "") | (part(t, 2) != "") | ((port != "") & (port.try_cast("int").isNull() | (port.try_cast("int") > 65535))), "invalid_url")
    )


def normalize_url(c: Column) -> Column:
    """Scheme in lower case, path at least ``/``, no fragment; the host's case stays. Null where ``url_error`` isn't."""
    t = _trimmed(c)
    port, query = part(t, 4), part(t, 6)
    built = F.concat(
        F.lower(part(t, 1)), F.lit("://"), part(t, 3), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""),
        F.coalesce(nz(part(t, 5)), F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(url_error(c).isNull(), built)


def canonical_url(c: Column) -> Column:
    """``normalize_url`` with the host in lower case, no slash at the path's end and the query's parameters sorted."""
    u = normalize_url(c)
    port, query = part(u, 4), part(u, 6)
    path = F.coalesce(nz(F.regexp_replace(part(u, 5), r"/+$", "")), F.lit("/"))
    return F.concat(
        part(u, 1), F.lit("://"), F.lower(part(u, 3)), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path,
        F.when(query != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise(""),
    )


def host(c: Column) -> Column:
    """The host in lower case, empty where there is none."""
    return F.lower(F.coalesce(part(F.trim(c), 3), F.lit("")))


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def slug(c: Column) -> Column:
    """The last segment of the decoded path, null for none, ``index`` and ``home``."""
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(part(c, 5), F.lit("+"), F.lit("%2B"))), part(c, 5)), r"/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(~last.isin("", "index", "home"), last)


def query_value(c: Column, key: str, default: str) -> Column:
    """The first value of a query parameter."""
    return F.coalesce(nz(F.regexp_extract(part(c, 6), rf"(?:^|&){key}=([^&]*)", 1)), F.lit(default))


def host_in(h: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a host is one of ``hosts`` or below it."""
    clean = F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"\.+$", "")
    return F.exists(F.array(*[F.lit(x) for x in hosts]), lambda x: (clean == x) | clean.endswith(F.concat(F.lit("."), x)))


def endpoint(c: Column, vendor_hosts: tuple[str, ...] = ("tracker.example",)) -> Column:
    """(kind, url) of a group's endpoint; null for unusable URLs, the tracker's own hosts and messengers."""
    u = normalize_url(c)
    h = host(u)
    kind = F.when(h.endswith(".onion"), "onion").otherwise("website")
    return F.when(u.isNotNull() & ~host_in(h, vendor_hosts + MESSENGERS), F.struct(kind.alias("kind"), u.alias("url")))


@pandas_udf(BooleanType())
def _public_literal(h: pd.Series) -> pd.Series:
    def judge(x: str) -> bool | None:
        try:
            return ipaddress.ip_address(x.strip("[]")).is_global
        except ValueError:
            return None

    return h.map(judge).astype("object")


def is_public_target(c: Column) -> Column:
    """Whether a URL's host may be a public one, as far as the text tells: no private name, no literal of a private network."""
    h = F.regexp_replace(host(normalize_url(c)), r"\.+$", "")
    private = h.isin("localhost", "metadata.google.internal") | h.rlike(r"\.(?:localhost|local|internal|lan)$")
    return F.when(h.isNull(), False).when(h.endswith(".onion"), True).when(private, False).otherwise(F.coalesce(_public_literal(h), h.contains(".")))
