"""Public addresses and platforms as Column expressions."""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Platforms by their domains.
PLATFORMS = {"youtube": ("youtube.com", "youtu.be"), "tiktok": ("tiktok.com",), "instagram": ("instagram.com",), "facebook": ("facebook.com", "fb.watch")}
PUBLIC_KEYS = ("v", "id")

ADDRESS = r"^(?i)(https?)://(\[[0-9a-f:.]+\]|[^\[\]/?#:@%\s\\]+)(?::([0-9]{1,5}))?(/[^?#\s]*)?(?:\?([^#\s]*))?(?:#\S*)?$"
NAME = r"^(?:[a-z0-9-]{1,63}\.)*[a-z0-9-]{1,63}$"
LOCAL = r"^(?:localhost|.*\.localhost|.*\.local)$"
#: Networks that carry addresses of another protocol, which are refused whatever they hold.
CARRIERS = tuple(map(ipaddress.ip_network, ("64:ff9b::/96", "64:ff9b:1::/48")))


def read_host(raw: str) -> str | None:
    """An address literal that is public, or a name in its ASCII form; null for any other host."""
    try:
        if ":" not in raw:
            raw = raw.encode("idna").decode("ascii").lower().rstrip(".")
        ip = ipaddress.ip_address(raw)
    except UnicodeError:
        return None
    except ValueError:
        return raw if re.fullmatch(r"[a-z0-9.-]+", raw) else None
    refused = not ip.is_global or ip.is_multicast or ip.is_reserved or ip.is_unspecified or ip.is_loopback or ip.is_link_local
    carried = isinstance(ip, ipaddress.IPv6Address) and (ip.ipv4_mapped or ip.sixtofour or ip.teredo or any(ip in n for n in CARRIERS))
    return None if refused or carried else raw.lower()


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, ADDRESS, i)


def raw_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.nullif(part(url, 2), F.lit(""))), r"^\[|\]$", "")


def host(url: Column) -> Column:
    """The host of an address, without brackets: plain names natively, literals and international names by ``read_host``; null if it is none or not public."""

    @F.arrow_udf("string")
    def odd(hosts: pa.Array) -> pa.Array:
        each = hosts.dictionary_encode()
        known = [read_host(h) for h in each.dictionary.to_pylist()]
        return pa.array([None if i is None else known[i] for i in each.indices.to_pylist()], pa.string())

    raw = raw_host(url)
    name = F.rtrim(raw, F.lit("."))
    plain = name.rlike(NAME) & ~name.rlike(r"^[0-9.]+$")
    return F.coalesce(F.when(plain, name), odd(F.when(~plain, raw)))


def hosts(urls: Column) -> Column:
    """The hosts of an array of addresses, for use inside of a lambda function, which can't call Python."""

    @F.arrow_udf("array<string>")
    def read(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [None if h is None else read_host(h) for h in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    return read(F.transform(urls, raw_host))


def is_valid(url: Column, *, longest: int = 2048, of: Column | None = None) -> Column:
    """http(s) on its default port, without user, within the length, to a host that is no private or reserved literal and no local name. of: the host, if it is known."""
    scheme, port, h = F.lower(part(url, 1)), part(url, 3), host(url) if of is None else of
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.coalesce(url.rlike(ADDRESS) & (F.char_length(url) <= longest) & default & ~h.rlike(LOCAL), F.lit(False))


def public_url(url: Column, keys: tuple[str, ...] = PUBLIC_KEYS, *, of: Column | None = None) -> Column:
    """scheme://host/path?query of a valid address, keeping only query keys of public identity with plain values; else null. of: the host, if it is known."""
    pairs = F.filter(F.split(part(url, 5), "&"), lambda p: p.rlike(rf"^(?:{'|'.join(keys)})=[A-Za-z0-9_\-]{{1,128}}$"))
    query = F.array_join(pairs, "&")
    path, h = part(url, 4), host(url) if of is None else of
    out = F.concat(F.lower(part(url, 1)), F.lit("://"), F.when(h.contains(":"), F.concat(F.lit("["), h, F.lit("]"))).otherwise(h), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(is_valid(url, of=h), out)


def platform(url: Column, platforms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The platform whose domain is the host or a parent of it; else ``web``."""
    h = host(url)
    out = F.lit("web")
    for name, domains in reversed((platforms or PLATFORMS).items()):
        match = F.lit(False)
        for d in domains:
            match = match | (h == d) | h.endswith("." + d)
        out = F.when(match, F.lit(name)).otherwise(out)
    return out
