"""IPv4 and IPv6 addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.masks import mask_ip
from ..functions.spans import find_spans, keep, let, no_spans, record
from .detector import Detector

NAME = "ip_address"

_IPV4 = r"(?U)(?=\d)(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
_IPV6 = r"(?U)(?=[0-9A-Fa-f:])(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"
_IPV6_HINT = ":(?::|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5}:)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# The blocks the IANA special-purpose registries list as not globally
# reachable, and the parts of them that are.
PRIVATE_V4 = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 "
    "192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 "
    "255.255.255.255/32"
).split()
PUBLIC_V4 = "192.0.0.9/32 192.0.0.10/32".split()
PRIVATE_V6 = (
    "::1/128 ::/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10"
).split()
PUBLIC_V6 = (
    "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28"
).split()
_MAPPED = "0" * 20 + "ffff"


def is_ipv4(value: Column) -> Column:
    """Four octets without leading zeros, not the unspecified address."""
    return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z") & (value != "0.0.0.0")


def ipv4_number(value: Column) -> Column:
    """An IPv4 address as a bigint."""
    return let(
        F.split(value, r"\."),
        lambda o: sum(
            (F.get(o, F.lit(i)).try_cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("bigint")
        ),
    )


def _in_blocks(number: Column, blocks: list[str]) -> Column:
    hit = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        first, last = int(block.network_address), int(block.broadcast_address)
        hit = hit | number.between(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
    return hit


def _private_number(number: Column) -> Column:
    return _in_blocks(number, PRIVATE_V4) & ~_in_blocks(number, PUBLIC_V4)


def is_private_v4(value: Column) -> Column:
    return let(ipv4_number(value), _private_number)


def is_ipv6(value: Column) -> Column:
    """A valid address of eight groups, or fewer around one ``::``, not all zero."""
    colons = F.length(value) - F.length(F.replace(value, F.lit(":"), F.lit("")))
    double = F.contains(value, F.lit("::"))
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    edges_ok = ~value.rlike("^:(?!:)") & ~value.rlike("(?<!:):\\z")
    one_double = ~F.contains(value, F.lit(":::")) & ~value.rlike("::.*::")
    return (
        F.when(double, one_double & (groups <= 7)).otherwise((colons == 7) & (groups == 8))
        & edges_ok
        & value.rlike("^[0-9A-Fa-f:]+\\z")
        & value.rlike("[1-9A-Fa-f]")
    )


def ipv6_hex(value: Column) -> Column:
    """A valid IPv6 address as 32 lower-case hex digits."""

    def padded(part: Column) -> Column:
        groups = F.filter(F.split(part, ":"), lambda g: g != "")
        return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")

    head = padded(F.substring_index(value, "::", 1))
    tail = padded(F.when(F.contains(value, F.lit("::")), F.substring_index(value, "::", -1)).otherwise(F.lit("")))
    return let(
        record(h=head, t=tail),
        lambda p: F.concat(
            p["h"], F.repeat(F.lit("0"), F.lit(32) - F.length(p["h"]) - F.length(p["t"])), p["t"]
        ),
    )


def _hex_rule(block: str) -> str:
    """Regex over the 32 hex digits of the addresses in a block."""
    net = ipaddress.IPv6Network(block)
    digits, rest = f"{int(net.network_address):032x}", net.prefixlen % 4
    whole = net.prefixlen // 4
    if not rest:
        return digits[:whole]
    first = int(digits[whole], 16)
    choices = "".join(f"{d:x}" for d in range(first, first + 2 ** (4 - rest)))
    return f"{digits[:whole]}[{choices}]"


def is_private_v6(value: Column) -> Column:
    """Private by block; an IPv4-mapped address is judged by its IPv4 address."""
    private = "^(?:" + "|".join(map(_hex_rule, PRIVATE_V6)) + ")"
    public = "^(?:" + "|".join(map(_hex_rule, PUBLIC_V6)) + ")"

    def judge(h: Column) -> Column:
        mapped = F.conv(F.substring(h, 25, 8), 16, 10).try_cast("bigint")
        return F.when(F.startswith(h, F.lit(_MAPPED)), let(mapped, _private_number)).otherwise(
            h.rlike(private) & ~h.rlike(public)
        )

    return let(ipv6_hex(value), judge)


def _maybe_v6(text: Column) -> Column:
    return F.contains(text, F.lit(":")) & text.rlike(_IPV6_HINT)


def ip_detector(ignore_private: bool = False) -> Detector:
    def good_v4(value: Column) -> Column:
        ok = is_ipv4(value)
        return ok & ~is_private_v4(value) if ignore_private else ok

    def good_v6(value: Column) -> Column:
        ok = is_ipv6(value)
        return ok & ~is_private_v6(value) if ignore_private else ok

    def spans(text: Column) -> Column:
        v4 = F.when(F.contains(text, F.lit(".")), keep(find_spans(text, _IPV4, NAME, "ipv4"), good_v4))
        v6 = F.when(_maybe_v6(text), keep(find_spans(text, _IPV6, NAME, "ipv6"), good_v6))
        return F.concat(F.coalesce(v4, no_spans()), F.coalesce(v6, no_spans()))

    return Detector(
        NAME,
        80,
        spans,
        lambda value, subtype: mask_ip(value),
        hint=lambda text: _maybe_v6(text) & text.rlike(_IPV6),
        shape=r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d",
        cuttable=True,
    )
