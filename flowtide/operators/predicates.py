"""Predicate builders: each returns a boolean Column over a `flows` table.

Combine them with `&`, `|` and `not_`. A field the exporter did not send is NULL and so
is a comparison with it; a filter drops such rows. `not_` turns that NULL into "does not
match" first, so that a negated predicate keeps the row. Plain predicates carry no
COALESCE and therefore still reach the parquet scan.

`direction` is "src", "dst", "either" or "both" unless the function says otherwise.
`cmp` is "=", "<" or ">"; numbers may be text with a suffix k, m, g or t (powers of 1000).
"""

from __future__ import annotations

import ipaddress
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, functions as F

from flowtide.functions import addresses as A, names as N, rates as R
from flowtide.schema import ADDRESS_COLUMNS

# Flag letter -> bit; X is all six.
FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "X": 63}

_SUFFIX = {"k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}


def scaled(n: int | str) -> int:
    """10, "10", "10k", "2M" -> number."""
    if isinstance(n, int):
        return n
    s = n.strip().lower()
    factor = _SUFFIX.get(s[-1:], 1)
    return int(s[:-1] if factor > 1 else s) * factor


def _within(what: str, n: int | str, top: int) -> int:
    v = scaled(n)
    if not 0 <= v <= top:
        raise ValueError(f"{what} must be 0..{top}, not {n}")
    return v


def compare(value: Column, cmp: str, n: int | str) -> Column:
    limit = F.lit(scaled(n))
    if cmp in ("=", "==", "eq"):
        return value == limit
    if cmp in ("<", "lt"):
        return value < limit
    if cmp in (">", "gt"):
        return value > limit
    raise ValueError(f"unknown comparison: {cmp}")


def _all(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds)


def _any(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds)


def _sides(direction: str, src: Column, dst: Column) -> Column:
    return _combine(direction, {"src": src, "dst": dst})


def _combine(direction: str, sides: dict[str, Column]) -> Column:
    if direction in sides:
        return sides[direction]
    if direction == "either":
        return _any(list(sides.values()))
    if direction == "both":
        return _all(list(sides.values()))
    raise ValueError(f"unknown direction: {direction}")


# --- constants, labels, families ------------------------------------------------


def any_() -> Column:
    return F.lit(True)


def not_(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


def ident(name: str) -> Column:
    return F.col("ident") == name


def ipv4() -> Column:
    return ~F.col("is_v6")


def ipv6() -> Column:
    return F.col("is_v6")


def proto(p: int | str) -> Column:
    return F.col("prot") == N.proto_number(p)


# --- counters and rates ---------------------------------------------------------


def packets(cmp: str, n, direction: str = "in") -> Column:
    return compare(F.col({"in": "packets", "out": "out_packets"}[direction]), cmp, n)


def bytes_(cmp: str, n, direction: str = "in") -> Column:
    return compare(F.col({"in": "bytes", "out": "out_bytes"}[direction]), cmp, n)


def flows(cmp: str, n) -> Column:
    return compare(F.col("aggr_flows"), cmp, n)


def pps(cmp: str, n) -> Column:
    return compare(R.pps(), cmp, n)


def bps(cmp: str, n) -> Column:
    return compare(R.bps(), cmp, n)


def bpp(cmp: str, n) -> Column:
    return compare(R.bpp(), cmp, n)


def duration(cmp: str, ms) -> Column:
    return compare(R.duration_ms(), cmp, ms)


def tos(cmp: str, n, direction: str = "src") -> Column:
    n = _within("tos", n, 255)
    return _sides(direction, compare(F.col("tos"), cmp, n), compare(F.col("dst_tos"), cmp, n))


def _flag_mask(flags: str) -> int:
    mask = 0
    for letter in flags.upper():
        if letter not in FLAG_BITS:
            raise ValueError(f"unknown TCP flag: {letter}")
        mask |= FLAG_BITS[letter]
    return mask


def flags(f: str | int, cmp: str = "=", negate: bool = False) -> Column:
    """A number up to 63 is compared; letters ask for "all of these set".

    The negated letter form asks for "none of these set", which is not the complement.
    """
    col = F.col("tcp_flags")
    if isinstance(f, int):
        p = compare(col, cmp, _within("TCP flags", f, 63))
        return not_(p) if negate else p
    mask = F.lit(_flag_mask(f))
    return col.bitwiseAND(mask) == (F.lit(0) if negate else mask)


# --- addresses and networks -----------------------------------------------------


def _equals(name: str, text: str) -> Column:
    v4, hi, lo = (F.col(c) for c in ADDRESS_COLUMNS[name])
    value = A.parse_address(text)
    return v4 == value[0] if len(value) == 1 else (hi == value[0]) & (lo == value[1])


def ip(address: str, direction: str = "either") -> Column:
    return _sides(direction, _equals("src", address), _equals("dst", address))


host = ip


def _inside(name: str, net: ipaddress.IPv4Network | ipaddress.IPv6Network) -> Column:
    v4, hi, lo = (F.col(c) for c in ADDRESS_COLUMNS[name])
    addr, mask = int(net.network_address), int(net.netmask)
    if net.version == 4:
        if net.prefixlen == 32:
            return v4 == addr
        return (v4 >= addr) & (v4 <= int(net.broadcast_address))
    (ah, al), (mh, ml) = A.split_v6(addr), A.split_v6(mask)
    if net.prefixlen <= 64:
        return hi.bitwiseAND(F.lit(mh)) == ah
    return (hi == ah) & (lo.bitwiseAND(F.lit(ml)) == al)


def ip_in(addresses: list[str], direction: str = "either") -> Column:
    """Inside any of the listed addresses or networks (`a.b.c.d` or `a.b.c.d/bits`).

    For lists of more than a few hundred entries use `joins.in_networks`.
    """
    nets = [ipaddress.ip_network(a, strict=False) for a in addresses]
    return _sides(
        direction, _any([_inside("src", n) for n in nets]), _any([_inside("dst", n) for n in nets])
    )


def net(network: str, netmask: str | None = None, direction: str = "either") -> Column:
    """`net("10.0.0.0/8")` or `net("10.0.0.0", "255.0.0.0")`."""
    n = ipaddress.ip_network(f"{network}/{netmask}" if netmask else network, strict=False)
    return _sides(direction, _inside("src", n), _inside("dst", n))


def next_hop(address: str) -> Column:
    return _equals("next_hop", address)


def bgp_next_hop(address: str) -> Column:
    return _equals("bgp_next_hop", address)


def router(address: str) -> Column:
    return _equals("router", address)


# --- ports, ICMP, engines, AS, masks --------------------------------------------


def port(cmp: str, n, direction: str = "either") -> Column:
    n = _within("port", n, 65535)
    return _sides(direction, compare(F.col("src_port"), cmp, n), compare(F.col("dst_port"), cmp, n))


def port_in(ports: list[int], direction: str = "either") -> Column:
    return _sides(direction, F.col("src_port").isin(*ports), F.col("dst_port").isin(*ports))


def icmp_type(n: int) -> Column:
    return A.is_icmp() & (F.shiftright("dst_port", 8) == _within("ICMP type", n, 255))


def icmp_code(n: int) -> Column:
    return A.is_icmp() & (F.col("dst_port").bitwiseAND(F.lit(255)) == _within("ICMP code", n, 255))


def engine_type(cmp: str, n) -> Column:
    return compare(F.col("engine_type"), cmp, n)


def engine_id(cmp: str, n) -> Column:
    return compare(F.col("engine_id"), cmp, n)


def as_(cmp: str, n, direction: str = "either") -> Column:
    return _sides(direction, compare(F.col("src_as"), cmp, n), compare(F.col("dst_as"), cmp, n))


def as_in(numbers: list[int], direction: str = "either") -> Column:
    return _sides(direction, F.col("src_as").isin(*numbers), F.col("dst_as").isin(*numbers))


def mask(n: int, direction: str = "either") -> Column:
    n = _within("mask", n, 255)
    return _sides(direction, F.col("src_mask") == n, F.col("dst_mask") == n)


def interface(n: int, direction: str = "either") -> Column:
    """`direction`: "in", "out" or "either"."""
    return _combine(direction, {"in": F.col("input_if") == n, "out": F.col("output_if") == n})


def vlan(n: int, direction: str = "either") -> Column:
    n = _within("VLAN", n, 65535)
    return _sides(direction, F.col("src_vlan") == n, F.col("dst_vlan") == n)


def mac(address: str, direction: str = "any") -> Column:
    """`direction`: "in_src", "in_dst", "out_src", "out_dst", a half of these
    ("in", "out", "src", "dst"), or "any" of the four."""
    n = int(address.replace(":", ""), 16)
    names = ["in_src", "out_dst", "in_dst", "out_src"]
    picked = [x for x in names if direction == "any" or direction == x or direction in x.split("_")]
    if not picked:
        raise ValueError(f"unknown direction: {direction}")
    return _any([F.col(f"{x}_mac") == n for x in picked])


# --- MPLS, forwarding, direction ------------------------------------------------


def mpls_label(i: int, cmp: str, n) -> Column:
    return compare(A.label_of(A.mpls_entry(i)), cmp, n)


def mpls_exp(i: int, cmp: str, n) -> Column:
    return compare(A.exp_of(A.mpls_entry(i)), cmp, n)


def mpls_eos(cmp: str, n) -> Column:
    return compare(A.mpls_bottom_label(), cmp, n)


def mpls_any(n: int) -> Column:
    """Any entry of the stack carries label n."""
    return F.exists("mpls", lambda e: A.label_of(e) == n)


def fwd_status(s: int | str) -> Column:
    return F.col("fwd_status") == N.fwd_status_number(s)


def flow_dir(d: str | int) -> Column:
    return F.col("dir") == ({"ingress": 0, "egress": 1}[d] if isinstance(d, str) else d)


# --- time and group limits ------------------------------------------------------


def time_window(start: datetime | None = None, end: datetime | None = None) -> Column:
    """Flows that lie inside [start, end]: first seen >= start and last seen <= end."""
    preds = []
    if start is not None:
        preds.append(F.col("first_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        preds.append(F.col("last_ts") <= F.lit(end).cast("timestamp_ntz"))
    return _all(preds) if preds else any_()


def time_frame(text: str, first: datetime, last: datetime) -> tuple[datetime, datetime | None]:
    """Resolve a window text against the data's own first and last time.

    "+n" is the first n seconds, "-n" the last n seconds, "start-end" and "start" are
    absolute times such as 2024/01/31.12:00:00 (any shorter prefix of it).
    """
    if text[0] == "-":
        return last - timedelta(seconds=int(text[1:])), last
    if text[0] == "+":
        return first, first + timedelta(seconds=int(text[1:]))
    start, _, end = text.partition("-")
    return _parse_time(start), _parse_time(end) if end else None


def _parse_time(text: str) -> datetime:
    for form in ("%Y/%m/%d.%H:%M:%S", "%Y/%m/%d.%H:%M", "%Y/%m/%d.%H", "%Y/%m/%d", "%Y/%m", "%Y"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    raise ValueError(f"cannot read time: {text}")


def group_limit(value: str, limit: str) -> Column:
    """HAVING on an aggregated counter: "+10k" keeps groups above, "-10k" below (strict)."""
    cmp = "<" if limit.startswith("-") else ">"
    return compare(F.col(value), cmp, limit.lstrip("+-").rstrip("bB"))
