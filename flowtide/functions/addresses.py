"""Address, network, MAC and label expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from flowtide.schema import ADDRESS_COLUMNS, ICMP, ICMP6

_V4_ALL = 0xFFFFFFFF


def signed64(v: int) -> int:
    """The BIGINT that holds an unsigned 64-bit value."""
    return v - (1 << 64) if v >= 1 << 63 else v


def split_v6(v: int) -> tuple[int, int]:
    return signed64(v >> 64), signed64(v & (1 << 64) - 1)


def parse_address(text: str) -> tuple[int, ...]:
    """(v4,) or (hi, lo)."""
    ip = ipaddress.ip_address(text)
    return (int(ip),) if ip.version == 4 else split_v6(int(ip))


# --- text forms -----------------------------------------------------------------


def ip4_string(addr: Column) -> Column:
    return F.concat_ws(
        ".", *[F.shiftright(addr, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def ip6_string(hi: Column, lo: Column) -> Column:
    """Expanded form: eight groups of four hex digits."""
    digits = F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))
    return F.concat_ws(":", *[F.substring(digits, 1 + 4 * i, 4) for i in range(8)])


def condense_v6(text: Column) -> Column:
    return F.when(
        F.length(text) > 16, F.concat(F.substring(text, 1, 7), F.lit(".."), F.right(text, F.lit(7)))
    ).otherwise(text)


def ip_string(name: str, long_v6: bool = True) -> Column:
    """Text of the address `name` (`src`, `dst`, `next_hop`, ...), whichever family it has."""
    v4, hi, lo = (F.col(c) for c in ADDRESS_COLUMNS[name])
    v6 = ip6_string(hi, lo)
    return F.when(v4.isNotNull(), ip4_string(v4)).when(
        hi.isNotNull(), v6 if long_v6 else condense_v6(v6)
    )


# --- networks -------------------------------------------------------------------


def netmask_v4(bits: Column) -> Column:
    """32-bit mask with `bits` leading ones; 0 bits gives 0."""
    return _left64(F.lit(32) - bits).bitwiseAND(F.lit(_V4_ALL))


def _left64(shift: Column) -> Column:
    return F.call_function("shiftleft", F.lit(-1).cast("bigint"), shift.cast("int"))


def netmask_v6(bits: Column) -> tuple[Column, Column]:
    zero, ones = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    hi = F.when(bits >= 64, ones).when(bits <= 0, zero).otherwise(_left64(F.lit(64) - bits))
    lo = F.when(bits <= 64, zero).when(bits >= 128, ones).otherwise(_left64(F.lit(128) - bits))
    return hi, lo


def network_v4(addr: Column, bits: Column) -> Column:
    return addr.bitwiseAND(netmask_v4(bits))


def network_v6(hi: Column, lo: Column, bits: Column) -> tuple[Column, Column]:
    mh, ml = netmask_v6(bits)
    return hi.bitwiseAND(mh), lo.bitwiseAND(ml)


def network(name: str) -> tuple[Column, Column, Column]:
    """(v4, hi, lo) of the `src` or `dst` address under the flow's own mask length."""
    v4, hi, lo = (F.col(c) for c in ADDRESS_COLUMNS[name])
    bits = F.col(f"{name}_mask")
    return (network_v4(v4, bits), *network_v6(hi, lo, bits))


def src_network() -> Column:
    return network("src")[0]


def dst_network() -> Column:
    return network("dst")[0]


def network_string(name: str, long_v6: bool = True) -> Column:
    v4, hi, lo = network(name)
    v6 = ip6_string(hi, lo)
    text = F.when(v4.isNotNull(), ip4_string(v4)).otherwise(v6 if long_v6 else condense_v6(v6))
    return F.concat(text, F.lit("/"), F.col(f"{name}_mask").cast("string"))


# --- ports and ICMP -------------------------------------------------------------


def is_icmp() -> Column:
    return F.col("prot").isin(ICMP, ICMP6)


def icmp_type() -> Column:
    return F.when(is_icmp(), F.shiftright("dst_port", 8))


def icmp_code() -> Column:
    return F.when(is_icmp(), F.col("dst_port").bitwiseAND(F.lit(255)))


def port_string(side: str) -> Column:
    """The port as text; the destination port of an ICMP flow reads `type.code`."""
    port = F.col(f"{side}_port").cast("string")
    if side == "src":
        return port
    return F.when(
        is_icmp(), F.concat_ws(".", icmp_type().cast("string"), icmp_code().cast("string"))
    ).otherwise(port)


def addr_port_string(side: str, long_v6: bool = True) -> Column:
    """`addr:port`; IPv6 uses a dot before the port."""
    sep = F.when(F.col(f"{side}_addr").isNotNull(), F.lit(":")).otherwise(F.lit("."))
    return F.concat(ip_string(side, long_v6), sep, port_string(side))


# --- MAC and MPLS ---------------------------------------------------------------


def mac_string(mac: Column) -> Column:
    digits = F.lpad(F.lower(F.hex(mac)), 12, "0")
    return F.concat_ws(":", *[F.substring(digits, 1 + 2 * i, 2) for i in range(6)])


def mpls_entry(i: int) -> Column:
    """Stack entry i, counted from 1; NULL when the stack is shorter."""
    return F.get("mpls", F.lit(i - 1))


def label_of(entry: Column) -> Column:
    return F.shiftrightunsigned(entry, 4)


def exp_of(entry: Column) -> Column:
    return F.shiftrightunsigned(entry, 1).bitwiseAND(F.lit(7))


def eos_of(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(1))


def mpls_string(i: int) -> Column:
    e = mpls_entry(i)
    return F.concat_ws("-", *[p.cast("string") for p in (label_of(e), exp_of(e), eos_of(e))])


def mpls_bottom_label() -> Column:
    """Label of the first entry with the end-of-stack bit; NULL when there is none."""
    return label_of(F.get(F.filter("mpls", lambda e: eos_of(e) == 1), F.lit(0)))
