"""Line output: flags, times, scaled numbers and token formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions import addresses as A, names as N, rates as R

# Flag letters from bit 5 down to bit 0.
FLAG_LETTERS = "UAPRSF"


def flags_string(flags: Column) -> Column:
    """`UAPRSF` with dots for unset bits; values above 63 read as hex."""
    letters = [
        F.when(flags.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(letter)).otherwise(F.lit("."))
        for bit, letter in zip(range(5, -1, -1), FLAG_LETTERS)
    ]
    return F.when(flags > 63, F.concat(F.lit("  0x"), F.lower(F.hex(flags)))).otherwise(
        F.concat(*letters)
    )


def scaled_number(n: Column, fixed_width: bool = False) -> Column:
    """`x.x M`, `x.x G`, `x.x T` from a million, a billion, a trillion; plain below."""
    f = n.cast("double")
    out = None
    for unit, letter in ((1e12, "T"), (1e9, "G"), (1e6, "M")):
        text = F.format_string(("%5.1f " if fixed_width else "%.1f ") + letter, f / F.lit(unit))
        out = F.when(f >= unit, text) if out is None else out.when(f >= unit, text)
    plain = n.cast("bigint").cast("string")
    if fixed_width:
        plain = F.when(F.length(plain) < 4, F.lpad(plain, 4, " ")).otherwise(plain)
    return out.otherwise(plain)


def time_string(ts: Column, millis: bool = False) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss" + (".SSS" if millis else ""))


def _left(text: Column, width: int) -> Column:
    """Pad on the right up to `width`, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def _right(text: Column, width: int) -> Column:
    """Pad on the left up to `width`, never cut."""
    text = text.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def _given(name: str) -> Column:
    """The field, or 0 when the exporter did not send it."""
    return F.coalesce(F.col(name), F.lit(0))


def _number(name: str, width: int) -> Column:
    return _right(_given(name), width)


def _counter(name: str) -> Column:
    return _right(scaled_number(_given(name), True), 8)


def _address(name: str, long_v6: bool = False) -> Column:
    return _right(F.coalesce(A.ip_string(name, long_v6=long_v6), F.lit("0.0.0.0")), 39 if long_v6 else 16)


def _mac(name: str) -> Column:
    return A.mac_string(_given(name).cast("bigint"))


def _address_port(side: str, long_v6: bool = False) -> Column:
    sep = F.when(F.col(f"{side}_addr").isNotNull(), F.lit(":")).otherwise(F.lit("."))
    return F.concat(_address(side, long_v6), sep, _left(A.port_string(side), 5))


def _net(side: str, long_v6: bool = False) -> Column:
    v4, hi, lo = A.network(side)
    v6 = A.ip6_string(hi, lo) if long_v6 else A.condense_v6(A.ip6_string(hi, lo))
    text = F.when(v4.isNotNull(), A.ip4_string(v4)).otherwise(v6)
    return F.concat(_right(text, 39 if long_v6 else 16), F.lit("/"), _left(_given(f"{side}_mask").cast("string"), 2))


def _proto() -> Column:
    name = N.proto_name(F.col("prot"))
    return F.when(F.col("prot") == 0, _right(name, 5)).otherwise(_left(name, 5))


def _mpls(i: int) -> Column:
    e = F.coalesce(A.mpls_entry(i), F.lit(0))
    return F.concat(
        _right(A.label_of(e), 8), F.lit("-"), A.exp_of(e).cast("string"),
        F.lit("-"), A.eos_of(e).cast("string"),
    )


# Token -> (column title, expression).
TOKENS = {
    "ts": ("Date flow start        ", lambda: time_string(F.col("first_ts"), True)),
    "te": ("Date flow end          ", lambda: time_string(F.col("last_ts"), True)),
    "td": (" Duration", lambda: F.format_string("%9.3f", R.duration_ms() / F.lit(1000.0))),
    "pr": ("Proto", _proto),
    "sa": ("     Src IP Addr", lambda: _address("src")),
    "da": ("     Dst IP Addr", lambda: _address("dst")),
    "sn": ("        Src Network", lambda: _net("src")),
    "dn": ("        Dst Network", lambda: _net("dst")),
    "nh": ("     Next-hop IP", lambda: _address("next_hop")),
    "nhb": (" BGP next-hop IP", lambda: _address("bgp_next_hop")),
    "ra": ("       Router IP", lambda: _address("router")),
    "sap": ("     Src IP Addr:Port ", lambda: _address_port("src")),
    "dap": ("     Dst IP Addr:Port ", lambda: _address_port("dst")),
    "sp": ("Src Pt", lambda: _number("src_port", 6)),
    "dp": ("Dst Pt", lambda: _right(A.port_string("dst"), 6)),
    "sas": ("Src AS", lambda: _number("src_as", 6)),
    "das": ("Dst AS", lambda: _number("dst_as", 6)),
    "in": (" Input", lambda: _number("input_if", 6)),
    "out": ("Output", lambda: _number("output_if", 6)),
    "pkt": (" Packets", lambda: _counter("packets")),
    "ipkt": ("  In Pkt", lambda: _counter("packets")),
    "opkt": (" Out Pkt", lambda: _counter("out_packets")),
    "byt": ("   Bytes", lambda: _counter("bytes")),
    "ibyt": (" In Byte", lambda: _counter("bytes")),
    "obyt": ("Out Byte", lambda: _counter("out_bytes")),
    "fl": ("Flows", lambda: _number("aggr_flows", 5)),
    "flg": (" Flags", lambda: flags_string(_given("tcp_flags"))),
    "tos": ("Tos", lambda: _number("tos", 3)),
    "stos": ("STos", lambda: _number("tos", 4)),
    "dtos": ("DTos", lambda: _number("dst_tos", 4)),
    "dir": ("Dir", lambda: _right(F.when(_given("dir") != 0, F.lit("E")).otherwise(F.lit("I")), 3)),
    "smk": ("SMask", lambda: _number("src_mask", 5)),
    "dmk": ("DMask", lambda: _number("dst_mask", 5)),
    "fwd": ("Fwd", lambda: _number("fwd_status", 3)),
    "svln": ("SVlan", lambda: _number("src_vlan", 5)),
    "dvln": ("DVlan", lambda: _number("dst_vlan", 5)),
    "ismc": ("  In src MAC Addr", lambda: _mac("in_src_mac")),
    "odmc": (" Out dst MAC Addr", lambda: _mac("out_dst_mac")),
    "idmc": ("  In dst MAC Addr", lambda: _mac("in_dst_mac")),
    "osmc": (" Out src MAC Addr", lambda: _mac("out_src_mac")),
    **{
        f"mpls{i}": (f" MPLS lbl {i}".ljust(12), lambda i=i: _mpls(i))
        for i in range(1, 11)
    },
    "mpls": ("MPLS labels 1-10", lambda: F.concat_ws(" ", *[_mpls(i) for i in range(1, 11)])),
    "bps": ("     bps", lambda: _right(scaled_number(R.bps(), True), 8)),
    "pps": ("     pps", lambda: _right(scaled_number(R.pps(), True), 8)),
    "bpp": ("   Bpp", lambda: _right(R.bpp(), 6)),
    "eng": (" engine", lambda: F.concat(
        _number("engine_type", 3), F.lit("/"), _left(_given("engine_id").cast("string"), 3))),
}

# Named formats.
FORMATS = {
    "line": "%ts %td %pr %sap -> %dap %pkt %byt %fl",
    "long": "%ts %td %pr %sap -> %dap %flg %tos %pkt %byt %fl",
    "extended": "%ts %td %pr %sap -> %dap %flg %tos %pkt %byt %pps %bps %bpp %fl",
    "biline": "%ts %td %pr %sap <-> %dap %opkt %ipkt %obyt %ibyt %fl",
    "bilong": "%ts %td %pr %sap <-> %dap %flg %tos %opkt %ipkt %obyt %ibyt %fl",
}


# Tokens of addresses, and how many blanks widen their titles in the long form.
_LONG_V6 = {
    **{t: (lambda n=n: _address(n, True)) for t, n in {"sa": "src", "da": "dst", "nh": "next_hop", "nhb": "bgp_next_hop", "ra": "router"}.items()},
    **{t: (lambda n=n: _net(n, True)) for t, n in {"sn": "src", "dn": "dst"}.items()},
    **{t: (lambda n=n: _address_port(n, True)) for t, n in {"sap": "src", "dap": "dst"}.items()},
}
_WIDER = " " * 23

# Numbers as they are: counters and rates without units, protocols by number.
_PLAIN = {
    "pr": lambda: _left(_given("prot").cast("string"), 5),
    **{
        t: (lambda c=c: _right(_given(c).cast("string"), 8))
        for t, c in {"pkt": "packets", "ipkt": "packets", "opkt": "out_packets", "byt": "bytes", "ibyt": "bytes", "obyt": "out_bytes"}.items()
    },
    "bps": lambda: _right(R.bps().cast("string"), 8),
    "pps": lambda: _right(R.pps().cast("string"), 8),
}


def _expression(token: str, long_v6: bool, plain: bool) -> Column:
    if long_v6 and token in _LONG_V6:
        return _LONG_V6[token]()
    if plain and token in _PLAIN:
        return _PLAIN[token]()
    return TOKENS[token][1]()


def _parts(fmt: str) -> list[tuple[str, str]]:
    """Split a format into ("text", s) and ("token", name)."""
    out = []
    for piece in re.split(r"(%[a-z]+[0-9]*)", FORMATS.get(fmt, fmt)):
        if piece.startswith("%"):
            if piece[1:] not in TOKENS:
                raise ValueError(f"unknown format token: {piece}")
            out.append(("token", piece[1:]))
        elif piece:
            out.append(("text", piece))
    return out


def format_line(fmt: str = "line", long_v6: bool = False, plain: bool = False) -> Column:
    """One output line per flow; absent fields print as 0.

    `long_v6` writes IPv6 addresses in full, in columns of 39; `plain` writes counters, rates
    and protocols as bare numbers.
    """
    return F.concat(
        *[
            F.lit(p) if kind == "text" else F.coalesce(_expression(p, long_v6, plain), F.lit(""))
            for kind, p in _parts(fmt)
        ]
    )


def format_header(fmt: str = "line", long_v6: bool = False) -> str:
    def title(token: str) -> str:
        return (_WIDER if long_v6 and token in _LONG_V6 else "") + TOKENS[token][0]

    return "".join(p if kind == "text" else title(p) for kind, p in _parts(fmt))


def format_flows(flows: DataFrame, fmt: str = "line", long_v6: bool = False, plain: bool = False) -> DataFrame:
    """Project each flow to one text line. `fmt` is a name of FORMATS or a token string."""
    return flows.select(format_line(fmt, long_v6, plain).alias("line"))
