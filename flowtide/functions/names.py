"""Number-to-name lookups: protocols, forwarding status, services."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Protocol number (the position) -> short name. Number 0 means "not given".
PROTOCOL_NAMES = [
    "0", "ICMP", "IGMP", "GGP", "IPIP", "ST", "TCP", "CBT", "EGP", "IGP",
    "BBN", "NVPII", "PUP", "ARGUS", "ENCOM", "XNET", "CHAOS", "UDP", "MUX", "DCN",
    "HMP", "PRM", "XNS", "Trnk1", "Trnk2", "Leaf1", "Leaf2", "RDP", "IRTP", "ISO-4",
    "NETBK", "MFESP", "MEINP", "DCCP", "3PC", "IDPR", "XTP", "DDP", "IDPR", "TP++",
    "IL", "IPv6", "SDRP", "Rte6", "Frag6", "IDRP", "RSVP", "GRE", "MHRP", "BNA",
    "ESP", "AH", "INLSP", "SWIPE", "NARP", "MOBIL", "TLSP", "SKIP", "ICMP6", "NOHE6",
    "OPTS6", "HOST", "CFTP", "NET", "SATNT", "KLAN", "RVD", "IPPC", "FS", "SATM",
    "VISA", "IPCV", "CPNX", "CPHB", "WSN", "PVP", "BSATM", "SUNND", "WBMON", "WBEXP",
    "ISOIP", "VMTP", "SVMTP", "VINES", "TTP", "NSIGP", "DGP", "TCP", "EIGRP", "OSPF",
    "S-RPC", "LARP", "MTP", "AX.25", "IPIP", "MICP", "SCCSP", "ETHIP", "ENCAP", "99",
    "GMTP", "IFMP", "PNNI", "PIM", "ARIS", "SCPS", "QNX", "A/N", "IPcmp", "SNP",
    "CpqPP", "IPXIP", "VRRP", "PGM", "0hop", "L2TP", "DDX", "IATP", "STP", "SRP",
    "UTI", "SMP", "SM", "PTP", "ISIS4", "FIRE", "CRTP", "CRUDP", "128", "IPLT",
    "SPS", "PIPE", "SCTP", "FC", "134", "MHEAD", "UDP-L", "MPLS",
]

# Forwarding status id -> short name.
FORWARDING_STATUS = {
    0: "Ukwn", 1: "Forw", 2: "Frag",
    16: "Drop", 17: "DaclD", 18: "Daclp", 19: "Noroute", 20: "Dadj", 21: "Dfrag",
    22: "Dbadh", 23: "Dbadtlen", 24: "Dbadhlen", 25: "DbadTTL", 26: "Dpolicy", 27: "Dwred",
    28: "Drpf", 29: "Dforus", 30: "DbadOf", 31: "Dhw",
    128: "Term", 129: "Tadj", 130: "TincAdj", 131: "Tforus",
}

# Fixed values: (port, transport, service); `*` is any transport.
SERVICES = [
    (20, "tcp", "ftp-data transfer"),
    (21, "tcp", "ftp-control"),
    (22, "tcp", "SSH"),
    (23, "tcp", "telnet"),
    (25, "tcp", "SMTP-m routing"),
    (53, "*", "DNS"),
    (80, "*", "HTTP"),
    (110, "tcp", "POP3"),
    (143, "tcp", "IMAP-management"),
    (179, "tcp", "BGP"),
    (194, "*", "IRC"),
    (220, "*", "IMAP-v3"),
    (443, "tcp", "HTTPS"),
    (513, "tcp", "rlogin"),
    (587, "tcp", "SMTP-m submission"),
    (666, "udp", "Doom"),
    (992, "*", "telnet-over SSL"),
    (993, "tcp", "IMAPS"),
    (995, "tcp", "POP3S"),
]

_FORWARDING_IDS = {name.lower(): i for i, name in FORWARDING_STATUS.items()}


def proto_name(prot: Column) -> Column:
    """Name of a protocol number; numbers without a name read as the number."""
    table = F.array(*[F.lit(n) for n in PROTOCOL_NAMES])
    return F.coalesce(F.get(table, prot), prot.cast("string"))


def proto_number(name: str | int) -> int:
    """Number of a protocol given by number or name (any case, first match)."""
    if isinstance(name, int) or name.isdigit():
        n = int(name)
        if not 0 <= n <= 255:
            raise ValueError(f"protocol number out of range: {n}")
        return n
    names = [p.lower() for p in PROTOCOL_NAMES]
    if name.lower() not in names:
        raise ValueError(f"unknown protocol: {name}")
    return names.index(name.lower())


def fwd_status_name(status: Column) -> Column:
    pairs = [F.lit(x) for item in FORWARDING_STATUS.items() for x in item]
    return F.create_map(*pairs)[status]


def fwd_status_number(name: str | int) -> int:
    if isinstance(name, int):
        return name
    if name.lower() not in _FORWARDING_IDS:
        raise ValueError(f"unknown forwarding status: {name}")
    return _FORWARDING_IDS[name.lower()]


def service_table(spark: SparkSession) -> DataFrame:
    """The lookup as a table: (port, prot, service), `*` rows carry a NULL protocol."""
    numbers = {"tcp": 6, "udp": 17}
    ports, transports, services = zip(*SERVICES)
    table = pa.table(
        {
            "port": pa.array(ports, pa.int32()),
            "prot": pa.array([numbers.get(t) for t in transports], pa.int32()),
            "service": list(services),
        }
    )
    return spark.createDataFrame(table)


def service_name(port: Column, prot: Column) -> Column:
    """Service of (port, protocol): the exact transport first, then `*`; else NULL."""

    def lookup(key: Column, rows: list[tuple]) -> Column:
        return F.create_map(*[F.lit(x) for r in rows for x in r])[key]

    by_transport = {
        t: [(p, s) for p, tt, s in SERVICES if tt == t] for t in ("tcp", "udp", "*")
    }
    exact = F.when(prot == 6, lookup(port, by_transport["tcp"])).when(
        prot == 17, lookup(port, by_transport["udp"])
    )
    wild = F.when(prot.isin(6, 17), lookup(port, by_transport["*"]))
    return F.coalesce(exact, wild)
