"""Reading and writing flow tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowtide.functions import addresses as A, names as N, rates as R, text as X
from flowtide.schema import FLOW_SCHEMA, conform

# --- parquet ----------------------------------------------------------------------


def read_flows(spark: SparkSession, *paths: str) -> DataFrame:
    """One table from any number of flow files or folders; missing columns read as NULL."""
    return conform(spark.read.schema(_stored_schema()).parquet(*paths))


def _stored_schema() -> T.StructType:
    return T.StructType(list(FLOW_SCHEMA.fields))


def read_sources(spark: SparkSession, root: str, sources: list[str], files: str = "") -> DataFrame:
    """The same file names below several source folders, as one table.

    `ident` is the source folder's name.
    """

    def one(source: str) -> DataFrame:
        path = "/".join(p for p in (root.rstrip("/"), source, files) if p)
        return read_flows(spark, path).withColumn("ident", F.lit(source))

    return reduce(DataFrame.unionByName, [one(s) for s in sources])


#: partition column of stored flow tables: the capture slot in the form yyyyMMddHHmm
SLOT_NAME = "flow_slot"
#: partition column for whole days
DATE_NAME = "flow_date"


def slot_name(ts: str = "first_ts") -> Column:
    return F.date_format(F.col(ts), "yyyyMMddHHmm")


def write_flows(flows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write flows as parquet, by default in one folder per day.

    Rows are clustered by partition first, so that a partition gets few files. The
    rebalance splits a large day over many tasks instead of sending it to one.
    """
    parts = [DATE_NAME] if partition_by is None else partition_by
    made = {DATE_NAME: F.to_date("first_ts"), SLOT_NAME: slot_name()}
    out = flows.withColumns({c: made[c] for c in parts if c in made and c not in flows.columns})
    if parts:
        out = out.hint("rebalance", *[F.col(c) for c in parts])
    out.write.mode(mode).partitionBy(*parts).parquet(path)


def read_range(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Capture slots between two names, both included, of a table partitioned by slot.

    The names are partition values, so slots outside are not even listed for reading.
    """
    schema = T.StructType([*FLOW_SCHEMA.fields, T.StructField(SLOT_NAME, T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    if first is not None:
        df = df.filter(F.col(SLOT_NAME) >= first)
    if last is not None:
        df = df.filter(F.col(SLOT_NAME) <= last)
    return df


def read_window(spark: SparkSession, path: str, start: datetime, end: datetime, slack: timedelta = timedelta(0)) -> DataFrame:
    """Flows inside [start, end] of a table partitioned by day.

    Whole days outside the window are pruned; `slack` widens the day range for tables
    whose partition day is not the day of `first_ts`.
    """
    schema = T.StructType([*FLOW_SCHEMA.fields, T.StructField(DATE_NAME, T.DateType())])
    df = spark.read.schema(schema).parquet(path)
    days = F.col(DATE_NAME).between(F.lit((start - slack).date()), F.lit((end + slack).date()))
    inside = (F.col("first_ts") >= F.lit(start).cast("timestamp_ntz")) & (
        F.col("last_ts") <= F.lit(end).cast("timestamp_ntz")
    )
    return df.filter(days & inside)


MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "file string, first_ts timestamp_ntz, last_ts timestamp_ntz, flows bigint"


def write_manifest(spark: SparkSession, path: str) -> None:
    """Note for each file of a flow table the earliest start and the latest end of its flows, beside the files.

    Names beginning with an underscore are not read as data. Reads two columns; call it again
    after files were added.
    """
    ranges = (
        spark.read.schema(_stored_schema()).parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count(F.lit(1)).alias("flows"))
    )
    ranges.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MANIFEST}")


def files_in_window(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """The manifest's files whose flows' range meets [start, end]; a file without times is always kept."""
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    meets = (F.col("first_ts") <= last) & (F.col("last_ts") >= first)
    return spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{path.rstrip('/')}/{MANIFEST}").filter(F.coalesce(meets, F.lit(True)))


def read_window_files(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Flows inside [start, end] of a table with a manifest, however it is laid out.

    Only files whose own range meets the window are opened, whatever folder they are in: flows
    that cross midnight, or lie in another day's folder, are found without guessing by how
    much. The driver holds the names of these files, as Spark's file index does.
    """
    names = [r.file for r in files_in_window(spark, path, start, end).select("file").collect()]
    reader = spark.read.schema(_stored_schema())
    df = reader.parquet(*names) if names else spark.createDataFrame([], _stored_schema())
    inside = (F.col("first_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("last_ts") <= F.lit(end).cast("timestamp_ntz"))
    return df.filter(inside)


# Accepted folder layouts -> the pieces of the date they are made of.
LAYOUTS = {
    1: "%Y/%m/%d",
    2: "%Y/%m/%d/%H",
    3: "%Y/%W/%u",
    4: "%Y/%W/%u/%H",
    5: "%Y/%j",
    6: "%Y/%j/%H",
    7: "%F",
    8: "%F/%H",
}


def _date_piece(letter: str, ts: str = "first_ts") -> Column:
    t = F.col(ts)
    monday_first = F.weekday(t)  # 0 = Monday
    # %W counts weeks that start on Monday, days before the first Monday are week 00
    week = R.int_div((F.dayofyear(t) + F.lit(6) - monday_first).cast("bigint"), F.lit(7).cast("bigint"))
    return {
        "Y": lambda: F.date_format(t, "yyyy"),
        "m": lambda: F.date_format(t, "MM"),
        "d": lambda: F.date_format(t, "dd"),
        "H": lambda: F.date_format(t, "HH"),
        "j": lambda: F.date_format(t, "DDD"),
        "W": lambda: F.lpad(week.cast("string"), 2, "0"),
        "u": lambda: (monday_first + 1).cast("string"),
        "F": lambda: F.date_format(t, "yyyy-MM-dd"),
    }[letter]()


def layout_columns(layout: int | str, ts: str = "first_ts") -> dict[str, Column]:
    """Partition columns of a layout, outermost first: {"part_Y": ..., "part_m": ...}."""
    text = LAYOUTS[layout] if isinstance(layout, int) else layout
    if text not in LAYOUTS.values():
        raise ValueError(f"unknown layout: {text}")
    return {f"part_{p[1]}": _date_piece(p[1], ts) for p in text.split("/")}


def sub_hierarchy(flows: DataFrame, layout: int | str) -> DataFrame:
    """Add the folder a flow belongs to, as `sub_dir` text and as partition columns."""
    cols = layout_columns(layout)
    return flows.withColumns(cols).withColumn("sub_dir", F.concat_ws("/", *cols))


def write_hierarchy(flows: DataFrame, path: str, layout: int | str, mode: str = "overwrite") -> None:
    cols = layout_columns(layout)
    write_flows(flows.withColumns(cols), path, list(cols), mode)


def export_aggregated(merged: DataFrame, path: str, by_date: bool = False, mode: str = "overwrite") -> None:
    """Write the result of a flow aggregation; `by_date` sorts it by first seen."""
    (merged.orderBy("first_ts") if by_date else merged).write.mode(mode).parquet(path)


# --- CSV ----------------------------------------------------------------------------

# Columns of the CSV flow form, in order.
CSV_COLUMNS = (
    "ts,te,td,sa,da,sp,dp,pr,flg,fwd,stos,ipkt,ibyt,opkt,obyt,in,out,sas,das,smk,dmk,dtos,dir,"
    "nh,nhb,svln,dvln,ismc,odmc,idmc,osmc,"
    "mpls1,mpls2,mpls3,mpls4,mpls5,mpls6,mpls7,mpls8,mpls9,mpls10,ra,eng"
).split(",")

_CSV_NUMBERS = {
    "sp": "src_port", "dp": "dst_port", "fwd": "fwd_status", "stos": "tos",
    "ipkt": "packets", "ibyt": "bytes", "opkt": "out_packets", "obyt": "out_bytes",
    "in": "input_if", "out": "output_if", "sas": "src_as", "das": "dst_as",
    "smk": "src_mask", "dmk": "dst_mask", "dtos": "dst_tos", "dir": "dir",
    "svln": "src_vlan", "dvln": "dst_vlan",
}
_CSV_ADDRESSES = {"sa": "src", "da": "dst", "nh": "next_hop", "nhb": "bgp_next_hop", "ra": "router"}
_CSV_MACS = {"ismc": "in_src_mac", "odmc": "out_dst_mac", "idmc": "in_dst_mac", "osmc": "out_src_mac"}


def flows_csv(flows: DataFrame) -> DataFrame:
    """The 43-column text form. Absent numbers read 0, absent addresses 0.0.0.0."""
    zero = F.lit(0)
    cols = {
        "ts": X.time_string(F.col("first_ts")),
        "te": X.time_string(F.col("last_ts")),
        "td": F.format_string("%.3f", R.duration_ms() / F.lit(1000.0)),
        "pr": N.proto_name(F.col("prot")),
        "flg": X.flags_string(F.col("tcp_flags")),
        "eng": F.concat_ws(
            "/", *[F.coalesce(F.col(c), zero).cast("string") for c in ("engine_type", "engine_id")]
        ),
    }
    for name, col in _CSV_NUMBERS.items():
        cols[name] = F.coalesce(F.col(col), zero).cast("string")
    for name, addr in _CSV_ADDRESSES.items():
        cols[name] = F.coalesce(A.ip_string(addr), F.lit("0.0.0.0"))
    for name, col in _CSV_MACS.items():
        cols[name] = A.mac_string(F.coalesce(F.col(col), zero.cast("bigint")))
    for i in range(1, 11):
        e = F.coalesce(A.mpls_entry(i), zero)
        cols[f"mpls{i}"] = F.concat_ws("-", *[p.cast("string") for p in (A.label_of(e), A.exp_of(e), A.eos_of(e))])
    return flows.select(*[cols[c].alias(c) for c in CSV_COLUMNS])


def write_flows_csv(flows: DataFrame, path: str, mode: str = "overwrite") -> None:
    flows_csv(flows).write.mode(mode).csv(path, header=True)


def _parse_v4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    return octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]


def _hex_half(digits: Column, start: int) -> Column:
    """16 hex digits to a BIGINT (two's complement)."""
    high = F.conv(F.substring(digits, start, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, start + 8, 8), 16, 10).cast("bigint")
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)


def _v6_digits(text: Column) -> Column:
    """32 hex digits of an IPv6 text, expanded or with `::`."""
    halves = F.split(text, "::")

    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":"), lambda g: g != "")

    left = groups(F.get(halves, F.lit(0)))
    right = F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(g, 4, "0")), "")


def read_flows_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Read the 43-column form back into the flow schema.

    The form has no arrival order, source label or flow count: these stay NULL.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    raw = spark.read.schema(schema).option("header", True).csv(list(paths))
    prot_ids: dict[str, int] = {}
    for i, name in enumerate(N.PROTOCOL_NAMES):
        prot_ids.setdefault(name, i)
    by_name = F.create_map(*[F.lit(x) for item in prot_ids.items() for x in item])
    flag_bits = [
        F.when(F.substring("flg", i + 1, 1) == letter, 1 << (5 - i)).otherwise(0)
        for i, letter in enumerate(X.FLAG_LETTERS)
    ]
    hex_flags = F.conv(F.regexp_extract("flg", r"0x\s*([0-9a-fA-F]+)", 1), 16, 10).cast("int")
    cols: dict[str, Column] = {
        "first_ts": F.col("ts").cast("timestamp_ntz"),
        "is_v6": F.contains(F.col("sa"), F.lit(":")),
        "prot": F.coalesce(by_name[F.col("pr")], F.col("pr").try_cast("int")),
        "tcp_flags": F.when(F.contains(F.col("flg"), F.lit("0x")), hex_flags).otherwise(
            sum(flag_bits[1:], flag_bits[0])
        ),
        "engine_type": F.get(F.split("eng", "/"), F.lit(0)).try_cast("int"),
        "engine_id": F.get(F.split("eng", "/"), F.lit(1)).try_cast("int"),
    }
    # times are whole seconds in the form; the duration restores the milliseconds between them
    millis = F.round(F.col("td").cast("double") * 1000).cast("bigint")
    cols["last_ts"] = F.timestamp_add("MILLISECOND", millis, F.col("ts").cast("timestamp_ntz"))
    for name, col in _CSV_NUMBERS.items():
        cols[col] = F.col(name).try_cast(FLOW_SCHEMA[col].dataType.simpleString())
    for name, addr in _CSV_ADDRESSES.items():
        text, v6 = F.col(name), F.contains(F.col(name), F.lit(":"))
        digits = _v6_digits(text)
        v4 = {"src": "src_addr", "dst": "dst_addr"}.get(addr, addr)
        # added, not nested: below a condition the text would be split anew for each octet
        cols[v4] = _parse_v4(text) + F.when(~v6, F.lit(0))
        cols[f"{addr}_hi"] = F.when(v6, _hex_half(digits, 1))
        cols[f"{addr}_lo"] = F.when(v6, _hex_half(digits, 17))
    for name, col in _CSV_MACS.items():
        cols[col] = F.conv(F.replace(F.col(name), F.lit(":"), F.lit("")), 16, 10).cast("bigint")

    def entry(i: int) -> Column:
        label, exp, eos = (F.get(F.split(f"mpls{i}", "-"), F.lit(j)).try_cast("int") for j in range(3))
        return label * 16 + exp * 2 + eos

    cols["mpls"] = F.array(*[entry(i) for i in range(1, 11)])
    return conform(raw.select(*[c.alias(n) for n, c in cols.items()]))


# --- pipe form and metric results -------------------------------------------------


def _word(c: Column, shift: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(0xFFFFFFFF))


def _words(side: str) -> list[Column]:
    """Address as four 32-bit words; an IPv4 address sits in the last one."""
    v4, hi, lo = F.col(f"{side}_addr"), F.col(f"{side}_hi"), F.col(f"{side}_lo")
    zero = F.lit(0).cast("bigint")
    return [
        F.coalesce(_word(hi, 32), zero),
        F.coalesce(_word(hi, 0), zero),
        F.coalesce(_word(lo, 32), zero),
        F.coalesce(v4, _word(lo, 0), zero),
    ]


def flows_pipe(flows: DataFrame) -> DataFrame:
    """One `|`-separated line of 24 numbers per flow.

    Address family (2 or 10), first, its ms, last, its ms, protocol, source words, source
    port, destination words, destination port, AS numbers, interfaces, flags, tos,
    packets, bytes.
    """
    first, last = R.epoch_ms("first_ts"), R.epoch_ms("last_ts")
    thousand = F.lit(1000).cast("bigint")
    fields = [
        F.when(F.col("is_v6"), 10).otherwise(2),
        R.int_div(first, thousand),
        F.pmod(first, thousand),
        R.int_div(last, thousand),
        F.pmod(last, thousand),
        F.col("prot"),
        *_words("src"),
        F.col("src_port"),
        *_words("dst"),
        F.col("dst_port"),
        *[F.col(c) for c in ("src_as", "dst_as", "input_if", "output_if", "tcp_flags", "tos", "packets", "bytes")],
    ]
    return flows.select(
        F.concat_ws("|", *[F.coalesce(f, F.lit(0)).cast("string") for f in fields]).alias("value")
    )


def write_flows_pipe(flows: DataFrame, path: str, mode: str = "overwrite") -> None:
    flows_pipe(flows).write.mode(mode).text(path)


def metric_csv(result: DataFrame) -> DataFrame:
    """A metric result as text: slot first, real numbers with six decimals."""
    order = ["slot", *[c for c in result.columns if c != "slot"]]

    def shown(c: str) -> Column:
        kind = result.schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.format_string("%.6f", F.col(c).cast("double"))
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return X.time_string(F.col(c))
        return F.col(c).cast("string")

    return result.select(*[shown(c).alias(c) for c in order])


def write_metric_csv(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    metric_csv(result).write.mode(mode).csv(path, header=True)
