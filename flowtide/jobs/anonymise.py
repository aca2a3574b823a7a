"""Prefix-preserving anonymisation of addresses.

Bit i of the result is bit i of the address, flipped when the top bit of
AES(first i address bits, then pad bits) is set. Two addresses that share their first n
bits therefore still share exactly n. The pad is the second half of the key, encrypted
with the first half.

A flip depends on a prefix only, so prefixes form a tree: each distinct prefix of a level is
encrypted once, for the bits since the level before, with the built-in `aes_encrypt`, and an
address is composed of the flips of its prefixes. Nothing that links addresses to their
pseudonyms is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.schema import ADDRESS_COLUMNS

#: prefix lengths of the tree's levels; the first level of IPv4 has 65,536 prefixes at most
LEVELS_V4 = (16, 24, 32)
LEVELS_V6 = (32, 48, 64, 96, 128)


def parse_key(text: str) -> bytes:
    """A key of 32 characters, or 0x and 64 hex digits."""
    if len(text) == 32:
        key = text.encode("latin-1")
    elif len(text) == 66 and text[:2].lower() == "0x":
        key = bytes.fromhex(text[2:])
    else:
        raise ValueError("a key is 32 characters, or 0x followed by 64 hex digits")
    return key


def aes_block(block: Column, key: bytes) -> Column:
    """AES of one 16-byte block. (ECB with padding adds a second block, which is cut off.)"""
    out = F.aes_encrypt(block, F.lit(key[:16]), F.lit("ECB"), F.lit("PKCS"))
    return F.substring(out, 1, 16)


def _pad(key: bytes) -> Column:
    return aes_block(F.lit(key[16:]), key)


def _hex_word(hexed: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(hexed, start, digits), 16, 10).cast("bigint")


def _pad_word(key: bytes, i: int) -> Column:
    """Word i (32 bits) of the pad."""
    return _hex_word(F.hex(_pad(key)), 1 + 8 * i, 8)


def _top_bit(block_hex: Column, key: bytes) -> Column:
    first = F.substring(F.hex(aes_block(F.unhex(block_hex), key)), 1, 1)
    return (first >= "8").cast("bigint")


def _shl(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n.cast("int"))


def flips_v4(prefix: Column, first: int, last: int, key: bytes) -> Column:
    """Bits `first` to `last` - 1 of the flips of addresses that begin with the bits of `prefix`, in place."""
    pad_hex = F.hex(_pad(key))
    pad, tail = _hex_word(pad_hex, 1, 8), F.substring(pad_hex, 9, 24)

    def flip(acc: Column, pos: Column) -> Column:
        # mask with `pos` leading ones
        mask = _shl(F.lit(0xFFFFFFFF).cast("bigint"), F.lit(32) - pos).bitwiseAND(F.lit(0xFFFFFFFF))
        word = prefix.bitwiseAND(mask).bitwiseOR(pad.bitwiseAND(F.bitwise_not(mask)))
        bit = _top_bit(F.concat(F.lpad(F.hex(word), 8, "0"), tail), key)
        return acc.bitwiseOR(_shl(bit, F.lit(31) - pos))

    return F.aggregate(F.sequence(F.lit(first), F.lit(last - 1)), F.lit(0).cast("bigint"), flip)


def flips_v6(hi: Column, lo: Column, first: int, last: int, key: bytes) -> Column:
    """The same for 128 bits; `first` to `last` lie in one half, whose word is returned."""
    pad_hex = F.hex(_pad(key))

    def half(digits_from: int) -> Column:
        top = _hex_word(pad_hex, digits_from, 8)
        return _shl(top, F.lit(32)).bitwiseOR(_hex_word(pad_hex, digits_from + 8, 8))

    pad_hi, pad_lo = half(1), half(17)
    ones, zero = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")

    def mixed(word: Column, pad: Column, bits: Column) -> Column:
        """`bits` leading bits of the word, the rest from the pad."""
        mask = F.when(bits >= 64, ones).when(bits <= 0, zero).otherwise(_shl(ones, F.lit(64) - bits))
        return word.bitwiseAND(mask).bitwiseOR(pad.bitwiseAND(F.bitwise_not(mask)))

    def flip(acc: Column, pos: Column) -> Column:
        h, l = mixed(hi, pad_hi, pos), mixed(lo, pad_lo, pos - 64)
        bit = _top_bit(F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(l), 16, "0")), key)
        return acc.bitwiseOR(_shl(bit, F.lit(63) - F.pmod(pos, F.lit(64))))

    return F.aggregate(F.sequence(F.lit(first), F.lit(last - 1)), zero, flip)


def anonymise_v4(addr: Column, key: bytes) -> Column:
    """The anonymised 32-bit address, all bits at once."""
    return flips_v4(addr, 0, 32, key).bitwiseXOR(addr)


def anonymise_v6(hi: Column, lo: Column, key: bytes) -> tuple[Column, Column]:
    """Both halves of the anonymised 128-bit address, all bits at once."""
    return flips_v6(hi, lo, 0, 64, key).bitwiseXOR(hi), flips_v6(hi, lo, 64, 128, key).bitwiseXOR(lo)


def _top(word: Column, bits: int, size: int) -> Column:
    """The first `bits` bits of a word of `size` bits, the others 0."""
    if bits <= 0:
        return F.lit(0).cast("bigint")
    mask = (1 << size) - (1 << size - bits)
    return word.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def prefix_tree_v4(addresses: DataFrame, key: bytes) -> list[DataFrame]:
    """Levels of distinct prefixes of `v4`, last level the addresses: `v4`, `flips` of all bits so far."""
    wanted = [addresses.select(_top(F.col("v4"), bits, 32).alias("v4")).distinct() for bits in LEVELS_V4]
    out: list[DataFrame] = []
    for bits, nodes in zip(LEVELS_V4, wanted):
        first = LEVELS_V4[len(out) - 1] if out else 0
        own = nodes.withColumn("flips", flips_v4(F.col("v4"), first, bits, key))
        if out:
            above = out[-1].select(F.col("v4").alias("_above"), F.col("flips").alias("_flips"))
            own = own.join(above, _top(F.col("v4"), first, 32) == F.col("_above")).select("v4", F.col("flips").bitwiseOR(F.col("_flips")).alias("flips"))
        out.append(own)
    return out


def prefix_tree_v6(addresses: DataFrame, key: bytes) -> list[DataFrame]:
    """The same for `hi`, `lo`: `flips_hi`, `flips_lo`."""

    def prefix(bits: int) -> list[Column]:
        return [_top(F.col("hi"), min(bits, 64), 64).alias("hi"), _top(F.col("lo"), bits - 64, 64).alias("lo")]

    zero = F.lit(0).cast("bigint")
    out: list[DataFrame] = []
    for bits in LEVELS_V6:
        first = LEVELS_V6[len(out) - 1] if out else 0
        own = flips_v6(F.col("hi"), F.col("lo"), first, bits, key)
        nodes = addresses.select(*prefix(bits)).distinct().select("hi", "lo", (own if bits <= 64 else zero).alias("flips_hi"), (own if bits > 64 else zero).alias("flips_lo"))
        if out:
            above = out[-1].select(*[F.col(c).alias(f"_{c}") for c in out[-1].columns])
            on = (_top(F.col("hi"), min(first, 64), 64) == F.col("_hi")) & (_top(F.col("lo"), first - 64, 64) == F.col("_lo"))
            nodes = nodes.join(above, on).select("hi", "lo", *[F.col(c).bitwiseOR(F.col(f"_{c}")).alias(c) for c in ("flips_hi", "flips_lo")])
        out.append(nodes)
    return out


_ROLES = tuple(ADDRESS_COLUMNS)


def _tuple_id(offset: int) -> Column:
    """Half of a 128-bit hash of all addresses of a flow."""
    return F.xxhash64(F.lit(offset), *[F.col(c) for cols in ADDRESS_COLUMNS.values() for c in cols])


def anonymise(flows: DataFrame, key: bytes | str) -> DataFrame:
    """All five addresses of a flow anonymised, AS numbers set to 0.

    The distinct combinations of a flow's addresses are told by 128-bit hashes. Their addresses
    are looked up one row each and gathered again per combination, and flows meet the result
    once: one wide join, on a key that no missing address makes frequent.
    """
    key = parse_key(key) if isinstance(key, str) else key
    keyed = flows.withColumns({"_t1": _tuple_id(1), "_t2": _tuple_id(2)})
    every = F.array(*[F.struct(*[F.col(c).alias(k) for c, k in zip(ADDRESS_COLUMNS[n], ("v4", "hi", "lo"))]) for n in _ROLES])
    combined = keyed.select("_t1", "_t2", *[c for cols in ADDRESS_COLUMNS.values() for c in cols]).distinct()
    rows = combined.select("_t1", "_t2", F.posexplode(every).alias("role", "a")).select("_t1", "_t2", "role", "a.*")
    v4, v6 = rows.filter("v4 IS NOT NULL"), rows.filter("v4 IS NULL AND hi IS NOT NULL")
    anon4 = v4.join(prefix_tree_v4(v4.select("v4").distinct(), key)[-1], "v4").select("_t1", "_t2", "role", F.col("v4").bitwiseXOR(F.col("flips")).alias("v4"), F.lit(None).cast("bigint").alias("hi"), F.lit(None).cast("bigint").alias("lo"))
    tree6 = prefix_tree_v6(v6.select("hi", "lo").distinct(), key)[-1]
    anon6 = v6.join(tree6, ["hi", "lo"]).select("_t1", "_t2", "role", "v4", F.col("hi").bitwiseXOR(F.col("flips_hi")).alias("hi"), F.col("lo").bitwiseXOR(F.col("flips_lo")).alias("lo"))
    gathered = anon4.union(anon6).groupBy("_t1", "_t2").agg(
        *[F.max(F.when(F.col("role") == i, F.col(k))).alias(f"_{n}_{k}") for i, n in enumerate(_ROLES) for k in ("v4", "hi", "lo")]
    )
    out = keyed.join(gathered, ["_t1", "_t2"], "left")
    new = {c: F.col(f"_{n}_{k}") for n, cols in ADDRESS_COLUMNS.items() for c, k in zip(cols, ("v4", "hi", "lo"))}
    as_zero = {c: F.when(F.col(c).isNotNull(), F.lit(0).cast("bigint")) for c in ("src_as", "dst_as")}
    return out.withColumns({**new, **as_zero}).select(*flows.columns)
