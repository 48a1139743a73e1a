"""Column expressions: cache keys, identity bytes, reason bits, u64 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the parts of a key; it cannot occur in the first two parts' tags.
SEP = "|"


def hash_key(h: Column) -> Column:
    """u:1042 or b:AAEC...; how a hash is written is part of its identity."""
    return F.when(h["encoding"] == "u64", F.concat(F.lit("u:"), h["u64"].cast("string"))).otherwise(F.concat(F.lit("b:"), F.regexp_replace(F.base64(h["bytes"]), "[\r\n]", "")))


def scope_key(group: Column, medium: Column) -> Column:
    """Group and medium of a key; unspecified is a value of its own, never 0 or an empty name. Named media come last: they may hold anything."""
    g = F.when(group["kind"] == "index", F.concat(F.lit("g"), group["value"].cast("string"))).otherwise("-")
    m = F.when(medium["kind"] == "named", F.concat(F.lit("m"), medium["value"])).otherwise("-")
    return F.concat(g, F.lit(SEP), m)


def cache_key(h: Column, group: Column, medium: Column) -> Column:
    return F.concat(hash_key(h), F.lit(SEP), scope_key(group, medium))


def key_bytes(h: Column, group: Column, medium: Column) -> Column:
    """What a key counts against the identity budget."""
    g = F.when(group["kind"] == "index", 4).otherwise(0)
    m = F.when(medium["kind"] == "named", F.octet_length(medium["value"])).otherwise(0)
    return (g + m + F.when(h["encoding"] == "u64", 8).otherwise(F.octet_length(h["bytes"]))).cast("long")


def first_clear(mutations: Column) -> Column:
    """Position of the first clear, null if there is none."""
    at = F.array_position(F.transform(mutations, lambda m: m["op"]), "clear")
    return F.when(at > 0, (at - 1).cast("int"))


def cache_ops(mutations: Column) -> Column:
    """Mutations as array<struct<op, keys, sizes>>: all that the fold reads of them."""
    return F.transform(
        mutations,
        lambda m: F.struct(
            m["op"].alias("op"),
            F.transform(m["hashes"], lambda h: cache_key(h, m["grp"], m["medium"])).alias("keys"),
            F.transform(m["hashes"], lambda h: key_bytes(h, m["grp"], m["medium"])).alias("sizes"),
        ),
    )


def reason_names(bits: Column) -> Column:
    names = {1: "baseline", 2: "equivocation", 4: "unavailable_gap", 8: "unclosed_gap"}
    return F.filter(F.array(*(F.when(bits.bitwiseAND(b) > 0, F.lit(n)) for b, n in names.items())), lambda x: x.isNotNull())


def is_u64_text(text: Column) -> Column:
    """A decimal without leading zeros, up to 2**64 - 1."""
    return F.coalesce(text.rlike("^(0|[1-9][0-9]{0,19})$") & (F.lpad(text, 20, "0") <= F.lit(str(2**64 - 1))), F.lit(False))


def eligible(certainty: Column, authoritative: Column, reasons: Column, pending: Column, pending_bytes: Column) -> Column:
    """Whether a summary may be compared: exact, authoritative, with nothing open."""
    return (certainty == "exact") & authoritative & (reasons == 0) & (pending == 0) & (pending_bytes == 0)
