"""References of candidates and anchors of judgements, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The end of a reference is ``:<entry>@<class>``, then an offset or an ordinal; here after its colon, which is a reference's last one. What may follow a ``$``, and the end of the class of a call through a wrapper.
TAIL = r"^[0-9a-f]+@[a-z_]+(?:@-?0x[0-9a-f]+|#\d+)?$"
TERMINATORS = "\n\r\x85\u2028\u2029"
WRAPPED = "_via_wrapper"


def _number(hexed: Column) -> Column:
    text = F.conv(hexed, 16, 10)
    return F.when(F.length(hexed) < 16, text.cast("long")).otherwise(text.cast("decimal(20,0)").cast("long"))


def _parts(ref: Column) -> dict[str, Column]:
    """head, entry, class, offset (signed) and ordinal of a reference, and whether it has such an end: one match of the short end, which is then cut at its marks."""
    end = F.substring_index(ref, ":", -1)
    tail = F.rtrim(end, F.lit(TERMINATORS))
    body = F.substring_index(tail, "@", -1)
    placed = F.length(tail) - F.length(F.replace(tail, F.lit("@"), F.lit(""))) == 2
    kind = F.when(placed, F.substring_index(F.substring_index(tail, "@", 2), "@", -1)).otherwise(F.substring_index(body, "#", 1))
    number = _number(F.substring_index(body, "0x", -1))
    met = ref.contains(":") & end.rlike(TAIL)
    found = {"entry": _number(F.substring_index(tail, "@", 1)), "class": kind, "offset": F.when(placed, F.when(body.startswith("-"), -number).otherwise(number)), "ordinal": F.when(body.contains("#"), F.substring_index(body, "#", -1).cast("long"))}
    cut = F.concat(F.substring(ref, F.lit(1), F.length(ref) - F.length(end) - 1), F.substring(end, F.length(tail) + 1, F.length(end)))
    return {k: F.when(met, v) for k, v in found.items()} | {"head": F.when(met, cut).otherwise(ref), "met": met}


def ref_parts(ref: Column) -> Column:
    """entry, class, offset (signed) and ordinal of a reference; null without such an end."""
    p = _parts(ref)
    return F.when(p["met"], F.struct(*(p[c].alias(c) for c in ("entry", "class", "offset", "ordinal"))))


def is_wrapper(kind: Column) -> Column:
    return kind.endswith(WRAPPED)


def call_address(ref: Column, wrapped: bool = False) -> Column:
    """The address of the call that a reference names: of the sink itself, or with ``wrapped`` of the call to its wrapper. Null for every other shape."""
    p = _parts(ref)
    kind = is_wrapper(p["class"])
    return F.when(p["offset"].isNotNull() & (kind if wrapped else ~kind), p["entry"] + p["offset"])


def offset_text(offset: Column) -> Column:
    """A signed offset as a reference writes it, six digits at least."""
    digits = F.lower(F.hex(F.abs(offset)))
    return F.concat(F.when(offset < 0, "-").otherwise(""), F.lit("0x"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def build_ref(run: Column, binary: Column, entry: Column, suffix: Column) -> Column:
    return F.concat(run, F.lit("#"), binary, F.lit(":"), entry, F.lit("@"), suffix)


def suffix(kind: Column, offset: Column, ordinal: Column) -> Column:
    """The class, with the call's offset or else its ordinal where there is one."""
    return F.when(offset.isNotNull(), F.concat(kind, F.lit("@"), offset)).when(ordinal.isNotNull(), F.concat(kind, F.lit("#"), ordinal.cast("string"))).otherwise(kind)


def anchor(run_a: Column, run_b: Column, kind: str, *key: Column) -> Column:
    """An anchor of a pair of runs: function_pair (binary, both addresses), function_presence (binary, side, address), candidate (subject), non_binary (path), binary_presence (side, path, and an address for one of its functions)."""
    pair = F.concat(run_a, F.lit(".."), run_b)
    inner = {
        "function_pair": lambda b, x, y: F.concat(b, F.lit("::"), x, F.lit("::"), y),
        "function_presence": lambda b, side, x: F.concat(b, F.lit("::"), side, F.lit(":"), x),
        "candidate": lambda subject: subject,
        "non_binary": lambda path: path,
        "binary_presence": lambda side, path, *x: F.concat(side, F.lit(":"), path, *(F.concat(F.lit("::"), a) for a in x)),
    }[kind](*key)
    return F.concat(pair, F.lit(f"#{kind}#"), inner)


def split_anchor(ref: Column) -> Column:
    """pair, kind and key of an anchor."""
    pattern = r"^([^#]+)#([a-z_]+)#(.*)$"
    return F.when(ref.rlike(pattern), F.struct(*(F.regexp_extract(ref, pattern, i + 1).alias(c) for i, c in enumerate(("pair", "kind", "key")))))


def minted(candidates: DataFrame) -> DataFrame:
    """candidates (evidence_ref, callsite, out_of_body) with ``formal_ref``: one anchor for each call outside of a body.

    Of the bare references that claim a call, those of the lowest entry are given the
    call's offset, unless a reference is anchored there already; the others stay as
    they are. No row is dropped. Claims are joined by their call, so no group is held.
    """
    p = _parts(F.col("evidence_ref"))
    bare = F.col("__offset").isNull() & F.col("__ordinal").isNull() & F.col("out_of_body") & F.col("callsite").isNotNull()
    read = candidates.withColumns({f"__{c}": p[c] for c in ("head", "class", "entry", "offset", "ordinal")})
    call = F.when(F.col("__offset").isNotNull(), F.col("__entry") + F.col("__offset")).when(bare, F.col("callsite"))
    # The array of one keeps conditions on what was read from being moved below the reading, which would be done for each.
    marks = F.inline(F.array(F.struct(F.col("__head"), F.col("__class"), F.col("__entry"), call.alias("__call"), F.coalesce(bare, F.lit(False)).alias("__bare"))))
    rows = read.select(*candidates.columns, marks)
    key = ["__head", "__class", "__call"]
    calls = rows.where("__call IS NOT NULL").groupBy(*key).agg(F.bool_or(~F.col("__bare")).alias("__taken"), F.min(F.when(F.col("__bare"), F.col("__entry"))).alias("__first"))
    found = rows.join(calls, key, "left")
    claims = F.col("__bare") & ~F.col("__taken") & (F.col("__entry") == F.col("__first"))
    formal = F.when(claims, F.concat("evidence_ref", F.lit("@"), offset_text(F.col("__call") - F.col("__entry")))).otherwise(F.col("evidence_ref"))
    return found.withColumn("formal_ref", formal).select(*candidates.columns, "formal_ref")
