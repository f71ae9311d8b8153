"""Column functions over strings, bodies and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: String classes in the order in which they are tried.
STRING_CLASSES = (
    ("crypto_hint", r"(?i)\b(AES|RSA|SHA[-_]?\d*|MD5|3DES|DES|HMAC|ECDSA|ECDH|EVP_|SSL_|TLS_|openssl|mbedtls|wolfssl|libcrypto)"),
    ("ipc_sock", r"(?i)(\.sock$|\.socket$|/var/run/\S+|\.pipe$|/tmp/\S+\.(sock|pipe|fifo)|PIPE_|\.fifo$)"),
    ("url", r"(?i)(https?://|ftp://|mqtt://|coap://|ws://)"),
    ("path", r"^/[a-zA-Z][a-zA-Z0-9_./\-]{3,}$"),
    ("nvram_key", r"^[A-Z][A-Z0-9_]{2,30}$"),
    ("format_str", r"%[0-9]*[sdifxXpuloO]"),
)
#: Directories too common to link two binaries.
GENERIC_PATHS = ("/tmp", "/var", "/proc", "/sys", "/dev", "/etc", "/usr", "/lib", "/bin", "/sbin", "/usr/lib", "/usr/bin")
#: String classes that may link two binaries.
SHARED_CLASSES = ("ipc_sock", "path", "crypto_hint")
#: A template's conversion, what it may stand for, and the mark of a key that was built.
CONVERSION = r"%[-+ 0#]*\d*(?:\.\d+)?[hljztL]*"
CONVERSIONS = (("[diou]", "[0-9]+"), ("[xX]", "[0-9a-fA-F]+"), ("[sp]", ".+"), ("c", "."), ("%", "%"))
BUILT = "<built:"


def string_class(value: Column) -> Column:
    """The first class whose rule a string matches, else misc; null stays null."""
    out = F.when(value.isNull(), None)
    for name, pattern in STRING_CLASSES:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise("misc")


def useful_shared_string(value: Column) -> Column:
    """Whether a string may link two binaries: 8 to 150 characters, no generic directory, not all digits."""
    bare = F.regexp_replace(value, "/+$", "")
    return F.length(value).between(8, 150) & ~value.isin(*GENERIC_PATHS) & ~bare.isin(*GENERIC_PATHS) & ~value.rlike(r"^\d+$")


def hex_address(number: Column) -> Column:
    """Eight lower-case hex digits (more where needed) of an address."""
    digits = F.lower(F.hex(number))
    return F.when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0"))


def address_candidates(text: Column) -> Column:
    """The numbers that an address may spell: hex with 0x, ``FUN_`` or neither, and bare digits in decimal too. Unsigned, of up to 64 bits."""
    token = F.trim(text)
    named = F.upper(F.substring(token, 1, 4)) == "FUN_"
    rest = F.when(named, F.substring(token, 5, 1 << 20)).otherwise(token)
    marked = F.lower(F.substring(rest, 1, 2)) == "0x"
    bare = F.regexp_replace(F.lower(F.when(marked, F.substring(rest, 3, 1 << 20)).otherwise(rest)), "^0+(?=.)", "")
    number = lambda base, fits: F.when(fits, F.conv(bare, base, 10).cast("decimal(20,0)"))
    decimal = bare.rlike("^[0-9]{1,20}$") & ~named & ~marked & (F.lpad(bare, 20, "0") <= "18446744073709551615")
    return F.array_distinct(F.array_compact(F.array(number(16, bare.rlike("^[0-9a-f]{1,16}$")), number(10, decimal))))


def parse_address(text: Column) -> Column:
    """The number that an address spells in hex; null where it spells none."""
    return F.get(address_candidates(text), F.lit(0))


def skeleton(body: Column) -> Column:
    """A body without what moves when code moves: synthetic names' addresses and large literals."""
    named = F.regexp_replace(body, r"_[0-9a-fA-F]{6,}\b", "_@")
    return F.regexp_replace(named, r"0x[0-9a-fA-F]{6,}\b", "0x#")


def skeleton_key(body: Column) -> Column:
    return F.sha2(skeleton(body), 256)


def large_literals(body: Column) -> Column:
    """The values of large literals in order."""
    named = F.regexp_replace(body, r"_[0-9a-fA-F]{6,}\b", "_@")
    return F.transform(F.regexp_extract_all(named, F.lit(r"0x([0-9a-fA-F]{6,})\b"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("decimal(20,0)"))


def template_pattern(template: Column) -> Column:
    """A regular expression that a key built by a printf template matches whole; null where a conversion is unknown or the key was built otherwise."""
    known = F.regexp_replace(template, CONVERSION + "[diouxXscp%]", "")
    # A conversion becomes a mark first, so that neither its letters nor what it stands for are taken for the template's own; %% counts where a reading from the left meets it.
    out = F.regexp_replace(template, "%%", "\x01")
    for i, (letters, _) in enumerate(CONVERSIONS):
        out = F.regexp_replace(out, CONVERSION + letters, chr(2 + i))
    out = F.regexp_replace(out, r"([.^$*+?()\[\]{}|\\])", r"\\$1")
    for i, (_, stands) in enumerate(CONVERSIONS):
        out = F.replace(out, F.lit(chr(2 + i)), F.lit(stands))
    whole = F.concat(F.lit("^"), F.replace(out, F.lit("\x01"), F.lit("%")), F.lit("$"))
    return F.when(~template.contains(BUILT) & ~known.contains("%"), whole)


def template_anchored(template: Column) -> Column:
    """Whether a template has two characters of its own besides conversions and white space."""
    own = F.regexp_replace(F.regexp_replace(template, CONVERSION + "[diouxXscp%]", ""), r"\s", "")
    return ~template.contains(BUILT) & (F.length(own) >= 2)


def conversions(template: Column) -> Column:
    """The printf conversions of a format; %% is none."""
    return F.regexp_extract_all(F.regexp_replace(template, "%%", ""), F.lit(r"%[-#0 +]*(?:[0-9]+|\*)?(?:\.(?:[0-9]+|\*))?(?:hh|h|ll|l|z|j|t|L)?([diouxXeEfgGcspn])"), F.lit(1))


def fill_constants(template: Column, values: Column) -> Column:
    """A format with its plain %s replaced by the arguments (array, null where not a constant text) that are constants.

    What a run decides stays a conversion. One with a width or precision given as * is
    left, and takes its arguments.
    """
    any_ = r"%(?:%|[-#0 +]*(?:[0-9]+|\*)?(?:\.(?:[0-9]+|\*))?(?:hh|h|ll|l|z|j|t|L)?[diouxXeEfgGcspn])"
    found, between = F.regexp_extract_all(template, F.lit(any_), F.lit(0)), F.split(template, any_)
    # The text so far and the arguments taken: one step for each conversion and what follows it.
    step = lambda s, x: F.struct(F.concat(s["text"], F.when(x["c"].rlike(r"^%[^*]*s$"), F.coalesce(F.get(values, s["taken"]), x["c"])).otherwise(x["c"]), x["after"]).alias("text"), (s["taken"] + F.when(x["c"] == "%%", 0).otherwise(1 + F.regexp_count(x["c"], F.lit(r"\*")))).alias("taken"))
    pieces = F.arrays_zip(found.alias("c"), F.slice(between, 2, 1 << 30).alias("after"))
    start = F.struct(F.get(between, F.lit(0)).alias("text"), F.lit(0).alias("taken"))
    return F.aggregate(pieces, start, step, lambda s: s["text"])


#: A private key's header and a whole crypt hash.
PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
CRYPT_HASH = r"(?<![\w$])\$(1|2[aby]?|5|6)\$(?:rounds=\d+\$)?[./A-Za-z0-9]{1,22}\$[./A-Za-z0-9]{8,}"


def shape_only(difference: Column) -> Column:
    """Why a file difference (array of its lines) may be told by its shape alone: a line other than a head holds a private key or a password's hash; null if none does."""
    lines = F.filter(difference, lambda x: ~x.startswith("@@"))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^[+\- ]", ""))
    return F.when(F.exists(bare, lambda x: x.rlike(PRIVATE_KEY) | x.rlike(CRYPT_HASH)), "embedded_secret")


def arity(template: Column) -> Column:
    """Arguments that a format takes, widths and precisions given as * included."""
    text = F.regexp_replace(template, "%%", "")
    return F.size(conversions(template)) + F.regexp_count(text, F.lit(r"%[-#0 +]*\*")) + F.regexp_count(text, F.lit(r"%[-#0 +]*(?:[0-9]+|\*)?\.\*"))


def fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits of the hash of parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 16)


def shard(key: Column, workers: int) -> Column:
    """A worker's number by the first eight hex digits of a key's hash."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % workers
