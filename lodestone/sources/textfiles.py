"""Rows out of text files: configuration, scripts and web pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Configuration rules in the order in which they are tried, over ``key=value``.
CONFIG_RULES = (
    ("hardcoded_credential", r"(?i)(?<![a-zA-Z0-9])(pass(word|wd)?|secret|api[_-]?key|token|priv(ate)?_?key)(?:[_-]\w*)?\s*[=:]\s*\S"),
    ("auth_disabled", r"(?i)(?<![a-zA-Z0-9])(auth|authentication|login_required)(?:[_-]\w*)?\s*[=:]\s*(0|no|off|false|disabled)\b"),
    ("debug_enabled", r"(?i)(?<![a-zA-Z0-9])(debug|verbose|test_mode)(?:[_-]\w*)?\s*[=:]\s*(1|yes|on|true|enabled)\b"),
    ("weak_crypto_setting", r"(?i)\b(ssl|tls|cipher|crypto|hash)\b.*\b(off|none|md5|rc4|des|sslv2|sslv3|tls1\.0)\b"),
)
#: Words, in lower case, of which a text that any of these rules matches has one.
CONFIG_WORDS = ("pass", "secret", "key", "token", "auth", "login_required", "debug", "verbose", "test_mode", "ssl", "tls", "cipher", "crypto", "hash")
#: What ends a line.
SPLIT = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
#: Endpoint rules in the order in which they are tried: name, pattern, groups of method and path.
ENDPOINT_RULES = (
    ("fetch", r"""(?i)fetch\(\s*['"]([^'"]+)['"]""", 0, 1),
    ("axios", r"""(?i)axios\.(get|post|put|delete|patch)\(\s*['"]([^'"]+)['"]""", 1, 2),
    ("xhr", r"""(?i)\.open\(\s*['"]([A-Za-z]+)['"]\s*,\s*['"]([^'"]+)['"]""", 1, 2),
    ("ajax", r"""(?i)url\s*:\s*['"]([^'"]+)['"]""", 0, 1),
    ("form", r"""(?i)<form\b([^>]*)>""", 0, 1),
    ("cgi_ref", r"""(/cgi-bin/[A-Za-z0-9_.\-]+)""", 0, 1),
    ("literal", r"""['"](/(?:api|rest|goform|cgi-bin)/[^'"\s]*)['"]""", 0, 1),
)


def _first(text: Column, rules) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def config_entries(files: DataFrame) -> DataFrame:
    """Entries of configuration files (path, text) that a rule matches: section, key, value, rule, sensitive, line.

    ``key=value`` is tried before ``key value``; a section header holds for the lines
    after it; blank lines and those from # or ; on are no entries.
    """
    lowered = lambda c: F.lower(F.col(c))
    named = lambda c: reduce(Column.__or__, (lowered(c).contains(w) for w in CONFIG_WORDS))
    split = files.where(named("text")).select("path", F.posexplode(F.split("text", SPLIT)).alias("line", "raw"))
    # A file or line that no rule's word is in has no entry; headers stay for the lines after them.
    lines = split.where(named("raw") | F.col("raw").contains("[")).withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''").where(~F.col("raw").rlike("^[#;]"))
    header = F.col("raw").rlike(r"^\[[^\]]+\]")
    headed = lines.withColumn("head", F.when(header, F.regexp_extract("raw", r"^\[([^\]]+)\]", 1)))
    carried = F.last("head", ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    kinds = headed.withColumn("section", carried).where("head IS NULL")
    # The two forms of an entry.
    equals = r"^([^=\s][^=]*?)\s*=\s*(.*)"
    spaced = r"^(\S+)\s+(\S.*)"
    part = lambda g: F.when(F.col("raw").rlike(equals), F.regexp_extract("raw", equals, g)).when(F.col("raw").rlike(spaced), F.regexp_extract("raw", spaced, g))
    # Arrays of one keep a condition on what a line is read as from reading the line again.
    pair = F.inline(F.array(F.struct(F.trim(part(1)).alias("key"), F.trim(part(2)).alias("value"))))
    entries = kinds.where(named("raw")).select("path", "line", "section", pair).where("key IS NOT NULL")
    ruled = entries.select("*", F.explode(F.array(_first(F.concat_ws("=", "key", "value"), CONFIG_RULES))).alias("rule"))
    return ruled.where("rule IS NOT NULL").withColumn("sensitive", F.col("rule") == "hardcoded_credential")


def web_endpoints(files: DataFrame) -> DataFrame:
    """Endpoints of web files (path, text): each once for its first rule, with the method where the rule has one."""

    def hits(rank: int, name: str, pattern: str, method: int, path: int) -> Column:
        paths, verbs = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (path, method))
        return F.zip_with(paths, verbs, lambda p, v: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("source"), F.upper(v if method else F.lit(None).cast("string")).alias("method"), p.alias("endpoint")))

    found = [hits(i, *rule) for i, rule in enumerate(ENDPOINT_RULES)]
    rows = files.select("path", F.posexplode(F.concat(*found)).alias("place", "e")).select("path", "place", "e.*")
    form = F.col("source") == "form"
    action, verb = (F.regexp_extract("endpoint", rf"""(?i)\b{a}\s*=\s*['"]([^'"]+)['"]""", 1) for a in ("action", "method"))
    read = rows.withColumn("method", F.when(form, F.upper(F.nullif(verb, F.lit("")))).otherwise(F.col("method"))).withColumn("endpoint", F.when(form, action).otherwise(F.col("endpoint"))).where("endpoint <> ''")
    first = F.row_number().over(Window.partitionBy("path", "endpoint").orderBy("rank", "place"))
    return read.withColumn("__n", first).where("__n = 1").select("path", "endpoint", "method", "source")


#: Inputs whose name carries nothing that a user enters, and scripts' ways of setting a field.
NOT_ENTERED = ("hidden", "button", "reset")
NAME_ATTRIBUTE = r"""(?i)\bname\s*=\s*['"]?([A-Za-z0-9_]+)"""
TYPE_ATTRIBUTE = r"""(?i)\btype\s*=\s*['"]?([A-Za-z]+)"""
SCRIPT_RULES = (("js_form_assign", r"""(?i)\bdocument\.form\.([A-Za-z0-9_]+)\.value\s*="""), ("nvram_char_to_ascii", r"""(?i)nvram_char_to_ascii\(\s*['"][^'"]*['"]\s*,\s*['"]([A-Za-z0-9_]+)['"]"""))


def form_fields(files: DataFrame) -> DataFrame:
    """Names of fields that a user can set, once for each rule: inputs but hidden, button and reset ones, text areas, selects, and fields that a script assigns or fills."""
    tags = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)<(?:input|textarea|select)\b[^>]*>"), F.lit(0)), lambda t: F.struct(F.lower(F.regexp_extract(t, r"^<([A-Za-z]+)", 1)).alias("rule"), F.regexp_extract(t, NAME_ATTRIBUTE, 1).alias("field"), F.lower(F.regexp_extract(t, TYPE_ATTRIBUTE, 1)).alias("type")))
    named = lambda rule: lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("field"), F.lit("").alias("type"))
    scripts = [F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), named(rule)) for rule, pattern in SCRIPT_RULES]
    rows = files.select("path", F.explode(F.concat(tags, *scripts)).alias("f")).select("path", "f.*")
    return rows.where((F.col("field") != "") & ~((F.col("rule") == "input") & F.col("type").isin(*NOT_ENTERED))).select("path", "field", "rule").distinct()


def _pages(text: str | None, size: int) -> list[tuple[int, int, int, str]]:
    out, held, used, first = [], [], 0, 0
    for i, line in enumerate((text or "").splitlines(keepends=True)):
        if held and used + len(line) > size:
            out.append((len(out), first, len(held), "".join(held)))
            held, used, first = [], 0, i
        held.append(line)
        used += len(line)
    return [*out, (len(out), first, len(held), "".join(held))] if held else out


def line_pages(files: DataFrame, size: int) -> DataFrame:
    """Texts (path, text) in pages of whole lines: page, first line, lines, text.

    A page takes lines while they fit ``size`` characters, and always one; joined,
    pages give the text back. Filling goes on from line to line, so it is a function of
    a whole text.
    """
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: _pages(t, size)), "array<struct<page int, first_line int, lines int, text string>>")
    return files.select("path", F.explode(cut(F.col("text"))).alias("p")).select("path", "p.*")
