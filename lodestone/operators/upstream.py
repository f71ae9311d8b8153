"""Upstream projects behind binaries, and the versions that their own strings state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V3 = r"(\d+\.\d+\.\d+[a-z]?)"
#: Public projects, the unversioned file names they ship under, and their banners (label, pattern with the version as its group).
LIBRARIES = (
    ("openssl", r"lib(?:crypto|ssl)", (("OpenSSL <v>", r"OpenSSL " + V3),)),
    ("sqlite", r"libsqlite3", (("<v> (whole string)", r"^(3\.\d{1,2}\.\d{1,2})$"),)),
    ("zlib", r"libz", (("(de|in)flate <v> Copyright", r"(?:de|in)flate (\d+\.\d+\.\d+(?:\.\d+)?) Copyright"), ("<v> (whole string)", r"^(1\.2\.\d+(?:\.\d+)?)$"))),
    ("curl", r"libcurl|curl", (("libcurl/<v>", r"libcurl/(\d+\.\d+\.\d+)"), ("<v> (whole string)", r"^(7\.\d+\.\d+)$"))),
    ("libxml2", r"libxml2", (("<v> (whole string)", r"^(2\.\d+\.\d+)$"),)),
    ("busybox", r"busybox.*", (("BusyBox v<v>", r"BusyBox v(\d+\.\d+\.\d+)"),)),
    ("dropbear", r"dropbear.*", (("dropbear_<v>", r"dropbear_(\d{4}\.\d+)"), ("Dropbear ... v<v>", r"Dropbear[^0-9]*v?(\d{4}\.\d+)"))),
    ("strongswan", r"libstrongswan.*|libcharon.*|charon|starter", (("strongSwan <v>", r"strongSwan (\d+\.\d+\.\d+)"),)),
    ("iproute2", r"ip|tc|ss|bridge", (("iproute2-<v>", r"iproute2-(?:ss)?([0-9][0-9.]+)"),)),
    ("uclibc", r"(?:lib|ld-)uClibc(?!\+\+).*", (("uClibc <v>", r"uClibc(?:-ng)? (\d+\.\d+\.\d+(?:\.\d+)?)"),)),
    ("glibc", r"libc-2\..*|ld-2\..*", (("GNU C Library ... version <v>", r"GNU C Library[^\n]*?version (\d+\.\d+)"),)),
    ("libpcap", r"libpcap", (("libpcap version <v>", r"libpcap version (\d+\.\d+\.\d+)"),)),
    ("dnsmasq", r"dnsmasq", (("dnsmasq-<v>", r"dnsmasq-(\d+\.\d+)"),)),
    ("hostapd", r"hostapd|wpa_supplicant", (("hostapd|wpa_supplicant v<v>", r"(?:hostapd|wpa_supplicant) v(\d+\.\d+)"),)),
    ("openvpn", r"openvpn", (("OpenVPN <v>", r"OpenVPN (\d+\.\d+\.\d+)"),)),
    ("lighttpd", r"lighttpd", (("lighttpd/<v>", r"lighttpd/(\d+\.\d+\.\d+)"),)),
    ("pppd", r"pppd", (("pppd version <v>", r"pppd version (\d+\.\d+\.\d+)"), ("<v> (whole string)", r"^(2\.4\.\d+)$"))),
    ("expat", r"libexpat", (("expat_<v>", r"expat_(\d+\.\d+\.\d+)"),)),
    ("mbedtls", r"libmbed.*|libpolarssl.*", (("mbed TLS|PolarSSL <v>", r"(?:mbed TLS|PolarSSL) (\d+\.\d+\.\d+)"),)),
    ("libstdcxx", r"libstdc\+\+", ()),
    ("json-c", r"libjson-c", ()),
    ("libnl", r"libnl.*", ()),
    ("iptables", r"(?:libiptc|libxtables|libip[46]tc|iptables|xtables-multi).*", (("iptables-<v>", r"iptables-(\d+\.\d+\.\d+)"),)),
    ("samba", r"(?:smbd|nmbd|samba_multicall|libsmb).*", (("Version <v>", r"Version (\d+\.\d+\.\d+)"),)),
    ("ncurses", r"libncurses.*", (("ncurses <v>", r"ncurses (\d+\.\d+)"),)),
    ("pcre", r"libpcre.*", ()),
    ("mtd-utils", r"mtdinfo|nanddump|ubinfo|nandwrite|flash_erase|ubiattach", (("mtd-utils <v>", r"mtd-utils[ -](\d+\.\d+\.\d+)"),)),
    ("gcc-runtime", r"libgcc_s", ()),
)
#: Projects whose rule names programs, so that a shared object never is one of theirs.
PROGRAMS_ONLY = ("iproute2",)
#: Groups and differences that a report names; the rest is counted.
GROUPS_SHOWN = 12
DIFFS_SHOWN = 4


def library_of(name: Column) -> Column:
    """The project that a file's name names by the first rule; null where none does."""
    base = F.element_at(F.split(name, "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(base, r"\.so(\.\d+)+$", ".so"), r"\.so$", "")
    out = F.lit(None).cast("string")
    for library, rule, _ in reversed(LIBRARIES):
        hit = stem.rlike(rf"^(?:{rule})\z")
        hit = hit & (stem == base) if library in PROGRAMS_ONLY else hit
        out = F.when(hit, library).otherwise(out)
    return F.when(name != "", out)


def stated(library: Column, value: Column) -> Column:
    """What a string states of its binary's project: an array of (version, rule, label), one for each banner that it has."""
    out = F.array().cast("array<struct<version:string,rule:int,label:string>>")
    for name, _, banners in LIBRARIES:
        if banners:
            found = F.array(*(F.struct(F.regexp_extract(value, p, 1).alias("version"), F.lit(i).alias("rule"), F.lit(label).alias("label")) for i, (label, p) in enumerate(banners)))
            out = F.when(library == name, F.filter(found, lambda s: s["version"] != "")).otherwise(out)
    return out


def versions(binaries: DataFrame, strings: DataFrame) -> DataFrame:
    """Each binary that names a project, with the version that its strings state: binary, library, version, reason, rule, string.

    binaries: (binary, name, strings_truncated); strings: (binary, value). unknown where
    no string or several versions are stated, or the project has no banner; the reason
    says which, and strings_truncated stands apart, as a banner may have been cut off.
    """
    named = binaries.select("binary", library_of(F.col("name")).alias("library"), F.coalesce("strings_truncated", F.lit(False)).alias("cut")).where("library IS NOT NULL")
    told = strings.join(named.select("binary", "library"), "binary").select("binary", "value", F.explode(stated(F.col("library"), F.col("value"))).alias("s"))
    each = told.groupBy("binary", "s.version").agg(F.min(F.struct("value", "s.rule", "s.label")).alias("first"))
    one = each.groupBy("binary").agg(F.count("*").alias("n"), F.min("version").alias("version"), F.min("first").alias("first"))
    silent = [name for name, _, banners in LIBRARIES if not banners]
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("library").isin(*silent), "no_banner_rule").when(n == 0, F.when(F.col("cut"), "no_banner_string_in_what_was_kept").otherwise("no_banner_string")).when(n > 1, "several_versions")
    sure = reason.isNull()
    return named.join(one, "binary", "left").select("binary", "library", F.when(sure, F.col("version")).otherwise("unknown").alias("version"), reason.alias("reason"), F.when(sure, F.col("first.label")).alias("rule"), F.when(sure, F.substring(F.col("first.value"), 1, 80)).alias("string"))


def combined(diffs: DataFrame, sides: DataFrame) -> DataFrame:
    """Each difference (diff_id, binary_a, binary_b) with the project of its sides (binary, library, version) and each side's version.

    The library is null where neither side names one, and where they name two, which
    ``libraries_differ`` says.
    """
    side = lambda x: sides.select(F.col("binary").alias(f"binary_{x}"), F.col("library").alias(f"library_{x}"), F.col("version").alias(f"version_{x}"))
    met = diffs.join(side("a"), "binary_a", "left").join(side("b"), "binary_b", "left")
    differ = F.coalesce(F.col("library_a") != F.col("library_b"), F.lit(False))
    return met.select("diff_id", F.when(~differ, F.coalesce("library_a", "library_b")).alias("library"), differ.alias("libraries_differ"), *(F.coalesce(f"version_{x}", F.lit("unknown")).alias(f"version_{x}") for x in "ab"))


def groups(labelled: DataFrame, units: DataFrame, shown: int = DIFFS_SHOWN) -> DataFrame:
    """One row for each project: differences, the first of them by name, the version pairs they state, and the units they hand out.

    labelled: (diff_id, binary, library, version_a, version_b); units: (diff_id, must_read,
    disposed). Navigation only: no unit is moved or left out.
    """
    rows = labelled.where("library IS NOT NULL")
    sums = units.groupBy("diff_id").agg(F.count("*").alias("units"), F.count_if("must_read").alias("must_read_units"), F.count_if(~F.coalesce("disposed", F.lit(False))).alias("open_units"))
    counted = ("units", "must_read_units", "open_units")
    met = rows.join(sums, "diff_id", "left")
    pairs = met.groupBy("library", "version_a", "version_b").agg(F.count("*").alias("diffs"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counted))
    stated_ = F.array_sort(F.collect_list(F.struct((-F.col("diffs")).alias("less"), F.col("version_a").alias("a"), F.col("version_b").alias("b"))))  # as many as version pairs
    out = pairs.groupBy("library").agg(F.sum("diffs").alias("diffs"), *(F.sum(c).alias(c) for c in counted), stated_.alias("v"))
    # The limit on the rank is applied before the shuffle too, so a project's differences do not meet in one task.
    place = F.row_number().over(Window.partitionBy("library").orderBy("binary", "diff_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= shown).groupBy("library").agg(F.array_sort(F.collect_list(F.struct("place", "diff_id"))).alias("f"))
    return out.join(first, "library").select("library", "diffs", *counted, F.transform("f", lambda x: x["diff_id"]).alias("first_diffs"), F.transform("v", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), (-x["less"]).alias("diffs"))).alias("versions"))


def report(found: DataFrame, shown: int = GROUPS_SHOWN) -> DataFrame:
    """The projects that hand out the most units."""
    return found.orderBy(F.desc("units"), "library").limit(shown)
