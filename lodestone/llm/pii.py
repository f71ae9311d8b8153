"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities. Over all documents, a term that stands in
a text with an entity discloses log2 p(entity | term) / p(entity) of the entity's
-log2 p(entity) bits. Terms that disclose at least the share ``REMOVE`` of any entity's
bits are removed. Those that disclose at least ``GENERALISE`` are replaced by a broader
class, all terms of the same first letters, if that class discloses less; else they
are removed too. DataFrame and SQL functions only.

Terms that occur in the same documents disclose alike, and so do entities: both are
joined as classes of equal sets of documents, so a long text does not give every pair
of its terms and entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.staging import staged, unstaged

#: The base kinds and their patterns. Runs are possessive, and an address
#: starts where its run does or the last match ended, so that reading takes linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
#: Shares of an entity's information that a term may disclose before it is removed or generalised, and letters of the broader class.
REMOVE, GENERALISE = 0.97, 0.94
STEM = 3
#: Bits of the bitmap that keeps rows without a chance from being shuffled; more keys than that only make it let more through.
SIEVE = 1 << 26
#: Shares are compared with so much room for rounding.
ROOM = 1e-9
#: Spans of a list that are appended one by one.
BLOCK = 256
SPAN = "array<struct<start:int,end:int,value:string>>"


def match_spans(text: Column, pattern: str, wanted=lambda v: F.lit(True)) -> Column:
    """The wanted matches' start, end (code points, end exclusive) and value, from what stands between all matches.

    One fold over the matches; spans are held in lists of ``BLOCK``, so that a long
    list is not copied for each of them.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # After the last match there is one more gap.
    pairs = F.zip_with(values, F.transform(F.split(text, pattern, -1), F.length), lambda v, g: F.struct(g.alias("gap"), v.alias("value")))
    none = F.array().cast(SPAN)

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        full = F.size(acc["out"]) >= BLOCK
        span = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))
        longer = F.struct(end.alias("at"), F.when(full, F.array(span)).otherwise(F.array_append(acc["out"], span)).alias("out"), F.when(full, F.array_append(acc["done"], acc["out"])).otherwise(acc["done"]).alias("done"))
        moved = F.struct(end.alias("at"), acc["out"].alias("out"), acc["done"].alias("done"))
        return F.when(p["value"].isNull(), acc).when(wanted(p["value"]), longer).otherwise(moved)

    start = F.struct(F.lit(0).alias("at"), none.alias("out"), F.array().cast(f"array<{SPAN}>").alias("done"))
    return F.aggregate(pairs, start, add, lambda acc: F.flatten(F.array_append(acc["done"], acc["out"])))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.substr(F.concat(F.lit("00"), p), F.length(p), F.lit(3)).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(kind: str, text: Column) -> Column:
    """A kind's findings; texts without its mark are not read for it."""
    found = F.filter(match_spans(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    mark = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}[kind]
    return F.when(mark, found).otherwise(F.array().cast(SPAN))


def written(kinds: list[tuple[str, Column]]) -> Column:
    def each(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*(each(*k) for k in kinds)), ",")


def _term_pattern(text: Column, read) -> Column:
    """``read`` of a text by a pattern of terms; in texts with an @ the pattern matches e-mail addresses first, whose letters are no terms."""
    return F.when(text.contains("@"), read(f"{PATTERNS['email']}|{TERM}")).otherwise(read(TERM))


def terms(text: Column) -> Column:
    """A text's different terms in lower case, and the classes of their first letters, marked by a star."""
    # Only the capital I with a dot changes its length, so a text without it may be lowered before it is read.
    low = F.lower(text)
    plain = F.filter(F.array_distinct(F.split(low, r"\P{L}+")), lambda v: F.length(v) >= 3)
    odd = F.transform(F.filter(_term_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))), lambda v: ~v.contains("@")), F.lower)
    words = F.when(text.contains("@") | text.contains("\u0130"), F.array_distinct(odd)).otherwise(plain)
    return F.concat(words, F.array_distinct(F.transform(words, stem)))


def stem(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(STEM)), F.lit("*"))


def found_entities(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the base spans of each kind, the different entities and, where there are any, the terms of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("digest"), "text", *(base_spans(k, F.col("text")).alias(k) for k in KINDS))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), F.lower(s["value"]).alias("value")))

    listed = read.withColumn("entities", F.array_distinct(F.concat(*map(named, KINDS))))
    return listed.select("doc_id", "digest", *KINDS, "entities", F.when(F.size("entities") > 0, terms(F.col("text"))).alias("terms"))


def _alike(digest: Column, weight: Column) -> list[Column]:
    """Aggregates that are equal for equal multisets of documents: their number and sums of two 31-bit hashes."""
    half = lambda shift: F.sum(F.shiftrightunsigned(digest, shift).bitwiseAND(0x7FFFFFFF) * weight)
    return [F.sum(weight).alias("n"), half(0).alias("low"), half(32).alias("high")]


def sieve(hashes: DataFrame) -> DataFrame:
    """A bitmap of the values of ``hashes`` (h), in rows of 32,768 bits: bucket and bits. Its size is bounded by ``SIEVE`` bits."""
    return hashes.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))


def sieve_hash(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SIEVE)) + 1


def sieved(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """The rows whose key is in a sieve; others may slip through, but none that is in it is lost."""
    place = F.bitmap_bit_position("__h")
    byte = F.conv(F.hex(F.substr(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # At most SIEVE / 8 bytes go to every executor.
    return rows.withColumn("__h", key).join(F.broadcast(bits), F.bitmap_bucket_number("__h") == F.col("bucket")).where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).drop("__h", "bucket", "bits")


def disclosures(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """term and share: the terms and classes that disclose at least ``generalise`` of an entity's information, with the largest share.

    ``found`` is that of docs; it is read several times.
    """
    alike = ["n", "low", "high"]
    total = found.count()
    # Copies of a text are counted together first.
    texts = found.where("terms IS NOT NULL").groupBy("digest").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    named = texts.select("digest", "copies", F.explode("entities").alias("entity"))
    entities = named.groupBy("entity").agg(*_alike(F.col("digest"), F.col("copies")))
    most = entities.agg(F.max("n")).first()[0] or 0
    # Of a term in n_t texts and an entity in n_e at most n_e share both, so no pair beyond this bound discloses enough.
    bound = lambda n: F.pow(n.cast("double"), F.lit(float(generalise))) * float(max(total, 1)) ** (1 - generalise) * (1 + 1e-6)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.xxhash64(text).alias("digest"), F.explode(terms(text)).alias("term"))
    frequency = staged(words.groupBy("term").agg(*_alike(F.col("digest"), F.lit(1).cast("long"))).where(F.col("n") <= bound(F.lit(most))), "terms")
    held = named.join(entities, "entity").select("digest", "copies", F.struct(*alike).alias("entity")).distinct()
    shown = texts.select("digest", F.explode("terms").alias("term")).join(frequency, "term").select("digest", F.struct(*alike).alias("class")).distinct()
    pairs = held.join(shown, "digest").where(F.col("class.n") <= bound(F.col("entity.n"))).groupBy("entity", "class").agg(F.sum("copies").alias("both"))
    own = F.log2(F.lit(float(max(total, 1)))) - F.log2(F.col("entity.n"))
    share = (own + F.log2("both") - F.log2(F.col("class.n"))) / own
    told = pairs.where(own > 0).withColumn("share", share).where(F.col("share") >= generalise - ROOM).groupBy("class").agg(F.max("share").alias("share"))
    return frequency.join(told.select("class.*", "share"), alike).select("term", "share")


def decided(told: DataFrame, remove: float = REMOVE) -> DataFrame:
    """term and whether it is removed, of ``disclosures``; the others are generalised."""
    classes = told.where(F.col("term").endswith("*")).select(F.col("term").alias("stem"))
    return told.where(~F.col("term").endswith("*")).withColumn("stem", stem(F.col("term"))).join(classes.withColumn("bad", F.lit(True)), "stem", "left").select("term", ((F.col("share") >= remove - ROOM) | F.coalesce("bad", F.lit(False))).alias("whole"))


def _dealt(values: Column) -> Column:
    """A set as lists of about the root of its size, by hash, so that a member is looked for in one short list."""
    return F.transform(F.array(values), lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda k: F.filter(v, lambda x: F.pmod(F.hash(x), F.ceil(F.sqrt(F.size(v))).cast("int") + 1) == k)))[0]


def _has(dealt: Column, value: Column) -> Column:
    return F.array_contains(F.get(dealt, F.pmod(F.hash(value), F.size(dealt))), value)


def find_personal(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """doc_id and the spans of each kind, base and added, of each row of docs (doc_id, text).

    Other columns are ignored. A null text is empty and has no findings; repeated rows
    each get a row. Columns: doc_id, digest, email, ip, card, phone, removed,
    generalised; spans have start, end and value. Every occurrence of a term that
    discloses too much is marked, in texts without the entity too. Terms are runs of
    three letters and more outside of e-mail addresses, alike in both cases; an entity
    that every document has has no information to disclose.
    """
    docs = docs.select("doc_id", "text")
    found = staged(found_entities(docs), "personal")
    told = staged(disclosures(found, docs, generalise), "told")
    words = staged(decided(told, remove), "decided")
    unstaged(told)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text"))
    likely = sieved(keyed.select("doc_id", "digest", F.explode(terms(F.col("text"))).alias("term")), sieve_hash("term"), sieve(words.select(sieve_hash("term").alias("h"))))
    lists = staged(likely.join(words, "term").groupBy(F.col("doc_id").alias("at_id"), F.col("digest").alias("at_digest")).agg(_dealt(F.collect_set("term")).alias("marked"), _dealt(F.collect_set(F.when(F.col("whole"), F.col("term")))).alias("whole")), "lists")
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("digest") == F.col("at_digest"))
    spans = _term_pattern(F.col("text"), lambda p: match_spans(F.col("text"), p, lambda v: _has(F.col("marked"), F.lower(v))))
    likely = sieved(keyed, sieve_hash("digest"), sieve(lists.select(sieve_hash("at_digest").alias("h"))))
    marked = likely.join(lists, same).select("at_id", "at_digest", "whole", spans.alias("all"))
    among = lambda kept: F.filter("all", lambda s: _has(F.col("whole"), F.lower(s["value"])) == kept)
    placed = marked.select("at_id", "at_digest", among(True).alias("removed"), among(False).alias("generalised")).dropDuplicates(["at_id", "at_digest"])
    out = found.drop("entities", "terms").join(placed, same, "left")
    return out.select("doc_id", "digest", *KINDS, *(F.coalesce(F.col(c), F.array().cast(SPAN)).alias(c) for c in ("removed", "generalised")))


def sanitised(docs: DataFrame, **limits) -> DataFrame:
    """docs with its columns, personal data in text replaced by its class, removed terms cut and generalised ones replaced by the class of their first letters."""
    marks = {"email": F.lit("[EMAIL]"), "ip": F.lit("[IP]"), "card": F.lit("[CARD]"), "phone": F.lit("[PHONE]"), "removed": F.lit("")}

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (marks[kind] if kind in marks else stem(F.lower(s["value"]))).alias("mark")))

    spans = F.array_sort(F.concat(*map(marked, (*marks, "generalised"))))
    found = find_personal(docs, **limits).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), spans.alias("__spans")).where(F.size("__spans") > 0).dropDuplicates(["__id", "__digest"])
    text = F.col("text")
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"]).alias("out")))
    done = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    keyed = docs.withColumn("__own", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(done)).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = [(k, F.col(k)) for k in KINDS]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written([*base, ("remove", F.col("removed")), ("generalise", F.col("generalised"))]).alias("spans"))


OP1_SQL = r"""
WITH m AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT rid, 0 AS k, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS v, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM m
UNION ALL SELECT rid, 1, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM m
UNION ALL SELECT rid, 2, regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+') FROM m
UNION ALL SELECT rid, 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM m),
each_ AS (SELECT rid, k, i, v[i] AS value, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM found)),
placed AS (SELECT rid, k, value, CAST(sum(gap + length(value)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS e, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM each_),
base AS (SELECT rid, k, lower(value) AS entity, e - length(value) AS s, e FROM placed WHERE k = 0
OR k = 1 AND len(list_filter(string_split(value, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0
OR k = 2 AND length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr(reverse(digits), j + 1, 1) AS INT) WHEN CAST(substr(reverse(digits), j + 1, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse(digits), j + 1, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse(digits), j + 1, 1) AS INT) END)) % 10 = 0
OR k = 3 AND length(digits) BETWEEN 8 AND 15),
words AS (SELECT rid, t, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\pL{3,}') AS v, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\pL{3,}') AS g FROM m),
terms AS (SELECT rid, lower(raw) AS term, CAST(sum(gap + length(raw)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e, length(raw) AS long FROM (SELECT rid, i, v[i] AS raw, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM words))),
places AS (SELECT rid, term, e - long AS s, e FROM terms WHERE NOT contains(term, '@')),
holds AS (SELECT DISTINCT rid, term FROM places UNION SELECT DISTINCT rid, left(term, 3) || '*' FROM places),
entities AS (SELECT DISTINCT rid, k, entity FROM base),
total AS (SELECT count(*) AS n FROM m),
share AS (SELECT h.term, (log2(any_value(total.n)) - log2(any_value(en.n)) + log2(count(*)) - log2(any_value(tn.n))) / nullif(log2(any_value(total.n)) - log2(any_value(en.n)), 0) AS share
FROM entities e JOIN holds h USING (rid) JOIN (SELECT k, entity, count(*) AS n FROM entities GROUP BY ALL) en ON en.k = e.k AND en.entity = e.entity JOIN (SELECT term, count(*) AS n FROM holds GROUP BY 1) tn ON tn.term = h.term, total GROUP BY e.k, e.entity, h.term),
told AS (SELECT term, max(share) AS share FROM share WHERE share >= 0.94 - 1e-9 GROUP BY 1),
added AS (SELECT p.rid, p.s, p.e, CASE WHEN w.share >= 0.97 - 1e-9 OR c.term IS NOT NULL THEN 4 ELSE 5 END AS k FROM places p JOIN told w ON w.term = p.term LEFT JOIN told c ON c.term = left(p.term, 3) || '*'),
spans AS (SELECT rid, k, s, e FROM base UNION ALL SELECT rid, k, s, e FROM added),
lists AS (SELECT rid, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base_spans, string_agg(['email', 'ip', 'card', 'phone', 'remove', 'generalise'][k + 1] || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM m LEFT JOIN lists USING (rid)
"""
