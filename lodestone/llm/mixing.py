"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are summed by the set of sources that they belong to. Each pattern offers
its words once for nothing and again at a price that rises with every pass; each
source asks for its target. The driver plans the flow of sources that overlap, whose
size is that of their patterns; what a source of its own sends is its target, worked out
for any number of sources as a table. The documents of a pattern are then taken in a
seeded order: whole passes, and of the last pass the documents whose seeded hash lies
below a cut, which is found digit by digit.
"""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import staged, unstaged

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240501
#: Bits of a digit of the hashes among which a cut is searched, and digits before whole hashes are sorted.
DIGIT, DIGITS = 10, 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], repeats: int = MAX_REPEATS) -> list[Fraction]:
    """Shares of the sum of sizes by weight; no share above ``repeats`` times its size, the excess reshared among the others."""
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] > total * repeats * sizes[i]}
        for i in full or open_:
            out[i] = Fraction(repeats * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(repeats * sizes[i] for i in full)
        open_ -= full
    return out


def route(patterns: list[tuple[int, tuple[int, ...]]], quotas: list[int], repeats: int = MAX_REPEATS) -> list[dict[int, int]]:
    """Words that each pattern (words, sources) sends to each source, at the least cost of repetition.

    A pass costs more than the one before, alike for all patterns, so cheapest paths
    are those that open the fewest passes: flow is augmented until no path is left
    before every pattern's next pass opens.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(members, 0) for _, members in patterns]
    sent, left = [0] * len(patterns), list(quotas)
    holders: dict[int, list[int]] = {}
    for p, (_, members) in enumerate(patterns):
        for s in members:
            holders.setdefault(s, []).append(p)
    for k in range(1, repeats + 1):
        for start, (words, _) in enumerate(patterns):
            while sent[start] < k * words:
                # A path from the pattern to a source with room, over patterns whose words go elsewhere instead.
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, i = queue.popleft()
                    for nxt in [("s", s) for s in flow[i]] if kind == "p" else [("p", p) for p in holders[i] if flow[p][i]]:
                        if nxt not in came:
                            came[nxt] = (kind, i)
                            queue.append(nxt)
                            if nxt[0] == "s" and left[nxt[1]] > 0:
                                end = nxt
                                break
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [flow[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s"]
                amount = min([k * words - sent[start], left[end[1]], *back])
                for a, b in zip(path, path[1:], strict=False):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                sent[start] += amount
                left[end[1]] -= amount
    return flow


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _marked(docs: DataFrame, members: Column, seed: int) -> DataFrame:
    return docs.withColumns({"__pattern": F.array_sort(F.array_distinct(members)), "__size": word_count(F.col("text")), "__order": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))})


def source_goals(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """__source, __source_size, __goal (whole words) and __target of every source of ``sums`` (__pattern, words).

    Of overlapping sources all together there are only so many words. Sources are
    ranked by ranges, so no task holds all of them, and rounds of sums find the share
    that is left for those below ``repeats`` times their size.
    """
    sizes = sums.select(F.explode("__pattern").alias("__source"), "words").groupBy("__source").agg(F.sum("words").alias("__source_size"))
    ranged = staged(sizes.repartitionByRange(F.col("__source").isNull(), "__source").withColumn("__part", F.spark_partition_id()), "sources")
    before, first = 0, {}
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():
        first[r[0]], before = before, before + r[1]
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("__source").asc_nulls_last())) - 1
    start = F.get(F.array(*(F.lit(first.get(i, 0)) for i in range(max(first, default=0) + 1))), F.col("__part"))
    weight = F.get(F.array(*map(F.lit, weights)), ((place + start) % len(weights)).cast("int"))
    listed = ranged.withColumn("__weight", weight).drop("__part")
    by_weight = lambda value: F.coalesce(*(F.when(F.col("__weight") == w, F.lit(value(w))) for w in sorted(set(weights))))
    added = [F.coalesce(F.sum(c), F.lit(0)) for c in ("__source_size", "__weight")]
    all_words, all_weights = listed.agg(*added).first()
    left, total, full = Fraction(all_words), all_weights, None
    while True:
        # Those that their share would fill stand at their most; what they leave is reshared.
        share = left / total if total else Fraction(0)
        capped = F.col("__source_size") < by_weight(lambda w: math.ceil(share * w / repeats))
        n, words, weight = listed.where(capped).agg(F.count("*"), *added).first()
        if n == full:
            break
        left, total, full = Fraction(all_words - repeats * words), all_weights - weight, n
    most = F.col("__source_size") * repeats
    return listed.select("__source", "__source_size", F.when(capped, most).otherwise(F.least(by_weight(lambda w: round(share * w)), most)).cast("long").alias("__goal"), F.when(capped, most.cast("double")).otherwise(by_weight(lambda w: float(share * w))).alias("__target"))


def plan_mix(marked: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each membership pattern: __passes, __cut and what the last pass takes at it, and the first source's size and target.

    ``marked`` has __pattern, __size and __order and is read several times.
    """
    spark = marked.sparkSession
    sums = staged(marked.groupBy("__pattern").agg(F.sum("__size").alias("words")), "patterns")
    goals = source_goals(sums, weights, repeats)
    lone = F.size("__pattern") <= 1
    shared = sums.where(~lone).select(F.explode("__pattern").alias("__source")).distinct()
    tied = sums.withColumn("__source", F.get("__pattern", F.lit(0))).join(shared.withColumn("__tied", F.lit(True)).withColumnRenamed("__source", "__other"), F.col("__source").eqNullSafe(F.col("__other")), "left").select("__pattern", "words", (~lone | (lone & F.coalesce("__tied", F.lit(False)) & (F.size("__pattern") > 0))).alias("__flows"))
    asked = goals.join(shared.withColumnRenamed("__source", "__other"), F.col("__source").eqNullSafe(F.col("__other")), "left_semi").select("__source", "__goal").collect()
    flowing = tied.where("__flows").select("__pattern", "words").collect()  # overlapping patterns and the sources in them only
    at = {r[0]: i for i, r in enumerate(asked)}
    order = lambda r: tuple((s is None, s or "") for s in r[0])
    flowing.sort(key=order)
    sent = route([(words, tuple(at[s] for s in pattern)) for pattern, words in flowing], [r[1] for r in asked], repeats)
    routed = spark.createDataFrame([(r[0], sum(x.values())) for r, x in zip(flowing, sent, strict=True)], "__pattern array<string>, __sent long")
    own = tied.join(routed.withColumnRenamed("__pattern", "__same"), F.col("__pattern") == F.col("__same"), "left").withColumn("__first", F.get("__pattern", F.lit(0)))
    with_goal = own.join(goals, (F.size("__pattern") > 0) & F.col("__first").eqNullSafe(F.col("__source")), "left")
    takes = F.when(F.col("__flows"), F.col("__sent")).otherwise(F.coalesce("__goal", F.lit(0)))
    passes = F.when(F.col("words") > 0, F.floor(takes / F.col("words"))).otherwise(0).cast("long")
    plan = staged(with_goal.select("__pattern", passes.alias("__passes"), F.when(F.col("words") > 0, takes - passes * F.col("words")).otherwise(0).alias("__rest"), F.coalesce("__source_size", F.lit(0)).alias("__source_size"), F.coalesce("__target", F.lit(0.0)).alias("__target")), "plan")
    # The cut, digit by digit: only the documents within the digits found so far are looked at again.
    rests, rows, done = plan.select("__pattern", "__rest"), marked.select("__pattern", "__size", "__order"), [sums, plan]
    for i in range(1, DIGITS + 1):
        digit = F.shiftrightunsigned("__order", 64 - DIGIT * i)
        near = staged(_crossing(rows.groupBy("__pattern", digit.alias("__at")).agg(F.sum("__size").alias("words")), rests), "near")
        rows = staged(rows.withColumn("__at", digit).join(near, ["__pattern", "__at"]).select("__pattern", "__size", "__order"), "inside")
        done += [near, rows]
        rests = near.select("__pattern", "__rest")
    whole = rows.groupBy("__pattern", F.col("__order").bitwiseXOR(F.lit(-(1 << 63))).alias("__at")).agg(F.sum("__size").alias("words"), F.count("*").alias("__ties"))
    cuts = _crossing(whole, rests).select("__pattern", F.col("__at").alias("__cut"), F.col("__rest").alias("__cut_rest"), "__ties")
    out = staged(plan.drop("__rest").join(cuts, "__pattern", "left"), "cuts")
    unstaged(*done)
    return out


def _crossing(sums: DataFrame, rests: DataFrame) -> DataFrame:
    """Per pattern, the place __at at which the running sum of words reaches the pattern's __rest, and what of it is left there."""
    before = F.sum("words").over(Window.partitionBy("__pattern").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    found = sums.withColumn("__before", before).join(rests, "__pattern")
    return found.where((F.col("__before") < F.col("__rest")) & (F.col("__rest") <= F.col("__before") + F.col("words"))).withColumn("__rest", F.col("__rest") - F.col("__before")).drop("__before", "words")


def _extra() -> Column:
    """Words of a document that the last, partial pass takes. Documents of one hash share what is left evenly."""
    order, cut = F.col("__order").bitwiseXOR(F.lit(-(1 << 63))), F.col("__cut")  # in the order of unsigned hashes
    return F.when(cut.isNull() | (order > cut), 0).when(order < cut, F.col("__size")).otherwise(F.least(F.col("__size"), F.floor(F.col("__cut_rest") / F.col("__ties")))).cast("long")


def mix(docs: DataFrame, members: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs (doc_id, text, source).

    ``members`` is the array of sources that a row belongs to, its source alone by
    default; source_size and target are those of its first. A null text has no
    words; a null source is a source of its own, last in order; a row of no source
    is not taken. Repeated rows have equal hashes and are taken alike. Every
    document is taken whole but those at a pattern's cut, of which the first words are.
    """
    members = F.array("source") if members is None else members
    marked = staged(_marked(docs, members, seed).select("doc_id", "__pattern", "__size", "__order"), "sized")
    taken = F.col("__passes") * F.col("__size") + _extra()
    return marked.join(plan_mix(marked, weights, repeats), "__pattern").select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"))


def mixed_documents(docs: DataFrame, members: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' columns, a row for each time that a document is taken; n_chars follows a text that is cut."""
    members = F.array("source") if members is None else members
    marked = _marked(docs, members, seed)
    plan = plan_mix(staged(marked.select("__pattern", "__size", "__order"), "sized"), weights, repeats)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    extra = F.col("__extra")
    part = F.when((extra > 0) & (extra < F.col("__size")), F.array(F.array_join(F.slice(words, F.lit(1), extra.cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    whole = F.array_repeat(F.col("text"), (F.col("__passes") + F.when((F.col("__size") > 0) & (extra == F.col("__size")), 1).otherwise(0)).cast("int"))
    out = marked.join(plan, "__pattern").withColumn("__extra", _extra()).withColumn("text", F.explode(F.concat(whole, part)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
