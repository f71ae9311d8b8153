import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The contract's patterns, read plainly: kind -> spans."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = {}
    for k, p in plain.items():
        found = []
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[k]
            if ok:
                found.append((m.start(), m.end()))
        out[k] = found
    return out


BITS = ["a@b.c", "a", "@", ".", "x-y", "1.2.3.4", "255", "256", "0", "00255", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "+", "+1 (459) 555-7415", "12345678", "(", ")", "ü", "😀", "%", "_", "\n", "é@e.x", "8", "7992739871300000003"]


def texts():
    rng = random.Random(3)
    return [None, "", " ", "a" * 60000, "a@" * 4000, "1 " * 9000, "1." * 9000, "+1" + "(" * 3000, "a@b.cd " * 700, "no data"] + ["".join(rng.choices(BITS, k=rng.randint(1, 12))) for _ in range(1500)]


def test_base_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.found_entities(df).collect()}
    for i, t in rows:
        want = brute(t or "")
        for k in pii.KINDS:
            assert [(s.start, s.end) for s in got[i][k]] == want[k], (k, t and t[:200])
            assert all((t or "")[s.start : s.end] == s.value for s in got[i][k])


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    rows = []
    for i in range(160):
        t = rng.choices(words, k=30)
        if i % 8 == 0:
            t[10:10] = ["Zorblax", f"{'kim' if i % 16 else 'lee'}@corp.example.com", "quendel", "obrest" if i % 16 else "the"]
        if i % 40 == 4:
            t.insert(3, "zorblax")
        rows.append((i, " ".join(t)))
    return rows + [(None, rows[8][1]), (8, rows[8][1]), (500, None), (501, "")]


def plain_terms(text):
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(rf"{mail}|[^\W\d_]{{3,}}", text) if "@" not in m[0]]


def plain_levels(texts, remove=pii.REMOVE, generalise=pii.GENERALISE):
    """term -> whether it is removed, by every pair of terms and entities."""
    holds = [{w for w, _, _ in plain_terms(t)} for t in texts]
    holds = [h | {w[:3] + "*" for w in h} for h in holds]
    entities = [{(k, t[a:b].lower()) for k, v in brute(t).items() for a, b in v} for t in texts]
    share = {}
    for e in set().union(*entities):
        n_e = sum(e in x for x in entities)
        if n_e < len(texts):
            for w in set().union(*(h for h, x in zip(holds, entities) if e in x)):
                n_t, both = sum(w in h for h in holds), sum(w in h and e in x for h, x in zip(holds, entities))
                told = math.log2(len(texts) * both / (n_e * n_t)) / math.log2(len(texts) / n_e)
                share[w] = max(told, share.get(w, -9))
    told = {w: s for w, s in share.items() if s >= generalise - 1e-9}
    return {w: s >= remove - 1e-9 or w[:3] + "*" in told for w, s in told.items() if "*" not in w}


def levels(df, generalise=pii.GENERALISE):
    return {r.term: r.whole for r in pii.decided(pii.disclosures(pii.found_entities(df), df.select("doc_id", "text"), generalise)).collect()}


def test_disclosing_terms_by_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = pii.find_personal(df, generalise=0.5).collect()
    assert len(got) == len(rows)
    level = plain_levels([t or "" for _, t in rows], generalise=0.5)
    assert levels(df, 0.5) == level and len(level) > 3
    want = []
    for d, t in rows:
        marked = [(level[w], a, b) for w, a, b in plain_terms(t or "") if w in level]
        want.append((str(d), [(a, b) for x, a, b in marked if x], [(a, b) for x, a, b in marked if not x]))
    assert sorted((str(r.doc_id), [(s.start, s.end) for s in r.removed], [(s.start, s.end) for s in r.generalised]) for r in got) == sorted(want)
    assert all(rows[r.doc_id][1][s.start : s.end] == s.value for r in got if r.doc_id and r.doc_id < 160 for s in r.removed)
    clean = pii.sanitised(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert clean.where(F.col("text").contains("@")).count() == 0 and clean.where(F.col("text").contains("[EMAIL]")).count() == 22
    assert pii.find_personal(df.limit(0)).count() == 0


def test_what_discloses_nothing_stays_and_what_discloses_all_goes(spark):
    everywhere = [(i, f"the word filler text a@b.cd {'one' if i % 2 else 'two'}") for i in range(20)]
    assert levels(spark.createDataFrame(everywhere, "doc_id long, text string")) == {}
    names = ["Abelard", "Brunhild", "Chlodwig", "Dietrich", "Ermelind", "Friedolin", "Gunther", "Hildegund", "Isolde", "Jutta"]
    once = [(i, f"we met {n} there, write to user{i}@mail.org") for i, n in enumerate(names)]
    df = spark.createDataFrame(once, "doc_id long, text string")
    assert levels(df) == {n.lower(): True for n in names}
    assert [r.text for r in pii.sanitised(df).orderBy("doc_id").collect()] == ["we met  there, write to [EMAIL]"] * 10


def test_a_term_far_from_its_entity_and_in_other_texts(spark):
    rows = [(100 + i, f"alpha filler{chr(97 + i % 26)}") for i in range(400)] + [(20 + i, "far away " + "pad " * 200 + "x@corp.com " + "pad " * 200 + "secretname") for i in range(9)] + [(40, "only secretname here, no address"), (41, "İİİİ secretname ßecretname x@corp.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_levels([t for _, t in rows])
    assert levels(df) == want and "secretname" in want
    got = {r.doc_id: r for r in pii.find_personal(df).collect()}
    spans = lambda r: [(s.start, s.end) for s in [*r.removed, *r.generalised] if s.value == "secretname"]
    assert spans(got[40]) == [(5, 15)] and spans(got[41]) == [(5, 15)] and len(spans(got[20])) == 1


def test_a_term_is_generalised_only_to_a_class_that_discloses_less(spark):
    # Both terms disclose alike; the class of the first is common, that of the second is not.
    rows = [(i, "quendel zyxter p@q.rs") for i in range(40)] + [(100 + i, f"quest{chr(97 + i % 26)} common words") for i in range(900)] + [(2000 + i, f"{w} alone") for i, w in enumerate(["quendel", "zyxter"] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert levels(df) == plain_levels([t for _, t in rows])
    assert levels(df) == {"quendel": False, "zyxter": True}
    got = pii.sanitised(df).where("doc_id = 5").first().text
    assert got == "que*  [EMAIL]"


def test_the_query_writes_kinds_and_digests(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op1_pii(spark, str(tmp_path)).collect():
        want = [f"{k}:{a}:{b}" for k, v in brute(rows[r.doc_id][1] or "").items() for a, b in v]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.spans.split(",") if r.spans else [])[: len(want)] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in pii.KINDS]
