"""Surrogates against a plain search of texts before and after."""

import random
import string

import regex
from pyspark.sql import functions as F

from siftwell.llm import pii

from .test_operators import docs, words

ENTITY = regex.compile(pii.ENTITY.replace("IsLatin", "Latin").replace("IsCyrillic", "Cyrillic"))


def canonical(mention):
    if "@" in mention:
        return mention.lower()
    title = regex.match(rf"(?:{pii._TITLES})\.?", mention)
    if title:
        return "name", title[0].rstrip("."), mention[title.end() :].strip().lower()
    return regex.sub(r"[ ().-]", "", mention) if mention.count(".") != 3 else mention


def test_every_mention_and_nothing_else_changes(spark):
    r = random.Random(3)
    given, family = ("Anna", "Karl", "J.", "Zoë"), ("Smith", "McDonald", "O'Brien", "Smith-Jones", "Müller", "Ng")
    makers = (
        lambda: f"{r.choice(string.ascii_lowercase)}{r.choice('.-_')}{r.choice('ab')}@{r.choice('abc')}.{r.choice(('org', 'co.uk'))}",
        lambda: f"+{r.choice((1, 44))}{r.choice(' -.')}403{r.choice(' -')}555{r.choice(' -')}93{r.randint(10, 13)}",
        lambda: f"({r.randint(200, 203)}) 555-0{r.randint(100, 103)}",
        lambda: f"{r.randint(100, 104)}-22-333{r.randint(0, 3)}",
        lambda: f"4570{r.choice(' -')}3642 4512 688{r.randint(0, 9)}",
        lambda: f"10.1.2.{r.randint(1, 30)}",
        lambda: f"DE89 3704 0044 0532 01{r.randint(10, 30)}",
        lambda: f"{r.choice(('Mr', 'Mr.', 'Mrs.', 'Dr.'))} {r.choice(given)} {r.choice(family)}",
        lambda: f"{r.choice(('Mr', 'Mrs'))} {r.choice(family)}",
    )
    texts = []
    for i in range(150):
        parts = []
        for k in range(r.randint(1, 6)):
            parts += words(r.randint(0, 4), i * 10 + k) + [r.choice(makers)() + r.choice(("", ",", "; so"))]
        texts.append(" ".join(parts))
    got = {x.doc_id: x for x in pii.replace(docs(spark, *texts)).collect()}
    seen, back = {}, {}
    for i, t in enumerate(texts):
        old, new = ENTITY.findall(t), ENTITY.findall(got[i].text)
        assert got[i].n_entities == len(old) == len(new) > 0
        assert ENTITY.split(t) == ENTITY.split(got[i].text)
        for a, b in zip(old, new, strict=True):
            assert seen.setdefault(canonical(a), canonical(b)) == canonical(b)
            assert back.setdefault(canonical(b), canonical(a)) == canonical(a)
            assert canonical(a) != canonical(b)
    assert not set(seen) & set(back)


def test_coreference_across_forms(spark):
    pairs = (
        ("Mrs. Anna Smith", "Mrs Smith"), ("Anna.B@x.org", "anna.b@X.org"), ("+1 403 555 9312", "+1-403-555-9312"), ("4570 3642 4512 6885", "4570364245126885"),
        ("Mr. SMITH", "Mr. John F. Smith"),
    )
    got = {x.doc_id: x.text for x in pii.replace(docs(spark, *[f"{a} | {b}" for a, b in pairs])).collect()}
    sides = [got[i].split(" | ") for i in range(len(pairs))]
    assert sides[0][0].split()[-1] == sides[0][1].split()[-1] != "Smith" and sides[0][0].split()[1] in pii.FEMALE_NAMES
    assert sides[1][0].lower() == sides[1][1].lower() and sides[1][0][0].isupper()
    assert sides[2][0].replace(" ", "-") == sides[2][1] and sides[3][0].replace(" ", "") == sides[3][1]
    assert sides[4][0].split()[-1] == sides[4][1].split()[-1].upper() == sides[0][0].split()[-1].upper()


def test_full_classes_widen(spark):
    mails = [f"{c}@corp.com" for c in string.ascii_lowercase]
    hosts = [f"x@{c}.org" for c in string.ascii_lowercase]
    got = [x.text for x in pii.replace(docs(spark, *mails, *hosts)).collect()]
    assert len(set(got)) == 52 and len({x.split("@")[1] for x in got}) == 27


def test_many_family_names_stay_distinct(spark):
    name = F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij")
    t = pii.surrogate_table(spark.range(100_000).select(F.lit("family").alias("kind"), name.alias("part")))
    assert t.count() == t.select("surrogate").distinct().count() == 100_000
    assert t.join(t.select(F.col("part").alias("surrogate")), "surrogate").isEmpty()


def test_clashing_columns_are_carried(spark):
    df = docs(spark, "Mail a.b@x.org", None, "nothing")
    for c in ("sha", "new", "mentions", "text_key", "text_sha", "surrogates", "entity", "at", "kind", "part"):
        df = df.withColumn(c, F.lit(c))
    df = df.withColumn("n_entities", F.lit(77))
    rows = pii.replace(df).collect()
    assert all(r.n_entities == 77 and r.sha == "sha" and r.surrogates == "surrogates" for r in rows)
    assert sorted(r["_n_entities"] for r in rows) == [0, 0, 1]


def test_possessives_scripts_and_titles(spark):
    """A possessive is the same person; a title without gender takes the name's; no letter stays in clear; widened values keep their type."""
    texts = [
        "Mr. Smith and Mr. Smith's car and Mr Smith’s dog", "Dr. Anna Smith | Mrs. Anna Smith | Prof. Karl Ng", "李明@例子.cn | 김철@서울.kr | דוד@x.org | ժան@x.org", "Mr. É. Smith | Mr. E. Smith | Mr. È. Smith",
        "555 123 4567 | 0171 1234567 | 1234 567 8901", None, "Mr. Smith", "Mr. Smith",
    ]
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x.text for x in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b, c = regex.findall(r"Mr\.? (\w+)", got[0])
    assert a == b == c != "Smith" and "'s car" in got[0] and "’s dog" in got[0] and got[6] == got[None] == f"Mr. {a}" and got[5] is None
    dr, mrs, _ = (x.split() for x in got[1].split(" | "))
    assert dr[1:] == mrs[1:] and mrs[1] in pii.FEMALE_NAMES
    assert not set("李明例子김철서울דודժան") & set(got[2]) and regex.search(r"\p{Han}{2}@\p{Han}{2}\.cn \| \p{Hangul}{2}@\p{Hangul}{2}\.kr \| \p{Hebrew}{3}@", got[2])
    initials = [x.split()[1] for x in got[3].split(" | ")]
    assert len(set(initials)) == 3 and not set(initials) & {"É.", "È.", "E."}
    first, second, third = got[4].split(" | ")
    assert regex.fullmatch(r"\d{3} \d{3} \d{4}", first) and first != "555 123 4567" and regex.fullmatch(r"0\d{3} \d{7}", second) and second != "0171 1234567" and third == "1234 567 8901"


def test_addresses_stay_addresses_at_any_draw(spark):
    part = spark.createDataFrame([("ip", "10.1.2.3"), ("ssn", "123456789"), ("local", "0171123456")], "kind string, part string")
    for attempt in (0, 2, 5, 40):
        got = {x.kind: x.s for x in part.select("kind", pii.surrogate(F.col("part"), F.col("kind"), F.lit(attempt)).alias("s")).collect()}
        assert all(0 < int(x) < 256 for x in got["ip"].split(".")) and got["ip"].count(".") == 3
        assert regex.fullmatch(r"\d{9}", got["ssn"]) and regex.fullmatch(r"0\d{9}", got["local"])
