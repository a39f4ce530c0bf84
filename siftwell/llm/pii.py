"""PII surrogates in DataFrame expressions only.

Mentions (e-mail addresses, telephone numbers, payment cards, IBANs, IPv4 addresses, social
security numbers and titled names) are brought to a canonical form and cut into parts: an address
into its mailbox and its host, a name into given names, initials and family name, a number
into its digits. Each part gets one keyed surrogate of its own type for the whole corpus, and each
mention is written with its parts' surrogates in its own format: so ``A.B@X.org`` and
``a.b@x.org``, ``+1 403 555 9312`` and ``+1-403-555-9312``, ``Mrs. Anna Smith`` and ``Mrs Smith``
stay the same entity. Digits stay digits, letters keep case and script, separators stay;
cards and IBANs keep valid check digits, a name keeps its title and so its gender, with given names
of that gender (after titles that tell none, of the gender that this name has behind most others, else any). Letters of other scripts become others
of their script where its letters are one range, else Latin ones.

Collision checks run over the distinct parts of the whole corpus: where two parts of a kind would
get the same surrogate, or a surrogate is itself such a part, the later one (by code point) draws
again; only those rows go into the next round. From the third draw on names, mailboxes, hosts, international numbers and accounts get longer, so a
full class (all one-letter mailboxes of a host, say) is no dead end and every part ends with a surrogate of its own. IPv4 addresses, social security and
national telephone numbers keep their form: they draw another whole one, from far more than a corpus has.

Defined results: null texts stay null; texts without mentions stay as they are; repeated rows
get equal results; null ids are ids like others; an empty table gives an empty result.
Other columns are carried through as they are, whatever their names. Names without a title and addresses of
streets are not looked for; a name takes in up to two capitalised words behind its first one, whatever they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, save

MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
OTHER_TITLES = ("Dr", "Prof")
MALE_NAMES = ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Pavel")
FEMALE_NAMES = ("Alma", "Berta", "Clara", "Diana", "Elena", "Fiona", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula")
MALE_ENDINGS, FEMALE_ENDINGS = ("o", "us", "er", "ik"), ("a", "ia", "ina", "elle")
SYLLABLES = ("ba", "den", "fi", "gor", "hal", "kin", "lo", "mar", "nes", "o", "per", "ra", "sol", "ta", "ven", "wei")
#: Country codes of the IBAN registry's European members.
IBAN_COUNTRIES = ("AD", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "SM", "TR")

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True))
#: A capitalised word; a possessive ending is none of its parts.
_WORD = r"\p{Lu}['’]?\p{L}++(?:(?!['’]s(?![\p{L}\p{N}]))['’-]\p{L}++)*+"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
PHONE = r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
LOCAL_PHONE = r"(?<![\p{L}\p{N}.+-])(?:(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}|0\d{2,4}[ /-]\d{6,8})(?![\p{L}\p{N}-])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])"
CARD = r"(?<![\p{L}\p{N}.])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}])"
IBAN = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(IBAN_COUNTRIES)})\d{{2}}(?: ?[A-Z0-9]{{4}}){{2}} ?[A-Z0-9]{{3,4}}(?: ?[A-Z0-9]{{1,4}}){{0,5}}(?![\p{{L}}\p{{N}}])"
IP = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{N}]|\.\d)"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? (?:(?:{_WORD}|\p{{Lu}}\.) ){{0,2}}{_WORD}"
#: No mention starts inside a word; one look back for all kinds spares the others at most places.
ENTITY = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join((EMAIL, PHONE, SSN, CARD, LOCAL_PHONE, IBAN, IP, NAME))})"

#: Code points that are all letters, by script: the first one and how many.
RANGES = ((r"\p{IsHan}", 0x4E00, 20_000), (r"\p{IsHangul}", 0xAC00, 11_172), (r"\p{IsHiragana}", 0x3042, 80), (r"\p{IsKatakana}", 0x30A2, 80), (r"\p{IsArabic}", 0x0621, 26), (r"\p{IsHebrew}", 0x05D0, 27), (r"\p{IsDevanagari}", 0x0915, 37), (r"\p{IsThai}", 0x0E01, 46))
#: Alphabets by script: letters are replaced inside their own.
ALPHABETS = (("0123456789", r"\d"), ("abcdefghijklmnopqrstuvwxyz", r"\p{IsLatin}(?<=\p{Ll})"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"\p{IsLatin}(?<=\p{Lu})"), ("абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsCyrillic}(?<=\p{Ll})"), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"\p{IsCyrillic}(?<=\p{Lu})"), ("αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsGreek}(?<=\p{Ll})"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{IsGreek}(?<=\p{Lu})"))


#: Latin letters with marks, along which such initials move.
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


@dataclass(frozen=True)
class PiiParams:
    key: str = "surrogates"
    same_length_draws: int = 2


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, "(?!^)(?!$)"), lambda c: c != "")


def _draw(seed: Column, place: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(n)).cast("int")


def _pick(names, seed: Column, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), _draw(seed, place, len(names)) + 1)


def _reshaped(text: Column, seed: Column) -> Column:
    """Every letter and digit replaced by another of its class."""

    def one(c, i):
        # Letters of no script named here become Latin ones, other numerals digits.
        out = F.when(c.rlike(r"^\p{L}$"), F.substring(F.lit(ALPHABETS[1][0]), _draw(seed, i, 26) + 1, F.lit(1))).when(c.rlike(r"^\p{N}$"), _draw(seed, i, 10).cast("string")).otherwise(c)
        for script, first, n in RANGES:
            letter = F.decode(F.unhex(F.lpad(F.hex((_draw(seed, i, n) + first).cast("long")), 4, "0")), "UTF-16BE")
            out = F.when(c.rlike(rf"^{script}(?<=\p{{L}})$"), letter).otherwise(out)
        for letters, pattern in ALPHABETS:
            out = F.when(c.rlike(f"^{pattern}$"), F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(text), one), "")


def _with_check_digit(digits: Column) -> Column:
    """The last digit set so that the Luhn sum is a multiple of ten."""

    def add(a, x):
        doubled = x["d"] * 2
        return a + F.when(x["i"] % 2 == 1, doubled - F.when(doubled > 9, 9).otherwise(0)).otherwise(x["d"])

    placed = F.transform(F.reverse(_chars(digits)), lambda d, i: F.struct(F.when(i == 0, 0).otherwise(d.cast("int")).alias("d"), i.alias("i")))
    check = (10 - F.aggregate(placed, F.lit(0), add) % 10) % 10
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), check.cast("string"))


def _with_iban_check(country: Column, account: Column) -> Column:
    """Country, check digits (98 less the rest by 97 of what follows with the country behind it) and account."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _gender(title: Column) -> Column:
    plain = F.regexp_replace(title, r"\.$", "")
    return F.when(plain.isin(*FEMALE_TITLES), "f").when(plain.isin(*MALE_TITLES), "m").otherwise("n")


def kind_of(mention: Column) -> Column:
    whole = lambda pattern: mention.rlike(f"^(?:{pattern})$")
    return (
        F.when(mention.contains("@"), "email").when(mention.startswith("+"), "phone").when(whole(NAME), "name").when(whole(SSN), "ssn")
        .when(whole(LOCAL_PHONE), "local").when(whole(IP), "ip").when(whole(IBAN), "iban").otherwise("card")
    )


def parts_of(mention: Column, kind: Column) -> Column:
    """The parts of a mention, in order, as (kind, canonical form)."""
    part = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("part"))
    low = F.lower(mention)
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.?", 0)
    tokens = F.split(F.substring(mention, F.length(title) + 2, F.length(mention)), " ")
    name = F.transform(tokens, lambda t, i: part(F.when(i == F.size(tokens) - 1, "family").when(t.rlike(r"^.\.$"), "initial").otherwise(F.concat(F.lit("given_"), _gender(title))), F.lower(t)))
    digits = F.regexp_replace(mention, r"[^\p{N}]", "")
    canonical = F.when(kind == "phone", F.concat(F.lit("+"), digits)).when(kind == "ip", mention).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(digits)
    return F.when(kind == "email", F.array(part("email", low), part("host", F.substring_index(low, "@", -1)))).when(kind == "name", name).otherwise(F.array(part(kind, canonical)))


def surrogate(part: Column, kind: Column, attempt: Column, p: PiiParams = PiiParams()) -> Column:
    """The surrogate that a part draws at an attempt; a mailbox keeps its host here, inside which it must be distinct."""
    seed = F.xxhash64(F.lit(p.key), kind, part, attempt)
    extra = F.greatest(attempt - p.same_length_draws, F.lit(0))
    more = lambda letters: F.array_join(F.transform(F.sequence(F.lit(1), extra + 1), lambda i: F.when(i <= extra, F.substring(F.lit(letters), _draw(seed, -i, len(letters)) + 1, F.lit(1))).otherwise("")), "")
    letters, digits = ALPHABETS[1][0], ALPHABETS[0][0]
    mailbox, host = F.substring_index(part, "@", 1), F.substring_index(part, "@", -1)
    email = F.concat(_reshaped(mailbox, seed), more(letters), F.lit("@"), host)
    last = F.concat(F.lit("."), F.substring_index(part, ".", -1))
    site = F.concat(_reshaped(F.substring(part, F.lit(1), F.length(part) - F.length(last)), seed), more(letters), last)
    code = F.regexp_extract(part, r"^\+(?:1|7|\d{2})", 0)
    phone = F.concat(code, _reshaped(F.substring(part, F.length(code) + 1, F.length(part)), seed), more(digits))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    account = F.concat(_reshaped(F.substring(part, F.lit(5), F.length(part)), seed), more(digits))
    latin = ~part.rlike(r"[^\p{IsLatin}'’-]")
    stem = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES, seed, i)), "")
    letters_of = F.concat(_reshaped(part, seed), F.when(part.rlike(r"\p{IsCyrillic}"), more(ALPHABETS[3][0])).when(part.rlike(r"\p{IsGreek}"), more(ALPHABETS[5][0])).otherwise(more(letters)))
    male = (kind == "given_m") | (kind == "given_n") & (_draw(seed, F.lit(-99), 2) == 0)
    listed = F.lower(F.when(male, _pick(MALE_NAMES, seed, F.lit(0))).otherwise(_pick(FEMALE_NAMES, seed, F.lit(0))))
    made = F.concat(stem(attempt + 1), F.when(male, _pick(MALE_ENDINGS, seed, F.lit(-1))).otherwise(_pick(FEMALE_ENDINGS, seed, F.lit(-1))))
    given = F.when(~latin, letters_of).when(attempt == 0, listed).otherwise(made)
    # An initial moves along its alphabet by a keyed step, so different ones stay different.
    moved = part
    for alphabet in (letters, ALPHABETS[3][0], ALPHABETS[5][0], ACCENTED):
        at = F.instr(F.lit(alphabet), F.substring(part, 1, 1))
        step = F.pmod(F.xxhash64(F.lit(p.key)), F.lit(len(alphabet) - 1)).cast("int") + 1
        moved = F.when(at > 0, F.concat(F.substring(F.lit(alphabet), (at - 1 + step) % len(alphabet) + 1, F.lit(1)), F.lit("."))).otherwise(moved)
    return (
        F.when(kind == "email", email).when(kind == "host", site).when(kind == "phone", phone).when(kind == "ip", octets)
        .when(kind == "iban", _with_iban_check(F.substring(part, 1, 2), account)).when(kind == "card", _with_check_digit(F.concat(_reshaped(part, seed), more(digits))))
        .when(kind == "family", F.when(latin, stem(attempt + 4)).otherwise(letters_of)).when(kind.startswith("given"), given).when(kind == "initial", moved)
        .when(part.startswith("0"), F.concat(F.lit("0"), _reshaped(F.substring(part, F.lit(2), F.length(part)), seed))).otherwise(_reshaped(part, seed))
    )


def surrogate_table(parts: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """(kind, part, surrogate) for distinct (kind, part): one to one inside a kind, and no surrogate among the parts."""
    parts = save(parts.select("kind", "part").distinct(), "parts")
    real = parts.select("kind", F.col("part").alias("surrogate"), F.lit(True).alias("real"))
    settled, waiting, attempt = [], parts, 0
    while True:
        drawn = save(waiting.withColumn("surrogate", surrogate(F.col("part"), F.col("kind"), F.lit(attempt), p)), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("part").alias("part"))
        good = first.join(real, ["kind", "surrogate"], "left").where("real is null or kind = 'initial'").select("kind", "part", "surrogate")
        for earlier in settled:
            good = good.join(earlier, ["kind", "surrogate"], "left_anti")
        settled.append(save(good.select("kind", "part", "surrogate"), "settled"))
        waiting, attempt = drawn.join(settled[-1], ["kind", "part"], "left_anti").select("kind", "part"), attempt + 1
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def _cased(drawn: Column, like: Column) -> Column:
    """A surrogate with capitals where the mention has them."""
    return F.array_join(F.transform(_chars(drawn), lambda c, i: F.when(F.substring(like, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")


def _laid_over(drawn: Column, like: Column, kept: str) -> Column:
    """The surrogate's characters in the places of the mention's, whose separators stay; what is longer goes to the end."""
    own = F.regexp_replace(drawn, kept, "")
    place = lambda i: F.length(F.regexp_replace(F.substring(like, F.lit(1), i + 1), kept, ""))
    out = F.array_join(F.transform(_chars(like), lambda c, i: F.when(c.rlike(kept), c).otherwise(F.substring(own, place(i), F.lit(1)))), "")
    return F.concat(out, F.substring(own, F.length(F.regexp_replace(like, kept, "")) + 1, F.length(own)))


def rendered(mention: Column, kind: Column, drawn: Column) -> Column:
    """A mention with its parts' surrogates (an array, in order) in its own format."""
    one = F.element_at(drawn, 1)
    email = F.concat(_cased(F.substring_index(one, "@", 1), F.substring_index(mention, "@", 1)), F.lit("@"), _cased(F.element_at(drawn, 2), F.substring_index(mention, "@", -1)))
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.?", 0)
    tokens = F.split(F.substring(mention, F.length(title) + 2, F.length(mention)), " ")
    loud = lambda t: (F.length(t) > 2) & (F.upper(t) == t)
    name = F.concat_ws(" ", title, F.array_join(F.zip_with(drawn, tokens, lambda d, t: F.when(loud(t), F.upper(d)).otherwise(F.initcap(d))), " "))
    return F.when(kind == "email", email).when(kind == "name", name).when(kind == "ip", one).when(kind == "iban", _laid_over(one, mention, " ")).otherwise(_laid_over(one, mention, r"[^\p{N}]"))


def mention_table(mentions: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """(entity, kind, surrogate) for distinct mentions (entity), each in its own format."""
    kinds = mentions.select("entity").distinct().withColumn("kind", kind_of(F.col("entity")))
    forms = save(kinds.withColumn("parts", parts_of(F.col("entity"), F.col("kind"))), "forms")
    each = forms.select("entity", F.posexplode("parts").alias("at", "x")).select("entity", "at", "x.kind", "x.part")
    # A given name behind a title that tells no gender is the same name as behind those that do: most of them decide.
    votes = each.where(F.col("kind").isin("given_f", "given_m")).groupBy("part").agg(F.sum(F.when(F.col("kind") == "given_f", 1).otherwise(-1)).alias("votes"))
    told = F.when(F.col("kind") != "given_n", F.col("kind")).when(F.col("votes") > 0, "given_f").when(F.col("votes") < 0, "given_m").otherwise("given_n")
    each = save(each.join(votes, "part", "left").select("entity", "at", told.alias("kind"), "part"), "parts-of")
    drawn = surrogate_table(each.select("kind", "part"), p)
    placed = each.join(drawn, ["kind", "part"])
    drawn = placed.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("drawn"))
    return forms.select("entity", "kind").join(drawn, "entity").select("entity", "kind", rendered(F.col("entity"), F.col("kind"), F.col("drawn")).alias("surrogate"))


def replace(docs: DataFrame, p: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """The documents with surrogates in their texts, plus the number of replaced mentions (``count_col``, renamed where the input has such a column)."""
    taken = list(docs.columns)
    count_col = fresh(count_col, taken)
    found, key, sha, new = (fresh(n, [*taken, count_col]) for n in ("mentions", "text_key", "text_sha", "surrogates"))
    text = F.col(f"`{text_col}`")
    columns = [F.col(f"`{c}`") for c in taken]
    marked = docs.withColumn(found, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)))
    plain = docs.where(text.isNull() | ~text.rlike(ENTITY)).select(*columns, F.lit(0).cast("long").alias(count_col))
    holding = marked.where(F.size(found) > 0)
    mentions = save(holding.select(F.sha2(text, 256).alias("sha"), F.posexplode(found).alias("at", "entity")).distinct(), "mentions")
    table = save(mention_table(mentions, p).select("entity", "surrogate"), "surrogates")
    put = mentions.join(table, "entity").groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias(new)).withColumnRenamed("sha", sha)
    joined = holding.withColumn(key, F.sha2(text, 256)).join(save(put, "texts"), F.col(key) == F.col(sha))
    between = F.split(text, ENTITY)
    full = F.array_join(F.zip_with(between, F.transform(F.col(new), lambda x: x["surrogate"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = joined.select(*[full.alias(c) if c == text_col else x for c, x in zip(taken, columns, strict=True)], F.size(found).cast("long").alias(count_col))
    return plain.unionByName(changed)
