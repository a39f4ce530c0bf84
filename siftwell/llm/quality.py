"""Line-first quality rules, in DataFrame expressions only.

Every line of a text is judged by itself and the line behind it (navigation bars, menus, symbol noise, shouting,
word repetition, notices and calls of page furniture); failing lines go, with the blank lines behind them, and
a document that loses too large a part of its words is rejected. Document-wide base
measures stand beside that: word, symbol, duplicate-line and repeated-window counts.

A line is bare if it neither ends as a sentence or clause does nor holds the end of a sentence. A bare line before a line that is not is a heading and stays; bare lines
before bare lines, or at the end, fail if they have few words or if most of these are capitalised: menus, link lists, teasers. Prose that is wrapped
at a line length is neither. Notices ("all rights reserved") count at the beginning or end of a line, between word bounds; calls ("read more") only
where they are nearly the whole line, or begin or end a short bare one: the same words in a sentence do no harm.

Defined results: a null text counts as empty; a text without words has all counts 0,
fails the base rule (fewer than ``min_words`` words) and cleans to an empty text; equal
rows get equal results; other columns are carried through untouched. Windows are
compared by 64-bit hashes of their words, within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, let, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Phrases of page furniture in English, Spanish, French and German, in lower case.
NOTICES = (
    "all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "powered by", "privacy policy", "terms of use", "accept cookies",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "aceptar cookies",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren",
)
CALLS = (
    "click here", "log in", "read more", "share this", "sign up", "subscribe to", "haga clic aquí", "iniciar sesión", "leer más", "suscríbete a",
    "cliquez ici", "se connecter", "lire la suite", "abonnez-vous", "hier klicken", "jetzt anmelden", "mehr lesen", "weiterlesen",
)


def at_edge(phrases: tuple[str, ...]) -> str:
    """A pattern for lines that begin or end with one of the phrases."""
    some, no = "|".join(phrases), r"[^\p{L}\p{N}]"
    return rf"^{no}*(?:{some})(?:{no}|$)|(?:^|{no})(?:{some}){no}*$"


#: How a sentence or clause ends, and the end of a sentence inside a line.
CLOSED = r"[.,!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"
SENTENCE = r"[.!?…][\"'”’»)\]]?[\x20\x09-\x0D]"
CAPITAL = r"(?:^|[\x20\x09-\x0D])\p{Lu}"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    nav_separators: int = 3
    nav_words_per_separator: int = 4
    symbols_per_two_words: int = 1
    notice_words: int = 20
    call_words: int = 4
    bare_call_words: int = 8
    menu_words: int = 7
    menu_capital_percent: int = 60
    repeat_line_words: int = 12
    repeat_line_distinct_percent: int = 34
    min_kept_percent: int = 50


def _covered(hashes: Column, window: int) -> Column:
    """Positions inside windows whose hash occurs twice or more."""

    def spread(ordered):
        twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["p"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), spread))


def repeat_words(words: Column, window: int = 8) -> Column:
    """Number of words in windows of that many words found twice or more in the text."""

    def windows(h):
        at = F.sequence(F.lit(1), F.size(h) - (window - 1))
        return F.when(F.size(h) < window, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(F.slice(h, i, window))))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda h: _covered(h, window))


def is_bare(line: Column) -> Column:
    return ~line.rlike(CLOSED) & ~line.rlike(SENTENCE)


def line_fails(line: Column, n: Column, bare: Column, bare_behind: Column, p: QualityParams) -> Column:
    """Whether a line with n words fails a rule; bare_behind: whether the next line with words is bare, too, or missing."""
    separators = F.regexp_count(line, F.lit(r"[|»›•]"))
    nav = (separators >= p.nav_separators) & (separators * p.nav_words_per_separator >= n)
    noise = F.regexp_count(line, F.lit(SYMBOLS)) * 2 > n * p.symbols_per_two_words
    shout = (n >= 3) & (F.regexp_count(line, F.lit("!!")) * 2 > n)
    menu = bare & bare_behind & ((n <= p.menu_words) | (F.regexp_count(line, F.lit(CAPITAL)) * 100 >= n * p.menu_capital_percent))
    notice = (n <= p.notice_words) & line.rlike("(?iu)" + at_edge(NOTICES))
    call = ((n <= p.call_words) | (bare & (n <= p.bare_call_words))) & line.rlike("(?iu)" + at_edge(CALLS))
    repeats = (n >= p.repeat_line_words) & (F.size(F.array_distinct(words_of(line))) * 100 < n * p.repeat_line_distinct_percent)
    return menu | nav | noise | shout | notice | call | repeats


def measures(text: Column, p: QualityParams = QualityParams()) -> Column:
    """Struct of all measures of a text, of its cleaned form and of the verdict."""
    text = F.coalesce(text, F.lit(""))

    def read(unit):
        """A line with words and the blank lines behind it; the first one may be blank."""
        line = F.substring_index(unit, "\n", 1)
        return F.struct(unit.alias("unit"), line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("n"), is_bare(line).alias("bare"))

    def judged(units):
        behind = lambda i: F.coalesce(F.get(units, i + 1)["bare"], F.lit(True))
        return F.transform(units, lambda x, i: x.withField("fails", (x["n"] > 0) & line_fails(x["line"], x["n"], x["bare"], behind(i), p)))

    def build(words, lines):
        n = F.size(words).cast("long")
        full = F.filter(lines, lambda x: x["n"] > 0)
        good = F.filter(lines, lambda x: ~x["fails"])
        clean = F.aggregate(good, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(F.transform(full, lambda x: x["line"]), lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            repeat_words(words, p.window).alias("n_repeat_words"),
            clean.alias("n_clean_words"),
            (F.size(lines) - F.size(good)).cast("long").alias("n_removed_lines"),
            F.array_join(F.transform(good, lambda x: x["unit"]), "\n").alias("clean_text"),
        )

    units = F.transform(F.split(text, r"\n(?=[^\n]*[^\x20\x09-\x0D])"), read)
    base = let(words_of(text), lambda w: let(let(units, judged), lambda ls: build(w, ls)))

    def verdict(m):
        failed = (m["n_words"] < p.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * p.max_repeat_percent)
        kept = ~failed & (m["n_clean_words"] * 100 >= m["n_words"] * p.min_kept_percent)
        return m.withField("base_failed", failed).withField("kept", kept)

    return let(base, verdict)


def assess(docs: DataFrame, text_col: str = "text", p: QualityParams = QualityParams(), into: str = "quality") -> DataFrame:
    """The documents with a struct column of measures and verdict (see ``measures``)."""
    return docs.withColumn(into, measures(docs[text_col], p))


def clean(docs: DataFrame, text_col: str = "text", p: QualityParams = QualityParams()) -> DataFrame:
    """Documents that pass, with their failing lines removed; the columns stay as they are.

    ``n_chars``, where there is such a column, is brought up to date for changed texts.
    """
    into = fresh("quality", docs.columns)
    judged = assess(docs, text_col, p, into)
    changed = F.col(into)["n_removed_lines"] > 0
    new = F.when(changed, F.col(into)["clean_text"]).otherwise(F.col(text_col))
    cols = {text_col: new}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length(F.col(into)["clean_text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return judged.where(F.col(into)["kept"]).select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns])
