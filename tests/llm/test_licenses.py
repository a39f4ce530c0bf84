"""License scans against a plain count of word pairs."""

import random
import re

from siftwell.llm import licenses

from .test_operators import EDGES, docs, words


def pairs(text):
    w = [re.sub(r"^[.\-]+|[.\-]+$", "", x) for x in re.split(r"[^\w.\-]+|_", (text or "").lower())]
    w = [x for x in w if x]
    return list(zip(w, w[1:]))


def brute(text, texts=licenses.TEMPLATES):
    """license -> (containment, first word): a template's pairs among hits of nearly one shift, the best of those that begin at one word."""
    own, found = pairs(text), {}
    for name, template in texts.items():
        places = {}
        for i, x in enumerate(pairs(template)):
            places.setdefault(x, []).append(i)
        k, groups = len(places), {}
        for at, x in enumerate(own):
            for pos in places.get(x, []):
                shift = (at - pos) // max(k // 4, 2)
                for g in (shift, shift - 1):
                    groups.setdefault(g, {}).setdefault(x, at)
        good = [(len(g), -min(g.values())) for g in groups.values() if len(g) >= k - k // 4]
        if good:
            n, back = max(good)
            found[name] = (n / k, -back)
    return {name: x for name, x in found.items() if x[0] == max(c for c, first in found.values() if first == x[1])}


def test_templates_are_found_in_prose(spark):
    names = list(licenses.TEMPLATES)
    texts = [f"{' '.join(words(30 + i, i))}. {licenses.TEMPLATES[k]} {' '.join(words(20, 50 + i))}" for i, k in enumerate(names)]
    got = {(r.doc_id, r.license) for r in licenses.licenses(docs(spark, *texts, *EDGES)).collect()}
    assert {(i, k) for i, k in enumerate(names)} <= got
    assert got == {(i, k) for i, t in enumerate(texts) for k in brute(t)}
    assert licenses.licenses(docs(spark, "a").limit(0)).count() == 0


def test_templates_of_any_length(spark):
    own = {str(n): " ".join(words(n, n)) for n in (40, 110, 150, 2000)}
    texts = [" ".join(words(200, 7)) + " " + t + " " + " ".join(words(100, 8)) for t in own.values()]
    cut = own["2000"].split()
    changed = " ".join(x for i, x in enumerate(cut) if i % 40)  # one word in forty dropped
    half = " ".join(cut[:1000])
    rows = licenses.licenses(docs(spark, *texts, changed, half, None, own["110"], own["110"]), texts=own).collect()
    assert {(r.doc_id, r.license) for r in rows} == {(0, "40"), (1, "110"), (2, "150"), (3, "2000"), (4, "2000"), (7, "110"), (8, "110")}
    assert all(r.containment == 1 for r in rows if r.doc_id < 4)


def test_short_and_changed_notices(spark):
    """Every short notice in many surroundings, and longer ones with a word changed: all that a plain count finds is found."""
    r, texts = random.Random(2), []
    for i in range(300):
        notice = r.choice(list(licenses.TEMPLATES.values())[:20]).split()
        if len(notice) > 12:
            notice[r.randrange(len(notice))] = "changed"
        texts.append(" ".join(words(r.randint(0, 30), i) + notice + words(r.randint(0, 30), 1000 + i)))
    got = {(x.doc_id, x.license): (x.containment, x.first_word) for x in licenses.licenses(docs(spark, *texts)).collect()}
    want = {(i, k): x for i, t in enumerate(texts) for k, x in brute(t).items()}
    assert all(want[k] == v for k, v in got.items()) and len(got) >= 0.999 * len(want) - 1 and {d for d, _ in want} == set(range(300))


def test_order_and_place_count(spark):
    """A notice's pairs in another order are none; a notice far behind is reported where it stands; one changed word lowers the containment; versions are told apart."""
    far = " ".join(words(300, 3))
    texts = [
        "under the Released under nothing MIT License here the MIT", f"{far} Released under the MIT License. {far}", "This program is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.", "Released under the license of MIT",
    ]
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in licenses.licenses(docs(spark, *texts)).collect()}
    assert got == {(i, k): x for i, t in enumerate(texts) for k, x in brute(t).items()}
    assert got[1, "MIT"] == (1.0, len(pairs(far)) + 1) and not any(d in (0, 4) for d, _ in got)
    assert got[3, "GPL-2.0"][0] == 1 and (3, "GPL-3.0") not in got and got[2, "GPL-3.0"][0] < 1


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "Released under the MIT License."), (None, None), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "nothing here"), (2, "")]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.license) for r in got), key=str) == [(1, "MIT"), (None, "MIT")]


def test_clashing_columns(spark):
    df = docs(spark, "Released under the MIT License.").selectExpr("*", "1 as version", "2 as license", "3 as pairs", "4 as at")
    assert [(r.doc_id, r.license) for r in licenses.licenses(df).collect()] == [(0, "MIT")]
