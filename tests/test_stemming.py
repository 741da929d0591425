"""Stems: published examples, and a plain stemmer on all tokens of the documents."""

import re

import pytest
from pyspark.sql import functions as F

from stratocast.functions import stemming
from stratocast.operators import evaluate

# Words and their published stems.
GOLDEN = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi
sky sky skies sky dying die relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll showers shower cloudy cloudi temperatures temperatur expected expect possible possibl conditions condit
died die spied spi flies fli dies die enjoy enjoy say say geologi geolog is is as as news news proceed proceed""".split()


def plain(word):
    """The algorithm letter by letter."""

    def cons(w, i):
        return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and cons(w, i - 1))

    def form(w):
        return "".join("c" if cons(w, i) else "v" for i in range(len(w)))

    def m(w):
        return len(re.findall("v+c+", form(w)))

    def cvc(w):
        return (form(w).endswith("cvc") and w[-1] not in "wxy") or form(w) == "vc"

    def rules(w, pairs, fits):
        for s, new in pairs:
            if w.endswith(s):
                rest = w[: len(w) - len(s)]
                return rest + new if fits(rest, s) else w
        return w

    if word in stemming.IRREGULAR or len(word) <= 2:
        return stemming.IRREGULAR.get(word, word)
    w = word
    w = w[:-1] if w.endswith("ies") and len(w) == 4 else rules(w, stemming.PLURALS, lambda r, s: True)
    if w.endswith("ied"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "v" in form(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1):
                    w = w if w[-1] in "lsz" else w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and len(w) > 2 and cons(w, len(w) - 2):
        w = w[:-1] + "i"
    if w.endswith("alli") and m(w[:-4]) > 0:
        w = w[:-2]
    positive = lambda r, s: m(r) > 0
    if w.endswith("logi") and not any(w.endswith(s) for s, _ in stemming.LONG):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        w = rules(w, stemming.LONG, positive)
    w = rules(w, stemming.MIDDLE, positive)
    w = rules(w, [(s, "") for s in stemming.ENDINGS], lambda r, s: m(r) > 1 and (s != "ion" or r[-1] in "st"))
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w[:-1]) > 1 else w


def test_published_stems(spark):
    want = dict(zip(GOLDEN[::2], GOLDEN[1::2]))
    assert {w: plain(w) for w in want} == want
    got = stemming.with_stem(spark.createDataFrame([(w,) for w in want], "word string")).collect()
    assert {r["word"]: r["stem"] for r in got} == want


def test_stems_of_all_tokens(spark, small_sf):
    from stratocast.plans.extensions import token_stems

    endings = "s ed ing eed ied ies ational izer alli fulli logi ement ion ll e y icate".split()
    made = [f"{head}{end}" for head in "a by tr oat yy hopp fizz tal cre eel zyx b2b gener".split() for end in endings]
    extra = stemming.with_stem(spark.createDataFrame([(w,) for w in made], "token string"), "token").collect()
    rows = token_stems(spark, small_sf).collect()
    assert len(rows) > 3000
    for r in [*rows, *extra]:
        assert r["stem"] == plain(r["token"]), r["token"]


def test_stemmed_rouge(spark):
    rows = [(1, "Showers expected in the cities", "A shower is expecting the city"), (2, None, "x"), (3, "", "")]
    df = spark.createDataFrame(rows, "id int, generated_forecast string, reference_forecast string")
    got = {r["id"]: r for r in evaluate.score_rows(df, rouge="stemmed", identity=["id"]).collect()}
    g, r = (["shower", "expect", "in", "the", "citi"], ["a", "shower", "is", "expect", "the", "citi"])
    assert got[1]["_rouge_1"] == pytest.approx(2 * len(set(g) & set(r)) / (len(g) + len(r)))
    assert got[2]["_rouge_1"] == got[3]["_rouge_1"] == 0 and got[1]["_rouge_l"] == pytest.approx(2 * 4 / 11)
    assert evaluate.evaluate(df, rouge="stemmed", identity=["id"]).first()["predictions"] == 3
    with pytest.raises(ValueError):
        evaluate.score_rows(df, rouge="stemmed")


def test_join_of_stems_reads_a_table(spark):
    """The plan of the join holds no rule of the stemmer: it would be optimized over and over."""
    df = spark.createDataFrame([(1, ["showers", "is"], ["rained"])], "id int, _g array<string>, _r array<string>")
    out = evaluate.stem_tokens(df, ["id"], ["_g", "_r"])
    assert "ational" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, ["shower", "is"], ["rain"])]
