"""Column functions on rows of our own, in both directions."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed as X
from corpusloom.functions import language, quality, questions, safety, scope, text
from corpusloom.plans import fixtures as fx


def of(spark, f, *rows):
    """f of each row: a string, or a tuple of arguments."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    cols = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in cols))
    return [r["x"] for r in df.select("i", f(*map(F.col, cols)).alias("x")).orderBy("i").collect()]


def stem(word):
    for s in X.SUFFIXES:
        if word.endswith(s) and len(word) - len(s) >= 4:
            base = word[: -len(s)]
            return base[:-1] if len(base) > 4 and base[-1] == base[-2] and base[-1] not in "aeiou" else base
    return word


def test_tokens_and_stems(spark):
    words = "planting planted plants running stopped weeds yellowing fertilisation managements quickly ties bees glasses cassava spraying pulled falling".split()
    assert of(spark, text.stem, *words) == [stem(w) for w in words]
    assert of(spark, text.tokens, "The a x-ray of 9lives and Maize2 should not Re-plant") == [["x-ray", "of", "lives", "maize2", "re-plant"]]


def test_cleaning(spark):
    assert of(spark, text.clean, "agri-\nculture  is\t here\n\n\n\nnow ") == ["agriculture is here\n\nnow"]
    assert of(spark, text.clean_lines, "Home\nTwo words\nthree words here\n\n\n\nand one more") == ["three words here\n\nand one more"]
    page = "[b]Pests[/b]\nBookmark this page\nMinor pest title: Aphids\nJane Doe, CABI\n" + "long line " * 10 + "\n" + "long line  " * 10 + "\nFurther reading\nbooks"
    assert of(spark, text.strip_boilerplate, page) == ["Pests\nAphids\n" + ("long line " * 10).strip()]


def test_furniture(spark):
    out = of(spark, lambda t: text.strip_furniture(t, F.lit("Growing cassava well")), "Growing cassava well. See www.x.org now. Growing cassava well Figure 2: a plant\nPlant early.")
    assert out[0].count("Growing cassava well") == 1 and "www" not in out[0] and "Figure" not in out[0] and "Plant early." in out[0]


def test_sentences_join_short_ones(spark):
    assert of(spark, text.sentences, "Plant early in the year. Yes. Weed twice each season! (Do it) well now please.") == [["Plant early in the year. Yes.", "Weed twice each season!", "(Do it) well now please."]]
    assert of(spark, text.sentences, "", "One") == [[], ["One"]]


def test_headings(spark):
    assert of(spark, text.is_heading, "Pests of maize", "Symptoms:", "this is lower", "A sentence ends here.", "", "X" * 80) == [True, True, False, False, False, False]
    assert of(spark, text.is_field_label, "Symptoms:", "What to do", "Symptoms of rot") == [True, True, False]


def test_citation_and_slug(spark):
    cite = lambda t, y: text.citation(t, y, F.lit("P"), F.lit(2), F.lit(4))
    assert of(spark, cite, ("T", "2001"), ("T", "unknown"), ("T", "")) == ["T (2001), P, pp. 2-4", "T, P, pp. 2-4", "T, P, pp. 2-4"]
    assert of(spark, text.slug, "Ünder the Sea! (2nd)") == ["nder_the_sea_2nd"]
    assert of(spark, lambda t: text.specific_title(F.lit("Mites"), t), "The mite (Tetranychus urticae) feeds", "no name (here)") == ["Mites (Tetranychus urticae)", "Mites"]


def test_quality(spark):
    assert of(spark, quality.unusable_reason, *fx.PASSAGES) == ["front matter", "questionnaire or worksheet, not guidance", "self-assessment checklist, not guidance", "garbled text (0% real words)", None]
    assert of(spark, quality.longest_question_run, "a? b? c. d? e? f? g!", "none") == [3, 0]


@pytest.mark.parametrize(("licence", "out"), [("CC BY-ND 4.0", True), ("CC-BY-NC-ND-3.0", True), ("No Derivatives", True), ("© Copyrighted", True), ("CC BY 4.0", False), ("", False), ("Highlands", False)])
def test_licence(spark, licence, out):
    assert (of(spark, quality.licence_reason, licence)[0] is not None) == out


REASONS = [
    None, "dosage", "live price", None, "live forecast", "financial or legal", "mechanical repair", "out-of-scope crop: cocoa", "personal decision", "outside the service area: scotland",
    "out of domain", "human medical", "harmful request: harm to others", "harmful request: deceiving a buyer",
]


def test_scope_in_order(spark):
    got = of(spark, lambda q: scope.refusal_reason(q, F.lit("en")), *fx.QUESTIONS[: len(REASONS)])
    assert got == REASONS
    assert of(spark, scope.out_of_scope_crop, "the price of wheat", "my wheat and rice") == ["wheat", "wheat"]
    assert of(spark, lambda q: scope.out_of_scope_crop(q, whole_words=False), "the price of wheat") == [None]
    assert of(spark, scope.crops_mentioned, "tomatoes and yams") == [["yam", "tomato"]]


def test_refusal_texts_fall_back_to_english(spark):
    pcm, hau = (of(spark, lambda r, code=code: scope.refusal_text(r, F.lit(code)), "live price", "dosage", "outside the service area: x") for code in ("pcm", "hau"))
    assert pcm[1] == X.MESSAGES["pcm"]["dosage_refusal"] and hau == [X.LIVE_PRICE_MESSAGE, X.MESSAGES["en"]["dosage_refusal"], X.OUT_OF_AREA_MESSAGE]


def test_languages(spark):
    rows = {"Wetin dey worry my goat": "pcm", "Plant maize early": "en", "Báwo ni mo ṣe le gbin àgbàdo": "yor", "Kedu ka m ga-esi kụọ oka": "ibo", "ɗan akuya": "hau", "sannu manomi, yaya gona": "hau", "Don get rain": "pcm", "I go to the farm": "en", "bawo ni agbado": "yor", "": "en"}
    assert of(spark, language.detect, *rows) == list(rows.values())
    assert of(spark, language.confidence, "ɗan akuya", "Plant maize", "wetin dey") == [0.95, 1.0, 0.8]


def test_pidgin_leaves_english_alone(spark):
    english = ["How do I plant maize?", "Fit the pump to the tank", "  two  blanks "]
    assert of(spark, language.pidgin_normalised, *english) == english
    assert of(spark, language.pidgin_normalised, "Wetin be  the matter wey dey my farm") == ["what is the matter wey is my farm"]


def test_farm_terms(spark):
    out = of(spark, lambda t: language.with_farm_terms(t, F.lit("yor")), "Àgbàdo mi ti ofeefee", "nothing")
    assert out[0].startswith("Àgbàdo mi ti ofeefee ") and {"maize", "yellow"} <= set(out[0].split()) and out[1] == "nothing"


def test_question_preparation(spark):
    assert of(spark, questions.retrieval_query, "A farmer says: my maize is stunted. Do not give doses.", "Explain.", "List it") == ["my maize is stunted.", "Explain.", "List it"]
    out = of(spark, questions.with_diagnostic_intent, "My goat is limping", "How do I plant yam?")
    assert out == ["My goat is limping foot rot " + X.DIAGNOSTIC_INTENT, "How do I plant yam?"]
    assert of(spark, questions.cannot_be_settled, "Is this product registered for use here?", "How is it registered by law?") == [True, False]


def test_doses(spark):
    assert of(spark, safety.doses, "Use 20 ml per litre.", "Give 5 ml of it daily.", "Keep 20 goats for 3 weeks.", "Mix at a ratio of 1:20.", "Store 50 kg bags.") == [["20 ml per litre", "20 ml"], ["5 ml"], [], ["Mix at a ratio of 1:20"], []]
    assert of(spark, safety.unsupported_doses, ("Use 20 ml per litre.", "use 20 ML  per litre"), ("Use 20 ml per litre.", "nothing")) == [[], ["20 ml per litre", "20 ml"]]


def test_money(spark):
    out = of(spark, safety.without_money, "It costs N12,500 now", "about 30 USD", "weigh 30 kg", "₦500 only")
    assert [X.MONEY_REDACTION in o for o in out] == [True, True, False, True]
    assert of(spark, safety.foreign_money, "sold for KES 400", "kwacha is far away from any number at all 5", "$ 5 or €9") == [["KES"], [], ["$", "€"]]


def test_verdict(spark):
    v = lambda a, q: safety.verdict(a, F.array(F.lit("Spray 20 ml per litre.")), q, F.array(F.lit("2001")), 2026)
    a = of(spark, v, ("Plant early.", ""), ("Spray 20 ml per litre of paraquat.", ""), ("Wait.", "How soon can I sell milk of a treated cow?"), ("Use an empty pesticide container for water.", ""))
    assert a[0]["safe"] and a[1]["hazardous"] == ["paraquat"] and a[1]["stale_sources"] == ["2001"] and not a[1]["unsupported_doses"]
    assert a[2]["missing_withdrawal"] and a[3]["container_reuse"] and not any(x["safe"] for x in a[1:])
    assert of(spark, lambda y: safety.is_stale(y, 2026), *fx.YEARS) == [True, False, True, True, False, True, False, True]


def test_cleaners(spark):
    assert of(spark, safety.without_disclaimer, "I do not have local guidance on this. plant it.", "Plant it.", "I have no information.") == ["Plant it.", "Plant it.", "I have no information."]
    assert of(spark, safety.without_citation_run, "[1] [2] Plant.", "[1] Plant.", "[1][2]") == ["Plant.", "[1] Plant.", None]
    echo = ("Cut young seedlings base night. Use collars of card.", "young seedlings cut base night")
    assert of(spark, safety.without_echo, echo, ("Plant early.", "young seedlings")) == ["Use collars of card.", "Plant early."]


def test_patterns_are_read_alike_by_python(spark):
    for name in ("LIVE_PRICE", "LIVE_FORECAST", "FINANCIAL_LEGAL", "IN_DOMAIN", "HARM_TO_OTHERS"):
        rx = getattr(X, name)
        assert of(spark, lambda q, rx=rx: text.matches(q, rx), *fx.QUESTIONS) == [bool(re.search(rx, q)) for q in fx.QUESTIONS]


def test_a_notice_asks_for_its_verdict_once(spark):
    v = safety.verdict(F.col("a"), F.array(F.lit("Use 5 ml of oil per litre.")), F.col("q"), F.array(F.lit("2010")), 2026)
    rows = spark.createDataFrame([("Give 5 ml of ivermectin. It costs $5.", "My goat has worms"), ("Weed twice.", "?")], "a string, q string")
    said = rows.select(safety.notice(v, F.lit("en")).alias("n"))
    times = lambda df: df._jdf.queryExecution().analyzed().toJSON().count("ml of oil")
    assert times(said) == times(rows.select(v.alias("v")))
    assert ["5 ml" in r.n or "currency" in r.n for r in said.collect()] == [True, False]
