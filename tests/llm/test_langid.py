"""Languages: labels, held-out accuracy, mixed texts, quotes, and defined results."""

import random

import pytest
from pyspark.sql import functions as F

from pressmill.llm import langid as L

PARTS = {
    "english": (["the harbour authority", "dock unions", "two chip makers", "an adviser to the ministry", "the regulator"], ["delayed", "confirmed", "questioned", "extended"], ["the inspection of the tankers", "a strike of the workers", "repairs to the berth", "plans to reroute sailings"], ["over the weekend", "on Friday", "after the storm", "before dawn"]),
    "spanish": (["la autoridad portuaria", "los estibadores", "dos fabricantes de chips", "un asesor del ministerio", "la red eléctrica"], ["aplazó", "confirmó", "cuestionó", "prorrogó"], ["la inspección de los petroleros", "una huelga de los trabajadores", "las obras del muelle", "el desvío de los viajes"], ["el fin de semana", "el viernes", "tras la tormenta", "antes del amanecer"]),
    "german": (["die Hafenbehörde", "der Zoll", "zwei Hersteller von Chips", "ein Berater des Ministeriums", "die Aufsicht"], ["verschob", "bestätigte", "prüfte", "verlängerte"], ["die Kontrolle von den Tankern", "einen Streik von den Beschäftigten", "die Arbeiten an dem Liegeplatz", "die Umleitung von den Fahrten"], ["über das Wochenende", "am Freitag", "nach dem Sturm", "vor Tagesanbruch"]),
    "french": (["l’autorité portuaire", "la douane", "deux fabricants de puces", "un conseiller du ministère", "le régulateur"], ["a reporté", "a confirmé", "a contesté", "a prolongé"], ["l’inspection des pétroliers", "une grève des salariés", "les travaux du quai", "le déroutement des voyages"], ["pendant le week-end", "vendredi", "après la tempête", "avant l’aube"]),
    "russian": (["администрация порта", "таможня города", "производитель чипов", "представитель компании", "сетевой оператор"], ["отложила", "подтвердил", "раскритиковал", "продлил"], ["осмотр всех танкеров", "забастовку многих рабочих", "ремонт старого причала", "перенос этих рейсов"], ["в выходные", "в пятницу", "после шторма", "рано утром"]),
    "chinese": (["港务局", "海关", "芯片厂", "部门顾问", "监管机构"], ["推迟了", "确认了", "质疑了", "延长了"], ["对油轮的检查", "工人的罢工", "泊位的维修", "航次的改道"], ["周末期间", "周五", "风暴之后", "清晨"]),
}


def name(r):
    return "".join(r.choice(["ba", "ku", "zi", "mo", "ter", "vin"]) for _ in range(3)).capitalize()


def sentence(r, lang):
    who, verb, what, when = (r.choice(p) for p in PARTS[lang])
    if lang == "chinese":
        return f"{name(r)}{who}{when}{verb}{r.randrange(9999)}{what}。"
    return f"{who[0].upper()}{who[1:]} {name(r)} {verb} {what} {when}, {name(r)} {r.randrange(9999)}."


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    samples = [(lang, " ".join(sentence(r, lang) for _ in range(4)) + "\nShare this page\n") for lang in L.LANGUAGES for _ in range(40)]
    # wrong labels among the samples must not spoil the model
    return L.fit(samples + [("german", " ".join(sentence(r, "english") for _ in range(4))) for _ in range(15)])


def test_held_out_sentences(model):
    r = random.Random(2)
    wanted = [r.choice(L.LANGUAGES) for _ in range(600)]
    got = model.texts([sentence(r, lang) for lang in wanted])
    assert sum(g[0] == [w] for g, w in zip(got, wanted, strict=True)) >= 597
    assert all(0 < c <= 1 for g in got for c in g[1])


def test_mixed_texts_and_separators(model):
    r = random.Random(3)
    for a in L.LANGUAGES:
        for b in L.LANGUAGES:
            if a < b:
                for mark in (" / ", " | ", " – ", "\n", " "):
                    assert set(model.texts([sentence(r, a) + mark + sentence(r, b)])[0][0]) == {a, b}, (a, b, mark)


def test_quotes_names_and_furniture_have_no_say(model):
    r = random.Random(4)
    quoted = sentence(r, "english")[:-1] + " « Die Hafenbehörde verschob die Kontrolle von den Tankern »."
    assert model.texts([quoted])[0][0] == ["english"]
    assert model.texts(["Bakuzi Motervin Zikumo | Kuvinba"])[0][0] == []
    assert model.texts([sentence(r, "german") + "\nShare this page\n"])[0][0] == ["german"]


def test_unknown_words_fall_back_to_their_letters(model):
    row = model.backoff("confirmación")
    assert row[L.LANGUAGES.index("spanish")] > row[L.LANGUAGES.index("german")]
    assert not model.backoff("🚢🚢🚢").any()


@pytest.mark.parametrize(("label", "want"), [("en", "english"), ("EN", "english"), ("en_US", "english"), ("es-419", "spanish"), ("castellano", "spanish"), ("zh-Hans", "chinese"), ("中文", "chinese"), ("русский", "russian"), (" German ", "german"), ("fre", "french"), ("und", None), ("-", None), ("", None), (None, None), ("n/a", None), ("italian", "other")])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(L.label_language(F.col("l"))).first()[0] == want


def test_frame_cases_and_edges(spark, model):
    r = random.Random(5)
    long = " ".join(sentence(r, "french") for _ in range(5000))
    rows = [(1, "de", sentence(r, "german")), (2, "en", sentence(r, "german")), (3, None, sentence(r, "german")), (4, "fr", sentence(r, "french") + " " + sentence(r, "english")), (5, "en", None), (6, None, ""), (7, None, "123 !!!"), (8, "fra", long), (8, "fra", long)]
    df = spark.createDataFrame([(*x, "keep") for x in rows], "id int, label string, text string, words string")
    seen = df.withColumn("d", L.language_udf(spark, model)("text"))
    got = sorted((x.id, x.language) for x in L.label_cases(seen, "d", "label").collect())
    assert got == [(2, "german"), (3, "german"), (4, "english"), (4, "french")]
    assert L.label_cases(seen.limit(0), "d", "label").count() == 0
    parts = L.segment_languages(df, "text", model, ["id"]).collect()
    assert {p.id for p in parts} == {1, 2, 3, 4, 8} and all(0 < p.confidence <= 1 for p in parts)
    assert {p.language for p in parts if p.id == 4} == {"french", "english"}


def test_fit_from_is_bounded_and_survives_empty(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, lang, sentence(r, lang)) for i, lang in enumerate(L.LANGUAGES * 30)], "k int, lang string, text string")
    assert L.fit_from(df, "k", "text", "lang", per_language=10).texts([sentence(r, "english")])[0][0] == ["english"]
    empty = L.fit_from(df.limit(0), "k", "text", "lang")
    assert empty.texts([sentence(r, "chinese"), None, ""])[0][0] == ["chinese"]


FOREIGN = [
    "Il governo ha annunciato ieri che lo sciopero dei lavoratori del porto di Genova durerà almeno tre giorni, secondo fonti sindacali.",
    "O governo anunciou ontem que a greve dos trabalhadores do porto de Santos vai durar pelo menos três dias, segundo fontes sindicais.",
    "De regering kondigde gisteren aan dat de staking van de havenarbeiders in Rotterdam minstens drie dagen zal duren.",
    "Уряд оголосив учора, що страйк працівників порту триватиме щонайменше три дні, за словами профспілки.",
    "政府は昨日、港湾労働者のストライキが少なくとも三日間続くと発表した。",
]


@pytest.mark.parametrize("text", FOREIGN)
def test_other_languages_are_none_of_the_six(spark, folder, text):
    from pressmill.tables import table

    model = _model_of_tables(spark, folder, table)
    assert model.texts([text]) == [([], [], [])]


_MODELS = {}


def _model_of_tables(spark, folder, table):
    if folder not in _MODELS:
        _MODELS[folder] = L.fit_from(table(spark, folder.replace("sf0.001", "sf0.01"), "documents"), "doc_id", "text", "lang")
    return _MODELS[folder]
