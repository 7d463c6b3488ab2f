import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.language import LANGUAGES, blank, cheapest_path, fit_model, join_short, label_code, language_segments, mislabelled, train, units_of

DOCS = "doc_id long, text string, lang string, label string, segments int"
SAID = {
    "en": ["the records unit closed the remaining tickets before the end of the quarter", "our supplier was asked for a second quotation and they have not answered", "all of the work which this team did is shown in the table below"],
    "fr": ["le service financier a approuvé le budget révisé avant la fin du trimestre", "notre fournisseur a publié les chiffres et il ne reste que deux points", "toute la direction était dans une salle avec les invités de la ville"],
    "de": ["das projektbüro hat den wartungsvertrag vor dem ende des quartals unterschrieben", "unser lieferant wurde um ein zweites angebot gebeten und hat nicht geantwortet", "die leitung war mit allen gästen in einem saal und sprach über das jahr"],
    "es": ["el equipo de finanzas aprobó el presupuesto revisado antes de que terminara el trimestre", "nuestro proveedor publicó las cifras y no quedan más que dos puntos", "toda la dirección estaba en una sala con los invitados de la ciudad"],
    "pt": ["a equipa financeira aprovou o orçamento revisto antes do fim do trimestre", "o nosso fornecedor publicou os números e não há mais do que dois pontos", "toda a direção estava numa sala com os convidados da cidade"],
    "it": ["l'ufficio progetti ha approvato il bilancio rivisto prima della fine del trimestre", "il nostro fornitore ha pubblicato i dati e non restano che due punti", "tutta la direzione era in una sala con gli ospiti della città"],
    "nl": ["het projectbureau heeft het contract voor het einde van het kwartaal ondertekend", "onze leverancier heeft de cijfers gepubliceerd en er zijn nog twee punten", "de hele leiding was met de gasten van de stad in een zaal"],
    "am": ["የፋይናንስ ክፍሉ በሁለተኛው ሩብ ዓመት የስልጠና ፕሮግራሙን ጀምሯል", "የቴክኒክ ኮሚቴው በዚህ ሳምንት አዲሱን ውል ፈርሟል", "የቅርንጫፉ ኃላፊ ከስብሰባው በኋላ የክፍያ ሰነዱን መርምሯል"],
}


def text(lang, n=12, start=0):
    end = "። " if lang == "am" else ". "
    return end.join(SAID[lang][(start + i) % 3].capitalize() for i in range(n)) + end.strip()


@pytest.fixture(scope="module")
def model():
    rows = [(lang, text(lang, 6, i)) for lang in LANGUAGES for i in range(9)]
    rows += [("fr", text("en", 6)), ("am", text("en", 6)), ("pt", text("de", 6))]  # wrong labels
    return train(rows)


def test_held_out_accuracy_in_spite_of_wrong_labels(model):
    assert model.accuracy > 0.95 and 0 < model.nonzero < 0.5 and model.temperature >= 0.5


def segments(spark, model, rows):
    df = spark.createDataFrame([(i, t, label, "x", 1) for i, (t, label) in enumerate(rows)], DOCS)
    return df, sorted((r.doc_id, r.segment_no, r.lang) for r in mislabelled(language_segments(df, model)).collect())


def test_labels_and_stretches(spark, model):
    table = "\n| the | costs |\n| --- | --- |\n```\nselect the sum from the ledger where it is\n```\n"
    rows = [
        (text("en"), "en"), (text("en"), "ENG"), (text("de"), "de-AT"), (text("es"), "Spanish"), (text("nl"), None), (text("it"), "n/a"), (text("pt"), "es"), (text("am"), "xx"),
        (text("fr", 4) + "\n\n" + text("nl", 4) + " " + text("fr", 4), "fr"), ("## The summary\n\n" + text("es", 6) + table + text("es", 3), "es"), (text("fr", 1), ""), (None, "en"), ("", None), ("12 34 !!", None),
    ]
    _, got = segments(spark, model, rows)
    assert got == [(4, 1, "nl"), (5, 1, "it"), (6, 1, "pt"), (7, 1, "am"), (8, 1, "fr"), (8, 2, "nl"), (8, 3, "fr"), (10, 1, "fr")]


def test_very_long_repeated_and_empty(spark, model):
    long = text("en", 4_000)
    df, got = segments(spark, model, [(long, "en"), (long + " " + text("de", 6), "en"), (long, "fr"), (long, "fr")])
    assert got == [(1, 1, "en"), (1, 2, "de"), (2, 1, "en"), (3, 1, "en")]
    assert all(0 < r.confidence <= 1 and r.start < r.end for r in language_segments(df, model).collect())
    assert language_segments(spark.createDataFrame([], DOCS), model).count() == 0
    assert language_segments(spark.createDataFrame([], DOCS)).count() == 0


def test_training_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, text(lang, 4, i), lang, "x", 1) for lang in LANGUAGES for i in range(6)], DOCS)
    assert fit_model(df, rows_per_language=3).languages == LANGUAGES


def test_label_notations(spark):
    names = ["EN", "en_US", " deu ", "Portuguese", "[fr]", "zz", None, "", "und"]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "l string").select(label_code(F.col("l")).alias("c")).collect()]
    assert got == ["en", "en", "de", "pt", "fr", None, None, None, None]


def test_parts():
    assert len(blank("a ```code``` (Name, 2.3.2020) | b")) == len("a ```code``` (Name, 2.3.2020) | b")
    assert units_of("One. Two!\nThree") == [(0, 5), (5, 10), (10, 15)]
    path = cheapest_path(np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1], [0.01, 0.99], [0.001, 0.999]])), 2.0)
    assert path.tolist() == [0, 0, 0, 1, 1]
    assert join_short(np.array([0, 1, 0]), np.array([20, 5, 20]), np.zeros((3, 2))) == [(0, 0, 3)]
