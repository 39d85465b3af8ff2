import pytest

pytest.importorskip("tidegrid.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from tidegrid.llm import residue  # noqa: E402

LONG = "The order book covers nine months of production and margins widened as freight costs fell. " * 40

RESIDUE = [
    ("Dear {{first_name}}, the report is ready.", "placeholder"), ("Margins widened by ${change} points.", "placeholder"), ("Dear [Name], thank you.", "placeholder"), ("Volume ran at %(volume)s times its average.", "placeholder"),
    ("Shares rose to [TBD: amount] after June.", "placeholder"), ("The risk is [object Object].", "placeholder"), ("It grew by NaN percent.", "placeholder"), ("The group slipped #REF! percent.", "placeholder"), ("{% if guidance %} Text.", "placeholder"),
    ("Hola [INSERTAR fecha]: la serie subió.", "placeholder"), ("Le dépôt est intervenu <%= jours %> jours après.", "placeholder"), ("____ will replace its auditor.", "placeholder"), (LONG + " It rose to {0} in May.", "placeholder"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("Content coming soon.", "filler"), ("Hier steht Ihr Text.", "filler"), ("Votre texte ici.", "filler"), ("Escriba aquí su texto.", "filler"), (LONG + "\n\nThis is placeholder text for the outlook section and will be replaced before publication.", "filler"),
    ("404 Not Found", "error_page"), ("403 Forbidden\nReference: a81f", "error_page"), ("<html><body><p>This article cannot be shown right now.</p></body></html>", "error_page"), ("Please enable JavaScript in your browser to read this note.", "error_page"),
    ("Home | Markets | Rates | Filings | Sign in\n\nThis app needs JavaScript to run.", "error_page"), ("Zugriff verweigert.\nVorgang 83af", "error_page"), ("La page n'existe pas ou plus. Retour à l'accueil.", "error_page"), ("ACCESO DENEGADO. REFERENCIA 12AB", "error_page"),
    ('{"status":503,"error":"Service Unavailable","path":"/notes/5","trace":"12ab"}', "error_page"), ("You  need  to  allow  scripts  to  view  the  article.", "error_page"), ("Markets today\nThe page does not exist. Go back and choose another link.", "error_page"),
]
CONTENT = [
    None, "", "   \n ", LONG, "If the page is not found, the crawler records status 404 and the headline keeps its earlier text.", "Access to the data room was denied to 46 bidders because their papers were incomplete.",
    "The broker's site answered with a 503 Service Unavailable page for 20 minutes on Monday, and clients could not trade.", "Sudorsk Grid sells a tool that fills {{placeholders}} in letters.", "Use ${RAW_ROOT} in the shell profile; the scheduler expands it.",
    "The staging model reads {{ source('raw', 'prices') }} first.", "Row format: <symbol>,<date>,<close>; for example A,1,2.", "Fragments are named part-<run>.parquet, where <run> is the run id.", 'A message such as {"symbol": "A"} goes to quarantine.',
    "The check counted 40 rows where the price was null and 5 where it was not a number.", "Write the ticker in the first box [see note 4].", "None of the banks moved.", "The fee applies pro rata and, ceteris paribus, lowers the margin.", "The query is select max(close) from prices where date > $1.",
    "The designers put dummy text into the draft prospectus.", "Wer JavaScript ausgeschaltet hatte, sah den Kurs trotzdem.", "Velden verkauft Vorlagen, in denen {{Name}} und {{Betrag}} erst beim Versand ersetzt werden.", "<html><body><p>Shares closed higher.</p></body></html>",
    LONG + " The page does not exist.",
]


@pytest.mark.parametrize("text,kind", RESIDUE)
def test_residue_is_found(text, kind):
    assert residue.classify(text)[0] == kind


@pytest.mark.parametrize("text", CONTENT)
def test_content_is_kept(text):
    assert residue.classify(text)[0] is None


def test_case_and_markup_do_not_matter():
    assert residue.classify("THE REQUESTED NOTE TOOK TOO LONG TO ANSWER.")[0] == "error_page"
    assert residue.classify("<p>Sample headline.</p><p>Sample subhead.</p>")[0] == "filler"


def test_very_long_texts():
    assert residue.classify("x" * 2_000_000)[0] is None
    assert residue.classify("{" * 20_000)[0] is None
    assert residue.classify("<" * 20_000 + "a" * 20_000)[0] is None
    assert residue.classify(LONG * 100 + " Dear {name}, hello.")[0] == "placeholder"


def test_tables(spark):
    data = [(1, "404 Not Found"), (1, "404 Not Found"), (None, LONG), (2, None), (3, "")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("id", F.lit("clash")).withColumn("residue", F.lit("clash")).withColumn("coverage", F.lit(1))
    out = residue.judge(df)
    assert out.columns == ["doc_id", "residue", "coverage"] and out.count() == 5
    assert [r.doc_id for r in out.where("residue is not null").collect()] == [1, 1]
    kept = residue.exclude(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert residue.judge(df.limit(0)).count() == 0 and residue.exclude(df.limit(0)).count() == 0


def test_other_columns_survive_exclusion(spark):
    df = spark.sql("select 1L as doc_id, 'fine text here' as text, timestamp_ntz'2024-01-01 00:00:00' as at, array(1, 2) as a, map('k', 1) as m, struct(1 as x) as s, date'2024-01-01' as d, cast(null as string) as n")
    assert residue.exclude(df).collect() == df.collect()


@pytest.mark.parametrize("text", ["An error occurred while processing your request. Please reload the page.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "Une erreur est survenue. Veuillez recharger la page.", "Se ha producido un error. Vuelva a cargar la página.", "Enter your text here."])
def test_general_messages_are_found(text):
    assert residue.classify(text)[0] in ("error_page", "filler")
    assert residue.classify(f"{text} Revenue of the quarter rose by a tenth, as the new plant reached its planned output and sold all of it to three long-standing customers, while the costs of transport fell.")[0] != "error_page"


def test_heldout_texts():
    """Texts written after the rules: recall and precision of 0.9 or more; the README has the figures of the first measurements."""
    import heldout_residue as held

    residues, ordinary = held.residue_texts(), held.ordinary_texts()
    assert len(residues) >= 200 and len(ordinary) >= 500
    found = sum(residue.classify(t)[0] is not None for t, _ in residues)
    false = sum(residue.classify(t)[0] is not None for t in ordinary)
    assert found / len(residues) >= 0.9 and found / (found + false) >= 0.9
    second = [residue.classify(t)[0] is not None for t in held.lines(held.SECOND_RESIDUE)]
    wrong = [t for t in held.lines(held.SECOND_ORDINARY) if residue.classify(t)[0]]
    assert sum(second) >= 0.9 * len(second) and not wrong


@pytest.mark.parametrize("text", ["var a={b}; fills {x} ", "$ % { [ < ", "the values null and ", "not found zebra giraffe ", "[a", "a | b ", "<a ", "It is {x} fill. "])
def test_time_grows_with_length_only(text):
    import time

    began = time.perf_counter()
    residue.classify(text * (400_000 // len(text)))
    assert time.perf_counter() - began < 20
