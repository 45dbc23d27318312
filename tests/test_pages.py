"""Paged texts: running lines, broken words, headings over pages, scans."""

from pyspark.sql import functions as F

from lorespark.operators import pages

PAGES = "doc_id bigint, page int, text string"


def units(spark, *texts):
    rows = [(1, i, t) for i, t in enumerate(texts, 1)]
    got = pages.paged_units(spark.createDataFrame(rows, PAGES)).orderBy("unit").collect()
    assert [r["unit"] for r in got] == list(range(1, len(got) + 1))
    return [(r["page"], r["section"], r["text"]) for r in got]


def test_headings_and_running_lines(spark):
    page = lambda n, *lines: "\n".join(["ООО Ромашка — внутренний документ", *lines, f"Страница {n}"])
    texts = [page(1, "1 Общие положения", "Документ описывает порядок.", "Он обязателен для всех."), page(2, "2 Сроки", "Не позднее двух рабочих дней."), page(3, "2.1 Исключения", "Срочные исправления — в тот же день.")]
    assert units(spark, *texts) == [
        (1, "1 Общие положения", "1 Общие положения\nДокумент описывает порядок.\nОн обязателен для всех."), (2, "2 Сроки", "2 Сроки\nНе позднее двух рабочих дней."),
        (3, "2 Сроки › 2.1 Исключения", "2.1 Исключения\nСрочные исправления — в тот же день."),
    ]
    assert [t for _, _, t in units(spark, *texts[:2])][0].startswith("ООО")  # two pages are too few
    middle = [f"Top {i}\nOne line here.\nSame text\nOther line {'abc'[i]}.\nFoot" for i in range(3)]
    assert all("Same text" in t for _, _, t in units(spark, *middle))  # repeated, but not at an edge
    half = ["Head\nText one.", "Head\nText two.", "Body three.\nMore.", "Body four.\nMore two."]
    assert [t for _, _, t in units(spark, *half)] == ["Text one.", "Text two.", "Body three.\nMore.", "Body four.\nMore two."]


def test_breaks_and_levels(spark):
    text = "Some exam-\nple of a soft\nbreak.\nkept? Yes:\nlist\n 3.2.1. Deep heading here\ntext\n1.1 ends with a stop.\n10 Ten\n100 Not one\n5 lower\n4 Fo"
    got = units(spark, text, "\r\nnext page\r\n4 Four More", None, "after four")
    assert got == [
        (1, "", "Some example of a soft break.\nkept? Yes:\nlist"), (1, "3.2.1. Deep heading here text", "3.2.1. Deep heading here text\n1.1 ends with a stop."),
        (1, "10 Ten", "10 Ten\n100 Not one\n5 lower\n4 Fo"), (2, "10 Ten", "next page"), (2, "4 Four More", "4 Four More"), (4, "4 Four More", "after four"),
    ]
    levels = units(spark, "1 One\nText.\n1.1 Two\nText.\n1.1.1 Three\nText.\n2 Next\nText.\n2.0.1 Odd One\nText.")
    assert [s for _, s, _ in levels] == ["1 One", "1 One › 1.1 Two", "1 One › 1.1 Two › 1.1.1 Three", "2 Next", "2 Next › 2.0.1 Odd One"]


def test_scans_and_empty(spark):
    many = spark.createDataFrame([(1, 1, "0.1 First Part\nText."), (1, 2, "7 Real Title\nText.\n8 Next\nText.")], PAGES)
    assert pages.paged_outcomes(many, pages.paged_units(many)).first()["title"] == "7 Real Title"
    rows = spark.createDataFrame([(1, 1, None), (1, 2, " short "), (2, 1, "1 Title Line\nEnough text to be read"), (3, 5, "no heading but enough text")], PAGES)
    made = pages.paged_units(rows)
    out = {r["doc_id"]: (r["pages"], r["units"], r["title"], r["error"]) for r in pages.paged_outcomes(rows, made).collect()}
    assert out == {1: (2, 0, None, pages.SCANNED), 2: (1, 1, "1 Title Line", None), 3: (1, 1, None, None)}
    assert {r["page"] for r in made.where("doc_id = 3").collect()} == {5}
    assert pages.paged_units(rows.limit(0)).count() == pages.paged_outcomes(rows.where(F.lit(False)), made).count() == 0
