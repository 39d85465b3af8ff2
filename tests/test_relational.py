"""Relational queries on small tables made for them, apart from their SQL."""

import datetime as dt

from conftest import rows

from tidegrid.queries import relational

D, T = dt.date, dt.datetime


def test_one_year_history_holds_the_whole_year(spark, tmp_path):
    latest = D(2025, 6, 30)
    data = [("A", latest, 150.0), ("A", D(2025, 1, 2), 150.0), ("A", D(2024, 7, 1), 50.0), ("A", D(2025, 6, 1), None), ("A", D(2024, 6, 30), 150.0), ("A", None, 150.0)]
    spark.createDataFrame(data, "symbol string, date date, close double").write.parquet(str(tmp_path / "prices.parquet"))
    got = rows(relational.one_year_history(spark, str(tmp_path)))
    assert got == sorted((r for r in data if r[1] and r[1] > D(2024, 6, 30)), key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_news_of_documents_is_whole(spark, tmp_path):
    texts = [" " * 60 + "late start", "x" * 500, "short", "  ", None]
    data = [(i, texts[i % 5] if i < 5 else "news", "en", "wire", T(2025, 1, 2)) for i in range(40)]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, published_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {str(i): t.strip(" ") for i, t, *_ in data if t and t.strip(" ")}
    assert len(kept) == 38
    assert {r.source_record_id: r.headline for r in relational.stg_news(spark, str(tmp_path)).collect()} == kept
    assert {r.source_record_id: r.url for r in relational.url_filter(spark, str(tmp_path)).collect()} == {i: f"https://n/{i}" for i in kept}
