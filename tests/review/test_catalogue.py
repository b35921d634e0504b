"""Every registered query gives rows on the smallest tables, and those with SQL give what DuckDB gives."""

import math

import duckdb
import pytest

from marginalia.plans import catalogue

D = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 9) if isinstance(value, float) else value.item() if hasattr(value, "item") else value


def rows(pdf):
    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in catalogue.TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        want = con.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_papers_hold_whole_documents(spark):
    documents = spark.read.parquet(f"{D}/documents.parquet")
    papers = {r["doc_id"]: r["text"] for r in catalogue.view(spark, D, catalogue.PAPERS).collect()}
    for r in documents.select("doc_id", "text").collect():
        n = len(r["text"]) // 3
        for part in (r["text"][:n], r["text"][n : 2 * n], r["text"][2 * n :]):
            assert part in papers[r["doc_id"]]
    longest = max(len(r["text"]) for r in documents.collect())
    assert longest > 10_000
    text = catalogue.QUERIES["paper_sections"](spark, D).selectExpr("max(length(text)) AS n").first()["n"]
    assert text >= longest // 4


def near(a, b):
    """Whether one deletion, insertion, replacement or swap of neighbours leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def test_suggestions_for_words_of_any_length(spark, tmp_path):
    known = {"of": 9, "be": 6, "house": 7, "horse": 8, "measurement": 5, "internationalisation": 6, "heteroscedasticity": 5}
    typed = "ox houze measurment measuremnet internationalisatoin heteroscedasticityy eb unrelatedness q interrnationalisation".split()
    text = " ".join([w for w, n in known.items() for _ in range(n)] + typed)
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for t in typed:
        if found := [(-n, k) for k, n in known.items() if near(t, k)]:
            want[t] = min(found)[1]
    got = {r["word"]: r["suggestion"] for r in catalogue.QUERIES["spelling_suggestions"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 8
