"""Training windows of the secret scan are made once, not once for each sort."""

from volpanel.llm import secrets


def test_windows_are_written_before_the_choice_by_sort(spark, monkeypatch):
    seen = []
    plain = secrets.cut
    monkeypatch.setattr(secrets, "cut", lambda df: seen.append(df.columns) or plain(df))
    docs = spark.createDataFrame([(i, f"some words before and after item {i} password = Zx9{i:09d}Qq end of it") for i in range(40)], "doc_id long, text string")
    model = secrets.fit(docs, rounds=2)
    assert seen == [["data", "sort"]] and model["weights"].any()
