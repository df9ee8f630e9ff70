import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Documents with nulls, ties, empty and very long texts, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and thing{i % 1013}," for i in range(6000))
    bodies = [None, "", " \n ", "a", "the cat sat on the mat", "the cat sat on the mat", long, long + " tail",
              "naïve café “quoted” — dash  double", "日本語のテキスト テスト", "x" * 5000,
              "<|endoftext|> special <|startoftext|>", "tab\tand\x01control\x1f" + " end ",
              "a\n\n\x01b  \x01\x01 c \t \x01", "\x01", " \x01 "]
    rows = [Row(doc_id=i if i != 4 else None, text=t, lang="en", source="s", n_chars=len(t or ""), row=i, key="k", fp=1, start=3, length=2, slot=1)
            for i, t in enumerate(bodies)] + [Row(doc_id=3, text="a", lang=None, source=None, n_chars=1, row=99, key=None, fp=None, start=None, length=None, slot=None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, key string, fp long, start int, length int, slot int")


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
