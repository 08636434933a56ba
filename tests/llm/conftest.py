import pytest

#: Texts every operator must take: null, empty, blank, short, repeated, long, wide characters, odd marks.
ODD = [None, "", " \t\n", "x", "x", "one two three four", "word " * 3000, "é😀" * 50, "a" * 20_000, "1.2.3.4 " * 40, "▁ ▁x", "\u0000 nul", "9" * 5000, "a.b@" * 500]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i}", i, "clash", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, spans int")


@pytest.fixture
def table_dir(spark, tmp_path):
    """Writes tables into a folder of the standard layout and returns its path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
