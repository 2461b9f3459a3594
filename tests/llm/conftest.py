import pytest

EXTRA = "score double, n_words int, fp string, component_id string, words string, kept string, _row int, formatted int, `a.b` int, `two words` int, `kept.n` struct<`x y`:int>"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog while seven small birds sing in a very old tree near the quiet river bank today"
    rows = [
        (1, base, "en", "s"), (2, base, "en", "s"), (2, base, "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, "  \n\t ", "en", "s"), (None, base, None, None), (None, None, None, None),
        (6, "word", "en", "s"), (7, "Größe ÉTÉ naïve 日本語 テキスト <|endoftext|> 'll  two  spaces", "de", "s"), (8, " ".join(f"w{i % 997}x{i}" for i in range(30_000)), "en", "s"),
        (9, base + " extra words at the end of it", "en", "s"), (10, "prefix " + base, "en", "s"), (11, "x " * 400, "en", "s"),
    ]
    wide = [(*r, None if r[3] is None else len(r[1] or ""), 0.5, 1, "f", "c", "w", "k", 1, 2, 3, 4, (5,)) for r in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).persist()
