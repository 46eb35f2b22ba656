import re

from adlens.llm import quality


def brute(text):
    """The contract's base figures, by plain loops and patterns."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


SENTENCE = "The quick brown fox jumps over the lazy dog near a wide river bank in the evening sun."
TEXTS = [None, "", " \n\t", "one", "a b a b a b", "x y z\nx y z\n\nx y z ", "é ü ö q \x0b w\x1cv", "#$% <|> a|b * &",
         "same line.\nsame line.\nsame line .", SENTENCE, (SENTENCE + "\n") * 6, " ".join(f"w{i}" for i in range(30_000)) + "."]


def distinct(n, seed=0):
    return " ".join(f"word{seed}x{i}" for i in range(n)) + "."


def test_base_figures_equal_brute_force():
    for text in TEXTS[:-1]:
        got = quality.judge(text)
        want = brute(text)
        assert got[:5] == want, text
        assert got[6] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_line_rules():
    fails = {line: quality.line_fails(line.encode(), line.encode().split()) for line in (
        "A plain sentence.", 'She said "yes."', "Wirklich?", "no closing mark", "Home | About | Contact | Help.",
        "Either/or is fine here / there.", "BUY!! NOW!! CHEAP!!", "price$$$ win%%% now.", "One shout only!",
        "All Rights Reserved.", "We read the Licensed under clause.", "a | b c d e f g h i j k l m.")}
    assert [k for k, v in fails.items() if v] == [
        "no closing mark", "Home | About | Contact | Help.", "BUY!! NOW!! CHEAP!!", "price$$$ win%%% now.",
        "All Rights Reserved.", "We read the Licensed under clause."]


def test_documents_that_lose_too_much_go():
    good = distinct(60)
    light = distinct(60) + "\nAll rights reserved.\n\nHome | Up | Down."
    heavy = distinct(50) + "\n" + "\n".join(" | ".join(f"m{i}x{j}" for j in range(20)) for i in range(5))
    assert quality.judge(good)[7] and quality.judge(light)[7] and not quality.judge(heavy)[7]
    assert quality.judge(light)[8].decode() == distinct(60) + "\n"
    assert not quality.judge(distinct(49))[7]


def test_figures_and_cleaning_of_a_table(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, distinct(80)), (50, distinct(55) + "\nno mark here"), (50, distinct(55) + "\nno mark here")]
    figures = quality.quality_figures(docs(rows)).collect()
    assert len(figures) == len(rows)
    long_one = next(r for r in figures if r.doc_id == len(TEXTS) - 1)
    assert (long_one.n_words, long_one.kept) == (30_000, True)
    assert all(not r.kept for r in figures if r.doc_id is not None and r.doc_id < len(TEXTS) - 1 and r.n_words < 50)
    clean = quality.clean_documents(docs(rows))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = clean.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, len(TEXTS) - 1), (False, 50), (False, 50), (True, 0)]
    assert all(r.n_chars == len(r.text) and "no mark" not in r.text for r in out)
    assert quality.quality_figures(docs([])).count() == 0 and quality.clean_documents(docs([])).count() == 0


def test_extra_columns_with_clashing_names(docs):
    from pyspark.sql import functions as F
    table = docs([(1, distinct(60))]).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(5))
    assert quality.quality_figures(table).first().n_words == 60
    assert quality.clean_documents(table).first().kept == 5
