"""Extra columns with the names that an operator uses inside change nothing, and stages hand them on."""

from pyspark.sql import functions as F

import corpus_pipeline
from adlens.llm import idcodes, packing, tiling, tokencount, tokenizing, warc

TEXTS = [(1, "one two three four five six seven. " * 9), (2, None), (3, ""), (None, "lost words."), (3, "x"), (3, "x"), (4, "word " * 50_000 + "end.")]
CLASHES = ["ids", "start", "length", "path", "part", "base", "n_tokens", "page", "seed", "gone", "owner", "_hash", "_text_hash", "shingles", "rep", "payload", "offset", "item_id"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def rows(df):
    return sorted(map(str, df.collect()))


def test_token_operators(docs, spark):
    plain = docs(TEXTS)
    for run in (lambda d: tokencount.token_counts(d, tokenizing.vocabulary_path(tokencount.VOCABULARY)),
                lambda d: packing.pack(d, tokenizing.vocabulary_path(tokenizing.BYTE_LEVEL)).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"))):
        assert rows(run(clashing(plain))) == rows(run(plain))
    read = []
    for table in (plain, clashing(plain)):
        folder = idcodes.new_folder(spark)
        manifest = spark.createDataFrame(idcodes.write_ids(table, folder, tokenizing.vocabulary_path(tokenizing.WORD_LEVEL)).collect(), idcodes._MANIFEST)
        read.append(rows(idcodes.read_ids(manifest, folder)))
    assert read[0] == read[1] and len(read[0]) == len(TEXTS)


def test_archives(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", None), (3, None, "<p>a</p>")], "page_id bigint, url string, html string")
    wide = pages.select("*", *[F.lit("clash").alias(c) for c in ("payload", "digest", "record_type", "refers_to", "part", "path", "top")])
    assert rows(warc.archive_round_trip(wide)) == rows(warc.archive_round_trip(pages))


def test_decontamination(docs, spark):
    plain = docs(TEXTS)
    items = spark.createDataFrame([(9, "one two three four five six seven. " * 2), (8, None)], "item_id bigint, text string")
    wide = items.select("*", F.lit("clash").alias("doc_id"), F.lit(1).alias("words"))
    got = rows(tiling.contaminated_pairs(clashing(plain).drop("item_id"), wide))
    assert got == rows(tiling.contaminated_pairs(plain, items)) and len(got) == 1


def test_stages_hand_extra_columns_on(docs, spark, tmp_path, words):
    spark.createDataFrame([(9, "no such words here at all, none.")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = clashing(docs([(d, "\n".join(" ".join(words(10, 100 * d + k)) + "." for k in range(9))) for d in range(5)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        assert out.count() > 0 and out.select(*CLASHES).distinct().count() == 1, name
