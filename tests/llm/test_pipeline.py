import random


import corpus_pipeline
from adlens.llm import linededup, quality, tiling
from test_linededup import brute as brute_lines
from test_minhash import brute as brute_near
from test_tiling import naive
from test_tokens import check_packing, library_ids


def sentence(seed, n=12):
    own = random.Random(seed)
    return " ".join(f"v{own.randrange(10**6)}" for _ in range(n)).capitalize() + "."


def corpus():
    rows = [(0, None), (1, ""), (2, "too short."), (3, "x " * 5000)]
    base = [[sentence(100 * d + k) for k in range(8)] for d in range(40)]
    items = [(i, sentence(9000 + i, 30)) for i in range(5)]
    passage = [sentence(7000 + k) for k in range(4)]
    for d, lines in enumerate(base):
        lines = list(lines)
        if d % 4 == 1:
            lines[2:2] = passage if d % 8 == 1 else [" ".join(passage)]
        if d % 4 == 2:
            lines.insert(3, "Home | About | Contact | Help")
        if d % 10 == 3:
            lines[1] = lines[1] + " " + items[d % 5][1]
        rows.append((10 + d, "\n".join(lines)))
        if d % 5 == 0:  # a near copy: one word of each line differs
            rows.append((100 + d, "\n".join(x.replace("v", "w", 1) if k == 2 else x for k, x in enumerate(lines))))
    rows.append((200, " ".join(sentence(50_000 + k) for k in range(300))))
    rows.append((15, dict(rows)[15]))
    return rows, items


def expected(rows, items):
    """Texts after each stage, by comparing everything with everything."""
    kept = []
    for doc, text in rows:
        verdict = quality.judge(text)
        if verdict[7]:
            kept.append((doc, verdict[8].decode()))
    stages = [sorted(kept)]
    left = brute_lines(kept, linededup.MIN_WORDS)
    kept = [(d, left[d, t][0]) for d, t in kept]
    kept = [(d, t) for d, t in kept if t.split()]
    stages.append(sorted(kept))
    near = brute_near(kept)
    kept = sorted({(d, t) for d, t in kept if near[d][1] == d})
    stages.append(kept)
    clean = []
    for doc, text in kept:
        own = tiling.word_ids(text).tolist()
        patterns = [tiling.word_ids(t).tolist() for _, t in items]
        if not any(100 * naive(own, p, tiling.MIN_MATCH) >= tiling.COVER_PERCENT * len(p) for p in patterns):
            clean.append((doc, text))
    return [*stages, clean]


def test_every_stage_equals_brute_force(docs, spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = table.columns
    wanted = expected(rows, items)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        target = str(tmp_path / f"stage{n}")
        stage(spark, table, str(tmp_path)).write.parquet(target)
        table = spark.read.parquet(target)
        if name != "packing":
            assert table.columns == columns
            assert sorted((r.doc_id, r.text) for r in table.collect()) == wanted[n], name
    assert len({len(w) for w in wanted}) > 2
    check_packing([tuple(r) for r in table.collect()],
                  [(d, [*library_ids("byte_bpe_50k.json", t), 0]) for d, t in wanted[-1]])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg({"length": "sum"}).first()[0] == table.agg({"length": "sum"}).first()[0]


def test_stages_of_an_empty_table(docs, spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, str(tmp_path)).count() == 0
