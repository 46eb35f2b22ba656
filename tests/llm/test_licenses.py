import random
import re

import pytest

from adlens.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text, templates=licenses.TEMPLATES):
    words = words_of(text)
    places = {label: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for label, p in licenses.PHRASES}
    flat = sorted(i for v in places.values() for i in v)
    base = sorted(label for label, v in places.items() if v)
    found, score, blocks = set(), 0.0, set()
    for n, line in enumerate((text or "").split("\n")):
        held = set(words_of(line))
        for label, sentence in templates:
            wanted = set(sentence.split())
            if 100 * len(held & wanted) >= licenses.CONTAINMENT_PERCENT * len(wanted):
                found.add(label)
                blocks.add(n)
                score = max(score, len(held & wanted) / len(wanted))
    return (len(words), len(flat), flat[0] if flat else None, flat[-1] if flat else None, ",".join(base), ",".join(sorted(found | set(base))), score, len(blocks))


def made(seed):
    own = random.Random(seed)
    filler = ["the", "of", "license", "under", "Word", "mit", "general", "public", "É9", "and", "use"]
    rows = []
    for d in range(120):
        lines = [" ".join(own.choice(filler) for _ in range(own.randrange(12))) for _ in range(own.randrange(5))]
        for _, sentence in own.sample(licenses.TEMPLATES, own.randrange(3)):
            words = sentence.split()
            for _ in range(own.randrange(4)):
                words[own.randrange(len(words))] = own.choice(filler)
            lines.insert(own.randrange(len(lines) + 1), " ".join(words).upper() if own.random() < .3 else "; ".join(words))
        rows.append((d, "\n".join(lines)))
    return rows


def test_scan_equals_brute_force(docs):
    from pyspark.sql import functions as F
    rows = made(3) + [(None, "MIT License"), (None, None), (1000, None), (1001, ""), (1002, "mit"), (1003, "\n\n"), (5, "GNU general-public LICENSE, mit license mit license"),
                      (1004, "x " * 200_000 + "Released under the MIT License."), (1005, "the lİcense MIT Lıcense mıt license")]
    rows += rows[:20]
    table = docs(rows).withColumn("labels", F.lit("x")).withColumn("words", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("line", F.lit(2))
    got = sorted((tuple(r) for r in licenses.scan_licenses(table).collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert len({g[6] for g in got}) > 10


@pytest.mark.parametrize("percent", [50, 100])
def test_any_threshold(docs, monkeypatch, percent):
    monkeypatch.setattr(licenses, "CONTAINMENT_PERCENT", percent)
    rows = made(4)
    found = licenses.template_blocks(docs(rows), percent=percent).groupBy("doc_id").agg({"label": "collect_set"}).collect()
    want = {}
    for d, t in rows:
        labels = {label for line in t.split("\n") for label, s in licenses.TEMPLATES
                  if 100 * len(set(words_of(line)) & set(s.split())) >= percent * len(set(s.split()))}
        if labels:
            want[d] = labels
    assert {r[0]: set(r[1]) for r in found} == want


def test_no_python_in_the_plan(docs):
    plan = licenses.scan_licenses(docs(made(5)[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_table(docs):
    assert licenses.scan_licenses(docs([])).count() == 0
