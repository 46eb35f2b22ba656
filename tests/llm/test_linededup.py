import difflib

from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import linededup


def line(i, n=9):
    return " ".join(f"l{i}w{k}" for k in range(n)) + "."


def pieces_of(text):
    """Lines of raw pieces, cut by walking over the characters."""
    out = []
    for raw in (text or "").split("\n"):
        pieces, start = [], 0
        for i in range(1, len(raw)):
            if raw[i] in " \t\v\f\r" and (raw[i - 1] in ".!?" or (raw[i - 1] in "\"')]”’»" and i > 1 and raw[i - 2] in ".!?")):
                pieces.append(raw[start:i + 1])
                start = i + 1
        out.append([*pieces, raw[start:]])
    return out


def brute(rows, least):
    """The text each (doc_id, text) keeps: every run of pieces with ``least`` words that one of its owners holds goes.

    All runs of all documents are compared, word by word.
    """
    def held(text):
        return [(n, k, tuple(p.encode().split())) for n, line in enumerate(pieces_of(text)) for k, p in enumerate(line) if p.encode().split()]

    def runs(words, shortest):
        out = set()
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if sum(map(len, words[i:j])) >= least:
                    out.add(tuple(words[i:j]))
                    if shortest:
                        break
        return out
    ordered = sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: (r[0], r[1] or ""))
    words = [[w for _, _, w in held(t)] for _, t in ordered]
    keys = [runs(w, True) for w in words]
    kept = {}
    for n, (d, t) in enumerate(ordered):
        owners = {next(m for m in range(n + 1) if run in keys[m]) for run in keys[n]} - {n}
        gone = set()
        for m in owners:
            shared = runs(words[m], False)
            gone |= {p for i in range(len(words[n])) for j in range(i + 1, len(words[n]) + 1) if tuple(words[n][i:j]) in shared for p in range(i, j)}
        lost = {held(t)[p][:2] for p in gone}
        touched = {line for line, _ in lost}
        lines = [(k, "".join(p for q, p in enumerate(line) if (k, q) not in lost)) for k, line in enumerate(pieces_of(t))]
        whole = sum(k in touched and not x.encode().split() for k, x in lines)
        left = None if t is None else "\n".join(x for k, x in lines if k not in touched or x.encode().split())
        kept[d, t] = (left, whole, sum(len(words[n][p]) for p in gone))
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=25), st.lists(st.integers(0, 8), max_size=25))
def test_matches_increase_and_are_equal(a, b):
    matches = linededup.patience_matches(a, b)
    assert all(a[i] == b[j] for i, j in matches)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(matches, matches[1:]))
    if a == b:
        assert len(matches) == len(a)


def test_unique_lines_anchor_the_alignment():
    a = [1, 0, 2, 0, 3, 0, 4]
    b = [9, 1, 0, 2, 8, 0, 3, 0, 4, 7]
    assert linededup.patience_matches(a, b) == [(0, 1), (1, 2), (2, 3), (3, 5), (4, 6), (5, 7), (6, 8)]
    # Lines that occur once on each side align as the longest common subsequence does.
    x, y = [1, 2, 3, 4, 5, 6], [4, 5, 1, 2, 3, 6]
    best = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    assert len(linededup.patience_matches(x, y)) == best


def test_blocks_need_enough_words():
    later, earlier, counts = [1, 2, 3, 9, 5], [1, 2, 8, 9, 5], [10, 10, 10, 10, 10]
    assert linededup.common_blocks(later, earlier, counts, 20) == [0, 1, 3, 4]
    assert linededup.common_blocks(later, earlier, counts, 21) == []


def shared_runs(later, earlier, counts, least):
    """Positions of ``later`` inside any run of ``least`` words that ``earlier`` holds, by trying every run."""
    held = {tuple(earlier[i:k]) for i in range(len(earlier)) for k in range(i + 1, len(earlier) + 1)}
    return sorted({p for i in range(len(later)) for k in range(i + 1, len(later) + 1)
                   if sum(counts[i:k]) >= least and tuple(later[i:k]) in held for p in range(i, k)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=16), st.lists(st.integers(0, 5), max_size=16), st.integers(1, 9))
def test_no_shared_run_is_left(later, earlier, least):
    counts = [1 + x % 4 for x in later]
    assert linededup.common_blocks(later, earlier, counts, least) == shared_runs(later, earlier, counts, least)


def test_repeated_and_reordered_passages_go(docs):
    def passage(n):
        return "\n".join(line(100 * n + k) for k in range(4))
    p, q = passage(1), passage(2)
    own = [line(9000 + k) for k in range(30)]
    rows = [(0, "\n".join([own[0], p, own[1], p, own[2], q, own[3]])),  # P twice in the owner, Q after it
            (1, "\n".join([own[4], p, own[5]])), (2, "\n".join([own[6], p, own[7], p, own[8]])),
            (3, "\n".join([own[9], q, own[10], p, own[11]]))]
    got = {r.doc_id: r.text for r in linededup.remove_repeated_lines(docs(rows)).collect()}
    assert got == {0: rows[0][1], 1: "\n".join(own[4:6]), 2: "\n".join(own[6:9]), 3: "\n".join(own[9:12])}


def test_passages_inside_longer_lines_go(docs):
    p = " ".join(line(i) for i in range(4))
    rows = [(0, f"{line(50)} {p} {line(51)}"),
            (1, f"Before it.  {p} And after it.\n \nnext line"),           # inside a line
            (2, "\n".join([line(60), *(line(i) for i in range(4)), "end"])),  # the same sentences as lines
            (3, f"{p.replace('l1w4', 'other')} {p}"),                       # one changed word
            (4, f"“Said so.” {p}"), (5, f"{p}\t\nrest")]
    got = {r.doc_id: r for r in linededup.remove_repeated_lines(docs(rows)).collect()}
    assert {d: r.text for d, r in got.items()} == {
        0: rows[0][1], 1: "Before it. And after it.\n \nnext line", 2: f"{line(60)}\nend",
        3: f"{line(0)} {line(1).replace('l1w4', 'other')} {line(2)} {line(3)} ", 4: "“Said so.” ", 5: "rest"}
    assert {d: (r.n_lines, r.removed_lines, r.removed_words) for d, r in got.items()} == {
        0: (1, 0, 0), 1: (2, 0, 36), 2: (6, 4, 36), 3: (1, 0, 36), 4: (1, 0, 36), 5: (2, 1, 36)}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_removal_equals_brute_force(docs):
    passage = [line(i) for i in range(100, 108)]
    hot = "Short common line of this site."
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, "\n".join(passage)), (3, "\n".join(passage))]
    for d in range(4, 24):
        body = [line(1000 * d + k) for k in range(5)]
        at = d % 5
        part = passage[d % 3:3 + d % 5] if d % 2 else passage[4:] + passage[:4]
        # Every third document has its sentences in long lines, and some of those end in quotes.
        joint = " " if d % 3 == 0 else "\n"
        if d % 4 == 0:
            body[0] = f"“{body[0]}” {body[1]}"
        rows.append((d, "\n".join([hot, joint.join([*body[:at], "", *part, *body[at:]]), hot + " \t" + hot])))
    rows += [(30, rows[5][1]), (31, "\n".join(line(i, 60) for i in range(2))), (32, line(0, 60)), (32, line(0, 60))]
    got = linededup.remove_repeated_lines(docs(rows)).collect()
    want = brute(rows, linededup.MIN_WORDS)
    assert len(got) == len(rows) and sum(bool(v[1] or v[2]) for v in want.values()) > 15
    texts = dict(rows)
    for r in got:
        source = "\n".join(passage) if r.doc_id is None else texts[r.doc_id]
        left, whole, words = (source, 0, 0) if r.doc_id is None else want[r.doc_id, source]
        assert (r.text, r.removed_lines, r.removed_words) == (left, whole, words), r.doc_id
        assert r.n_chars == (None if left is None else len(left))
        assert r.n_lines == (0 if source is None else sum(bool(x.encode().split()) for x in source.split("\n")))


PARTS = ["a b c.", "d e! ", "f g? ", "h. ", "i.) ", "j k l m n o p q r s t. ", "\n", " ", "u", "v w.” ", "x.\t", "é ü. "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_pieces_and_runs_are_those_of_the_text(parts):
    text = "".join(parts)
    lines, counts, places, runs = linededup.line_keys(text, 5)
    want = [((n << linededup.PLACE_BITS) + k, p.encode().split()) for n, line in enumerate(pieces_of(text)) for k, p in enumerate(line) if p.encode().split()]
    assert places.tolist() == [w[0] for w in want] and counts.tolist() == [len(w[1]) for w in want]
    assert lines.tolist() == linededup.line_keys(text.encode(), 5)[0].tolist()
    # Equal runs have equal keys, wherever they stand; others do not.
    keys = {}
    for i in range(len(want)):
        j = next((j for j in range(i + 1, len(want) + 1) if sum(len(w) for _, w in want[i:j]) >= 5), None)
        if j:
            alone = "\n".join(" ".join(x.decode() for x in w) for _, w in want[i:j])
            keys[tuple(tuple(w) for _, w in want[i:j])] = linededup.line_keys(alone, 5, sentences=False)[3]
    assert len(keys) == len(runs) and all(len(set(k.tolist()) & set(runs.tolist())) >= 1 for k in keys.values())


def test_a_very_long_text_and_a_hot_owner(docs):
    long = "\n".join(line(i) for i in range(9000))
    shared = " ".join(line(i) for i in range(20, 25))
    rows = [(0, long)] + [(d, f"{line(50_000 + d)} {shared}") for d in range(1, 1300)]
    got = {r.doc_id: r for r in linededup.remove_repeated_lines(docs(rows, 6)).collect()}
    assert got[0].text == long and all(got[d].text == line(50_000 + d) + " " and got[d].removed_words == 45 for d in range(1, 1300))


def test_one_key_shared_by_all_gives_a_pair_each(docs):
    shared = line(1, 40)
    rows = [(d, f"{line(d + 10)}\n{shared}") for d in range(200)]
    got = {r.doc_id: r.removed_lines for r in linededup.remove_repeated_lines(docs(rows, 8)).collect()}
    assert got == {d: int(d > 0) for d in range(200)}


def test_repeated_ids_clashing_columns_and_empty_table(docs):
    from pyspark.sql import functions as F
    rows = [(1, line(1, 40)), (1, line(2, 40)), (2, line(1, 40) + "\n" + line(2, 40) + "\nrest.")]
    table = docs(rows).withColumn("removed_lines", F.lit("x")).withColumn("gone", F.lit(1)).withColumn("owner", F.lit(2))
    got = sorted(((r.doc_id, r.removed_lines, r.text) for r in linededup.remove_repeated_lines(table).collect()))
    assert [g[:2] for g in got] == [(1, 0), (1, 0), (2, 2)] and got[2][2] == "rest."
    assert linededup.remove_repeated_lines(docs([])).count() == 0
