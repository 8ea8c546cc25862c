from pathlib import Path

import numpy as np

from tests.llm import fixtures as D
from wavecohort.llm import lines, text
from wavecohort.session import checkpoint_dir


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def simhash(line):
    votes = np.zeros(64, int)
    parts = line.split(" ")
    for w in parts:
        raw = np.frombuffer(w.encode(), np.uint8)
        h = text.span_hashes(raw, np.array([0]), np.array([len(raw)]))
        votes += np.unpackbits(h.astype(">u8").view(np.uint8))
    return int("".join("1" if 2 * v > len(parts) else "0" for v in votes), 2)


def brute(rows):
    """All pairs of distinct classes within 3 bits are verified by their first lines; the first place of each group stays."""
    first, places, line_of = {}, [], {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            whole = lines.written(line.lower().encode())
            n = lines.class_name(whole)
            if n:
                if (i, k) <= first.get(n, (i, k)):
                    first[n], line_of[n] = (i, k), whole
                places.append((i, k, n))
    names = list(first)
    bits = {n: simhash(n) for n in names}
    near = [(a, b) for x, a in enumerate(names) for b in names[x + 1:] if (bits[a] ^ bits[b]).bit_count() <= 3]
    near = [(line_of[a], line_of[b], a, b) for a, b in near]
    root = D.groups_of([(a, b) for s, t, a, b in near if levenshtein(s, t) <= 0.2 * max(len(s), len(t)) + 1e-9], names)
    keep = {}
    for n in names:
        keep[root[n]] = min(keep.get(root[n], first[n]), first[n])
    gone = {(i, k) for i, k, n in places if keep[root[n]] != (i, k)}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [p for k, p in enumerate(parts) if (i, k) not in gone]
        out.append((i, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in df.collect()), key=str)


def test_documents_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in D.documents(spark, sf).collect()][:120]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(lines.deduplicate(df)) == brute(rows)


def test_odd_rows_and_near_lines(spark):
    base = "released under the terms of the licence that comes with this package and all later versions of it number"
    more = [(20 + k, f"own line of document {k * 37 + 5} {'abc'[k % 3] * 3}\n\n{base} {['one', 'two', 'one two', 'ONE!', '1', '2'][k % 6]}\n---\n") for k in range(30)]
    rows = [(r[0], r[1]) for r in D.ROWS] + more
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(lines.deduplicate(df)) == brute(rows)
    assert found(lines.deduplicate(D.odd(spark))) == brute([(r[0], r[1]) for r in D.ROWS])
    assert found(lines.deduplicate(D.empty(spark))) == []


def test_block_masks_meet_within_the_distance():
    rng = np.random.default_rng(0)
    for rows in (10, 10**6, 10**8, 10**11):
        masks = lines.block_masks(3, rows)
        for _ in range(500):
            a = int(rng.integers(0, 2**63))
            b = a ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
            assert any(a & m == b & m for m in masks)


def test_edit_distance_equals_the_plain_table():
    rng = np.random.default_rng(2)
    for _ in range(600):
        a, b = ("".join(rng.choice(list("abc é"), int(rng.integers(0, 30)))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[: len(a) // 2] + b[:3] + a[len(a) // 2:]
        assert lines.distance(list(a), list(b)) == levenshtein(a, b)
        assert lines.similar(a, b, 0.8) == (levenshtein(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_number_variants_are_left_to_the_edit_check(spark):
    texts = ["12,345 67", "98,710 24", "Total 2019: 4,512", "Total 2024: 7,893", "12.345, 67",
             "all rights reserved by the owners of this page since 2019", "all rights reserved by the owners of this page since 2020"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [n for _, _, n, _ in found(lines.deduplicate(df))] == [0, 0, 0, 0, 1, 0, 1]


def test_rows_of_numbers_make_no_pairs(spark):
    rows = [(k, f"{k * 7919 % 10007:05d}") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    distinct = lines.line_table(df, "bigint").select("n", "sim").distinct()
    assert lines._meet(distinct, 3, lines.block_masks(3, 3000)).count() == 0


def test_number_variants_of_a_sentence_are_one_class(spark):
    text = "this page was seen by {} people on the day it was moved to the new address of the project"
    df = spark.createDataFrame([(k, text.format(1000 + k)) for k in range(500)], "doc_id long, text string")
    assert sorted(n for _, _, n, _ in found(lines.deduplicate(df))) == [0] + [1] * 499


def test_keys_with_many_near_classes_equal_brute_force(spark, monkeypatch):
    """Hot keys, blocks and linear emission, with all limits made small."""
    for name, value in (("HOT", 4), ("PAIRS", 1), ("ROWS", 8)):
        monkeypatch.setattr(lines, name, value)
    base = [f"{w}{k}" for k, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa".split() * 3)]
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        parts = list(base)
        if k % 3:
            parts[int(rng.integers(30))] = f"other{'abcdefgh'[int(rng.integers(8))]}"
        rng.shuffle(parts) if k % 5 == 0 else None
        rows.append((k, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(lines.deduplicate(df)) == brute(rows)


def test_texts_move_once_for_all_pairs_and_tables_are_gone_before_the_result(spark, monkeypatch):
    for name, value in (("HOT", 4), ("PAIRS", 1), ("ROWS", 8)):
        monkeypatch.setattr(lines, name, value)
    made, plain = [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: made.append(name) or plain(df, name))
    base = [f"{w}{k}" for k, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa".split() * 3)]
    rows = [(k, " ".join([*base[:k % 30], f"other{k % 7}", *base[k % 30:]])) for k in range(40)]
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "rest" in made and made.count("texts") == 1 and "lines" in made
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["dropped"]
    assert found(out) == brute(rows)


def test_pairs_whose_lengths_rule_similarity_out_do_not_go_on(spark, monkeypatch):
    masks = lines.block_masks(3, 4)
    rows = [(1, 5, 100), (2, 5, 120), (3, 5, 300)]
    classes = spark.createDataFrame(rows, "n long, sim long, chars int")
    pairs = lambda: sorted((r.a, r.b) for r in lines._meet(classes, 3, masks).filter("m is null").collect())
    assert pairs() == [(1, 2)]
    monkeypatch.setattr(lines, "HOT", 2)
    met = lines._meet(classes, 3, masks)
    part = spark.createDataFrame([], "node long, root long")
    rest = lines._rest(met.filter("m is not null"), part, 3, masks)
    assert set(pairs()) <= {(1, 2)} and [(r.a, r.b) for r in rest.collect()] == [(1, 2)]


def test_characters_of_a_class_are_those_of_its_written_lines(spark):
    texts = ["  The number, 7 of the Ärger -- pages\n42 17,19 é\n\n...\nX", "ß 日本 e1\tf"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.line): r.chars for r in lines.line_table(df, "bigint").collect()}
    want = {(i, k): len(lines.written(x.lower().encode())) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))}
    assert got == {k: v for k, v in want.items() if v}


def test_votes_of_lines_of_any_length_are_the_majority():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 3, 254, 0, 255, 256, 257, 300, 1000, 5, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 2**64, first[-1], dtype=np.uint64) | rng.integers(0, 2**64, first[-1], dtype=np.uint64)
    for a, z, got in zip(first[:-1].tolist(), first[1:].tolist(), lines.simhashes(h, first).tolist()):
        own = h[a:z].tolist()
        assert got == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own))


def test_common_subsequence_equals_the_plain_table():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (list(rng.choice(list("abcd"), int(rng.integers(0, 90)))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        assert lines.common(a, b) == row[-1]


def test_only_rows_whose_ids_are_wanted_move(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(5000)] + [(None, "none")], "id long, text string")
    wanted = spark.createDataFrame([(k,) for k in range(0, 5000, 50)], "id long")
    some, none = lines.split(docs, wanted)
    moved, stay = [r.id for r in some.collect()], [r.id for r in none.collect()]
    assert set(range(0, 5000, 50)) <= set(moved) and len(moved) < 150
    assert sorted(map(str, moved + stay)) == sorted(map(str, [*range(5000), None]))
