"""PartEnum join, decontamination and the pipeline: against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinwork.llm import components, decontam, jaccard, mixing

from .conftest import words


def sets_of(rows):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()))
    return out


def brute(rows):
    sets, parent = sets_of(rows), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n in range(len(sets)):
        parent[n] = n
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = len(x & y)
            if x and y and 100 * same >= 85 * (len(x) + len(y) - same):
                parent[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for n, (i, _) in enumerate(sets):
        if i is not None and (low[find(n)] is None or i < low[find(n)]):
            low[find(n)] = i
    return sorted((str(i), len(s), str(low[find(n)] if s else i)) for n, (i, s) in enumerate(sets))


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"q{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rows, i = [], 0
    for g in range(25):
        base = words(1000 + g, [8, 12, 20, 40, 80, 160, 320, 700][g % 8])
        for k in range(7):
            rows.append((i, edited(base, k * len(base.split()) // 90, i), "en", "s"))
            i += 1
    common = words(7, 30)
    rows += [(i + k, common + " " + words(5000 + k, 25), "en", "s") for k in range(40)]
    base = words(99, 60)
    rows += [(500 + k, edited(base, k % 4, k), "en", "s") for k in range(60)] + [(900 + k, base, "en", "s") for k in range(20)]
    rows += [(990, None, "en", "s"), (991, "", "en", "s"), (992, "Two Words", "en", "s"), (993, "two words", "en", "s"), (994, " \n", "en", "s"), (None, base, "en", "s"), (995, words(3, 20000), "en", "s"), (995, words(3, 20000), "en", "s")]
    return rows


def test_components_match_brute_force(table, monkeypatch):
    rows = corpus()
    for block in (2000, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.groups(table(rows)).collect())
        assert got == brute(rows)


def test_one_of_each_and_empty(table, no_docs):
    rows = corpus()
    kept = sorted(r.doc_id for r in jaccard.one_of_each(table(rows)).collect() if r.doc_id is not None)
    assert kept == sorted({int(c) for i, _, c in brute(rows) if c != "None"})
    assert jaccard.groups(no_docs).count() == 0


@pytest.mark.parametrize("size", [6, 7, 9, 13, 30, 100, 400])
def test_similar_sets_share_a_signature(size):
    r = np.random.default_rng(size)
    signer = jaccard.Signer()
    for _ in range(60):
        s = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, size, dtype=np.uint64))
        for drop in range(size):
            t = np.unique(np.concatenate([s[drop // 2 :] if drop else s, r.integers(0, 2**63, drop - drop // 2, dtype=np.uint64)]))
            same = len(np.intersect1d(s, t))
            if 100 * same < 85 * (len(s) + len(t) - same):
                break
            assert len(s) == same == len(t) or set(signer.signatures(s).tolist()) & set(signer.signatures(t).tolist())


def brute_at(rows, length, num):
    """Sets of ids linked, by shingles of length words and a similarity of num / 100."""
    sets = [(i, frozenset(tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1)))) for i, w in ((i, t.split()) for i, t in rows)]
    link = {i: {i} for i, _ in sets}
    for i, x in sets:
        for j, y in sets:
            if link[i] is not link[j] and 100 * len(x & y) >= num * len(x | y):
                both = link[i] | link[j]
                for k in both:
                    link[k] = both
    return {i: min(g) for i, g in link.items()}


def test_other_shingles_and_thresholds(table):
    base = words(31, 50).split()
    rows = [(i, edited(words(2000 + i // 4, [8, 24, 50, 120][i // 4 % 4]), i % 4, i)) for i in range(64)]
    rows += [(100, " ".join(base)), (101, " ".join([*base[:20], "zzz", *base[21:]])), (102, " ".join([*base, *words(32, 11).split()]))]
    d = table([(i, t, "en", "s") for i, t in rows])
    got = {}
    for length, num in ((4, 85), (5, 80)):
        got[num] = {r.doc_id: r.component_id for r in jaccard.groups(d, words=length, num=num).collect()}
        assert got[num] == brute_at(rows, length, num)
    assert got[85][101] == 101 and got[80][101] == got[80][102] == 100
    assert {r.doc_id for r in jaccard.one_of_each(d, words=5, num=80).collect()} == set(got[80].values())


def test_rows_without_ids_and_with_shared_ids(table):
    a, b, c, e = (words(600 + k, 40) for k in range(4))
    rows = [(3, a), (7, b), (7, a), (8, c), (8, e), (None, words(700, 40)), (None, words(701, 40)), (None, a), (None, words(702, 40)), (None, words(702, 40)), (9, ""), (9, ""), (None, " "), (None, " ")]
    want = [(3, a), (7, b), (8, c), (8, e), (None, words(700, 40)), (None, words(701, 40)), (None, words(702, 40)), (9, ""), (None, " "), (None, " ")]
    got = jaccard.one_of_each(table([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("size", [4, 5, 6, 9, 13, 30, 100, 400])
def test_similar_sets_share_a_signature_at_four_fifths(size):
    r = np.random.default_rng(size)
    signer = jaccard.Signer(80, 100)
    for _ in range(60):
        s = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, size, dtype=np.uint64))
        for drop in range(1, size):
            t = np.unique(np.concatenate([s[drop // 2 :] if drop else s, r.integers(0, 2**63, drop - drop // 2, dtype=np.uint64)]))
            same = len(np.intersect1d(s, t))
            if 100 * same < 80 * (len(s) + len(t) - same):
                break
            assert set(signer.signatures(s).tolist()) & set(signer.signatures(t).tolist())


def test_rows_behind_in_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 5)
    count = np.array([0, 3, 9, 0, 1, 1, 0, 0, 2, 1, 0, 0])
    parts = [np.stack(p, 1).tolist() for p in jaccard._behind(count)]
    assert sum(parts, []) == [[a, a + k] for a, c in enumerate(count) for k in range(1, c + 1)]
    assert max(map(len, parts)) == 9 and list(jaccard._behind(count[:0])) == []


@pytest.mark.parametrize(("blocks", "batch"), [(1, 10000), (1, 7), (3, 10000), (3, 7)])
def test_many_small_buckets_are_taken_together(spark, monkeypatch, blocks, batch):
    """The pairs across components that sizes and bins allow, no bound of which is worked out bucket by bucket."""
    r = np.random.default_rng(blocks)
    base = [r.integers(0, 2**63, 40 + 8 * k, dtype=np.uint64) for k in range(12)]
    sets = {k: np.unique(np.concatenate([base[k % 12][k % 13 :], r.integers(0, 2**63, k % 17, dtype=np.uint64)])) for k in range(240)}
    bins = {k: np.bincount(s.astype(np.uint8), minlength=256) for k, s in sets.items()}
    members = {b: r.choice([k for k in sets if k % 12 in (b % 12, (b + 1) % 12)], r.integers(1, 14), replace=False).tolist() for b in range(500)}
    members |= {1000: list(sets)}
    rows = [(b, k, k // 60, len(sets[k]), bytearray(jaccard._histogram(sets[k])), blocks) for b, m in members.items() for k in m]
    want, calls, close = set(), spark.sparkContext.accumulator(0), jaccard._close
    for m in members.values():
        for a, b in combinations(sorted(m), 2):
            if a // 60 != b // 60 and 185 * abs(bins[a] - bins[b]).sum() <= 15 * (len(sets[a]) + len(sets[b])):
                want.add((a, b))

    def counted(*args):
        calls.add(1)
        return close(*args)

    monkeypatch.setattr(jaccard, "_close", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        dirty = spark.createDataFrame(rows, "bucket bigint, node bigint, comp bigint, n bigint, hist binary, blocks int")
        got = [(x.a, x.b) for x in jaccard._across(dirty, 85, 100).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and len(want) > 100
    assert batch == 7 or 0 < calls.value < len(members)


def test_few_rows_go_to_python_at_once(spark, monkeypatch):
    """Texts and packed signatures: batches of thousands took hundreds of MB in the JVM and in each worker."""
    sign, buckets, most = jaccard._sign, jaccard._buckets, 512

    def held(run):
        def checked(batches):
            def each():
                for b in batches:
                    assert b.num_rows <= most, f"{b.num_rows} rows at once"
                    yield b

            return run(each())

        return checked

    monkeypatch.setattr(jaccard, "_sign", lambda *a: held(sign(*a)))
    monkeypatch.setattr(jaccard, "_buckets", held(buckets))
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t u v w x{i // 2}") for i in range(3000)]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, 21, 0) for i in range(3000)]  # 20 of 22 shingles are common to any two


def test_signatures_travel_as_five_bytes():
    sig = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    assert len(jaccard._short(sig)) == 2500 and (jaccard._long(jaccard._short(sig)) == sig >> np.uint64(24) << np.uint64(24)).all()


def test_fine_bins_never_exceed_the_difference():
    r = np.random.default_rng(2)
    for n in (1, 5, 255, 257, 1000, 1025, 5000):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        for out, more in ((0, 0), (n // 10, n // 8), (n // 2, n)):
            b = np.unique(np.concatenate([a[out:], r.integers(0, 2**64, more, dtype=np.uint64)]))
            got, want = jaccard._apart(*(np.frombuffer(jaccard._fine(s), np.uint8) for s in (a, b))), len(np.setxor1d(a, b))
            assert got <= want and (want == 0 or got > 0)
    x = np.arange(1, 2000, dtype=np.uint64) << np.uint64(32)  # all in one bin, held at 255
    assert jaccard._apart(*(np.frombuffer(jaccard._fine(s), np.uint8) for s in (x, x[:300]))) <= len(x) - 300


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(path).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == got[1000] == 1000 and len(got) == 203


ITEMS = "item_id bigint, text string, extra string"


def test_passages_are_found_through_substitutions(spark, table, docs, no_docs):
    items = [(k, words(9000 + k, 15 + 4 * k), "e") for k in range(8)] + [(50, words(77, 8), "e"), (51, None, "e"), (52, "", "e"), (53, "too short", "e")]
    bench = spark.createDataFrame(items, ITEMS)
    rows, want = [], set()
    for k, t, _ in items[:9]:
        rows.append((k, words(k, 80) + " " + t.upper().replace(" ", "\n", 3) + ". " + words(50 + k, 80), "en", "s"))
        want.add((k, k))
    changed = items[5][1].split()
    changed[4], changed[20] = "other", "different"
    rows.append((200, words(200, 50) + " " + " ".join(changed), "en", "s"))
    want.add((200, 5))
    rows += [(300 + k, words(300 + k, 200), "en", "s") for k in range(20)] + [(400, None, "en", "s"), (401, "", "en", "s"), (None, items[6][1], "en", "s")]
    want.add((None, 6))
    d = table(rows)
    got = decontam.overlaps(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    one = next(r for r in got if r.doc_id == 200)
    assert one.run_words == one.item_words and one.equal_words == one.item_words - 2
    left = decontam.clean(d, bench)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in rows if (r[0], None) not in want and r[0] not in {w for w, _ in want})
    assert decontam.overlaps(no_docs, bench).count() == 0 and decontam.overlaps(docs, bench.where("1 = 0")).count() == 0


def test_short_items_count_where_they_are_the_whole_text(spark, table):
    bench = spark.createDataFrame([(1, "What is the capital of?", "e"), (2, "yes", "e"), (3, "...", "e"), (4, "one two three four five", "e"), (5, "yes", "e"), (6, "What is the capital of France today", "e")], ITEMS)
    texts = ["what is the capital of", "what is the capital", "What is: the capital OF", "so what is the capital of", "yes", "Yes!", "yes yes", "...", "one two three four", "one two three four six", "one two three four five", None, "what is the capital of france"]
    d = table([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "yes", "en", "s")])
    got = decontam.overlaps(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (2, 1), (4, 2), (4, 5), (5, 2), (5, 5), (10, 4), (None, 2), (None, 5)}
    assert all((r.doc_word, r.run_words, r.equal_words) == (0, r.item_words, r.item_words) for r in got)
    assert sorted(r.doc_id for r in decontam.clean(d, bench).collect()) == [1, 3, 6, 7, 8, 9, 11, 12]


@pytest.mark.parametrize("size", range(12, 24))
def test_masks_cover_every_accepted_window(size):
    places = np.array(list(combinations(range(size), size // 4)), np.int64)
    same = (1 << size) - 1 - (np.int64(1) << places).sum(1)
    hit = np.zeros(len(same), bool)
    for mask in decontam.MASKS:
        bits = sum(1 << p for p in mask)
        for at in range(size - mask[-1]):
            hit |= (same >> at) & bits == bits
    assert hit.all()


@pytest.mark.parametrize("size", range(6, 12))
def test_masks_of_short_items_cover_what_is_accepted(size):
    masks = decontam.masks_for(size)
    for places in combinations(range(size), size // 4):
        assert any(not set(mask) & set(places) for _, _, mask in masks)


def best_overlap(doc, item):
    """What the rule finds of item in doc (lists of words), by trying every stretch of every diagonal: words, equal ones, place."""
    n, best = len(item), None
    for d in range(-n + 1, len(doc)):
        same = [0 <= d + k < len(doc) and doc[d + k] == item[k] for k in range(n)]
        found = [(n, sum(same), -d)] if n >= 6 and 0 <= d <= len(doc) - n and 4 * sum(same) >= 3 * n else []
        ends = [k for k in range(n) if same[k]] if not found else []
        found += [(e - s + 1, sum(same[s : e + 1]), -d - s) for s in ends for e in ends if e - s >= 11 and 4 * sum(same[s : e + 1]) >= 3 * (e - s + 1)]
        best = max([x for x in (best, *found) if x], default=None)
    return best and (best[0], best[1], -best[2])


def changed(item, places):
    return [f"q{k}" if k in places else x for k, x in enumerate(item)]


def test_the_row_that_stays_of_repeated_ones_is_the_same_in_every_run(spark, table):
    rows = [(i % 5 if i % 7 else None, words(i % 5, 30) if i % 3 else "", f"l{i}", f"s{i}") for i in range(90)]
    d = table(rows)
    first = sorted(map(str, jaccard.one_of_each(d).collect()))
    assert sorted(map(str, jaccard.one_of_each(d.repartition(7, "lang")).collect())) == first
    assert sorted(map(str, jaccard.one_of_each(d.orderBy("source").coalesce(1)).collect())) == first
    wordless = [r[0] for r in rows if not r[1]]
    assert len(first) == len({i for i in wordless if i is not None}) + wordless.count(None) + len({r[1] for r in rows if r[1]})


def test_all_substitutions_that_the_rule_accepts_are_found(spark, table):
    item = words(4711, 15).split()
    docs = {k: ["before", *changed(item, p), "behind"] for k, p in enumerate(p for n in range(5) for p in combinations(range(15), n))}
    bench = spark.createDataFrame([(1, " ".join(item), "e")], ITEMS)
    got = {r.doc_id: (r.run_words, r.equal_words, r.doc_word) for r in decontam.overlaps(table([(k, " ".join(w), "en", "s") for k, w in docs.items()]), bench).collect()}
    want = {k: x for k, w in docs.items() if (x := best_overlap(w, item))}
    assert got == want and len(want) > 1 + 15 + 105 + 455 - 20


def test_substitutions_in_items_of_all_lengths(spark, table):
    """All is found that trying every stretch finds: 1 to 3 substitutions anywhere, in items of 6 to 60 words."""
    r = random.Random(5)
    items = [words(8000 + k, n).split() for k, n in enumerate(range(6, 61))]
    docs = [words(100 + k, 20).split() + changed(item, r.sample(range(len(item)), min(len(item) // 4, subs))) + words(300 + k, 20).split() for k, item in enumerate(items) for subs in (1, 2, 3)]
    bench = spark.createDataFrame([(k, " ".join(x), "e") for k, x in enumerate(items)], ITEMS)
    got = {(x.doc_id, x.item_id): (x.run_words, x.equal_words, x.doc_word) for x in decontam.overlaps(table([(k, " ".join(w), "en", "s") for k, w in enumerate(docs)]), bench).collect()}
    for k, doc in enumerate(docs):
        assert got.pop((k, k // 3)) == best_overlap(doc, items[k // 3]) is not None
    assert all(best_overlap(docs[k], items[i]) == x for (k, i), x in got.items())


def test_null_and_repeated_items_and_repeated_words(spark, table):
    import time

    a, b = words(61, 20), words(62, 20)
    bench = spark.createDataFrame([(None, a, "e"), (1, b, "e"), (1, b, "e"), (None, None, None), (2, "na " * 1000, "e"), (3, "na ba " * 500, "e")], ITEMS)
    rows = [(1, a, "en", "s"), (None, f"x {b} y", "en", "s"), (2, f"{a} z", "en", "s"), (2, f"{b} z", "en", "s"), (3, "na " * 5000, "en", "s"), (1, a, "en", "s"), (4, "na na na na na na", "en", "s")]
    began = time.time()
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.overlaps(table(rows), bench).collect())
    assert got == [("1", "None"), ("2", "1"), ("2", "None"), ("3", "2"), ("None", "1")]
    assert time.time() - began < 30
    assert sorted(str(r.doc_id) for r in decontam.clean(table(rows), bench).collect()) == ["4"]


def test_hits_of_many_documents_are_not_broadcast(spark, table):
    """Hits that documents share take next to nothing as Parquet: 400 documents of 100 items each have megabytes of them, their keys a few kilobytes."""
    items = [words(700 + k, 12) for k in range(100)]
    bench = spark.createDataFrame([(k, t, "e") for k, t in enumerate(items)], ITEMS)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")  # the least that Spark takes for any table is about 1 MB
    try:
        got = decontam.overlaps(table([(k, " ".join(items), "en", "s") for k in range(400)]), bench)
        found = {(r.doc_id, r.item_id): (r.doc_word, r.run_words, r.equal_words) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert found == {(d, k): (12 * k, 12, 12) for d in range(400) for k in range(100)}


def test_longest_stretch():
    same = np.array([0] * 5 + [1] * 6 + [0] + [1] * 6 + [0] * 20 + [1] * 3, bool)
    assert decontam.stretch(same, 12) == (13, 12, 5)
    assert decontam.stretch(np.zeros(30, bool), 12) == (0, 0, 0)


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rows = [(r[0], r[1], "en", "a" if k % 3 else "b", 1) for k, r in enumerate(corpus()) if r[0] is not None]
    passage = words(4242, 30)
    rows += [(2000 + k, words(6000 + k, 70) + " " + passage, "en", "a", 1) for k in range(5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    cleaned = {r.doc_id for r in docs.collect()}
    planned = mixing.plan(docs).groupBy("doc_id").agg(F.sum("copies").alias("c")).where("c > 0").collect()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [r for r in rows if len((r[1] or "").split()) >= 50]
    comp = brute_at([(r[0], r[1]) for r in good], 5, 80)
    want = {r[0] for r in good if comp[r[0]] == r[0] and r[0] < 2000}
    got = {r.doc_id for r in out}
    assert cleaned == want and got == {r.doc_id for r in planned}
    assert Counter(r.doc_id for r in out) == Counter({r.doc_id: r.c for r in planned})
    n = [sum(r.shard == s for r in out) for s in range(24)]
    assert max(n) - min(n) <= 1


@pytest.mark.parametrize("full", [True, False])
def test_pipeline_takes_awkward_tables(spark, tmp_path, docs, no_docs, full):
    """Null and repeated ids, columns of any name; no documents, benchmark or labels at all."""
    import corpus_pipeline

    # columns named like those that the last stage adds are replaced by it
    d = (docs if full else no_docs).withColumn("text", F.regexp_replace("text", " x ", " y "))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(d.columns)
    got = out.collect()
    rows = [r for r in d.collect() if len((r.text or "").split()) >= 50]
    # documents repeat 37 texts, cut to different lengths; each set of near copies leaves one
    link = brute_at(list(enumerate(r.text for r in rows)), 5, 80) if rows else {}
    one = {min((rows[k].doc_id is None, rows[k].doc_id or 0, k) for k in link if link[k] == root)[2] for root in set(link.values())}
    assert {r.text for r in got} <= {rows[k].text for k in one}
    assert bool(got) == full
