"""op11 and op12 against the tokenizer libraries and plain-Python recounts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veinwork.llm import alignment, bpe

ODD = ["a" * 5000, "ab" * 3000, " " * 700, "\n" * 90 + "x", "it's we'll I'D 'tis", "  lead", "trail  ", "<|endoftext|> </s> <unk>", "tab\tand\x00nul", "mark ▁ here", "漢字かな \U0001f600 é ü ß", "ՠ ֋ ᲊ \U0001e4d0", "x" * 200 + " " + "y"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.vocabulary(bpe.default_path()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


@pytest.fixture(scope="module")
def points():
    return [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]


def mixed(r, points, n):
    return "".join(r.choice(points) if r.random() < 0.2 else r.choice(" '\t\n  aabcds1!é.　x'llreAB_-") for _ in range(n))


def test_encoding_is_the_librarys(library, points):
    v, r = bpe.vocabulary(bpe.default_path()), random.Random(5)
    for text in ODD + [mixed(r, points, r.randint(1, 80)) for _ in range(1500)]:
        ids = v.encode(text)
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text), text
        assert v.decode(ids) == text.encode()


def test_stale_entries_and_lower_ranks_after_a_merge():
    """Ranks of no training: 'bc' joins after 'abc' has a lower rank than it, and pairs overlap."""
    r = random.Random(3)
    for _ in range(300):
        ranks = {bytes([i]): i for i in range(256)}
        some = ["".join(r.choice("abc") for _ in range(r.randint(2, 5))).encode() for _ in range(25)]
        for s in dict.fromkeys(some):
            ranks[s] = len(ranks)
        v = bpe.Vocabulary(ranks)
        for _ in range(5):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 40))).encode()
            parts = [bytes([x]) for x in word]
            while word not in ranks:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert v.merged(word) == ([ranks[word]] if word in ranks else [ranks[p] for p in parts])
            assert not v.buckets and not any(v.low)


def test_long_texts_are_cut_where_a_token_begins(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    v, r = bpe.vocabulary(bpe.default_path()), random.Random(8)
    for _ in range(200):
        text = "".join(r.choice(["word", " ", "  ", "\n", "!", "é", " x", "12", "'s"]) for _ in range(200))
        assert "".join(bpe.stretches(text)) == text
        assert list(memoryview(v.encode(text)).cast("I")) == library.encode_ordinary(text)


def test_memo_that_is_emptied_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    v = bpe.Vocabulary(bpe.vocabulary(bpe.default_path()).ranks)
    text = "seven sailors sang seven slow songs " * 20
    assert list(memoryview(v.encode(text)).cast("I")) == library.encode_ordinary(text)


def test_ids_and_vocabularies_that_are_wrong():
    v = bpe.vocabulary(bpe.default_path())
    with pytest.raises(ValueError):
        v.decode(b"abc")
    with pytest.raises(KeyError):
        v.decode(b"\xff\xff\xff\x7f")
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_op12_rows(spark, docs, no_docs, library):
    rows = bpe.decode(bpe.encode(docs)).select("doc_id", "n_tokens", F.hex("ids").alias("ids"), "decoded").collect()
    texts = Counter((x.doc_id, x.text or "") for x in docs.collect())
    assert Counter((x.doc_id, bytes(x.decoded).decode()) for x in rows) == texts
    for x in rows:
        ids = library.encode_ordinary(bytes(x.decoded).decode())
        assert x.n_tokens == len(ids) and x.ids.lower() == b"".join(i.to_bytes(4, "little") for i in ids).hex()
    assert bpe.decode(bpe.encode(no_docs)).count() == 0
    assert bpe.encode(docs, keep=("n", "doc_id")).columns == ["n", "doc_id", "n_tokens", "ids"]
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary")).first().decoded is None


def test_op12_query(spark, library):
    want = {}
    for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode_ordinary(x.text or "")
        want[x.doc_id] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((x.text or "").encode()).hexdigest())
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.op12_rank_queue(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


@pytest.fixture(scope="module")
def sides():
    raw = []
    for path in alignment.default_paths():
        with open(path, "rb") as f:
            raw.append(f.read())
    return alignment._sides(*raw)


def libraries(text):
    """Token ids of A and B with their bytes, by whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    global _loaded
    try:
        t, s, table = _loaded
    except NameError:
        pa, pb = alignment.default_paths()
        t, s = Tokenizer.from_file(pa), sentencepiece.SentencePieceProcessor(model_file=pb)
        t.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        _loaded = t, s, table
    a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    bytes_a = [bytes(table[c] for c in t.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, bytes_a, bytes_b


def brute(texts):
    """By document: the query's columns, by comparing all byte ranges."""
    held, rows, digests = Counter(), [], []
    for text in texts:
        a, b, bytes_a, bytes_b = libraries(text) if text else ([], [], [], [])
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append((0, 0, 0, Counter()))
            digests.append("")
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            ends.append(own)
        links, j0 = Counter(), 0
        for i, (lo, hi) in zip(a, ends[0]):
            while ends[1][j0][1] <= lo:
                j0 += 1
            j = j0
            while j < len(b) and ends[1][j][0] < hi:
                links[i, b[j]] += 1
                j += 1
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        text_of, i, j = [], 0, 0
        for c in cuts:
            k = next(x for x in range(i, len(a)) if ends[0][x][1] == c) + 1
            m = next(x for x in range(j, len(b)) if ends[1][x][1] == c) + 1
            text_of.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        held.update(set(links))
        rows.append((len(a), len(b), len(cuts), links))
        digests.append(hashlib.sha256(";".join(text_of).encode()).hexdigest())
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (n_a, n_b, n_g, sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), d)
        for (n_a, n_b, n_g, links), d in zip(rows, digests)
    ]


def result(rows):
    return [(x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups) for x in rows]


def tokens_of(side, windows, numbers, which):
    import re

    return [int(x) for n in numbers for g in windows.text[n].split(";") for x in re.split(",", g.split("|")[which])]


def test_tokens_of_segments_are_those_of_whole_texts(sides, points):
    a, b, w = sides
    assert a.apart and b.apart
    r = random.Random(4)
    texts = ODD + [mixed(r, points, r.randint(1, 60)) for _ in range(2500)] + ["▁" + mixed(r, points[:400], 9) for _ in range(60)]
    texts += ["".join(r.choice([" ", "  ", "\n", "\t ", " a", "b", "'s", ",", "\u3000", "\x1c", "\x85", "é"]) for _ in range(r.randint(1, 25))) for _ in range(2500)]
    for text, own in zip(texts, w.documents(texts)):
        assert "".join(alignment.segments(" " + text)) == " " + text
        ids_a, ids_b, bytes_a, bytes_b = libraries(text)
        same = b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
        assert (own is not None) == same
        if same:
            assert tokens_of(a, w, own, 0) == ids_a and tokens_of(b, w, own, 1) == ids_b, text


@pytest.mark.parametrize("frequent", [1 << 20, 150, 0])
def test_op11_against_brute_force(spark, docs, table, frequent, tmp_path):
    rows = [(500 + i, t, "en", "s") for i, t in enumerate(ODD)]
    all_docs = docs.unionByName(table(rows))
    chunks = alignment.staged(alignment.aligned(all_docs), "t-chunks")
    counts = alignment.staged(alignment.pair_counts(chunks), "t-counts")
    got = alignment.scored(chunks, counts, frequent).collect()
    assert len({x.row for x in got}) == len(got)
    texts = [(x.doc_id, x.text) for x in all_docs.collect()]
    want = brute([t for _, t in texts])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert Counter((x.doc_id, *r[:6], digest(r[6])) for x, r in zip(got, result(got))) == Counter((i, *w) for (i, _), w in zip(texts, want))


def test_op11_models_that_are_not_apart(docs, sides, monkeypatch):
    a, b, w = sides
    texts = [x.text for x in docs.collect()][:40] + ODD
    want = brute(texts)
    for apart in (True, False):
        monkeypatch.setattr(b, "apart", apart)
        w.forget()
        for own, row in zip(w.documents(texts), want):
            assert (own is not None) == (row[0] > 0)
            if own is not None:
                assert hashlib.sha256(";".join(w.text[n] for n in own).encode()).hexdigest() == row[6]
                assert sum(len(w.links[n]) // 8 for n in own) == row[3]
    w.forget()


def test_windows_are_cut_at_spaces_that_both_have(sides):
    a, b, w = sides
    own = w.documents(["some words, and  two spaces"])[0]
    said = ["".join(a.bytes_of[int(x)].decode() for g in w.text[n].split(";") for x in g.split("|")[0].split(",")) for n in own]
    assert said == [" some", " words,", " and", "  two", " spaces"] or "".join(said) == " some words, and  two spaces" and len(said) >= 4
    again = w.documents(["two words, some spaces"])[0]
    assert set(again) & set(own)


def test_op11_empty(spark, no_docs, table):
    for some in (no_docs, table([(1, None, None, None), (None, "", "en", "s")])):
        chunks = alignment.staged(alignment.aligned(some), "t-none")
        got = alignment.scored(chunks, alignment.staged(alignment.pair_counts(chunks), "t-nc")).collect()
        assert len(got) == some.count() and all(r == (0, 0, 0, 0, 0, 0, "") for r in result(got))


def test_op11_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = dict(zip((x.doc_id for x in docs), brute([x.text for x in docs])))
    got = {x.doc_id: (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in alignment.op11_space_anchors(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_ranks_of_the_vocabulary_are_its_merges(sides):
    """Every token's text, and joined ones, by the rank library as by the tokenizer library."""
    a = sides[0]
    assert hasattr(a, "encoding")
    r = random.Random(9)
    shown = [b.decode() for b in a.bytes_of[:50000] if not any(x >= 128 for x in b)]
    texts = [" " + t for t in shown[::7]] + [" " + "".join(r.choice(shown) for _ in range(4)) for _ in range(4000)]
    want = libraries("x") and [e.ids for e in _loaded[0].encode_batch(texts, add_special_tokens=False)]
    assert a.ids(texts) == want



def test_op11_memo_keeps_what_came_again(sides, monkeypatch):
    a, b, w = sides
    monkeypatch.setattr(alignment, "SEGMENTS", 60)
    w.forget()
    often, texts = "these words come in every chunk, and  these", []
    for i in range(8):
        texts = [often, " ".join(f"x{i}y{k}" for k in range(25)), None, "", "▁x " + often]
        known = len(w.known)
        own = w.documents(texts)
        for text, n in zip(texts, own):
            ids_a, ids_b, *said = libraries(text) if text else ([], [], [], [])
            assert (n is not None) == bool(text and b"".join(said[0]) == b"".join(said[1]) == (" " + text).encode())
            assert n is None or (tokens_of(a, w, n, 0), tokens_of(b, w, n, 1)) == (ids_a, ids_b)
        assert i == 0 or len(w.known) - known <= 25 or known == 0  # only what is new was looked up
        w.trim()
        assert len(w.known) < 60 and (i < 2 or " words" in w.known)
        assert len(w.text) == len(w.links) == len(w.number) == len(w.size_a) == len(w.size_b) == len(w.groups)
    w.forget()


def test_op11_passes_few_documents_at_once(spark, monkeypatch):
    seen, stage = {}, alignment.staged
    monkeypatch.setattr(alignment, "staged", lambda df, tag, **options: seen.update({tag: spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}) or stage(df, tag, **options))
    assert alignment.op11_space_anchors(spark, "/root/testdata/sf0.001").count() == 200
    assert seen["alignment-chunks"] == str(alignment.BATCH_ROWS) and seen["alignment-scores"] == "1"


def test_chunks_are_written_in_small_row_groups(spark, tmp_path):
    """Ten rows of 4 MB: a row group each has about as many bytes as WIDE says, not all of them."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    wide = spark.range(0, 10, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 65536), i -> sha2(concat(id, '/', i), 256)), '') as binary)").alias("links"))
    path = alignment.staged(wide, "t-wide", **alignment.WIDE).inputFiles()[0].removeprefix("file://")
    of = pq.ParquetFile(path).metadata
    assert of.num_rows == 10 and max(of.row_group(i).num_rows for i in range(of.num_row_groups)) <= 3
