"""Secrets, pseudonyms, toxicity, token rollups, archives: against brute force and round trips."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinwork.llm import pii, rollups, secrets, toxicity, warc

KEY = "key-for-tests"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HEX = "0123456789abcdef" * 2


def base_spans(t):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))


def test_secrets_match_brute_force(table):
    texts = [
        f'x token = "{HEX}" y', "é\U0001f600 Password: hunter22 secret=abc token:ab", "AKIA" + "B" * 20 + " AKIA12 AKIAAKIA" + "C" * 16, "secret = token: abcdefgh", None, "",
        f"api_key='{HEX}{HEX}'{HEX}", "PASSWD=\"a.b/c+d\"" * 300, "apikey:=x secret = = zzzzzz", f"{HEX} " * 50,
    ]
    d = table([(i, t, "en", "s") for i, t in enumerate(texts)])
    for r in secrets.scan(d).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert r.n_assign == want.count("assign") and r.n_access == want.count("access") and r.n_hex == want.count("hex")


def test_texts_of_very_many_matches(table):
    text = "é token=abcdef0 " * 4000 + f"user=ab {HEX} " * 3000
    r = secrets.scan(table([(1, text, "en", "s")])).first()
    assert r.base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest() and r.n_assign == 4000 and r.n_hex == 3000


IDENT, BLOB, ENDPOINT = re.compile(secrets.IDENT, re.A), re.compile(secrets.BLOB), re.compile(secrets.ENDPOINT)


def all_spans(t, scope=secrets.SCOPE):
    """Base spans, and weak ones whose complement is near, by trying all pairs."""
    base = [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base_spans(t).split(",") if x)]
    weak = [(m.start(), 3, m.end()) for m in IDENT.finditer(t) if len(m[1]) >= 3]
    weak += [(m.start(), 4, m.end()) for m in BLOB.finditer(t) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(t)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    role = lambda x: secrets.ROLE[secrets.KINDS[x[1]]]
    near = lambda w, r: any(p is not w and role(p) == r and (w[0] - p[2] <= scope if p[:2] < w[:2] else p[0] - w[2] <= scope) for p in base + weak)
    needs = {3: ["secret"], 4: ["identifier"], 5: ["identifier", "secret"]}
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + [w for w in weak if all(near(w, r) for r in needs[w[1]])]))


def test_linked_spans_match_brute_force(table):
    import random

    r = random.Random(11)
    pieces = ["user: alice", "login=bob", "Zx9Kq2LmNvB4Ty7PwRsD1fGhJkCa8UeQ", "https://db.example.org/x", "password: hunter22", "AKIA" + "B" * 16, HEX, "client_id=abc-1", "é" * 50, "plain words " * 9, "word " * 25]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(200)]
    got = {x.doc_id: x.spans for x in secrets.scan(table([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: all_spans(t) for i, t in enumerate(texts)}


def test_weak_parts_need_their_complement(table):
    blob, far = "Zx9Kq2LmNvB4Ty7PwRsD1fGhJkCa8UeQ", "word " * 100
    d = table(
        [
            (1, "user: alice no more", "en", "s"), (2, "user: alice password: hunter22", "en", "s"), (3, f"user: alice {far} password: hunter22", "en", "s"),
            (4, f"{blob} alone", "en", "s"), (5, f"login=bob {blob} at https://db.example.org/x", "en", "s"), (6, "https://a.example.org password: hunter22", "en", "s"), (2, "user: alice password: hunter22", "en", "s"),
        ]
    )
    kinds = {r.doc_id: sorted(x.split(":")[0] for x in r.spans.split(",") if x) for r in secrets.scan(d).collect()}
    assert kinds == {1: [], 2: ["assign", "ident"], 3: ["assign"], 4: [], 5: ["blob", "endpoint", "ident"], 6: ["assign"]}
    assert secrets.scan(d).where("doc_id = 2").count() == 2


def test_secrets_take_awkward_tables(docs, no_docs):
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(no_docs).count() == 0


VALUES = {
    "card": ["4111 1111 1111 1111", "5500005555555559"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], "ssn": ["078-05-1120"], "date": ["2024-02-29", "31/12/1999", "12/31/1999", "31.12.1999"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234567"], "ip": ["10.0.0.1", "192.168.7.33"], "email": ["john.doe+x@mail.example.org"],
}


def test_pseudonyms_keep_formats_and_links(table, no_docs, docs):
    rows = [(i, f"a {v} b {v}, é", "en", "s") for i, v in enumerate(v for vs in VALUES.values() for v in vs)]
    bad = ["4111111111111112", "999.1.1.1", "2024-02-30", "DE00370400440532013000", "000-12-3456", "plain text 12", None, ""]
    rows += [(100 + i, t, "en", "s") for i, t in enumerate(bad)]
    d = table(rows)
    out = {r.doc_id: r for r in pii.pseudonymize(d, KEY.encode()).collect()}
    for i, (kind, v) in enumerate((k, v) for k, vs in VALUES.items() for v in vs):
        t = out[i].text
        m = re.fullmatch(r"a (.*) b (.*), é", t)
        assert m[1] == m[2] != v and out[i][f"n_{kind}"] == 2, (kind, v, t)
        assert re.sub("[0-9]", "9", m[1]) == re.sub("[0-9]", "9", v) or kind in ("iban", "email", "ip")
        assert kind != "card" or pii.luhn(re.sub(r"\D", "", m[1])) == 0
    assert [out[100 + i].text for i in range(len(bad))] == bad
    back = {r.doc_id: r.text for r in pii.pseudonymize(pii.pseudonymize(d, KEY.encode()), KEY.encode(), restore=True).collect()}
    assert back == {i: t for i, t, _, _ in rows}
    other = pii.pseudonymize(d, b"another key").where("doc_id = 0").first().text
    assert other != out[0].text
    assert pii.pseudonymize(no_docs, b"k").count() == 0 and pii.pseudonymize(docs, b"k").count() == docs.count()


def test_values_beside_other_digits_and_capitals():
    names = pii.Pseudonyms(KEY.encode())
    alone = lambda v: names.text(v)[0]
    card, iban, phone = "4111 1111 1111 1111", "DE89370400440532013000", "+49 30 1234567"
    spaced = "DE89 3704 0044 0532 0130 00"
    cases = {
        f"{card} 123": card, "12 5500005555555559": "5500005555555559", f"12 34 {card} 7": card, f"{iban} EUR": iban, f"{spaced} EUR": spaced, f"AB12 CDEF {iban} X": iban,
        "555-123-4567 4112": "555-123-4567",
    }
    for text, v in cases.items():
        assert v in text and alone(v) != v
        assert names.text(text)[0] == text.replace(v, alone(v)), text
    out, n = names.text(f"{phone} 12 34 56 78 90")
    assert n["phone"] == 1 and phone not in out and out.startswith("+49 ")
    digits = lambda t: re.sub("[^0-9]", "", t)
    assert digits(alone(phone)) == digits(alone("+49301234567")) and alone(phone).startswith("+49 ")
    assert digits(alone("+1 212 555 0100")) == digits(alone("+12125550100"))
    assert names.text("+353 1 234 5678")[0].startswith("+353 ")
    two = f"{card} 123 {iban} EUR 12 5500005555555559"
    assert not any(v in names.text(two)[0] for v in (card, iban, "5500005555555559"))


def test_one_value_in_several_layouts_keeps_its_link():
    names = pii.Pseudonyms(KEY.encode())
    day = lambda t, order: tuple(int(re.split("[-/.]", names.text(t)[0])[order.index(k)]) for k in "ymd")
    assert day("2024-03-25", "ymd") == day("25.03.2024", "dmy") == day("25/03/2024", "dmy") == day("03/25/2024", "mdy") == day("2024/03/25", "ymd") != (2024, 3, 25)
    assert day("2024-03-05", "ymd") == day("05.03.2024", "dmy") == day("05/03/2024", "dmy")
    assert names.text("John.Doe@x.org")[0].lower() == names.text("john.doe@x.org")[0] and names.text("John.Doe@x.org")[0][0].isupper()
    long = "".join(chr(97 + i % 26) for i in range(900))
    one, two = (names.text(f"{a}{long}@x.org")[0].split("@")[0] for a in "ab")
    assert sum(x == y for x, y in zip(one, two, strict=True)) < 120 and pii.Pseudonyms(KEY.encode(), True).text(one + "@x.org")[0] == "a" + long + "@x.org"


@pytest.mark.parametrize("length", [128, 129, 3040, 100_000])
def test_long_values_are_permuted_in_blocks(table, length):
    names, back = pii.Pseudonyms(KEY.encode()), pii.Pseudonyms(KEY.encode(), True)
    local = "".join("abcxyz0189AB"[i * i % 12] for i in range(length))
    new = [names.text(f"x {v}@x.org y")[0] for v in (local, local[:-1] + "q", "q" + local[1:])]
    assert [back.text(t)[0] for t in new] == [f"x {v}@x.org y" for v in (local, local[:-1] + "q", "q" + local[1:])]
    for other in new[1:]:
        assert len(other) == len(new[0]) and sum(x == y for x, y in zip(new[0][2:-8], other[2:-8], strict=True)) < 0.2 * length + 40
    out = pii.pseudonymize(table([(1, f"{local}@x.org", "en", "s")]), KEY.encode()).first()
    assert out.n_email == 1 and out.text == new[0][2:-2]


@pytest.mark.parametrize("size", [1, 2, 10, 1000, 73049])
def test_permutation_is_one(size):
    p, q = pii.Permutation(b"k"), pii.Permutation(b"k", inverse=True)
    xs = range(min(size, 500))
    ys = [p("x", x, size) for x in xs]
    assert len(set(ys)) == len(ys) and all(0 <= y < size for y in ys) and [q("x", y, size) for y in ys] == list(xs)


def test_toxicity_finds_hidden_words(table, no_docs, spark):
    clean = ["the lamp stood near the door and the rain kept falling", "we walked along the river to the old mill", "bread and butter with some tea in the morning"]
    rude = ["you are an idiot and a moron my friend", "what a stupid clown that idiot is", "stupid moron go away you clown"]
    rows = [(i, (rude if i % 4 == 0 else clean)[i % 3] + f" w{i % 11}", "en", "s") for i in range(600)]
    rows += [(1000, "what an 1d10t", "en", "s"), (1001, "such a m o r o n", "en", "s"), (1002, "you stuuupid thing", "en", "s"), (1003, "the river and the mill", "en", "s"), (1004, None, "en", "s"), (1005, "", "en", "s"), (None, "idiot", "en", "s"), (1006, "cl0wn", "en", "s"), (1003, "the river and the mill", "en", "s")]
    d = table(rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    out = toxicity.score(d, labels).collect()
    got = {r.doc_id: r.predicted for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(got[i] == int(i % 4 == 0) for i in range(600))
    assert [got[i] for i in (1000, 1001, 1002, 1006, 1003, 1004, 1005, None)] == [1, 1, 1, 1, 0, 0, 0, 1]
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert toxicity.score(no_docs, labels).count() == 0
    nothing = toxicity.score(d, labels.where("1 = 0")).select(F.min("score"), F.max("score")).first()
    assert nothing[0] == nothing[1] == 0.5


def test_restorer_reads_heavy_leet_edges_long_runs_and_joined_words():
    words = "the lamp stood near the door and an idiot said moron or shit to a dumbass then stupid clown ass".split()
    four = toxicity.count_grams(Counter({w: 50 for w in words})).reshape([toxicity.ALPHABET] * 4)
    three, two, one = four.sum(0), four.sum((0, 1)), four.sum((0, 1, 2))
    p = (one + 1) / (one.sum() + toxicity.ALPHABET)
    for counts in (two, three, four):
        p = (counts + toxicity.ALPHABET * p) / (counts.sum(-1, keepdims=True) + toxicity.ALPHABET)
    restorer = toxicity.Restorer(-np.log(p).astype(np.float32))
    cases = {
        "1d107": "idiot", "5h17": "shit", "dumba$$": "dumbass", "a$$,": "ass", "(lown": "clown", "st" + "u" * 24 + "pid": "stupid", "idiot/moron": "idiot", "door,moron": "moron",
        "lamp-moron": "moron", "door\u2014idiot": "idiot", "the/1d10t": "idiot", "m-o-r-o-n": "moron", "1 d 1 0 7": "idiot", "x" * 30: "x" * 30, "x" * 30 + "/moron": "moron",
    }
    for raw, want in cases.items():
        assert want in restorer.words(f"near {raw} door"), (raw, restorer.words(raw))
    assert restorer.words("the lamp, the door.") == {"the", "lamp", "door"}


def test_restorer_reads_any_spacing_and_long_tokens():
    restorer = toxicity.Restorer(costed("the lamp stood near the door and an idiot said moron or shit to a dumbass then stupid clown ass".split()))
    gaps = ["  ", "\t", "\n", "/", " . ", "_", "\u00a0", " - "]
    cases = {f"{gap.join('idiot')}": {"idiot"} for gap in gaps} | {f"{gap.join('1d10t')}": {"idiot"} for gap in gaps}
    cases |= {"i d-i o t": {"idiot"}, "s-tu-pid": {"stupid"}, "mo/ro/n": {"moron"}, "st-up-1d": {"stupid"}}
    long = "stupididiotmoron" * 2
    cases |= {long: {"stupid", "idiot", "moron"}, "5tup1d1d10tm0r0n5tup1d1d10tm0r0n": {"stupid", "idiot", "moron"}, "lamp" * 40 + "idiot" + "door" * 40: {"idiot"}, "-".join("lampdoor" * 9 + "moron" + "lamp" * 9): {"moron"}}
    for raw, want in cases.items():
        assert want <= restorer.words(f"door: {raw}. near"), (raw, restorer.words(f"door: {raw}. near"))
    assert restorer.words("a\nlamp - the door, 3 of 4") == {"a", "lamp", "the", "door", "3", "of", "4"}
    assert "idiot" in restorer.words("x" * 100_000 + " idiot") and "moron" in restorer.words("lamp" * 3000 + "moron")


def every_path(token, model):
    """The cheapest reading of a token's lattice by trying all of its paths, one after the other."""
    best, paths = (float("inf"), ""), [(0.0, "", (0, 0, 0))]
    for unit in toxicity.lattice(token):
        longer = []
        for cost, text, h in paths:
            for letters, more, gap in unit:
                for edge in (False, True) if gap and text else (False,):
                    total, said, state = cost + more, text, h
                    if edge:
                        total, said, state = total + toxicity.GAP_COST + float(model[(*state, 0)]), said + " ", (0, 0, 0)
                    elif said and said[-1] == letters:
                        longer.append((cost + more + toxicity.RUN_COST, text, h))
                    for x, k in zip(letters, toxicity.codes(letters), strict=True):
                        total, said = total + float(model[(*state, k)]) - toxicity.LETTER_CREDIT, said + x
                        state = (*state[1:], k)
                    longer.append((total, said, state))
        paths = longer
    for cost, text, h in paths:
        best = min(best, (cost + float(model[(*h, 0)]), text))
    return best


def costed(words):
    four = toxicity.count_grams(Counter({w: 50 for w in words})).reshape([toxicity.ALPHABET] * 4)
    three, two, one = four.sum(0), four.sum((0, 1)), four.sum((0, 1, 2))
    p = (one + 1) / (one.sum() + toxicity.ALPHABET)
    for counts in (two, three, four):
        p = (counts + toxicity.ALPHABET * p) / (counts.sum(-1, keepdims=True) + toxicity.ALPHABET)
    return -np.log(p).astype(np.float32)


def test_decoding_finds_the_cheapest_of_all_paths():
    import random

    r, model = random.Random(7), costed("the lamp stood near the door and an idiot said moron or shit to a dumbass then stupid clown ass".split())
    words = ["idiot", "moron", "stupid", "clown", "lamp", "shit"]
    back = {"o": "0", "i": "1!", "s": "5$", "t": "7+", "a": "4@", "e": "3", "l": "1|"}
    for _ in range(150):
        token = "".join((r.choice(back[x]) if x in back and r.random() < 0.5 else x) * r.choice([1, 1, 1, 2, 5]) for x in r.choice(words))
        if r.random() < 0.3:
            token = " ".join(token[:7])
        assert toxicity.decode(token, model) == every_path(token, model)[1].split(), token


def test_rollups_add_revise_delete_and_repeat(spark, tmp_path):
    store = rollups.Store(spark, f"file://{tmp_path}/store")
    rows = "op string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
    make = lambda *x: spark.createDataFrame(list(x), rows)
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}
    assert store.totals().count() == 0
    assert store.apply("a", make(("put", 1, "s", "en", "t1", 10), ("put", 2, "s", "en", "t1", 5), ("put", 3, None, None, "t1", None), ("put", None, "s", "en", "t1", 1)))
    assert totals() == {("s", "en", "t1"): (3, 16), (None, None, "t1"): (1, 0)}
    second = make(("put", 1, "q", "en", "t1", 12), ("put", 2, "s", "en", "t2", 7), ("delete", 3, None, None, "t1", 0), ("delete", 99, "s", "en", "t1", 0))
    assert store.apply("b", second) and not store.apply("b", second)
    assert totals() == {("s", "en", "t1"): (2, 6), ("q", "en", "t1"): (1, 12), ("s", "en", "t2"): (1, 7)}
    # a batch that broke off before its marker counts nothing and is written anew
    make(("put", 5, "s", "en", "t1", 100)).select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("docs"), "tokens", F.lit(3).alias("bucket")).write.partitionBy("bucket").parquet(f"file://{tmp_path}/store/ledger/c")
    assert totals()[("s", "en", "t1")] == (2, 6)
    assert store.apply("c", make(("delete", 2, "s", "en", "t1", 0))) and store.apply("d", make().where("1 = 0"))
    assert totals()[("s", "en", "t1")] == (1, 1) and store.current().where("doc_id = 2").count() == 1
    before = totals()
    store.compact("e")
    assert totals() == before and not store.apply("b", second) and totals() == before
    assert store.apply("f", make(("delete", 1, None, None, "t1", 0))) and totals() == {k: v for k, v in before.items() if k != ("q", "en", "t1")}


def test_random_batches_match_a_plain_table(spark, tmp_path):
    import random

    r, plain, store = random.Random(3), {}, rollups.Store(spark, f"file://{tmp_path}/store")
    for batch in range(5):
        changes = {(i, t): ("delete" if r.random() < 0.3 else "put", i, r.choice("ab"), r.choice(["en", None]), t, r.randrange(50)) for i, t in ((r.randrange(40), r.choice(["t1", "t2"])) for _ in range(30))}
        store.apply(f"b-{batch}", spark.createDataFrame(list(changes.values()), "op string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint"))
        for key, (op, _, source, lang, t, n) in changes.items():
            plain.pop(key, None)
            if op == "put":
                plain[key] = (source, lang, t, n)
        if batch == 2:
            store.compact("sum")
        want = Counter()
        for source, lang, t, n in plain.values():
            want[source, lang, t, "docs"] += 1
            want[source, lang, t, "tokens"] += n
        got = {(x.source, x.lang, x.tokenizer, k): x[k] for x in store.totals().collect() for k in ("docs", "tokens")}
        assert +want == {k: v for k, v in got.items() if v}


def test_the_rollup_query_matches_a_recount(spark, tmp_path):
    text = lambda i: ["one two  three", "Some\ttext here", "plain words", None, ""][i % 5] + f" {i % 20}" if i % 5 != 3 else None
    rows = [(i, text(i), f"s{i % 2}", "en" if i % 3 else None) for i in range(60)] + [(None, "plain words 2", "s0", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    encode, first, want = rollups.encoding(rollups.TOKENIZERS, rollups.VOCABULARY).encode_ordinary, {}, Counter()
    for i, t, *_ in rows:
        if t is not None and i is not None:
            first[t] = min(i, first.get(t, i))
    for i, t, source, lang in rows:
        if t is None or i is None or first[t] == i:
            # a null id stays as it was put: once as written, once cleaned
            forms = [t] if i is None else []
            cleaned = re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ")
            forms += [cleaned] if i is not None or cleaned != t else []
            for x in forms:
                want[source, lang, "docs"] += 1
                want[source, lang, "tokens"] += len(encode(x))
    got = {(x.source, x.lang, k): x[k] for x in rollups.op10_token_rollups(spark, str(tmp_path)).collect() for k in ("docs", "tokens")}
    assert got == dict(+want)

def test_token_counts(docs, no_docs):
    encode = rollups.encoding(rollups.TOKENIZERS, rollups.VOCABULARY).encode_ordinary
    want = sorted((str(r.doc_id), len(encode(r.text)) if r.text else 0) for r in docs.collect())
    assert sorted((str(r.doc_id), r.tokens) for r in rollups.counted(docs).collect()) == want
    assert rollups.counted(no_docs).count() == 0


PAGES = "page_id bigint, url string, html string, digest string, file string"


def test_archives_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 5000
    rows = [(1, "http://www.Example.org:80/a?b=1#c", big), (2, "https://sub.example.org/", big), (3, "http://example.org/a?b=1", big), (4, None, None), (5, "http://e.com/\r\nx", ""), (6, "http://z.net/q", "small"), (7, "http://z.net/q", "small"), (8, "http://z.net/q", other), (8, "http://z.net/q", other), (None, "http://n.org/", other)]
    pages = spark.createDataFrame([(*r, "c", "f") for r in rows], PAGES).repartition(3)
    folder = f"file://{tmp_path}/warc"
    indexed = warc.index(warc.write(warc.decide(pages), folder), folder, block_lines=2)
    keys = pages.select(warc.url_key(F.col("url")).alias("url_key")).distinct()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.captures(keys, indexed).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = {big: 3, other: 8}.get(h) if len(data) >= 1000 else None
        revisit = last is not None and i != last
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None, True))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    asked = spark.createDataFrame([("http://example.org/a?b=1",), ("http://z.net/q",), ("http://absent.org/",)], "url string")
    hits = sorted((r.url, r.page_id) for r in warc.lookup(asked, indexed).collect())
    assert hits == [("http://example.org/a?b=1", 1), ("http://example.org/a?b=1", 3), ("http://z.net/q", 6), ("http://z.net/q", 7), ("http://z.net/q", 8), ("http://z.net/q", 8)]
    empty = warc.index(warc.write(warc.decide(pages.where("1 = 0")), folder), folder)
    assert warc.captures(keys, empty).count() == 0


def test_lookups_match_a_scan(spark, tmp_path):
    """Every key of many captures, several to a block and to a key, against all captures of that key; absent keys find nothing."""
    pages = spark.createDataFrame([(i, f"http://h{i % 13}.org/{i * i % 97}", f"page {i}", "c", "f") for i in range(2000)], PAGES).repartition(5)
    indexed = warc.index(warc.write(warc.decide(pages), f"file://{tmp_path}/w"), f"file://{tmp_path}/w", block_lines=7)
    asked = pages.select("url").union(spark.createDataFrame([("http://h1.org/999",), ("http://zz.org/",), (None,)], "url string"))
    got = sorted((r.url, r.page_id, r.intact) for r in warc.lookup(asked, indexed).collect())
    assert got == sorted((f"http://h{i % 13}.org/{i * i % 97}", i, True) for i in range(2000))
    raw = [r.file for r in indexed.collect()]
    assert len(raw) == len(set(raw)) and sum(r.lines for r in indexed.collect()) == 2000
