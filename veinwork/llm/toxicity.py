"""Toxicity of texts behind a noisy channel.

Writers hide words by leetspeak, by repeating letters and by spacing them out. A suspect token becomes a lattice of
letters (each character's readings and their costs; runs may shrink; a gap, which any white space or punctuation makes, may be a
word's end or nothing; so may any place of a token of more than LONGEST units), and Viterbi's algorithm finds its cheapest path under a character 4-gram model of the whole corpus. Texts are then
scored by their restored words.

* Language model: 4-gram counts of ALPHABET symbols over the words of all documents, at most ALPHABET ** 4 numbers.
* Lexicon: words that mark label 1, from a sample of at most SAMPLE labelled rows outside the held-out third
  (crc32 of the id as text, mod 3, is 1); a word enters when its count among toxic texts is improbable by chance
  (exact binomial tail <= CHANCE) and over half of its texts are toxic; the sample bounds their number.
* Score: the log odds of label 1 in texts without such words; in texts with some, those of all texts plus each distinct
  word's smoothed log odds ratio.

Labels, language, source and id are no inputs of a score.

Very long texts are read whole; long tokens and long runs of spaced characters in windows of 2 * LONGEST units, each of which has the
last half of the one before, so any word of LONGEST units lies in one of them.

Cases: null and empty texts score as texts without marked words; rows with a null id aren't held out; labels without id
or value are left out, repeated ones count as given; repeated rows score alike; an empty table gives no rows; without
usable labels every text gets the prior of 0.5 documents of each kind; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged
from .quality import binomial_tail

SAMPLE, CHANCE, CUT = 20_000, 1e-5, 0.7
ALPHABET = 28  # word edge, a to z, any other letter
#: Readings of leet characters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
READ_COST, RUN_COST, PAIR_COST, GAP_COST, OTHER_COST = 0.5, 0.3, 3.0, 1.0, 4.0
LETTER_CREDIT = 2.0  # about a letter's cost under the model, so that dropping one is no gain in itself
LONGEST = 24  # tokens of more units (a run is one) are read in windows, as joined words
_TRAIL, _LEAD = ".,;:!?\"'`()[]{}<>*_#%&$|~-@/\\=", ".,;:?\"'`()[]{}<>*_#%&~-/\\="
_RUN = re.compile(r"([^\W\d_])\1\1")
_FIRM_TRAIL, _FIRM_LEAD = ("".join(c for c in x if c not in LEET) for x in (_TRAIL, _LEAD))
_LEETY = re.compile("[" + re.escape("".join(LEET)) + "]")
_GAP = r"(?:[^\w" + re.escape("".join(LEET)) + r"]|_)"
_UNIT = r"(?:[^\W_]|[" + re.escape("".join(LEET)) + r"])"
_SPLIT = re.compile(r"(?<=.)" + _GAP + r"(?=.)")
_JOINED = re.compile(r"(?:[^\w\s" + re.escape("".join(LEET)) + r"]|_)+")
_REPEAT = re.compile(r"(.)\1*", re.DOTALL)
_SPACED = re.compile(rf"(?<!{_UNIT}){_UNIT}(?:{_GAP}+{_UNIT}){{2,}}(?!{_UNIT})")
_GAPS = re.compile(_GAP)
_CODES = bytes(1 + i - 97 if 97 <= i <= 122 else 27 for i in range(256))


def codes(word: str) -> bytes:
    return word.encode("latin-1", "replace").translate(_CODES)


def count_grams(words: Counter) -> np.ndarray:
    """4-gram counts of words with three edges before and one behind."""
    parts, lengths = [], []
    for w in words:
        parts.append(b"\0\0\0" + codes(w) + b"\0")
        lengths.append(len(w) + 4)
    a = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    n, size = np.array(lengths), np.fromiter(words.values(), np.float64, len(words))
    gram = ((a[:-3] * ALPHABET + a[1:-2]) * ALPHABET + a[2:-1]) * ALPHABET + a[3:]
    within = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    weight = np.repeat(size, n)
    ok = within[:-3] + 3 < np.repeat(n, n)[:-3]
    return np.bincount(gram[ok], weights=weight[:-3][ok], minlength=ALPHABET**4)


def language_model(docs: DataFrame) -> np.ndarray:
    """docs: (text). Costs (minus log probabilities) of a symbol after three others, as [ALPHABET] * 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def grams() -> pa.RecordBatch:
            alpha = Counter()
            for w, n in words.items():
                w = w.strip(_TRAIL)
                if w.isalpha():
                    alpha[w] += n
            c = count_grams(alpha) if alpha else np.zeros(1)
            at = np.flatnonzero(c)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["gram", "n"])

        for b in batches:
            for t in b.column(0):
                words.update((t.as_py() or "").lower().split())
                if len(words) > 300_000:
                    yield grams()
                    words.clear()
        if words:
            yield grams()

    rows = docs.mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most ALPHABET ** 4
    four = np.zeros(ALPHABET**4)
    four[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    four = four.reshape([ALPHABET] * 4)
    three, two, one = four.sum(0), four.sum((0, 1)), four.sum((0, 1, 2))
    p = (one + 1) / (one.sum() + ALPHABET)
    for counts in (two, three, four):  # each order backs off to the one below with the weight of one observation a symbol
        p = (counts + ALPHABET * p) / (counts.sum(-1, keepdims=True) + ALPHABET)
    return -np.log(p).astype(np.float32)


def lattice(token: str, gaps: bool | None = None) -> list[list[tuple[str, float, bool]]]:
    """For each unit of a token its readings (letters, cost, may follow a word's end). gaps: whether every unit may (unset: if it is spaced out)."""
    spaced = bool(_SPACED.fullmatch(token)) or (len(p := _SPLIT.split(token)) >= 3 and all(len(x) <= 2 for x in p))
    chars, spaced = _GAPS.sub("", token) if spaced else [c for c in token if c not in ".-_*~"], spaced if gaps is None else gaps
    out, i = [], 0
    while i < len(chars):
        j = i
        while j < len(chars) and chars[j] == chars[i]:
            j += 1
        c, n = chars[i], j - i
        reads = [(c, 0.0)] if c.isalpha() else [(r, READ_COST) for r in LEET.get(c, "")]
        if not reads:
            reads = [("?", OTHER_COST)]
        options = [(r * k, cost * k + (0.0 if k == n else RUN_COST if n > 2 else PAIR_COST)) for r, cost in reads for k in sorted({1, min(2, n), min(n, 4)})]
        out.append([(letters, cost, spaced and i > 0) for letters, cost in options])
        i = j
    return out


def decode(token: str, model: np.ndarray, gaps: bool | None = None) -> list[str]:
    """The words of the cheapest path through the token's lattice: Viterbi's, one best history for each state of three letters."""
    paths: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    for unit in lattice(token, gaps):
        new: dict[tuple[int, int, int], tuple[float, str]] = {}
        for h, (cost, text) in paths.items():
            for letters, more, gap in unit:
                for edge in (False, True) if gap and text else (False,):
                    a, b, c = h
                    total, said = cost + more, text
                    if edge:
                        total, said = total + GAP_COST + float(model[a, b, c, 0]), said + " "
                        a = b = c = 0
                    if said and said[-1] == letters and not edge:  # a leet reading that goes on with the letter before it
                        new[h] = min(new.get(h, (math.inf, "")), (cost + more + RUN_COST, text))
                    for x, k in zip(letters, codes(letters), strict=True):
                        total, said = total + float(model[a, b, c, k]) - LETTER_CREDIT, said + x
                        a, b, c = b, c, k
                    new[a, b, c] = min(new.get((a, b, c), (math.inf, "")), (total, said))
        paths = new
    best = min(((cost + float(model[(*h, 0)]), text) for h, (cost, text) in paths.items()), default=(0.0, ""))
    return best[1].split()


class Restorer:
    """Distinct restored words of a text; tokens seen before are remembered."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def token(self, raw: str) -> tuple[str, ...]:
        """The words of a token, read whole and, if punctuation joins words in it, each by itself."""
        parts = [x for x in _JOINED.split(raw) if x]
        out = self.read(raw)
        if len(parts) > 1 and any(len(x) > 2 for x in parts):
            out += tuple(w for x in parts for w in self.read(x))
        return tuple(dict.fromkeys(out))

    def read(self, raw: str) -> tuple[str, ...]:
        core = raw.rstrip(_TRAIL).lstrip(_LEAD)
        out = (core.lstrip("$@!|"),)
        # leet characters at the edges are letters or punctuation: read with and without
        for form in dict.fromkeys(x.lstrip(lead) for x in (raw.rstrip(_TRAIL), raw.rstrip(_FIRM_TRAIL)) for lead in (_LEAD, _FIRM_LEAD)):
            parts = [x for x in _SPLIT.split(form) if x]
            broken = len(parts) >= 3 and all(len(x) <= 3 for x in parts)
            if broken:
                out += ("".join(parts),)
            units = _REPEAT.findall(form) if len(form) > LONGEST else ()
            if not any(map(str.isalpha, form)) or not (broken or len(units) > LONGEST or _RUN.search(form) or _LEETY.search(form)):
                continue
            if len(units) <= LONGEST and broken:
                out += tuple(decode("".join(parts), self.model, all(len(x) <= 2 for x in parts)))
            elif len(units) <= LONGEST:
                out += tuple(decode(form, self.model))
            else:
                out += self.joined(form)
        return out

    def joined(self, form: str) -> tuple[str, ...]:
        """Words of a long run of characters: each unit may begin one."""
        runs, out = [m[0] for m in _REPEAT.finditer(_GAPS.sub("", form))], []
        for at in range(0, max(1, len(runs) - LONGEST), LONGEST):
            out += decode("".join(runs[at : at + 2 * LONGEST]), self.model, True)
        return tuple(dict.fromkeys(out))

    def words(self, text: str) -> set[str]:
        text, out = text.lower(), set()
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for raw in set(text.split()):
            got = known.get(raw)
            if got is None:
                got = known[raw] = self.token(raw)
            out.update(got)
        for m in _SPACED.finditer(text):
            run = _GAPS.sub("", m[0])
            for at in range(0, max(1, len(run) - LONGEST), LONGEST):
                piece = run[at : at + 2 * LONGEST]
                letters = sum(map(str.isalpha, piece))
                if letters >= 2 or letters and _LEETY.search(piece):
                    key = f" {piece}"
                    if key not in known:
                        known[key] = tuple(decode(piece, self.model, True))
                    out.update(known[key])
        out.discard("")
        return out


def sample(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): at most SAMPLE labelled rows outside the held-out third, the first by hash of the id."""
    used = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    return used.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(SAMPLE)


def lexicon(docs: DataFrame, labels: DataFrame, model) -> tuple[float, float, dict[str, float]]:
    """docs: (doc_id, text); model: a broadcast. The log odds without marked words, those of all texts, the words' weights."""
    chosen = staged(sample(labels).withColumnRenamed("doc_id", "__id"), "toxic-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for b in batches:
            rows = [sorted(restorer.words(t.as_py() or "")) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.string()))], names=["toxic", "words"])

    # the sample has at most SAMPLE rows of two numbers
    read = staged(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "toxic").mapInArrow(run, "toxic int, words array<string>"), "toxic-words")
    n, k = read.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, k = n or 0, k or 0
    if not 0 < k < n:
        return math.log((k + 0.5) / (n - k + 0.5)), 0.0, {}
    rate = k / n
    counts = read.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where("2 * k > n")
    by_chance = binomial_tail(F.col("n") - F.col("k"), F.col("n"), 1 - rate)
    top = counts.where(by_chance <= CHANCE).collect()  # several toxic texts of the sample for each word
    odds = lambda p: math.log(p / (1 - p))
    words = {r.word: odds((r.k + 2 * rate) / (r.n + 2)) - odds(rate) for r in top}
    marked = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0]).filter(pa.array([marked.value.isdisjoint(w) for w in b.column(1).to_pylist()], pa.bool_()))

    m, j = read.select("toxic", "words").mapInArrow(unmarked, "toxic int").agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    return math.log((j + 0.5) / (m - j + 0.5)), odds(rate), words


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. labels: (doc_id, toxic)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(language_model(docs.select("text")))
    free, prior, weights = lexicon(docs, labels, model)
    known = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, lex = Restorer(model.value), known.value
        marked = lex.keys()
        for b in batches:
            s = []
            for t in b.column(2):
                found = sorted(restorer.words(t.as_py() or "") & marked)
                x = prior + sum(lex[w] for w in found) if found else free
                s.append(1 / (1 + math.exp(-max(-700.0, min(700.0, x)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op9_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
