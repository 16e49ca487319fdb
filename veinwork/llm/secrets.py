"""Secret scans with multipart credential linking (native: DataFrame functions only).

Base kinds (assign, access, hex) are always reported. Weak kinds are reported only when complementary parts
stand within SCOPE code points of each other in the same text:

* ident (a user, client or key name in an assignment) needs a secret part (assign, hex or blob),
* blob (a long mixed-case token) needs an identifier part (access or ident),
* endpoint (a URL) needs both an identifier and a secret part.

Spans of a kind are leftmost, non-overlapping matches: the texts between matches give their places. Parts of the
few texts that hold a weak part and its complement are joined by interval: two windows over a text's parts in
order give each part the nearest part of every role before and behind it.

Cases: null text counts as empty (no spans); repeated rows get equal results; null ids are rows like any other; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

SCOPE = 200
#: Patterns by kind, base kinds first; group 1 is the value where a kind has one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ with 24 characters or more
IDENT = r"""(?i:access_?key_?id|client_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
BLOB = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
KINDS = ["assign", "access", "hex", "ident", "blob", "endpoint"]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "blob": "secret", "endpoint": "endpoint"}

SPAN = "array<struct<s:int,k:int,e:int>>"


def _spans(df: DataFrame, into: str, kind: str, pattern: str, may: Column, valid=None, group: int = 0) -> DataFrame:
    """Add the spans of a kind. may: a cheap condition without which no match is possible."""
    p, k = "__vw_s_", KINDS.index(kind)
    text, pat = F.col(p + "text"), F.lit(pattern)
    hits, vals, gaps = F.col(p + "hits"), F.col(p + "vals"), F.col(p + "gaps")
    df = df.withColumn(p + "hits", F.when(may, F.regexp_extract_all(text, pat, F.lit(0))))
    df = df.withColumn(p + "vals", F.when(F.size(hits) > 0, F.regexp_extract_all(text, pat, F.lit(group))) if group else hits)
    # lengths of what precedes each match; zipped, as an array named inside a lambda would be made again for every element
    df = df.withColumn(p + "gaps", F.when(F.size(hits) > 0, F.transform(F.split(text, pattern), lambda x: F.length(x))))
    zipped = F.filter(F.arrays_zip(p + "hits", *([p + "vals"] if group else []), p + "gaps"), lambda x: x[p + "hits"].isNotNull())
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("block"), F.array().cast(f"array<{SPAN}>").alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x[p + "gaps"]
        e = s + F.length(x[p + "hits"])
        span = F.array(F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e"))).cast(SPAN)
        block = F.concat(acc["block"], span)
        if valid:
            block = F.when(valid(x[p + ("vals" if group else "hits")]), block).otherwise(acc["block"])
        # arrays grow by copying, so full blocks are set aside
        full = F.size(acc["block"]) >= 256
        return F.struct(e.alias("at"), F.when(full, F.slice(block, 257, 1)).otherwise(block).alias("block"), F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"]).alias("blocks"))

    found = F.when(F.size(hits) > 0, F.aggregate(zipped, start, step, lambda a: F.flatten(F.concat(a["blocks"], F.array(a["block"])))))
    return df.withColumn(into, F.coalesce(found, none)).drop(p + "hits", p + "vals", p + "gaps")


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (of id and text), base and weak spans of every whole text."""
    t = F.col("__vw_s_text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__vw_s_text"))
    assigns = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    df = _spans(df, "assign", "assign", ASSIGN, assigns, lambda v: F.length(v) >= 6, group=1)
    df = _spans(df, "access", "access", ACCESS, F.contains(t, F.lit("AKIA")))
    df = _spans(df, "hex", "hex", HEX, F.lit(True))
    df = _spans(df, "ident", "ident", IDENT, assigns, lambda v: F.length(v) >= 3, group=1)
    df = _spans(df, "blob", "blob", BLOB, F.lit(True), lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"))
    df = _spans(df, "endpoint", "endpoint", ENDPOINT, F.contains(t, F.lit("://")))
    base = F.concat("assign", "access", "hex")
    apart = lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))  # noqa: E731  what a base span holds is reported already
    df = df.withColumn("base", base).withColumn("weak", F.filter(F.concat("ident", "blob", "endpoint"), apart))
    key = F.when(F.size("weak") > 0, F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), t), 256))
    return df.select("doc_id", key.alias("key"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), "base", "weak")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """found: (key, base, weak). (key, linked): the weak spans whose complement is in scope."""
    roles = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    rows = found.where("key is not null").dropDuplicates(["key"]).select("key", F.explode(F.concat("base", "weak")).alias("p")).select("key", "p.*", F.get(roles, F.col("p.k")).alias("role"))
    before = Window.partitionBy("key").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("key").orderBy("s", "k").rowsBetween(1, Window.unboundedFollowing)
    for r in ("identifier", "secret"):
        last, first = F.max(F.when(F.col("role") == r, F.col("e"))).over(before), F.min(F.when(F.col("role") == r, F.col("s"))).over(behind)
        rows = rows.withColumn(r, F.coalesce(F.col("s") - last <= scope, F.lit(False)) | F.coalesce(first - F.col("e") <= scope, F.lit(False)))
    kind = lambda k: F.col("k") == KINDS.index(k)
    ok = (kind("ident") & F.col("secret")) | (kind("blob") & F.col("identifier")) | (kind("endpoint") & F.col("identifier") & F.col("secret"))
    return rows.where(ok).groupBy("key").agg(F.collect_list(F.struct("s", "k", "e")).cast(SPAN).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row of docs."""
    found = staged(parts(docs, id_col, text_col), "secrets")
    # only texts with weak parts have a key; the others take no part in the join
    out = found.where("key is not null").join(linked(found, scope), "key", "left")
    out = out.unionByName(found.where("key is null").withColumn("linked", F.lit(None).cast(SPAN)))
    extra = F.coalesce("linked", F.array().cast(SPAN))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", extra)).alias("spans"), F.size(extra).cast("long").alias("n_linked")
    )


def op4_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
