"""Benchmark decontamination by template canonicalisation, in DataFrame
operations alone.

On both sides each number, unit behind a number and capitalised word becomes a typed
placeholder; capitals count wherever they stand, as a word that opens a sentence does
so in a copy too. Windows
of five template tokens are hashed and joined with those of the benchmark. Windows
with fewer than two ordinary words say too little: an item is known by its others.
Items without any other, and those shorter than a window, are known by their words
as they are: by all their windows, or by the one that they are.

For each pair of a document and an item, the slots under the matching windows are
compared. Windows at one distance form a run. In a run, a value of the item must
stand against one value of the document: where a number or a unit does not, the
run is dropped; where a capitalised word does not, its windows are dropped (it may be
no name). Runs are united, longest first, as long as they agree on all values: one
assignment for the pair. A pair is a leak if at least `share` of the item's distinct
windows are found so; `verbatim` tells whether every slot has the item's own value.

Documents' windows, numbers alone, flow through the join unshuffled while the
benchmark's are small enough to broadcast, which is measured; beyond that the join is
a shuffled one on the window's hash. Only matches are aggregated, and only documents
that hold enough of an item are read again for the words in its slots: by a broadcast
of their keys while these are few, which is measured, and a shuffled join beyond.

A document is a doc_id with its text: repeated rows are one document, rows that share
a doc_id or have none are judged by their own texts. Null or empty texts have no
windows and leak nothing; null or empty items are leaked by nothing. Further columns
are ignored, or kept by `drop_leaks`. An empty benchmark gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

# Units of measure that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec secs min mins h hr hrs hour hours day days week weeks month months year years euro euros dollar dollars usd eur percent degrees c f k kb mb gb tb hz khz mhz ghz w kw v a j n pa mph kmh".split()

#: Codes of the placeholders; words have hashes. A number begins with a digit, or has one behind a first sign.
NUMBER, NAME, UNIT = 1, 2, 3
WIDTH = 5
#: Ordinary words that a window of a template needs.
PLAIN = 2
#: Punctuation that may follow a unit.
TAILS = ["", ".", ",", ";", ":", "!", "?", ")"]

WORDS = "array<struct<kind:bigint,value:string>>"


def _raw(text: F.Column) -> F.Column:
    return F.split(F.btrim(text, F.lit(" \t\n\u000b\f\r")), r"\s+")


def _words(df: DataFrame) -> DataFrame:
    """Only rows whose text has a word."""
    return df.where(F.btrim(F.col("text"), F.lit(" \t\n\u000b\f\r")) != "")


def _code(w: F.Column) -> F.Column:
    """A word's code before units are known; most words are told by one comparison."""
    second = F.substring(w, 2, 1)
    capital = lambda c: (F.lower(c) != c)
    name = F.when(~capital(second), F.lit(NAME).cast("long")).otherwise(F.xxhash64(F.lower(w)))
    return (
        F.when((w >= "a") & (w < "{"), F.xxhash64(w))
        .when((w >= "0") & (w < ":"), NUMBER)
        .when((w >= "A") & (w < "["), name)
        .when((second >= "0") & (second < ":"), NUMBER)
        .when(capital(F.substring(w, 1, 1)), name)
        .otherwise(F.xxhash64(F.lower(w)))
        .cast("long")
    )


def _coded(df: DataFrame, text: F.Column) -> DataFrame:
    """Adds codes: the template, a number for each word."""
    df = df.withColumn("codes", F.transform(_raw(text), _code))
    units = F.array(*[F.xxhash64(F.lit(u + t)) for u in UNITS for t in TAILS])
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("codes", 1, F.size("codes") - 1))
    return df.withColumn("codes", F.zip_with(before, "codes", lambda b, c: F.when((b == NUMBER) & F.array_contains(units, c), UNIT).otherwise(c).cast("long")))


def _windows(df: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """keys, length, pos, window: hashes of the codes' windows of these lengths (1 to WIDTH)."""
    n = F.size("codes")
    every = lambda k: F.transform(F.slice("codes", 1, F.greatest(n - (k - 1), F.lit(0))), lambda c, i: F.xxhash64(c, *[F.get("codes", i + j) for j in range(1, k)]))
    return reduce(DataFrame.union, [df.select(*keys, F.lit(k).alias("length"), F.posexplode(every(k)).alias("pos", "window")) for k in lengths])


def _values(codes: F.Column, raw: F.Column, pos: F.Column) -> F.Column:
    """The placeholders of the window at pos with the words under them."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")
    both = F.zip_with(F.slice(codes, pos + 1, WIDTH), F.slice(raw, pos + 1, WIDTH), lambda c, r: F.struct(c.alias("kind"), r.alias("raw")))
    return F.transform(F.filter(both, lambda s: s["kind"] <= UNIT).cast("array<struct<kind:bigint,raw:string>>"), lambda s: F.struct(s["kind"].alias("kind"), bare(s["raw"]).alias("value"))).cast(WORDS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """Columns doc_id, item_id, n_windows (of the item), n_found, containment, verbatim:
    one row for each leak (of each text under that doc_id)."""
    return _leaks(docs, benchmark, share, broadcast_rows)[0].drop("text_key")


def _asked(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id, literal, item_pos, window, item_values; and the lengths of literal windows."""
    items = _words(benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct())
    items = _coded(items, F.col("text")).withColumn("raw", _raw(F.col("text"))).withColumn("n", F.size("codes"))
    inside = _windows(items.where(F.col("n") >= WIDTH), ["item_id", "text"], [WIDTH]).join(items.select("item_id", "text", "codes", "raw"), ["item_id", "text"])
    plain = F.size(F.filter(F.slice("codes", F.col("pos") + 1, WIDTH), lambda c: (c < NUMBER) | (c > UNIT)))
    template = inside.where(plain >= PLAIN).select("item_id", F.lit(False).alias("literal"), F.col("pos").alias("item_pos"), "window", _values(F.col("codes"), F.col("raw"), F.col("pos")).alias("item_values"))
    rest = items.join(template.select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.transform("raw", lambda w: F.xxhash64(F.lower(w))).alias("codes"), F.least("n", F.lit(WIDTH)).alias("n"))
    lengths = sorted(r[0] for r in rest.select("n").distinct().collect())  # five values at most
    parts = [template]
    for k in lengths:
        own = _windows(rest.where(F.col("n") == k), ["item_id"], [k])
        parts.append(own.select("item_id", F.lit(True).alias("literal"), F.col("pos").alias("item_pos"), "window", F.array().cast(WORDS).alias("item_values")))
    return reduce(DataFrame.union, parts), lengths


def _leaks(docs: DataFrame, benchmark: DataFrame, share: float, broadcast_rows: int) -> tuple[DataFrame, bool]:
    """The leaks with text_key, and whether they are few enough to broadcast."""
    asked, lengths = _asked(benchmark)
    asked = materialize(asked, "leak-items")
    totals = asked.groupBy("item_id").agg(F.countDistinct("window").alias("n_windows"))
    small = asked.limit(broadcast_rows + 1).count() <= broadcast_rows
    keys = ["doc_id", "text_key"]
    text = F.col("text").cast("string")
    rows = _words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")))
    found = _windows(_coded(rows, F.col("text")), keys, [WIDTH]).withColumn("literal", F.lit(False))
    if lengths:
        words = rows.withColumn("codes", F.transform(_raw(F.col("text")), lambda w: F.xxhash64(F.lower(w))))
        found = found.union(_windows(words, keys, lengths).withColumn("literal", F.lit(True)))
    hits = found.drop("length").join(F.broadcast(asked) if small else asked, ["window", "literal"])
    hit = F.struct("window", F.col("pos").alias("doc_pos"), "item_pos", "literal", "item_values")
    pairs = hits.groupBy(*keys, "item_id").agg(F.collect_set(hit).alias("hits")).join(totals, "item_id")
    most = F.size(F.array_distinct(F.transform("hits", lambda h: h["window"])))
    pairs = materialize(pairs.where(most >= share * F.col("n_windows")), "leak-pairs")
    # The words of the documents that may leak; a document without an id is found by its text.
    wanted = pairs.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).distinct()
    few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    again = rows.join(F.broadcast(wanted) if few else wanted, (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")
    again = _coded(again.dropDuplicates(keys), F.col("text")).select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "codes", _raw(F.col("text")).alias("raw"))
    both = pairs.join(again, (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    values = lambda h: F.when(h["literal"], F.array().cast(WORDS)).otherwise(_values(F.col("codes"), F.col("raw"), h["doc_pos"]))
    slot = lambda a, b: F.struct(a["kind"].alias("kind"), a["value"].alias("item"), b["value"].alias("doc"))
    slots = lambda h: F.zip_with(h["item_values"], values(h), slot)
    hits = both.select(*keys, "item_id", "n_windows", F.explode(F.transform("hits", lambda h: F.struct((h["doc_pos"] - h["item_pos"]).alias("shift"), h["window"].alias("window"), slots(h).alias("slots")))).alias("hit"))
    runs = hits.groupBy(*keys, "item_id", "n_windows", "hit.shift").agg(F.collect_list("hit").alias("hits"))
    every = lambda hits: F.array_distinct(F.flatten(F.transform(hits, lambda h: h["slots"])))
    same = lambda a, b: (a["kind"] == b["kind"]) & (a["item"] == b["item"])
    # Item values that meet several of the document's; none is the usual case.
    runs = runs.withColumn("slots", every(F.col("hits")))
    runs = runs.withColumn("split", F.filter("slots", lambda s: F.exists("slots", lambda o: same(o, s) & (o["doc"] != s["doc"]))))
    runs = runs.where(F.forall("split", lambda s: s["kind"] == NAME))
    bad = lambda h: F.exists(h["slots"], lambda s: F.exists("split", lambda o: same(o, s)))
    runs = runs.withColumn("hits", F.when(F.size("split") == 0, F.col("hits")).otherwise(F.filter("hits", lambda h: ~bad(h))))
    runs = runs.select(*keys, "item_id", "n_windows", "shift", F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("found"), every(F.col("hits")).alias("slots")).where(F.size("found") > 0)
    run = F.struct((-F.size("found")).alias("less"), "shift", "found", "slots")
    pairs = runs.groupBy(*keys, "item_id", "n_windows").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    start = F.struct(F.array().cast("array<bigint>").alias("found"), F.array().cast("array<struct<kind:bigint,item:string,doc:string>>").alias("slots"))
    agree = lambda a, b: F.forall(b, lambda s: F.forall(a, lambda o: ~same(o, s) | (o["doc"] == s["doc"])))
    union = lambda seen, r: F.struct(F.array_union(seen["found"], r["found"]).alias("found"), F.array_union(seen["slots"], r["slots"]).alias("slots"))
    pairs = pairs.withColumn("one", F.aggregate("runs", start, lambda seen, r: F.when(agree(seen["slots"], r["slots"]), union(seen, r)).otherwise(seen)))
    leaks = (
        pairs.select(*keys, "item_id", "n_windows", F.size("one.found").cast("long").alias("n_found"), F.forall("one.slots", lambda s: s["item"] == s["doc"]).alias("verbatim"))
        .withColumn("containment", F.col("n_found") / F.col("n_windows"))
        .where(F.col("containment") >= share)
        .select(*keys, "item_id", "n_windows", "n_found", "containment", "verbatim")
    )
    return leaks, few


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows whose text leaks no item, every column as it was."""
    leaky_id, leaky_text = unused(docs, "leaky_id"), unused(docs, "leaky_text")
    leaks, few = _leaks(docs, benchmark, share, broadcast_rows)
    bad = leaks.select(F.col("doc_id").alias(leaky_id), F.col("text_key").alias(leaky_text)).distinct()
    bad = F.broadcast(bad) if few else bad
    text = F.xxhash64(F.col("text").cast("string"))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(leaky_id)) & (text == F.col(leaky_text)), "left_anti")
