"""Benchmark decontamination by template canonicalisation, DataFrame functions only.

A text becomes a sequence of template tokens: lower-case words, and typed
placeholders for numbers, units that follow a number, and names (capitalised
words inside a sentence). Windows of ``width`` tokens with at least
``literals`` words among them are hashed; a document's windows are looked up in
the hash table of the benchmark's. A (document, item) pair counts where the
matched windows cover ``share`` of the item's words that any window covers, and
where the slots agree: under the matched windows of a set of alignments, every
value of an item's slot is replaced by one value throughout. So a question with
other numbers, units or names is found, and a text that merely has the same
frame with values that contradict each other is not. Every alignment is judged
by itself, and those that agree with each other are put together.

The same is done with the texts lower-cased first, where names stay words: that
finds copies in any case. Items that have no window with enough words, or fewer
than ``width`` tokens, are looked for as whole sequences of tokens and values.

Null and empty texts match nothing, and nothing matches in empty tables. Texts of any
length are read whole. Every row gets its own rows, whether ids are null, large or
repeat, and equal rows get equal answers; an item that several alignments reach is one
row. Only ``doc_id``, ``item_id`` and ``text`` are read, so other columns may have any name. The benchmark's table is broadcast only where its counted
windows are within ``BROADCAST_ROWS`` (about 60 bytes each); beyond that it is a
shuffled hash-partitioned join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, few_or_shuffled, materialize, row_keyed

WIDTH = 5
LITERALS = 3
SHARE = 0.8
BROADCAST_ROWS = 500_000
#: Sets of alignments of a pair that are followed at a time; all of them where a pair has up to ten different fillings.
STATES = 1024
NUMBER = r"(?<![\p{L}\p{N}])[0-9]+(?:[.,:/][0-9]+)*"
#: Unit words that become a placeholder after a number.
UNITS = (
    "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ft|in|inch|inches|feet|mile|miles|metre|metres|meter|meters|litre|litres|liter|liters|ml|l|s|sec"
    "|seconds|min|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|percent|dollars|euros|cents|kmh|mph|w|kw|v|a|hz"
)
UNIT = rf"(⟨n[^⟩]*⟩ )\s*({UNITS})(?![\p{{L}}\p{{N}}])"
NAME = r"\p{Lu}(?<=[\p{Ll},;]\s\p{Lu})\p{Ll}+"
TOKEN = r"⟨[^⟩]*⟩|\p{L}[\p{L}\p{M}\p{N}]*"


def template_tokens(text: Column, keep: bool = False, names: bool = True) -> Column:
    """Template tokens of a text; with ``keep`` placeholders carry what they stand for. Without ``names`` case makes no difference."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t if names else F.lower(t), NUMBER, " ⟨n$0⟩ " if keep else " ⟨n⟩ ")
    t = F.regexp_replace(t, UNIT, "$1⟨u$2⟩ " if keep else "$1⟨u⟩ ")
    t = F.regexp_replace(t, NAME, "⟨p$0⟩" if keep else "⟨p⟩") if names else t
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))


def window_hashes(tokens: str, width: int) -> Column:
    """Hash of every window of an array column, empty where it is shorter than a window."""
    return F.expr(
        f"case when size({tokens}) >= {width} then "
        f"transform(sequence(1, size({tokens}) - {width - 1}), i -> xxhash64(slice({tokens}, i, {width}))) "
        f"else cast(array() as array<bigint>) end"
    )


def benchmark_windows(items: DataFrame, names: bool, width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """(h, item, at): windows with enough words in them, ``at`` from 0."""
    tokens = items.select("item", template_tokens(F.col("text"), names=names).alias("t"))
    rows = tokens.select("item", "t", F.posexplode(window_hashes("t", width)).alias("at", "h"))
    words = F.expr(f"size(filter(slice(t, at + 1, {width}), x -> not startswith(x, '⟨')))")
    return rows.filter(words >= literals).select("h", "item", "at")


def _covered(at: str, width: int) -> str:
    """Tokens under windows that start at the sorted positions of an array."""
    return f"aggregate(zip_with({at}, slice({at}, 2, size({at})), (a, b) -> least({width}, coalesce(b - a, {width}))), 0, (s, x) -> s + x)"


def _looked_up(windows: DataFrame, table: DataFrame, n_rows: int) -> DataFrame:
    by_hash = table.groupBy("h").agg(F.collect_list(F.struct(*[c for c in table.columns if c != "h"])).alias("where_"))
    by_hash = F.broadcast(by_hash) if n_rows <= BROADCAST_ROWS else by_hash
    return windows.join(by_hash, "h").withColumn("w", F.explode("where_"))


def _alignments(keyed: DataFrame, table: DataFrame, names: bool, width: int, share: float) -> DataFrame:
    """(row key, item, shift, ats, coverable) of pairs whose matched windows cover enough, all alignments together."""
    coverable = table.groupBy("item").agg(F.array_sort(F.collect_set("at")).alias("_at"))
    coverable = coverable.select("item", F.expr(_covered("_at", width)).alias("coverable"))
    windows = keyed.select(ROW, template_tokens(F.col("text"), names=names).alias("t"))
    windows = windows.select(ROW, F.posexplode(window_hashes("t", width)).alias("pos", "h"))
    met = _looked_up(windows, table, table.count()).select(ROW, "w.item", "w.at", (F.col("pos") - F.col("w.at")).alias("shift"))
    by_shift = materialize(met.groupBy(ROW, "item", "shift").agg(F.collect_set("at").alias("ats")))
    pairs = by_shift.groupBy(ROW, "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("_at"))
    pairs = pairs.join(coverable, "item").filter(F.expr(_covered("_at", width)) >= share * F.col("coverable"))
    return by_shift.join(pairs.select(ROW, "item", "coverable"), [ROW, "item"])


def _consistent(keyed: DataFrame, items: DataFrame, aligned: DataFrame, names: bool, width: int, share: float) -> DataFrame:
    """(row key, item, best): the largest cover of a pair by alignments whose slots are filled one way, where it is enough."""
    aligned = materialize(aligned)
    own = items.select("item", template_tokens(F.col("text"), keep=True, names=names).alias("it"))
    texts = few_or_shuffled(keyed, aligned.select(ROW).distinct(), ROW, "left_semi").select(ROW, template_tokens(F.col("text"), keep=True, names=names).alias("dt"))
    slots = F.expr(
        f"transform(filter(array_distinct(flatten(transform(ats, a -> sequence(a, a + {width - 1})))), i -> startswith(it[i], '⟨')), "
        "i -> struct(i as at, it[i] as own, dt[i + shift] as other))"
    )
    filled = aligned.join(own, "item").join(texts, ROW).select(ROW, "item", "coverable", "ats", slots.alias("slots"))
    filled = filled.withColumn("filling", F.expr("array_sort(array_distinct(transform(slots, s -> struct(s.own as own, s.other as other))))"))
    # Alignments with the same filling are one; one that contradicts itself is none.
    filled = filled.filter("size(filling) = size(array_distinct(filling.own))").groupBy(ROW, "item", "coverable", "filling")
    filled = filled.agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    state = F.struct(F.expr(_covered("array_sort(ats)", width)).alias("covered"), "ats", "slots", "filling")
    pairs = filled.groupBy(ROW, "item", "coverable").agg(F.sort_array(F.collect_list(state), asc=False).alias("single"))

    def joined(states: Column, one: Column) -> Column:
        agree = F.filter(states, lambda a: F.size(F.array_union(a["filling"], one["filling"])) == F.size(F.array_distinct(F.array_union(a["filling"], one["filling"])["own"])))
        more = F.transform(
            agree,
            lambda a: F.struct(
                F.size(F.array_distinct(F.flatten(F.transform(F.array_union(a["ats"], one["ats"]), lambda x: F.sequence(x, x + (width - 1)))))).alias("covered"),
                F.array_union(a["ats"], one["ats"]).alias("ats"), F.array_union(a["slots"], one["slots"]).alias("slots"), F.array_union(a["filling"], one["filling"]).alias("filling"),
            ),
        )
        return F.slice(F.sort_array(F.concat(states, F.array(one), more), asc=False), 1, STATES)

    alone = F.col("single")[0]
    together = F.aggregate("single", F.slice("single", 1, 0), joined)[0]
    best = F.when((alone["covered"] >= share * F.col("coverable")) | (F.size("single") == 1), alone).otherwise(together)
    return pairs.select(ROW, "item", "coverable", best.alias("best")).filter(F.col("best.covered") >= share * F.col("coverable"))


def _whole(keyed: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(row key, item, n) of items that a row holds as a whole, token by token with the values of its numbers; found by their first tokens."""
    tokens = items.select("item", template_tokens(F.col("text"), keep=True, names=False).alias("it")).filter("size(it) > 0")
    heads = materialize(tokens.withColumn("k", F.least(F.lit(width), F.size("it"))).select("item", "it", "k", F.xxhash64(F.expr("slice(it, 1, k)")).alias("h")))
    texts = keyed.select(ROW, template_tokens(F.col("text"), keep=True, names=False).alias("dt"))
    found = None
    for k in sorted(r["k"] for r in heads.select("k").distinct().collect()):  # at most ``width`` rows
        table = heads.filter(F.col("k") == k).select("h", "item", "it")
        windows = texts.select(ROW, "dt", F.posexplode(window_hashes("dt", k)).alias("pos", "h"))
        met = _looked_up(windows, table, table.count()).filter("slice(dt, pos + 1, size(w.it)) = w.it").select(ROW, "w.item", F.size("w.it").alias("n"))
        found = met if found is None else found.union(met)
    return found if found is None else found.distinct()


def find_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, covered, coverage, n_slots, n_changed) of every pair that counts."""
    keyed = row_keyed(docs.select("doc_id", "text"))
    ids = keyed.select(ROW, "doc_id")
    found = contaminated_rows(keyed, benchmark, width, literals, share)
    return found.join(ids, ROW).select("doc_id", *[c for c in found.columns if c != ROW])


def contaminated_rows(keyed: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """As ``find_contaminated``, with the row key (``row_keyed``) in place of doc_id."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()))
    rest, parts = items, []
    for names in (True, False):
        table = materialize(benchmark_windows(items, names, width, literals))
        rest = rest.join(table.select("item").distinct(), "item", "left_anti")
        best = _consistent(keyed, items, _alignments(keyed, table, names, width, share), names, width, share)
        changed = F.filter("best.slots", lambda s: s["own"] != s["other"])["at"]
        parts.append(
            best.select(
                ROW, "item", F.col("best.covered").cast("long").alias("covered"), F.round(F.col("best.covered") / F.col("coverable"), 6).alias("coverage"),
                F.size(F.array_distinct("best.slots.at")).cast("long").alias("n_slots"), F.size(F.array_distinct(changed)).cast("long").alias("n_changed"),
            )
        )
    out = parts[0].union(parts[1])
    whole = _whole(keyed, rest, width)
    if whole is not None:
        none = F.lit(0).cast("long")
        out = out.union(whole.select(ROW, "item", F.col("n").cast("long"), F.lit(1.0), none, none))
    # Of both ways the one that covers more, and of several texts of an item the best.
    values = F.struct("coverage", "covered", -F.col("n_changed"), "n_slots", "n_changed")
    out = out.join(items.select("item", "item_id"), "item").groupBy(ROW, "item_id").agg(F.max(values).alias("v"))
    return out.select(ROW, "item_id", "v.covered", "v.coverage", "v.n_slots", "v.n_changed")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item."""
    keyed = row_keyed(docs)
    found = materialize(contaminated_rows(keyed, benchmark).select(ROW).distinct())
    return few_or_shuffled(keyed, found, ROW, "left_anti").select(*docs.columns)
