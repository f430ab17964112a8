"""Benchmark decontamination by template windows.

Numbers, units after numbers and names become typed placeholders; the rest is lower-cased words. White space counts as
one blank. What is a name can't be told from one place alone, so there are three views of each text: names are the
capitalised words inside a sentence, or all capitalised words, or none. Views have the same tokens at the same places.
A window of an item stands in a document where any view of the one equals any view of the other, so neither the start
of a sentence nor quotes, wrapping or case hide a passage. A pair of document and benchmark item counts when at least
``similarity`` of the item's windows of ``window`` tokens, distinct by the first view, stand in the document. Windows with the item's own slot values always count.
Others count where they are consistent with their alignment: in it, each slot value of the item stands for one value of
the document, the one that most of its windows hold. So passages whose numbers or names were changed, throughout or in
places, are found, and mere look-alikes of filled-in forms are not.

Search in two passes. Whoever holds a share s of n windows holds at least one of any n - ceil(s n) + 1 of them, so every
item is looked up by that many windows only, its rarest in the benchmark, in all views. The documents found are read again and
checked window by window.

Defined cases: null and empty texts, and items without a word, match nothing; a text of fewer words than a window has
one window, the whole sequence; a row is known by doc_id (null included) and a hash of its text, rows that repeat both
are judged as one, and other texts of an id by themselves; repeated items are one item per item_id; empty tables give no pairs; ``drop_contaminated`` returns the columns of its input unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseek.llm.common import broadcast_if_small, stored

WINDOW = 5
SIMILARITY = 0.8
#: Anchor and window tables up to this many rows (some 60 MB) are broadcast, larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000

# Units that are recognised after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs"
    " hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp"
    " mph kmh kb mb gb tb hz khz mhz ghz w kw mw v a j kj kcal cal pa kpa meter meters metre metres kilometer"
    " kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles inch inches"
    " foot feet pound pounds ounce ounces degree degrees"
).split()

# Marks of placeholders: private-use characters, removed from the texts first.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
# In front of a token: it is capitalised, and it is so inside a sentence.
CAPITALISED, WITHIN = "\ue004", "\ue005"
_WORD = r"[\p{L}\p{M}]+"
_BLANK = r"[\s\p{Z}\x{85}]"
_NAME = rf"(?<=[\p{{L}}\p{{N}},;] )(?=\p{{Lu}})({_WORD})"
_NUMBER = r"(\p{Nd}+(?:[.,]\p{Nd}+)*)"
_CAPITAL = rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})({_WORD})"
# Views, by what a name is; the first is the one by which an item's windows are counted.
INSIDE, CAPITAL, NO_NAME = VIEWS = (_NAME, _CAPITAL, None)
_UNIT_OR_NAME = (
    rf"(?i)({NUMBER}{_BLANK}*+)((?:{CAPITALISED}{WITHIN}?)?)"
    rf"(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])"
)
_UNIT = rf"(?i)({NUMBER}[\p{{Nd}}.,]*\s{{0,2}})({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])"


def _unmarked(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    # All marks begin with the same two bytes, which few texts hold.
    marked = F.contains(t.cast("binary"), F.lit(NAME.encode()[:2]))
    return F.when(marked, F.translate(t, NAME + NUMBER + UNIT + CAPITALISED + WITHIN, "")).otherwise(t)


def _bare(text: Column) -> Column:
    """The text without marks, each run of white space as one blank; single blanks, the most, are no match."""
    return F.regexp_replace(_unmarked(text), F.lit(rf"{_BLANK}(?:{_BLANK}+|(?<! ))"), F.lit(" "))


def _names(text: Column, view: str | None, by: str) -> Column:
    return text if view is None else F.regexp_replace(text, F.lit(view), F.lit(by))


def _marked(text: Column, view: str | None) -> Column:
    """The lower-cased text with each slot behind its mark."""
    t = _names(_bare(text), view, NAME + "$1")
    t = F.regexp_replace(t, F.lit(_NUMBER), F.lit(f" {NUMBER}$1 "))
    return F.lower(F.regexp_replace(t, F.lit(_UNIT), F.lit(f"$1 {UNIT}$2")))


def _template(bare: Column, view: str | None) -> Column:
    t = _names(bare, view, f" {NAME} ")
    t = F.regexp_replace(t, F.lit(_NUMBER), F.lit(f" {NUMBER} "))
    t = F.regexp_replace(t, F.lit(_UNIT), F.lit(f" {NUMBER} {UNIT} "))
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{M}}{NAME}{NUMBER}{UNIT}]+"), lambda w: w != "")


def template(text: Column, view: str | None = INSIDE) -> Column:
    """Template tokens: lower-case words and the marks of placeholders."""
    return _template(_bare(text), view)


def slotted(text: Column, view: str | None = INSIDE) -> Column:
    """array<struct<t, slot>>: the tokens of ``template`` with the value of each placeholder."""
    tokens = F.regexp_extract_all(
        _marked(text, view),
        F.lit(rf"{NAME}{_WORD}|{NUMBER}\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|{UNIT}{_WORD}|{_WORD}"),
        F.lit(0),
    )

    def token(x: Column) -> Column:
        first = F.substring(x, 1, 1)
        slot = first.isin(NAME, NUMBER, UNIT)
        return F.struct(
            F.when(slot, first).otherwise(x).alias("t"), F.when(slot, F.substring(x, 2, 1 << 30)).alias("slot")
        )

    return F.transform(tokens, token)


def _windows_of(rows: DataFrame, tokens: str, window: int) -> DataFrame:
    """A row, with ``pos``, for each window of the array ``tokens``; a shorter array has one, an empty one none.

    Outer, since an inner explode has a filter on the array's size put in front that makes the array twice."""
    at = rows.select("*", F.posexplode_outer(tokens).alias("pos", "first"))
    return at.filter(F.col("pos") <= F.greatest(F.size(tokens) - window, F.lit(0)))


def _part(tokens: str, window: int) -> list[Column]:
    """The elements of the window at ``pos``, null beyond the end."""
    return [F.get(tokens, F.col("pos") + k) for k in range(window)]


def _hash(tokens: str, window: int) -> Column:
    """Of the window at ``pos``, from its tokens' hashes."""
    return F.xxhash64(*_part(tokens, window))


def _view_tokens(text: Column) -> Column:
    """The tokens of all views at once: those without names, behind marks where other views may have a name.

    Runs of white space are taken as they are, which saves the pass that makes them one blank."""
    within = rf"{_BLANK}(?<=[\p{{L}}\p{{N}},;]{_BLANK}){_BLANK}*+(?=\p{{Lu}})"
    t = F.regexp_replace(_unmarked(text), F.lit(within), F.lit(f" {CAPITALISED}{WITHIN}"))
    t = F.regexp_replace(t, F.lit(rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}{WITHIN}])"), F.lit(CAPITALISED))
    t = F.regexp_replace(t, F.lit(_NUMBER), F.lit(f" {NUMBER} "))
    t = F.regexp_replace(t, F.lit(_UNIT_OR_NAME), F.lit(f"$1 $2{UNIT} "))
    marks = NAME + NUMBER + UNIT + CAPITALISED + WITHIN
    return F.array_remove(F.split(F.lower(t), rf"[^a-z\p{{L}}\p{{M}}{marks}]+"), "")


def view_hashes(rows: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """(key, h) of the windows of the texts in all views, equal ones of a text not yet merged.

    A token is hashed once, a window from the hashes of its tokens. Windows are hashed behind the explode, in
    generated code: array lambdas are interpreted."""
    name = F.xxhash64(F.lit(NAME))

    def kind(t: Column) -> Column:
        """0: never a name, 1: a capital, 2: one inside a sentence; as many marks stand in front."""
        return F.when(t.startswith(CAPITALISED), F.when(t.startswith(CAPITALISED + WITHIN), 2).otherwise(1)).otherwise(0)

    def word(t: Column, k: Column) -> Column:
        return F.xxhash64(F.when(k > 0, F.substring(t, k + 1, F.lit(1 << 30))).otherwise(t))

    tokens = rows.select(key, _view_tokens(F.col("text")).alias("ts"))
    tokens = tokens.select(key, "ts", F.transform("ts", kind).alias("kinds"))
    words = tokens.select(key, "kinds", F.zip_with("ts", "kinds", word).alias("words"))
    at = _windows_of(words, "words", window)

    def hashed(least: int) -> Column:
        """Names are the tokens of at least this kind."""
        parts = zip(_part("kinds", window), _part("words", window))
        return F.xxhash64(*[F.when(k >= least, name).otherwise(w) for k, w in parts])

    views = at.select(key, hashed(2).alias("inside"), hashed(1).alias("capital"), hashed(3).alias("none"))

    def other(view: str) -> Column:
        return F.when(F.col(view) != F.col("inside"), F.col(view))

    return views.select(key, F.explode(F.array("inside", other("capital"), other("none"))).alias("h")).filter("h IS NOT NULL")


def slot_windows(rows: DataFrame, key: str, window: int, wanted: DataFrame | None = None) -> DataFrame:
    """(key, pos, w, h, slots) of every window of the texts in each view, by slot-carrying tokens; w: h of the first view.

    Views of a window that are equal are one row. With ``wanted``, a table of h that fits a broadcast, only those rows;
    slots of others are not made."""
    texts = rows.select(key, *[slotted(F.col("text"), view).alias(f"v{i}") for i, view in enumerate(VIEWS)])

    def hashes(view: str) -> Column:
        return F.transform(view, lambda x: F.xxhash64(x["t"]))

    def values(view: str) -> Column:
        # A unit and a name of equal letters are two values.
        return F.transform(view, lambda x: F.coalesce(F.concat(x["t"], x["slot"]), F.lit("")))

    views = [f"v{i}" for i in range(len(VIEWS))]
    texts = texts.select(key, *[hashes(v).alias(f"h{v}") for v in views], F.array(*[values(v) for v in views]).alias("values"))
    at = _windows_of(texts, "hv0", window)
    at = at.select(key, "pos", "values", *[_hash(f"h{v}", window).alias(v) for v in views])
    seen = [
        F.when(F.lit(i == 0) | (F.col(v) != F.col("v0")), F.struct(F.lit(i).alias("view"), F.col(v).alias("h")))
        for i, v in enumerate(views)
    ]
    at = at.select(key, "pos", "values", F.col("v0").alias("w"), F.explode(F.array(*seen)).alias("v")).filter("v IS NOT NULL")
    at = at.select(key, "pos", "values", "w", "v.view", "v.h")
    if wanted is not None:
        at = at.join(F.broadcast(wanted.select("h")), "h", "left_semi")
    part = [F.coalesce(F.get(F.get("values", F.col("view")), F.col("pos") + k), F.lit("")) for k in range(window)]
    return at.select(key, "pos", "w", "h", F.array_remove(F.array(*part), "").alias("slots"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(item_id, item_pos, w, h, item_slots, n, anchor) of the items' windows in each view.

    n: distinct windows w, anchor: looked up first."""
    items = benchmark.select(F.col("item_id"), F.col("text")).distinct()
    windows = slot_windows(items, "item_id", window)
    per = windows.select("item_id", "w", "h").distinct()
    shared = per.groupBy("h").agg(F.count_distinct("item_id").alias("items"))
    # A window is as rare as the commonest of its views.
    rare = per.join(shared, "h").groupBy("item_id", "w").agg(F.max("items").alias("items"))
    # An item's windows are bounded by its own text.
    ordered = rare.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("items", "w"))).alias("ws"))
    size = F.size("ws")
    ranked = ordered.select("item_id", size.alias("n"), F.posexplode("ws").alias("place", "x")).select(
        "item_id",
        "n",
        F.col("x.w").alias("w"),
        (F.col("place") < F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).alias("anchor"),
    )
    return windows.join(ranked, ["item_id", "w"]).select(
        "item_id", F.col("pos").alias("item_pos"), "w", "h", F.col("slots").alias("item_slots"), "n", "anchor"
    )


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, coverage, n_windows, changed) of contaminated documents; changed: with other slot values."""
    pairs = _pairs(docs, benchmark, window, similarity, max_broadcast_rows)
    return pairs.select("doc.doc_id", "item_id", "coverage", "n_windows", "changed")


def _key(docs: DataFrame) -> Column:
    """What a row is known by: equal where both fields are, nulls included."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("h"))


def _pairs(docs: DataFrame, benchmark: DataFrame, window: int, similarity: float, max_broadcast_rows: int) -> DataFrame:
    docs = docs.select(_key(docs).alias("doc"), "text")
    items = stored(benchmark_windows(benchmark, window, similarity), "items")
    anchors = broadcast_if_small(items.filter("anchor").select("h", "item_id").distinct(), max_broadcast_rows)
    found = stored(
        view_hashes(docs, "doc", window).join(anchors, "h").select("doc", "item_id").distinct(), "candidates"
    )
    again = docs.join(broadcast_if_small(found.select("doc").distinct(), max_broadcast_rows), "doc", "left_semi")
    hashes = items.select("h").distinct()
    small = hashes.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    windows = slot_windows(again, "doc", window, hashes if small else None).drop("w")
    named = found.join(broadcast_if_small(items, max_broadcast_rows), "item_id")
    hits = windows.join(named, ["doc", "h"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    hits = hits.withColumn(
        "pairs",
        F.array_distinct(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))),
    )
    hits = stored(hits.select("doc", "item_id", "n", "shift", "pos", "w", "pairs"), "hits")
    same = F.forall("pairs", lambda p: p["item"] == p["doc"])
    agreed = F.forall("pairs", lambda p: F.element_at("kept", p["item"]) == p["doc"])
    counted = hits.join(_kept_values(hits), ["doc", "item_id", "shift"], "left").filter(
        same | F.coalesce(agreed, F.lit(False))
    )
    return (
        counted.groupBy("doc", "item_id", "n")
        .agg(F.size(F.collect_set("w")).alias("n_windows"), F.max(~same).alias("changed"))
        .filter(F.col("n_windows") >= F.ceil(F.col("n") * similarity - 1e-9))
        .select("doc", "item_id", (F.col("n_windows") / F.col("n")).alias("coverage"), "n_windows", "changed")
    )


def _kept_values(hits: DataFrame) -> DataFrame:
    """(doc, item_id, shift, kept) of alignments with slots: for each item value the document's value of most windows.

    Of equally many, the unchanged value is kept, then the largest."""
    alignment = ["doc", "item_id", "shift"]
    votes = (
        hits.select(*alignment, "pos", F.explode("pairs").alias("p"))
        .groupBy(*alignment, "p")
        .agg(F.count_distinct("pos").alias("windows"))
    )
    best = votes.groupBy(*alignment, F.col("p.item").alias("value")).agg(
        F.max(F.struct("windows", (F.col("p.item") == F.col("p.doc")).alias("same"), F.col("p.doc").alias("doc_value"))).alias("b")
    )
    # An item's values are bounded by its own text.
    return best.groupBy(*alignment).agg(
        F.map_from_entries(F.collect_list(F.struct("value", "b.doc_value"))).alias("kept")
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    pairs = _pairs(docs, benchmark, window, similarity, max_broadcast_rows)
    bad = broadcast_if_small(stored(pairs.select(F.col("doc").alias("_bad")).distinct(), "leaks"), max_broadcast_rows)
    return docs.join(bad, _key(docs) == bad["_bad"], "left_anti")
