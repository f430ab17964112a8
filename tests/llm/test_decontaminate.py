from __future__ import annotations

import pytest
import regex
from pyspark.sql import functions as F

from pixelseek.llm import decontaminate as d
from tests.llm.helpers import clash, docs, rows

ITEMS = [
    (1, "A train leaves Paris at 30 km per hour and then meets Anna after 12 hours on the way home"),
    (2, "the quick brown fox jumps over the lazy dog while seven old men are watching it from afar"),
    (3, "too short"),
    (4, None),
    (5, ""),
]

DOCS = [
    (1, "Well. " + ITEMS[0][1] + ". Indeed.", "en", "s"),
    (2, "A train leaves Rome at 45 km per hour and then meets Bob after 7 hours on the way home", "en", "s"),
    # Two words are missing.
    (3, "Filler before it. the quick brown fox jumps over the lazy dog while seven old men are watching it", "en", "s"),
    (4, "the quick brown fox jumps over it", "en", "s"),
    (5, None, None, None),
    (6, "", "en", "s"),
    (7, "Too short!", "en", "s"),
    (8, "This text is too short to say", "en", "s"),
    (None, ITEMS[1][1], "en", "s"),
    (9, "word " * 20_000 + ITEMS[1][1] + " word" * 20_000, "en", "s"),
    (9, "word", "en", "s"),
    (None, "clean", "en", "s"),
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items + items[:1], "item_id long, text string")


def brute_tokens(text):
    """Template tokens and slot values, one token at a time."""
    out = []
    for m in regex.finditer(r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{M}]+", text or ""):
        w, before = m[0], (text or "")[max(0, m.start() - 2) : m.start()]
        if w[0].isdigit():
            out.append(("#", w.lower()))
        elif out and out[-1][0] == "#" and w.lower() in d.UNITS and regex.fullmatch(r"(?s).*[\p{Nd}]\s?", text[: m.start()]):
            out.append(("unit", w.lower()))
        elif regex.match(r"\p{Lu}", w) and regex.fullmatch(r"[\p{L}\p{N},;] ", before):
            out.append(("name", w.lower()))
        else:
            out.append((w.lower(), None))
    return out


def brute(docs_, items, window=5, similarity=0.8):
    def windows(text):
        t = brute_tokens(text)
        return [tuple(t[i : i + window]) for i in range(max(1, len(t) - window + 1))] if t else []

    found = set()
    for item, text in items:
        want = windows(text)
        templates = {tuple(x for x, _ in w) for w in want}
        for i, doc, *_ in docs_:
            hit, shifts = set(), {}
            for p, g in enumerate(windows(doc)):
                for q, w in enumerate(want):
                    if [x for x, _ in g] == [x for x, _ in w]:
                        shifts.setdefault(p - q, []).append((g, w))
            for pairs in shifts.values():
                slots = {(a, b) for g, w in pairs for (_, b), (_, a) in zip(g, w) if a is not None}
                consistent = len({a for a, _ in slots}) == len(slots)
                for g, w in pairs:
                    if consistent or all(a is None for _, a in w):
                        hit.add(tuple(x for x, _ in w))
            if templates and len(hit) >= similarity * len(templates):
                found.add((i, item))
    return sorted(found, key=repr)


def test_tokens(spark):
    for text in [t for _, t in ITEMS] + [t for _, t, *_ in DOCS[:9]] + ["It costs 3.50 dollars, Sir John Doe 5kg 7 8"]:
        got = spark.range(1).select(d.slotted(F.lit(text)).alias("s"), d.template(F.lit(text)).alias("t")).first()
        marks = {d.NAME: "name", d.NUMBER: "#", d.UNIT: "unit"}
        assert [(marks.get(x["t"], x["t"]), x["slot"]) for x in got["s"]] == brute_tokens(text)
        assert [x["t"] for x in got["s"]] == list(got["t"])


def test_hashes_of_all_views_at_once(spark):
    """The document's side, token by token, finds the same windows as the item's side, view by view."""
    texts = [t for _, t in ITEMS] + [t for _, t, *_ in DOCS[:9]] + [
        "It costs 3.50 dollars, Sir John Doe 5 Kg 7 8", "5kg 5Kg 5 KG 5  Kg\tKm", "ANNA Anna, Anna; anna \"Anna\" (Bob) O'Brien",
        "Über ein Ärger, Éa 1,000 Euro 7", "\ue001\ue004\ue005 A \ue004B c", "e\u0301Anna iPhone 5Anna Anna5 \U0001d400b", "A", "a 7 Km",
        " \n Two  blanks \u00a0 and \x85 more ",
    ]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {tuple(r) for r in d.view_hashes(rows_, "id").collect()}
    assert got == {tuple(r) for r in d.slot_windows(rows_, "id", d.WINDOW).select("id", "h").collect()}
    assert len(got) > 100


@pytest.mark.parametrize("limit", [d.MAX_BROADCAST_ROWS, 0])
def test_pairs(spark, checkpoint_dir, limit):
    got = d.contaminated_pairs(clash(docs(spark, DOCS), F), bench(spark), max_broadcast_rows=limit)
    pairs = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    assert sorted(pairs, key=repr) == brute(DOCS, ITEMS)
    assert set(pairs) == {(1, 1), (2, 1), (3, 2), (7, 3), (None, 2), (9, 2)}
    assert not pairs[1, 1]["changed"] and pairs[2, 1]["changed"]
    assert pairs[1, 1]["coverage"] == 1.0 and 0.8 <= pairs[3, 2]["coverage"] < 1


def test_inconsistent_slots_do_not_count(spark, checkpoint_dir):
    item = [(1, "add 5 and 5 and 5 and 5 and 5 and 5 to get the sum")]
    same = [(1, "add 7 and 7 and 7 and 7 and 7 and 7 to get the sum", "en", "s")]
    other = [(2, "add 1 and 2 and 3 and 4 and 5 and 6 to get the sum", "en", "s")]
    got = d.contaminated_pairs(docs(spark, same + other), spark.createDataFrame(item, "item_id long, text string"))
    assert [(r["doc_id"], r["changed"]) for r in got.collect()] == [(1, True)] and brute(same + other, item) == [(1, 1)]


def test_drop(spark, checkpoint_dir):
    table = clash(docs(spark, DOCS), F)
    kept = d.drop_contaminated(table, bench(spark))
    assert kept.columns == table.columns
    assert rows(kept, "doc_id") == sorted([(4,), (5,), (6,), (8,), (9,), (None,)], key=repr)


def test_empty(spark, checkpoint_dir):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated_pairs(docs(spark, []), bench(spark)).count() == 0
    assert d.contaminated_pairs(docs(spark, DOCS), nothing).count() == 0
    assert d.drop_contaminated(docs(spark, DOCS), nothing).count() == len(DOCS)


def brute_most_agreed(doc, item, window=5):
    """Share of the item's windows: unchanged ones, and those that hold only the most frequent value of each slot."""
    def windows(text):
        t = brute_tokens(text)
        return [tuple(t[i : i + window]) for i in range(max(1, len(t) - window + 1))] if t else []

    want, hit = windows(item), set()
    shifts = {}
    for p, g in enumerate(windows(doc)):
        for q, w in enumerate(want):
            if [x for x, _ in g] == [x for x, _ in w]:
                slots = {((k, a), (k, b)) for (_, b), (k, a) in zip(g, w) if a is not None}
                shifts.setdefault(p - q, []).append((w, slots))
    for found in shifts.values():
        votes = {}
        for _, slots in found:
            for a, b in slots:
                votes.setdefault(a, {}).setdefault(b, 0)
                votes[a][b] += 1
        kept = {a: max(v, key=lambda b: (v[b], a == b, b)) for a, v in votes.items()}
        for w, slots in found:
            if all(a == b for a, b in slots) or all(kept[a] == b for a, b in slots):
                hit.add(tuple(x for x, _ in w))
    return len(hit) / len({tuple(x for x, _ in w) for w in want})


REPEATED = (
    "every morning 2 farmers walk down to the old mill and carry back heavy sacks of flour which they sell to a baker"
    " at the corner of our street for 40 coins before they return home where dinner has been waiting since noon and"
    " the younger one of them counts what is left after paying 2 helpers for loading each cart with fresh golden hay"
)


def test_one_changed_value_of_several(spark, checkpoint_dir):
    item = [(1, REPEATED)]
    found = [
        (1, REPEATED.replace("2 helpers", "3 helpers"), "en", "s"),
        (2, REPEATED.replace("2", "7").replace("7 helpers", "3 helpers"), "en", "s"),
        (3, REPEATED.replace("2 farmers", "3 farmers").replace("40", "50"), "en", "s"),
    ]
    got = d.contaminated_pairs(docs(spark, found), spark.createDataFrame(item, "item_id long, text string"))
    cover = {r["doc_id"]: r["coverage"] for r in got.collect()}
    assert cover == {i: pytest.approx(brute_most_agreed(text, REPEATED)) for i, text, *_ in found}
    assert min(cover.values()) >= 0.8


JANET = (
    "Janet buys 16 eggs for the farm shop. Janet eats three of them at breakfast every day. Janet sells the others at"
    " the market. How much money does she make by evening?"
)
ASKED = (
    "In the year after the war, a teacher from Vienna met Clara and walked along the Danube with Otto until the lamps"
    " of Linz were lit and the ferry had left"
)


def test_names_at_sentence_starts_case_and_wrapping(spark, checkpoint_dir):
    wrapped = ASKED.replace("from Vienna", "from\nVienna").replace("with Otto", "with\nOtto").replace("of Linz", "of  Linz")
    found = [
        (1, JANET.replace("Janet", "Maria"), "en", "s"),
        (2, ASKED.lower(), "en", "s"),
        (3, wrapped, "en", "s"),
        (4, wrapped.replace("Otto", "Paul").replace("Clara", '"Anna'), "en", "s"),
        (5, JANET.lower().replace("16", "17"), "en", "s"),
        (6, ASKED.upper(), "en", "s"),
        (7, JANET.replace("Janet", "My neighbour"), "en", "s"),
        (8, "The war was over. In Vienna Clara met Otto. They left Linz by ferry along the Danube", "en", "s"),
    ]
    items = spark.createDataFrame([(1, JANET), (2, ASKED)], "item_id long, text string")
    got = d.contaminated_pairs(docs(spark, found), items)
    pairs = {r["doc_id"]: (r["item_id"], r["coverage"], r["changed"]) for r in got.collect()}
    whole = {1: (1, 1.0, True), 2: (2, 1.0, False), 3: (2, 1.0, False), 4: (2, 1.0, True), 5: (1, 1.0, True), 6: (2, 1.0, False)}
    assert pairs == whole


def test_views_have_the_same_tokens(spark):
    for text in [JANET, ASKED, ASKED.upper(), "5 KM 5Kg X5 İstanbul ΟΔΟΣ' 3.50 Dollars  Müller's 7 M"]:
        views = [(d.slotted(F.lit(text), v), d.template(F.lit(text), v)) for v in d.VIEWS]
        got = spark.range(1).select(*[c for pair in views for c in pair]).first()
        assert len({len(x) for x in got}) == 1
        for slots, words in zip(got[::2], got[1::2]):
            assert [x["t"] for x in slots] == list(words)


def test_windows_of_equal_views_are_hashed_once(spark):
    """A window counts once for each way it reads, however many views read it so, and texts are cut once."""
    texts = [JANET, ASKED, ASKED.upper(), ASKED.lower(), "Anna met Bob", "one, Two", "", None]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    hashes = d.view_hashes(rows_, "id")
    seen = d.slot_windows(rows_, "id", d.WINDOW).select("id", "pos", "h")
    assert sorted(map(tuple, hashes.collect())) == sorted((r["id"], r["h"]) for r in seen.distinct().collect())
    assert hashes._jdf.queryExecution().executedPlan().toString().count("split(lower(") == 1


def test_runs_of_white_space_of_any_kind(spark):
    """The document's side takes white space as it is, the item's side makes each run one blank."""
    blanks = [" ", "\n", " \n ", "\u00a0", "  ", "\x85\t", "\u2003\u2028 ", "\x0b\u3000"]
    parts = ["{0}Anna{0}met,{0}Bob;{0}Clara.{0}Otto", "a{0}5{0}Kg{0}7{0}8{0}kg{0}9{0}{0}Days{0}", "5{0}Anna{0}\u0660{0}km\"{0}Eve", "{0}"]
    texts = [p.format(b) for p in parts for b in blanks]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {tuple(r) for r in d.view_hashes(rows_, "id").collect()}
    assert got == {tuple(r) for r in d.slot_windows(rows_, "id", d.WINDOW).select("id", "h").collect()}
    assert len(got) > 100


def test_wanted_windows_only(spark):
    """Slots are made for the windows asked for, which are those of the whole table with these hashes."""
    texts = [JANET, ASKED, ASKED.upper(), "5 kg", "", None]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    every = d.slot_windows(rows_, "id", d.WINDOW)
    wanted = every.select("h").distinct().filter("h % 3 = 0")
    got = d.slot_windows(rows_, "id", d.WINDOW, wanted)
    assert got.columns == ["id", "pos", "w", "h", "slots"]
    assert sorted(map(tuple, got.select(*every.columns).collect())) == sorted(map(tuple, every.filter("h % 3 = 0").collect()))
    assert 0 < got.count() < every.count()
