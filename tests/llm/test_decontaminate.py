
from hypothesis import given, settings
from hypothesis import strategies as st

from tessarine.llm import decontaminate as d
from tests.llm.fixtures import frame, odd_documents, prose, with_clashes


def plain_tiles(item, doc, least):
    """Greedy string tiling over words, all pairs of places each round."""
    marked_i, marked_d, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n] and q + n not in marked_i and p + n not in marked_d:
                    n += 1
                if n > best[0]:
                    best = (n, q, p)
        if best[0] < least:
            return total
        n, q, p = best
        total += n
        marked_i.update(range(q, q + n))
        marked_d.update(range(p, p + n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=3, max_size=24), st.lists(st.sampled_from("abc"), max_size=40))
def test_tiling_of_seeds_is_tiling_of_words(item, doc):
    size = 3
    seeds = lambda w: [(i, hash(tuple(w[i : i + size]))) for i in range(len(w) - size + 1)]
    shared = {s for _, s in seeds(item)}
    tiles = d.tile(seeds(item), [x for x in seeds(doc) if x[1] in shared], size)
    assert sum(t[2] for t in tiles) == plain_tiles(item, doc, size)


def tables(spark):
    item, other = prose(50, 40), prose(51, 30)
    half = item.split()
    reordered = " ".join(half[25:] + ["between", "them"] + half[:12] + ["and"] + half[12:25])
    docs = odd_documents() + [
        (60, f"{prose(60, 50)} {item.upper()}, {prose(61, 50)}"), (61, prose(62, 30) + " " + reordered), (62, " ".join(half[:8]) + " " + prose(63, 60)),
        (63, f"{item} {other}"), (63, f"{item} {other}"), (64, "a b"), (65, prose(64, 20_000) + " " + other),
    ]
    bench = [(1, item), (2, other), (3, "a b"), (4, ""), (5, None), (6, prose(52, 25)), (None, item)]
    return frame(spark, docs), frame(spark, bench, "item_id long, text string")


def test_planted_passages(spark):
    docs, bench = tables(spark)
    got = {r.doc: r["items"] for r in d.contaminated(with_clashes(docs), with_clashes(bench)).collect()}
    assert got == {60: [1], 61: [1], 63: [1, 2], 64: [3], 65: [2]}


def test_coverages_against_plain_version(spark):
    docs, bench = tables(spark)
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    got = {(r.doc, r.item): round(r.coverage, 9) for r in d.matches(docs.where("doc_id >= 60 and doc_id < 64"), bench).collect()}
    want = {}
    for r in docs.where("doc_id >= 60 and doc_id < 64").collect():
        for b in bench.where("item_id is not null").collect():
            if words(b.text):
                c = plain_tiles(words(b.text), words(r.text), min(5, len(words(b.text)))) / len(words(b.text))
                if c:
                    want[r.doc_id, b.item_id] = round(c, 9)
    assert got == want


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, bench = tables(spark)
    wide = with_clashes(docs)
    out = d.decontaminate(wide, bench)
    assert out.columns == wide.columns
    assert out.count() == docs.where("doc_id is null or doc_id not in (60, 61, 63, 64, 65)").count()
    assert d.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert d.decontaminate(docs.limit(0), bench).count() == 0


def test_small_bitmap_gives_the_same(spark):
    docs, bench = tables(spark)
    rows = lambda b: sorted((r.doc, r.item, r.coverage) for r in d.matches(docs, bench, bits=b).where("doc is not null").collect())
    assert rows(8) == rows(20)


def words_of(text):
    """Letters and digits of any script, case folded."""
    return "".join(c if c.isalnum() else " " for c in text.upper().lower()).split()


def test_punctuation_and_case_beyond_ascii(spark):
    """Verbatim items with curly quotes, dashes and an ellipsis, and in capitals with ß and É, against the plain tiling."""
    item = "Die Straße am Fluß führt über die Brücke bis zum Café Élysée und weiter"
    fancy = f"\u201c{item.replace(' ', chr(0x2014), 2)}\u2026\u201d"
    rows = [(1, f"{prose(80, 30)} {fancy} {prose(81, 30)}"), (2, f"{prose(82, 30)} {item.upper()}! {prose(83, 30)}"), (3, f"{prose(84, 30)}\u00ab{item}\u00bb{prose(85, 30)}"), (4, prose(86, 60) + " \u2014 \u00e9t\u00e9")]
    items = [(1, item), (2, "\u0434\u043e\u043c \u0443 \u0440\u0435\u043a\u0438 \u0438 \u043c\u043e\u0441\u0442 \u043d\u0430\u0434 \u043d\u0435\u0439")]
    rows += [(5, f"\u2014{items[1][1].upper()}\u2014")]
    got = {(r.doc, r.item): round(r.coverage, 9) for r in d.matches(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    want = {(k, i): round(c / len(words_of(b)), 9) for k, t in rows for i, b in items if (c := plain_tiles(words_of(b), words_of(t), 5))}
    assert got == want and {k for k, c in want.items() if c == 1} == {(1, 1), (2, 1), (3, 1), (5, 2)}


def test_seeds_common_to_many_items_and_documents(spark):
    """A phrase of a third of all documents and of all items; the salted join and the broadcast one give what plain tiling gives."""
    phrase = "answer the following question with one of these choices"
    items = [(i, f"{phrase} {prose(300 + i, 25)}") for i in range(12)] + [(3, prose(340, 30)), (20, phrase)]
    rows = [(i, f"{prose(400 + i, 40)} {phrase} {prose(500 + i, 10)}") for i in range(40)] + [(100 + i, f"{prose(600 + i, 20)} {items[i][1]}") for i in range(13)]
    rows += [(None, items[2][1]), (7, items[4][1])]
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    for floor in (0.0, 0.6):
        want = {}
        for k, t in rows:
            for i, b in items:
                c = plain_tiles(words_of(b), words_of(t), 5) / len(words_of(b))
                if c and c >= floor:
                    want[k, t, i] = max(want.get((k, t, i), 0), round(c, 9))
        keys = {r.rk: (r.doc_id, r.text) for r in docs.selectExpr("xxhash64(doc_id, text) rk", "*").collect()}
        for how in ({}, {"most_seeds": 0}):
            got = {(*keys[r.rk], r.item): round(r.coverage, 9) for r in d.matches(docs, bench, floor=floor, **how).collect()}
            assert got == want, (floor, how)


def test_column_names_pass_untouched(spark):
    docs, bench = tables(spark)
    wide = docs
    for name in ("rk", "__rk", "doc", "pos", "seed", "copy"):
        wide = wide.selectExpr("*", f"'own {name}' AS `{name}`")
    out = d.decontaminate(wide, bench)
    assert out.columns == wide.columns and all(r[n] == f"own {n}" for r in out.collect() for n in wide.columns[2:])


def test_query_whole_table(spark):
    got = {r.doc_id: r.item_ids for r in d.op6_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").collect()
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    bench = {b.item_id: words(b.text) for b in read("benchmark")}
    want = {}
    for r in read("documents"):
        w = words(r.text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, b in bench.items():
            covered = set()
            for k in range(len(b) - 4):
                if tuple(b[k : k + 5]) in grams:
                    covered |= set(range(k, k + 5))
            if len(covered) >= 0.6 * len(b):
                want.setdefault(r.doc_id, []).append(i)
    assert got == {k: sorted(v) for k, v in want.items()}


def test_items_that_repeat_their_phrases(spark):
    """Few distinct seeds cover an item of repeated phrases; a copy of it, or of a part of it, has the coverage of its words."""
    phrase = " ".join(f"w{i}" for i in range(10))
    item = " ".join([phrase] * 9)
    docs = frame(spark, [(1, f"{prose(70, 40)} {item} {prose(71, 40)}"), (2, f"{prose(72, 40)} {phrase} {prose(73, 40)}"), (3, prose(74, 80))])
    bench = frame(spark, [(1, item)], "item_id long, text string")
    assert {(r.doc, r.coverage) for r in d.contaminated(docs, bench).collect()} == {(1, 1.0)}
    assert sorted(r.doc_id for r in d.decontaminate(docs, bench).collect()) == [2, 3]
