import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessarine.llm import linededup
from tests.llm.fixtures import WORDS, frame, odd_documents, prose, with_clashes


def plain(rows, depth=3, min_words=5, min_docs=3, share=0.6, common=0.05, copies=False):
    """Texts after dropping, by loops over all lines."""
    seen, count, whole = set(), Counter(), Counter()
    lines = []
    for key, text in rows:
        rk = (key, text)
        for n, line in enumerate((text or "").split("\n")):
            words = linededup.masked(line)
            if len(words) >= min_words:
                lines.append((rk, key, n, (len(words), *words[:depth]), tuple(words), tuple(line.lower().split())))
    for rk, _, _, leaf, words, _ in lines:
        if (rk, words) not in seen:
            seen.add((rk, words))
            whole[leaf] += 1
            for p, w in enumerate(words):
                count[leaf, p, w] += 1
    where, placed = defaultdict(set), []
    for rk, key, n, leaf, words, same in lines:
        template = tuple(w if count[leaf, p, w] >= max(min_docs, common * whole[leaf]) else None for p, w in enumerate(words))
        groups = [(2, same)]
        if sum(w is not None for w in template[depth:]) >= share * max(1, len(words) - depth):
            groups.append((min_docs, leaf, template))
        for g in groups:
            where[g].add(rk)
            placed.append((rk, key, n, g))
    gone, shared, total, spared = defaultdict(set), defaultdict(list), Counter(), set()
    for rk, _, _, _, words, _ in {(x[0], x[2]): x for x in lines}.values() if copies else ():
        total[rk] += len(words)
    done = set()
    for rk, key, n, _, words, same in lines if copies else ():
        keeper = min((k for k, _ in where[2, same] if k is not None), default=None)
        if len(where[2, same]) > 1 and key != keeper and (rk, n) not in done:
            done.add((rk, n))
            shared[rk, keeper].append((n, len(words)))
    for (rk, _), own in shared.items():
        part = sum(w for _, w in own)
        if 2 * part >= total[rk] or len(own) > 1 and 5 * part >= total[rk]:
            spared |= {(rk, n) for n, _ in own}
    for rk, key, n, g in placed:
        if (rk, n) in spared:
            continue
        keepers = [k for k, _ in where[g] if k is not None]
        if len(where[g]) >= g[0] and key != (min(keepers) if keepers else None):
            gone[rk].add(n)
    return [(k, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k, t])) for k, t in rows]


def cases():
    boiler = "All content on this page is provided as is"
    stamped = "Posted on {} by user {} in the news section"
    rows = [(i, f"{prose(i, 30)}\n{boiler}\n{prose(500 + i, 25)}\n{stamped.format(f'2024-01-{i:02d}', f'u{i}x')}") for i in range(20, 30)]
    return rows + [(40, boiler), (41, boiler), (41, boiler), (42, boiler + "\n" + boiler), (43, "short line"), (44, "short line"), (45, "short line")] + odd_documents()


def test_against_plain_version(spark):
    rows = cases()
    got = sorted(((r.doc_id, r.text) for r in linededup.line_dedup(with_clashes(frame(spark, rows))).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_what_goes_and_what_stays(spark):
    out = {r.doc_id: r for r in linededup.line_dedup(frame(spark, cases()), counts=True).collect() if r.doc_id}
    assert "All content" in out[20].text and "Posted on" in out[20].text
    assert all("All content" not in out[i].text and "Posted on" not in out[i].text for i in range(21, 30))
    assert all(out[i].n_dropped == 2 and out[i].n_lines == 4 for i in range(21, 30))
    assert out[40].text == "" and out[43].text == "short line" and out[10].n_dropped == 0 and out[8].n_dropped == 0


def test_empty_table_and_null_ids(spark):
    assert linededup.line_dedup(frame(spark, [])).count() == 0
    rows = [(None, "a line of many words that recurs"), (None, "a line of many words that recurs\nx"), (None, "y\na line of many words that recurs")]
    assert sorted(r.text for r in linededup.line_dedup(frame(spark, rows)).collect()) == sorted(t for _, t in rows)


def test_query_whole_table(spark):
    out = linededup.op1_line_dedup(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.text) for r in out) == sorted(plain(rows))


def test_lines_in_two_documents_go_from_the_second(spark):
    line = " ".join(prose(77, 60).split())
    rows = [(5, f"{prose(1, 20)}\n{line}"), (3, f"{line}\n{prose(2, 20)}\n{line}"), (9, line.upper()), (7, "a 1 b 2 c 3 d 4"), (8, "a 5 b 6 c 7 d 8")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(frame(spark, rows)).collect()}
    assert got == {5: prose(1, 20), 3: rows[1][1], 9: "", 7: rows[3][1], 8: rows[4][1]}


def test_fields_generalise_alike_at_every_size(spark):
    """A line with two fields of letters is dropped from all documents but one, whether its fields' values recur or not."""
    letters = str.maketrans("0123456789", "abcdefghij")
    for n in (100, 3000):
        rows = [(i, f"this page was posted by name{i * 13 % 400} from city{i * 17 % 397} and may be shared freely".translate(letters)) for i in range(n)]
        out = linededup.line_dedup(frame(spark, rows)).collect()
        assert sum(r.text != "" for r in out) == 1, n


def test_long_document_is_rewritten_in_linear_time(spark):
    body = "\n".join(f"line of words number x{chr(97 + i % 26)}y{i}" if i % 2 else f"short {i}" for i in range(200_000))
    rows = [(1, body), (2, body), (3, body)]
    began = time.time()
    got = {r.doc_id: r for r in linededup.line_dedup(frame(spark, rows), counts=True).collect()}
    assert got[1].text == body and got[2].n_dropped == 100_000 and got[3].text == "\n".join(x for x in body.split("\n") if x.startswith("short"))
    assert time.time() - began < 90


def test_columns_named_like_those_inside_keep_their_values(spark):
    line = "a line of many words that recurs"
    df = frame(spark, [(i, line) for i in range(4)])
    names = ["rk", "__rk", "gone", "doc", "n", "N_LINES", "n_dropped", "same", "template"]
    for name in names:
        df = df.withColumn(name, F.lit(f"own {name}"))
    out = linededup.line_dedup(df, counts=True)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped_"]
    rows = out.collect()
    assert all(r[name] == f"own {name}" for r in rows for name in names) and sorted(r.text for r in rows) == ["", "", "", line]


@pytest.mark.parametrize("copies", [False, True])
def test_copies_against_plain_version(spark, copies):
    """Whole copies, edited copies in pairs and in groups, and documents that share a passage."""
    def doc(seed, n=6):
        return [prose(1000 * seed + i, 30) for i in range(n)]

    rows = cases()
    for c in range(4):
        base = doc(20 + c)
        rows.append((200 + 10 * c, "\n".join(base)))
        for j in range(1, 2 + c):
            own = list(base)
            own[j % 6] = prose(7000 + 10 * c + j, 30)
            own[(j + 3) % 6] += " more"
            rows.append((200 + 10 * c + j, "\n".join(own)))
    rows += [(300, "\n".join(doc(20))), (301, "\n".join([*doc(40), doc(20)[0]])), (302, "\n".join([*doc(41), doc(20)[1]])), (303, doc(20)[2]), (None, "\n".join(doc(21)))]
    got = sorted(((r.doc_id, r.text) for r in linededup.line_dedup(frame(spark, rows), copies=copies).collect()), key=str)
    assert got == sorted(plain(rows, copies=copies), key=str)
    texts = dict(got)
    assert (texts[300] == "\n".join(doc(20))) == copies and (texts[303] == doc(20)[2]) == copies
    assert texts[301] == "\n".join(doc(40)) and (texts[201] == dict(rows)[201]) == copies
