"""Jaccard join, decontamination, PII and HTML by brute force and planted cases."""

import random
from collections import defaultdict

import pytest

from pulsegrid.llm import decontaminate, html, jaccard, pii


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("limit", [10**9, 3000])
def test_components(spark, limit):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 20, 60, 150]))] for _ in range(12)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(300):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(b) // 20)):
            b[rng.randrange(len(b))] = rng.choice(vocab)
        if rng.random() < 0.3:
            b = b + passage
        if rng.random() < 0.1:
            b = [rng.choice(vocab) for _ in range(rng.randrange(0, 50))] + passage
        rows.append((i * 7 % 1000, " ".join(b)))
    rows += [(2001, None), (2002, ""), (2003, "  "), (2004, "One two"), (2005, "one TWO"), (2006, "one")]
    want = brute_components(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, set_key int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, limit).collect()}
    assert got == want
    if limit > 3000:
        kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
        assert kept == {c for _, c in want.values()}


def test_join_edge_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard.jaccard_join(spark.createDataFrame([], schema)).count() == 0
    t = "one two three four five six seven eight"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "other words here entirely"), (None, "a b c d e")], schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()), key=repr)
    assert got == sorted([(None, 5, 5), (5, 5, 5), (5, 5, 5), (5, 1, 5), (None, 2, None)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=repr)
    assert kept == sorted([(5, t), (5, "other words here entirely"), (None, "a b c d e")], key=repr)


def edits_within(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(prev[j - 1] + (c != d), prev[j] + 1, now[j - 1] + 1))
        prev = now
    return min(prev)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    syllables = ["the", "an", "tion", "er", "in", " ", "re", "of ", " on", "ed"]

    def prose(n):
        return "".join(rng.choice(syllables) for _ in range(n))

    def edit(t, k):
        t = list(t)
        for _ in range(k):
            p, o = rng.randrange(len(t)), rng.randrange(3)
            t[p : p + 1] = [["x"], [], [t[p], "y"]][o]
        return "".join(t)

    items = [(i, prose(rng.randrange(30, 90))) for i in range(8)] + [(100, None), (102, "")]
    docs = []
    for d in range(60):
        t = prose(rng.randrange(0, 120))
        if rng.random() < 0.6:
            it = rng.choice(items[:8])[1]
            t += " " + edit(it, rng.randrange(0, int(len(it) * 0.11) + 1)).upper() + "\n" + prose(rng.randrange(0, 60))
        docs.append((d, t))
    docs += [(200, None), (201, ""), (None, items[0][1]), (3, items[1][1])]
    index = decontaminate.Index([(i, decontaminate.normal(t)) for i, t in items])
    want = set()
    for d, t in docs:
        for k, (i, it) in enumerate(index.items):
            n = edits_within(it, decontaminate.normal(t))
            if n <= index.edits[k]:
                want.add((d, i, n))
    frame = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == want and want
    small = decontaminate.BLOCK_CHARS
    try:
        decontaminate.BLOCK_CHARS = 200
        assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(frame, bench).collect()} == want
    finally:
        decontaminate.BLOCK_CHARS = small
    clean = decontaminate.clean_documents(frame, bench).collect()
    texts = {t for d, t in docs if not any(edits_within(it, decontaminate.normal(t)) <= index.edits[k] for k, (_, it) in enumerate(index.items))}
    assert {r.text for r in clean} == texts
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0 and decontaminate.leaks(frame.limit(0), bench).count() == 0


def luhn(n):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(n))) % 10


def test_surrogates(spark):
    rows = [
        (1, "Call +1 (988) 555-2485 or 988-555-2485, Mrs. Anna Smith, card 4041894974608795 and 4041 8949 7460 8795."),
        (2, None), (3, ""), (4, "bosbt.42@mail8.example.com BOSBT.42@MAIL8.EXAMPLE.COM 42.144.35.254."), (5, "clean 4.0 text"), (6, "42.144.35.254"),
        (7, "IBAN GB82 WEST 1234 5698 7654 32 ok, 123-45-6789; Herr Müller, госпожа Иванова"), (8, 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'), (1, "dup Mrs Anna Smith"), (None, "42.144.35.254"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, key int")
    got = pii.replace_mentions(df).collect()
    assert len(got) == len(rows) and got[0].key == 9
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    for k in (2, 3, 5, 8):
        assert by[k] == [t for d, t in rows if d == k]
    one = next(t for t in by[1] if t.startswith("Call"))
    assert one.startswith("Call +1 (") and "555-2485" not in one and "Smith" not in one and "8795" not in one
    area = one[9:12]
    assert f"or {area}-" in one  # coreference across formats
    card = one.split("card ")[1].split(" ")[0]
    assert card[0] == "4" and luhn(card) == luhn("4041894974608795") and " ".join(card[k : k + 4] for k in range(0, 16, 4)) in one
    name = one.split("Mrs. ")[1].split(",")[0]
    assert name.split()[0][-1] in "ae" and any(name in t for t in by[1] if t.startswith("dup"))
    mail = by[4][0].split(" ")
    assert mail[0].upper() == mail[1] and mail[0].endswith(".com") and mail[0] != "bosbt.42@mail8.example.com"
    assert by[6] == by[None] and by[6][0] + "." == mail[2]
    iban = by[7][0].split("IBAN ")[1][:27].replace(" ", "")
    assert iban[:2] == "GB" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "госпожа " in by[7][0] and "Иванова" not in by[7][0] and all("а" <= c.lower() <= "я" for c in by[7][0].split("госпожа ")[1])
    assert pii.replace_mentions(df.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    from pyspark.sql import functions as F

    # nearly all two-letter addresses at one host: draws collide and must be redrawn
    names = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"]
    ents = spark.createDataFrame([("email", f"{n}@h.com") for n in names], "kind string, entity string")
    got = pii.surrogate_table(ents).collect()
    assert len({r.surrogate for r in got}) == len(names) and not {r.surrogate for r in got} & {r.entity for r in got}
    assert ents.select(F.count("*")).first()[0] == len(got)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a<p>b<ul><li>x<li>y<ol start=3><li>q<li>z</ol></ul>after", "a\n\nb\n\n- x\n- y\n  3. q\n  4. z\n\nafter"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>both</table>t", "Name      | N\nlong name | 1\nboth\n\nt"),
        ("<div hidden>no</div><span style='display: none'>no</span>yes<br>line2<pre>\n a  b\n  c</pre>x", "yes\nline2\n\n a  b\n  c\n\nx"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
        ("<head><title>t</title><script>x()</script></head><body>a &amp; b<!-- c --></body>", "a & b"),
        ("<b>one</b> <i>two</i>\n three", "one two three"),
        ("", ""),
    ],
)
def test_html(page, text):
    assert html.html_text(page)[0] == text


def test_html_table(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "<p>x", 0), (3, "<p>x", 0), (None, "<div>" * 5000 + "deep", 0)]
    got = sorted(((r.page_id, r.text, r.n_blocks) for r in html.render_pages(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()), key=repr)
    assert got == sorted([(1, None, 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (None, "deep", 1)], key=repr)
