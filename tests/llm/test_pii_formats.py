"""Surrogates keep formats, whole runs are replaced, and texts of any alphabet and length pass."""

import re

import regex

from pulsegrid.llm import pii

from .test_pairs import luhn


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.text for r in sorted(pii.replace_mentions(df, count="n").collect(), key=lambda r: r.i)]


def test_formats_stay(spark):
    out = replaced(
        spark,
        "Mrs Anna-Maria Schmidt-Weber, Mrs Anna Maria Schmidt Weber;",
        "John.Smith@Example.com john.smith@example.com JOHN.SMITH@EXAMPLE.COM",
        "371449635398431 5555555555554444 6011000990139424 4111111111111111",
        "Dear John Smith, Dear Customer, Dear Mr O'Brien and MR nobody, Dr McDonald; Mr SMITH.",
        "ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00.",
        "Mr Abcd Efgh Ijkl Mnop Qrst and so on",
    )
    first, second = out[0][:-1].split(", ")
    assert re.fullmatch(r"Mrs [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+", first) and second == first.replace("-", " ")
    assert not set("Anna Maria Schmidt Weber".split()) & set(re.findall("[A-Z][a-z]+", first))
    mixed, low, up = out[1].split(" ")
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{4}@[A-Z][a-z]{6}\.com", mixed) and mixed.lower() == low and up == low.upper() and low != "john.smith@example.com"
    for was, now in zip("371449635398431 5555555555554444 6011000990139424 4111111111111111".split(), out[2].split()):
        kept = {"3": 2, "5": 2, "6": 4, "4": 1}[was[0]]
        assert was != now and was[:kept] == now[:kept] and luhn(now) == luhn(was) and len(was) == len(now)
    assert re.fullmatch(r"Dear [A-Z][a-z]+ [A-Z][a-z]+, Dear Customer, Dear Mr [A-Z][a-z]+ and MR nobody, Dr [A-Z][a-z]+; Mr [A-Z]+\.", out[3])
    assert not re.search("John|Smith|SMITH|Brien|Donald", out[3])
    assert re.fullmatch(r"ES\d\d( \d{4}){5} [A-Z]{2}\d\d( \d{4}){4} \d\d\.", out[4]) and "0532" not in out[4]
    assert not re.search("Efgh|Ijkl|Mnop|Qrst", out[5]) and out[5].endswith(" and so on")


def test_megabytes_of_each_alphabet(spark):
    units = ["a@b" + ".c" * 3000 + ".com ", "a", "a@", "a.b@c.", ".c", "@", "GB82", "GB82 WEST ", "A1", "1.", "255.", "1.2.3.4 ", "4", "4111 ", "37-", "123-45-", "1-", "+1 ", "(988) ", "555-", "Mr Ab ", "Mr A'", "Ab-", "Dear Ab-Cd "]
    out = replaced(spark, *((u * (300_000 // len(u) + 1))[:300_000] for u in units))
    assert len(out) == len(units) and all(o is not None for o in out)


def test_key_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "Mr Smith 42.144.35.254", 5)], "doc_id int, text string, n_mentions int")
    a = pii.replace_mentions(df, key="a", count="n_mentions").collect()
    b = pii.replace_mentions(df, key="b", count="n_mentions").collect()
    assert a[0].text != b[0].text and a[0].n_mentions == 2 and a == pii.replace_mentions(df, key="a", count="n_mentions").collect()
    assert pii.replace_mentions(df).columns == df.columns
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64


def test_whole_table_by_brute_force(spark):
    """All text outside mentions stays, mentions map one to one, and each is of its kind again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    after = {r.doc_id: r for r in pii.replace_mentions(docs, count="n").collect()}
    pattern = regex.compile(pii.MENTION)  # it names classes of letters
    seen: dict = {}
    for r in docs.collect():
        got, parts = after[r.doc_id], pattern.split(r.text or "")
        mentions = [m[0] for m in pattern.finditer(r.text or "")]
        assert got.n == len(mentions)
        plain = pattern.sub("\0", r.text or "").split("\0")
        rest = got.text or ""
        for k, m in enumerate(mentions):
            assert rest.startswith(plain[k])
            rest = rest[len(plain[k]) :]
            end = rest.index(plain[k + 1][:40]) if plain[k + 1] else len(rest)
            put, rest = rest[:end], rest[end:]
            assert put != m and seen.setdefault(m, put) == put, (m, put)
        assert rest == plain[-1] and parts
    assert len(set(seen.values())) == len(seen)


def test_an_account_ends_where_its_country_says(spark):
    out = replaced(spark, "ES91 2100 0418 4502 0005 1332 CALL NOW", "ES9121000418450200051332 and ES91 2100 0418 4502 0005 1332.", "NO93 8601 1117 947 OK, MT84 MALT 0110 0001 2345 MTLC AST0 01S", " ".join(["DE89 3704 0044 0532 0130 00"] * 100))
    assert re.fullmatch(r"ES\d\d( \d{4}){5} CALL NOW", out[0]) and "0418" not in out[0]
    number = out[0][:29].replace(" ", "")
    assert out[1] == f"{number} and {out[0][:29]}."
    assert re.fullmatch(r"NO\d\d \d{4} \d{4} \d{3} OK, MT\d\d [A-Z]{4} \d{4} \d{4} \d{4} [A-Z]{4} [A-Z]{3}\d \d\d[A-Z]", out[2]) and "MALT" not in out[2]
    assert len(set(re.findall("DE[0-9 ]{25}", out[3] + " "))) == 1 and "3704" not in out[3]


#: The test's own idea of a person: title, then words with their particles.
PERSON = r"(?:Mr|Mrs|Dr|Prof|Herr|Frau|Señora) ((?:[^\W\d_]+[ -]?)+)"


def test_one_person_has_one_name(spark):
    """Possessives, titles that tell no gender, other alphabets and particles."""
    out = replaced(spark, "Mr Smith met Mr Smith's sister; Dr Smith’s car.", "Mr John Smith, Dr John Smith, Prof. John Smith", "Dr Jane Roe; Mrs Jane Roe, Frau Jane Roe", "Dr Kim Lee, Mr Kim Lee, Mrs Kim Lee", "Mr Łukasz Nowak; Herr Łukasz Nowak. Mr Žižek", "Mr van Dyke, Mr Vincent van der Berg", "Mr O'Brien's and Mr James' and Mr O'Brien")
    first = re.fullmatch(r"Mr (\w+) met Mr (\w+)'s sister; Dr (\w+)’s car\.", out[0])
    assert first and len(set(first.groups())) == 1 and "Smith" not in out[0]
    for k in (1, 2):
        names = {n.strip(" ") for n in re.findall(PERSON, out[k].replace(". ", " "))}
        assert len(names) == 1 and not names & {"John Smith", "Jane Roe"}, out[k]
    doctor, mister, missis = (x.split(" ", 1)[1] for x in out[3].split(", "))
    assert len({doctor, mister, missis}) == 3
    a, b = re.findall(r"(?:Mr|Herr) (\w+ \w+)[;.]", out[4])
    assert a == b and not re.search("Łukasz|Nowak|Žižek", out[4])
    assert re.fullmatch(r"Mr van [A-Z][a-z]+, Mr [A-Z][a-z]+ van der [A-Z][a-z]+", out[5]) and not re.search("Dyke|Vincent|Berg", out[5])
    brien, james, again = re.fullmatch(r"Mr (\w+)'s and Mr (\w+)' and Mr (\w+)", out[6]).groups()
    assert brien == again != james


def test_numbers_with_area_codes(spark):
    out = replaced(spark, "call (030) 1234567 or (0711) 123 45 67; not (2020) 1234567 or (030)")
    assert re.fullmatch(r"call \(\d{3}\) \d{7} or \(\d{4}\) \d{3} \d\d \d\d; not \(2020\) 1234567 or \(030\)", out[0])
    assert "1234567" not in out[0][:20]
