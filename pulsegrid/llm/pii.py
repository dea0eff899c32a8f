"""Operator 8: surrogates for personal data, in DataFrame functions only.

Regular expressions detect mentions of emails, phone numbers, IPv4 addresses,
payment cards, social security numbers, IBANs and names after a title or a
salutation. Each distinct entity gets a keyed replacement of its kind: the
mention's punctuation, letter case and length classes stay, cards keep the
digits that tell their network and their Luhn residue, IBANs keep country and
valid check digits, names keep title, gender, script, hyphens and number of
words. Mentions of one entity in any format get one surrogate (coreference); a
name whose title tells no gender is the person of the same words whose gender
another title tells, unless there are two. Possessive endings and particles
("van", "de la") stay. An account number is as long as its country's are,
whatever follows; its check digits need not be right, as a slip of the pen is
no less personal. Names without a title or salutation are not detected.

The key comes from the setting ``spark.pulsegrid.pii.key``. Where that is unset,
a random one is drawn and kept for the session, as a key that is public would
let anyone try entities out; surrogates then differ from session to session.

Surrogates are drawn from a digest of key, kind, entity and attempt. A draw
that equals another entity's surrogate or any entity found in the corpus is
drawn again with the next attempt until all are distinct. Every ``GROW``
attempts a name gains a syllable, an email's local part a letter, and a phone
number of fewer than ten digits a digit, so a pool that its entities fill
grows; the other kinds keep their formats' lengths.

Defined results: a null text stays null, a text without mentions stays as it
is; all columns and rows stay, copies get equal texts; adjoining mentions are
separate; an empty table stays empty. Internal column names avoid the
table's own.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

KEY_SETTING = "spark.pulsegrid.pii.key"
ATTEMPTS = 64
GROW = 4
MALE, FEMALE = ("Mr", "Herr", "Señor", "Monsieur", "господин", "Sir"), ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "госпожа", "Lady")
#: Titles that tell no gender.
NEUTRAL = ("Dr", "Prof")
#: Salutations, after which a name has two words at least.
SALUTATIONS = ("Dear", "Hello", "Querido", "Querida", "Cher", "Chère", "Liebe", "Lieber", "Уважаемый", "Уважаемая")
#: Labels of a domain name, which has no more by its standard.
LABELS = 127
#: The length of a bank account number (IBAN) by its country, as the public registry has them.
IBAN_LENGTHS = """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27
    GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
    MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28
    TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30
"""
#: Small words that a name's words may have before them; they stay.
PARTICLES = ("van", "von", "vom", "zu", "zum", "zur", "der", "den", "de", "del", "della", "di", "da", "das", "do", "dos", "du", "la", "le", "los", "las", "ten", "ter", "bin", "ibn", "al", "el")
_UP, _LOW = r"\p{Lu}\p{Lt}", r"\p{L}\p{M}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A capital, then letters, which an apostrophe may stand between; a possessive ending is no part of it.
_WORD = f"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}+[{_UP}](?:(?!['’][sS](?![{_LOW}]))['’]?[{_LOW}])++"


def _ibans() -> str:
    """Account numbers of each length, in groups of four or in one piece."""
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]) - 4, []).append(entry[:2])

    def body(n: int) -> str:
        return f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    return "|".join(f"(?:{'|'.join(countries)})[0-9]{{2}}{body(n)}" for n, countries in sorted(by_length.items()))


#: In the order of their trial at a place.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{0,{LABELS}}}\.[A-Za-z]{{2,}}+",
    "iban": rf"(?<![A-Za-z0-9])(?:{_ibans()})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.])(?:[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|4[0-9]{12})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])\(0[0-9]{1,4}\) ?[0-9]{3,8}(?:[ -][0-9]{2,4}){0,2}(?![0-9A-Za-z])",
    "name": rf"(?<![{_LOW}])(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? {_WORD}|(?:{'|'.join(SALUTATIONS)}) (?!(?:{'|'.join(MALE + FEMALE + NEUTRAL)})[. ]){_WORD}[ -]{_WORD})(?:[ -]{_WORD})*+",
}
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every mention holds.
HINT = "[0-9@]|" + "|".join(MALE + FEMALE + NEUTRAL + SALUTATIONS)

#: Syllables of made-up names, and their endings by gender, by script.
SYLLABLES = {
    "latin": ("ba da fe ga ha jo ka le mi no pe ra so ta vi wa ze bri dor fal gan hel kor lin mar nor", "n s r l", "a ia ina elle"),
    "cyrillic": ("ба ва га да жа зо ки ле ми но пе ра со та фи хо бор вел гор дан кир лен мар нор", "н р с л", "а ия ина"),
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def entity_of(kind: Column, mention: Column) -> Column:
    """What equal mentions have in common: digits without separators, a phone's last ten, lower case; names keep a gender mark."""
    phone = F.when(F.length(digits(mention)) > 10, F.right(digits(mention), F.lit(10))).otherwise(digits(mention))

    def titled(titles):
        return mention.rlike(f"^(?:{'|'.join(titles)})(?![{_LOW}])")

    words = F.lower(F.translate(F.regexp_replace(mention, r"^\S+ ", ""), "-", " "))
    name = F.concat(F.when(titled(FEMALE), "f:").when(titled(MALE), "m:").otherwise("n:"), words)
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits(mention)).when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "name", name).otherwise(F.lower(mention))


def stream(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)), 256)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is computed once, however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def byte(hashed: Column, i: Column) -> Column:
    """The i-th byte (from 0) of a digest, which repeats after 32."""
    return F.conv(F.substr(hashed, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def like(text: Column, hashed: Column) -> Column:
    """Letters for letters and digits for digits, all else as it is."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def one(c, b):
        letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return let(hashed, lambda h: F.array_join(F.transform(chars, lambda c, i: let(byte(h, i), lambda b: one(c, b))), ""))


def luhn(number: Column) -> Column:
    """Luhn sum of a digit string."""
    n = F.length(number)

    def add(total, i):
        d = F.substr(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def surrogate_of(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The attempt's draw for an entity, in the entity's normal form."""
    h = stream(key, kind, entity, attempt.cast("string"))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    grown = F.floor(attempt / GROW).cast("int")
    more = stream(key, "more", kind, entity, attempt.cast("string"))
    email = F.concat(like(local, h), like(F.repeat(F.lit("a"), grown), more), F.lit("@"), like(host, stream(key, "host", domain)), F.lit("."), F.substring_index(domain, ".", -1))
    octets = [(byte(h, F.lit(0)) % 223 + 1), byte(h, F.lit(1)), byte(h, F.lit(2)), byte(h, F.lit(3)) % 254 + 1]
    ip = F.concat_ws(".", *(o.cast("string") for o in octets))
    network = F.when(entity.startswith("4"), 1).when(entity.startswith("6011"), 4).otherwise(2)
    body = F.concat(F.left(entity, network), like(F.substr(entity, network + 1, F.length(entity) - network - 1), h), F.lit("0"))
    card = F.concat(F.left(body, F.length(body) - 1), F.pmod(luhn(entity) - luhn(body), F.lit(10)).cast("string"))
    inner = like(F.substr(entity, F.lit(5)), h)
    rest = F.aggregate(
        F.filter(F.split(F.concat(inner, F.left(entity, F.lit(2)), F.lit("00")), ""), lambda c: c != ""),
        F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97,
    )
    iban = F.concat(F.left(entity, F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), inner)
    longer = like(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.least(grown, 10 - F.length(entity)))), more)
    phone = F.concat((byte(h, F.lit(31)) % 8 + 2).cast("string"), F.substr(like(entity, h), F.lit(2)), longer)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "ssn", like(entity, h))
        .when(kind == "phone", phone)
        .otherwise(F.concat(F.left(entity, F.lit(2)), let(h, lambda known: made_up_name(entity, known, grown))))
    )


def made_up_name(entity: Column, h: Column, grown: Column) -> Column:
    """Lower-case words, as many as the entity has; the first has ``grown`` more syllables, and its ending follows the gender mark."""
    words = F.split(F.substr(entity, F.lit(3)), " ")

    def pick(choices: str, i: Column) -> Column:
        parts = choices.split(" ")
        return F.element_at(F.array(*map(F.lit, parts)), byte(h, i) % len(parts) + 1)

    def word(script: str, first: Column):
        middle, male, female = SYLLABLES[script]

        def one(w, i):
            more = F.slice(F.sequence(F.lit(12), F.lit(31)), F.lit(1), F.when(i == first, grown).otherwise(0))
            base = F.concat(pick(middle, i * 4), pick(middle, i * 4 + 1), pick(middle, i * 4 + 2), F.array_join(F.transform(more, lambda j: pick(middle, j)), ""))
            end = F.when((i == first) & entity.startswith("f:"), pick(female, i * 4 + 3)).when((i == first) & entity.startswith("n:"), "e").otherwise(pick(male, i * 4 + 3))
            return F.when(w.isin(*PARTICLES), w).otherwise(F.concat(base, end))

        return F.array_join(F.transform(words, one), " ")

    # the first word that isn't a particle
    leading = F.size(F.split(F.regexp_extract(F.substr(entity, F.lit(3)), f"^(?:(?:{'|'.join(PARTICLES)}) )*", 0), " ")) - 1
    return let(leading, lambda first: F.when(entity.rlike("[а-яё]"), word("cyrillic", first)).otherwise(word("latin", first)))


def render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format."""
    n = F.length(mention)
    plain = F.when(kind == "iban", surrogate).otherwise(F.concat(F.left(digits(mention), F.greatest(F.lit(0), F.length(digits(mention)) - F.length(surrogate))), surrogate))

    def put(state, i):
        c = F.substr(mention, i, F.lit(1))
        taken = F.when(kind == "iban", c.rlike("[A-Z0-9]")).otherwise(c.rlike("[0-9]"))
        return F.struct(
            F.concat(state["out"], F.when(taken, F.substr(plain, state["k"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(taken, state["k"] + 1).otherwise(state["k"]).alias("k"),
        )

    numbered = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: F.concat(s["out"], F.substr(plain, s["k"])))
    called = F.regexp_replace(mention, r"^\S+ ", "")
    cased = F.zip_with(F.split(called, "[ -]"), F.split(F.substr(surrogate, F.lit(3)), " "), lambda m, s: F.when(F.upper(m) == m, F.upper(s)).when(F.lower(m) == m, s).otherwise(F.initcap(s)))
    marks = F.concat(F.regexp_extract_all(called, F.lit("[ -]"), 0), F.array(F.lit("")))
    name = F.concat(F.regexp_extract(mention, r"^\S+ ", 0), F.array_join(F.zip_with(cased, marks, lambda w, m: F.concat(w, m)), ""))
    email = F.concat(*(x for k in (1, -1) for x in (like_case(F.substring_index(mention, "@", k), F.substring_index(surrogate, "@", k)), F.lit("@") if k == 1 else F.lit(""))))
    return F.when(kind == "name", name).when(kind == "email", email).when(kind == "ip", surrogate).otherwise(numbered)


def like_case(mention: Column, surrogate: Column) -> Column:
    """The surrogate with capitals where the mention has them; what is longer follows a mention all in capitals."""

    def chars(text):
        return F.filter(F.split(text, ""), lambda c: c != "")

    shaped = F.zip_with(chars(surrogate), chars(mention), lambda c, m: F.when(F.lower(m) != m, F.upper(c)).otherwise(c))
    return F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(surrogate)).otherwise(F.array_join(shaped, ""))


def session_key(spark: SparkSession) -> str:
    """The key in the setting, or one drawn for the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def surrogate_table(entities: DataFrame, key: str | None = None) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): all surrogates of a kind differ, and none is an entity.

    Each attempt draws for those that clashed in the one before, and writes them alone.
    """
    key = session_key(entities.sparkSession) if key is None else key
    entities = materialize(entities, "pii-entities")
    taken = entities.select("kind", F.col("entity").alias("surrogate"))
    pending, settled = entities, None
    for attempt in range(ATTEMPTS):
        drawn = pending.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("entity"), F.lit(attempt), key))
        ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity")))
        checked = ranked.join(taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        checked = materialize(checked.select("kind", "entity", "surrogate", (F.col("taken").isNotNull() | (F.col("rank") > 1)).alias("clash")), "pii-surrogates")
        kept = checked.filter("not clash").select("kind", "entity", "surrogate")
        settled = kept if settled is None else settled.unionByName(kept)
        pending = checked.filter("clash").select("kind", "entity")
        if pending.isEmpty():
            return settled
        taken = taken.unionByName(kept.select("kind", "surrogate"))
    raise ValueError("a kind has too few surrogates for its entities")


def coreferent(entities: DataFrame) -> DataFrame:
    """(kind, entity, of): a name without a known gender is ``of`` the one with the same words whose gender is known, if that is one only."""
    mark, words = F.left("entity", F.lit(2)), F.substr("entity", F.lit(3))
    titled = entities.filter((F.col("kind") == "name") & (mark != "n:")).groupBy(words.alias("words")).agg(F.min(mark).alias("first"), F.max(mark).alias("last"))
    known = titled.filter(F.col("first") == F.col("last")).select(F.concat(F.lit("n:"), "words").alias("entity"), F.lit("name").alias("kind"), F.concat("first", "words").alias("named"))
    return entities.join(known, ["kind", "entity"], "left").select("kind", "entity", F.coalesce("named", "entity").alias("of"))


def replace_mentions(documents: DataFrame, key: str | None = None, column: str = "text", count: str | None = None) -> DataFrame:
    """``documents`` with surrogates in ``column``; ``count`` names a column for the number of mentions, whose old values go.

    Mentions are found once: texts are written with theirs, and those without any are not read by an expression again.
    """
    documents = documents.drop(count) if count else documents
    names = documents.columns
    mark, parts, reps, list_of = (f"_{x}_{len(''.join(names))}" for x in ("key", "parts", "reps", "mentions"))
    text = F.col(column)
    seen = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(MENTION), 0))
    marked = materialize(documents.withColumn(list_of, seen), "pii-texts")
    has = F.coalesce(F.size(list_of) > 0, F.lit(False))
    held = marked.filter(has).withColumn(mark, F.unhex(F.sha2(text, 256)))
    found = held.select(F.col(mark).alias("key"), F.col(list_of).alias("mentions")).dropDuplicates(["key"])
    mentions = found.select("key", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    mentions = materialize(mentions.withColumn("entity", entity_of(F.col("kind"), F.col("mention"))), "pii-mentions")
    people = materialize(coreferent(mentions.select("kind", "entity").distinct()), "pii-people")
    table = surrogate_table(people.select("kind", F.col("of").alias("entity")).distinct(), key)
    table = people.join(table.withColumnRenamed("entity", "of"), ["kind", "of"]).select("kind", "entity", "surrogate")
    ready = mentions.join(table, ["kind", "entity"]).select("key", "at", render(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("put"))
    lists = ready.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "put"))).alias(reps)).withColumnRenamed("key", mark)
    pieces = F.zip_with(F.split(text, MENTION, -1), F.concat(F.transform(F.col(reps), lambda r: r["put"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    changed = held.join(lists, mark).withColumn(parts, F.size(reps)).withColumn(column, F.array_join(pieces, ""))
    extra = [F.col(parts).alias(count)] if count else []
    clean = marked.filter(~has).select(*names, *([F.lit(0).alias(count)] if count else []))
    return clean.unionByName(changed.select(*names, *extra))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, and how many mentions each had."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_mentions(documents, count="n_mentions")
