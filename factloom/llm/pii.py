"""Personal data: surrogate generation, in DataFrame operations only.

Detected entities (e-mail addresses, IPv4 addresses, IBANs whose check digits
hold, payment cards that pass the Luhn check, phone numbers, US social security
numbers, and names after an honorific) are replaced by surrogates derived from a
keyed SHA-256.  A surrogate keeps type and format: letters stay letters of their
case, digits digits, separators stay; a card passes the Luhn check, an IBAN its
own, an octet stays an octet of as many digits, a phone keeps its country code,
an address its top-level domain.  Name words get words of the same script.

A given name is an entity with its gender, which is the person's, not the
honorific's: after a neutral honorific, or mentioned alone, a given name has the
gender that the document's honorifics give it, else the corpus' honorifics, if
that is a single one.  Every other whole-word mention of a word of such a name
in the same document, written the same way, gets the same surrogate.  So
"Dr Ian Moss", "Mr Ian Moss", "Mr Moss" and "Moss" stay one person.

Equal entities always get equal surrogates.  Collision checks run over the
distinct entities of the whole corpus: a surrogate that two entities of a class
(all names are one) share, or that is itself an entity of the corpus, is derived
anew for the losers until none is left.  After some attempts formats widen, so this ends.

Scale: only documents with an entity are taken apart, each within its own row;
all others pass through without a shuffle.  Distinct entities are made by
partial aggregation and dealt over all tasks.  Uses are joined to them by a
sort-merge join between plain shuffles, which adaptive execution splits when one
entity is everywhere.  The text is shuffled once, to meet its surrogates; what
is gathered per row is bounded by that one document.

Defined results: null text counts as empty; repeated rows are handled alike; an
empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, drop_table, rows_of, write_table

#: For tests and the registered query; real use passes its own key.
DEMONSTRATION_KEY = "factloom demonstration key"
MOST_ATTEMPTS = 64
WIDEN_AFTER = 8

# Honorifics by gender, and syllables by script.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha he ka ke la le li lo ma me mi mo na ne ra re sa se ta te".split(),
    "cyrillic": "ба бе би бо ва ве да де за зе ка ке ла ле ли ло ма ме ми мо на не па пе ра ре са се та те фа фе".split(),
    "greek": "βα βε βι βο γα γε δα δε ζα ζε θα θε κα κε λα λε λι λο μα με μι μο να νε πα πε ρα ρε σα σε τα τε".split(),
}
ENDINGS = {
    "latin": {"male": ("n", "ro"), "female": ("a", "nia"), "any": ("s", "l")},
    "cyrillic": {"male": ("н", "ир"), "female": ("на", "ия"), "any": ("к", "л")},
    "greek": {"male": ("ς", "νος"), "female": ("να", "ρη"), "any": ("κης", "λας")},
}

_octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_honorific = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=lambda x: (-len(x), x))) + ")"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:(?:4[0-9]{3}|5[1-5][0-9]{2}|2[2-7][0-9]{2}|6(?:011|5[0-9]{2}|4[4-9][0-9]))"
    r"(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|3[47][0-9]{13})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}}){_honorific}\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
_any = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match has; cheap, so that most texts are told apart quickly.
_hint = rf"[0-9]{{2}}|[0-9]\.[0-9]|@|{_honorific}\.? \p{{Lu}}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + weigh(i))


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN (without spaces): 1 if its check digits hold."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def feed(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), feed)


def _kind(value: Column) -> Column:
    """The kind of a match; null for a card number or an IBAN whose check digits fail."""
    card = value.rlike(f"^(?:{PATTERNS['card']})$")
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(f"^{_octet}(?:\\.{_octet}){{3}}$"), "ip")
        .when(value.rlike("^[A-Z]{2}[0-9]{2}"), F.when(_mod97(F.replace(value, F.lit(" "))) == 1, "iban"))
        .when(card, F.when(F.when(card, _luhn_sum(_digits(value))) % 10 == 0, "card"))
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.rlike(r"^\p{L}"), "name")
        .otherwise("phone")
    )


# ---------------------------------------------------------------- surrogates


def _stream(key: str, *parts: Column) -> Column:
    """256 hex digits that depend on the key and all parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{k}\x1f"), seed), 256) for k in range(4)])


def _byte(stream: Column, i: Column | int) -> Column:
    at = (F.lit(i) if isinstance(i, int) else i) % 128
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(first: str, n: Column) -> Column:
    return F.char(F.lit(ord(first)) + n % 26)


def _shaped(value: Column, stream: Column) -> Column:
    """Every ASCII letter and digit replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (
            F.when(c.between("0", "9"), (b % 10).cast("string"))
            .when(c.between("a", "z"), _letter("a", b))
            .when(c.between("A", "Z"), _letter("A", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _more_digits(stream: Column, attempt: Column) -> Column:
    """Extra digits once a format has been tried often."""
    n = F.greatest(F.lit(0), attempt - WIDEN_AFTER + 1)
    tail = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (_byte(stream, 127 - i) % 10).cast("string"))
    return F.when(n > 0, F.array_join(tail, "")).otherwise("")


def _email(value: Column, key: str, attempt: Column) -> Column:
    domain = F.substring_index(value, "@", -1)
    top = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    host = F.regexp_replace(domain, r"\.[A-Za-z]+$", "")
    own = _stream(key, F.lit("email"), value, attempt.cast("string"))
    local = F.concat(_shaped(F.substring_index(value, "@", 1), own), _more_digits(own, attempt))
    return F.concat(local, F.lit("@"), _shaped(host, _stream(key, F.lit("host"), F.lower(host))), top)


def _ip(value: Column, stream: Column, attempt: Column) -> Column:
    def octet(o: Column, i: Column) -> Column:
        b = _byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1)
        kept = F.when(F.length(o) == 1, 1 + b % 9).when(F.length(o) == 2, 10 + b % 90).otherwise(100 + b % 155)
        return F.when(attempt < WIDEN_AFTER, kept).otherwise(1 + b % 254).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _card(value: Column, stream: Column, attempt: Column) -> Column:
    digits = _digits(value)
    body = F.concat(F.substring(digits, 1, 1), F.substring(_shaped(digits, stream), F.lit(2), F.length(digits) - 2))
    body = F.concat(body, _more_digits(stream, attempt))
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    plain = F.concat(body, check.cast("string"))
    split = lambda mark: F.regexp_replace(plain, "([0-9]{4})(?=[0-9])", f"$1{mark}")
    return F.when(value.contains(" "), split(" ")).when(value.contains("-"), split("-")).otherwise(plain)


def _iban(value: Column, stream: Column, attempt: Column) -> Column:
    body = F.concat(_shaped(F.substring(value, F.lit(5), F.length(value)), stream), _more_digits(stream, attempt))
    plain = F.concat(F.substring(value, 1, 2), F.lit("00"), F.replace(body, F.lit(" ")))
    return F.concat(F.substring(value, 1, 2), F.lpad((98 - _mod97(plain)).cast("string"), 2, "0"), body)


def _word(value: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """A name word of the same script; given names end after their gender."""

    def made(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        count = F.lit(2) + F.length(value) % 2 + F.floor(attempt / 2).cast("int")
        root = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(syllables, _byte(stream, i) % 32 + 1)), "")
        ends = {g: F.element_at(F.array(*map(F.lit, e)), _byte(stream, 0) % len(e) + 1) for g, e in ENDINGS[script].items()}
        end = F.when(kind == "given male", ends["male"]).when(kind == "given female", ends["female"]).otherwise(ends["any"])
        return F.initcap(F.concat(root, end))

    word = F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(value.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))
    return F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(word)).otherwise(word)


def _surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    stream = _stream(key, kind, value, attempt.cast("string"))
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    phone = F.concat(country, _shaped(F.regexp_replace(value, r"^\+[0-9]{1,3}(?=[ .(-])", ""), stream))
    return (
        F.when(kind == "email", _email(value, key, attempt))
        .when(kind == "ip", _ip(value, stream, attempt))
        .when(kind == "iban", _iban(value, stream, attempt))
        .when(kind == "card", _card(value, stream, attempt))
        .when(kind == "phone", F.concat(phone, _more_digits(stream, attempt)))
        .when(kind == "ssn", F.concat(_shaped(value, stream), _more_digits(stream, attempt)))
        .otherwise(_word(value, kind, stream, attempt))
    )


def _class(kind: Column) -> Column:
    return F.when(kind.startswith("given ") | (kind == "surname"), "name").otherwise(kind)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): one-to-one in a class of kinds, and no surrogate is a value of it."""
    spark = entities.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = entities.withColumn("attempt", F.lit(0))
    path = ""
    for _ in range(MOST_ATTEMPTS):
        # Hashing is what costs here, and rows are small: a fixed count keeps them from being put into one task.
        made = now.repartition(tasks, "kind", "value").withColumn("class", _class(F.col("kind")))
        made = made.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        made, made_path = write_table(spark, made, "surrogates")
        if path:
            drop_table(spark, path)
        path = made_path
        # The one that keeps a shared surrogate: of the fewest attempts, then the least hash.
        own = F.struct("kind", "value").alias("own")
        rank = F.struct((-F.col("attempt")).alias("a"), F.sha2(F.concat(F.lit(key), F.col("value")), 256).alias("h"), own)
        shared = made.groupBy("class", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("winner")).filter("n > 1")
        losers = made.join(shared, ["class", "surrogate"]).filter(F.struct("kind", "value") != F.col("winner.own")).select("kind", "value")
        real = made.select("class", F.col("value").alias("surrogate"))
        losers = losers.unionAll(made.join(real, ["class", "surrogate"], "left_semi").select("kind", "value")).distinct()
        losers, losers_path = write_table(spark, losers, "collisions")
        if losers.isEmpty():
            drop_table(spark, losers_path)
            return made.select("kind", "value", "surrogate")
        again = losers.withColumn("more", F.lit(1))
        now = made.join(again, ["kind", "value"], "left").select(
            "kind", "value", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")
        )
    raise RuntimeError("surrogates still collide")


# ----------------------------------------------------------------- operators

#: How a document's map from entity to surrogate is keyed.
_MARK = "\x1f"
_PARTS = "array<struct<kind:string,value:string>>"


def _named_words(found: Column) -> Column:
    """The words of a document's names after an honorific: (word, role, gender); a single word has a role of its own."""

    def of(f: Column) -> Column:
        words = F.split(f["value"], " ")
        title = F.regexp_extract(f["value"], rf"^({_honorific})", 1)
        gender = F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female").otherwise("any")
        role = lambda i: F.when(F.size(words) == 2, "single").when(i < F.size(words) - 2, "given").otherwise("surname")
        return F.transform(F.slice(words, 2, 8), lambda w, i: F.struct(w.alias("word"), role(i).alias("role"), gender.alias("gender")))

    return F.flatten(F.transform(F.filter(found, lambda f: f["kind"] == "name"), of))


def _name_kind(word: Column, role: Column, gender: Column, names: Column) -> Column:
    """given male, given female, given any (not known in this document) or surname; ``role`` may be "mention"."""
    same = F.filter(names, lambda n: n["word"] == word)
    given = F.exists(same, lambda n: n["role"] == "given")
    surname = F.exists(same, lambda n: n["role"] == "surname")
    genders = F.filter(same, lambda n: (n["gender"] != "any") & ((n["role"] == "given") | ((n["role"] == "single") & ~surname)))
    genders = F.array_distinct(F.transform(genders, lambda n: n["gender"]))
    known = F.when(gender != "any", gender).when(F.size(genders) == 1, F.element_at(genders, 1)).otherwise("any")
    return F.when((role == "given") | ((role != "surname") & given & ~surname), F.concat(F.lit("given "), known)).otherwise("surname")


def _taken_apart(rows: DataFrame) -> DataFrame:
    """Rows with a match: _row, doc_id, lines (gap, value, kind, parts) in order.

    A line's text is its gap, then its value.  Parts are what has surrogates of
    its own, a name's words or the whole value; titles have no kind.
    """
    hit = rows.filter(F.col("text").rlike(_hint))
    found = hit.select("_row", "doc_id", "text", F.regexp_extract_all("text", F.lit(_any), F.lit(0)).alias("found"))
    found = found.filter(F.size("found") > 0).withColumn("gaps", F.split("text", _any, -1)).drop("text")
    kinds = F.transform("found", lambda v: F.struct(v.alias("value"), _kind(v).alias("kind")))
    found = found.select("_row", "doc_id", "gaps", kinds.alias("found"))
    found = found.withColumn("names", _named_words(F.col("found")))
    words = F.array_distinct(F.transform("names", lambda n: n["word"]))
    by_length = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(by_length, "|"), F.lit(r")(?!\p{L})"))
    none = F.lit(None).cast("struct<value:string,kind:string>")
    whole = F.arrays_zip(F.col("gaps").alias("gap"), F.concat("found", F.array(none)).alias("f"))
    found = found.select("_row", "doc_id", "names", whole.alias("whole"), F.when(F.size("names") > 0, pattern).alias("pattern"))

    def line(gap: Column, value: Column, kind: Column, parts: Column) -> Column:
        return F.struct(gap.alias("gap"), value.alias("value"), kind.alias("kind"), parts.cast(_PARTS).alias("parts"))

    def itself(x: Column) -> Column:
        value, kind = x["f"]["value"], x["f"]["kind"]
        plain = F.when(kind.isNotNull(), F.array(F.struct(kind.alias("kind"), value.alias("value"))))
        return line(x["gap"], value, kind, plain)

    def part(word: Column, kind: Column) -> Column:
        return F.struct(kind.cast("string").alias("kind"), word.alias("value"))

    def cut(x: Column) -> Column:
        """A gap cut at further mentions of the document's names, then the match itself."""
        names, value, kind = F.col("names"), x["f"]["value"], x["f"]["kind"]
        pieces = F.arrays_zip(F.split(x["gap"], F.col("pattern"), -1).alias("gap"), F.regexp_extract_all(x["gap"], F.col("pattern"), F.lit(0)).alias("m"))
        mention = lambda m: F.array(part(m, _name_kind(m, F.lit("mention"), F.lit("any"), names)))
        mentions = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: line(p["gap"], p["m"], F.lit("name"), mention(p["m"])))
        own = _named_words(F.array(x["f"]))
        title = part(F.element_at(F.split(value, " "), 1), F.lit(None))
        spelt = F.concat(F.array(title), F.transform(own, lambda n: part(n["word"], _name_kind(n["word"], n["role"], n["gender"], names))))
        parts = F.when(kind == "name", spelt).when(kind.isNotNull(), F.array(part(value, kind)))
        return F.concat(mentions, F.array(line(F.element_at(pieces, -1)["gap"], value, kind, parts)))

    lines = F.when(F.col("pattern").isNotNull(), F.flatten(F.transform("whole", cut))).otherwise(F.transform("whole", itself))
    return found.select("_row", "doc_id", lines.alias("lines"))


def _known(distinct: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate); a given name of no gender takes that of the only gender the corpus gives it."""
    gendered = distinct.filter(F.col("kind").isin("given male", "given female")).groupBy("value")
    single = gendered.agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("as")).filter("n = 1").select(F.lit("given any").alias("kind"), "value", "as")
    of, _ = write_table(distinct.sparkSession, distinct.join(single, ["kind", "value"], "left"), "entities")
    made = surrogates(of.filter("as is null").select("kind", "value"), key)
    same = of.filter("as is not null").join(made.withColumnRenamed("kind", "as"), ["as", "value"]).select("kind", "value", "surrogate")
    return made.unionByName(same)


def replace_personal_data(docs: DataFrame, key: str = DEMONSTRATION_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_entities, spans (kind:start:end in the original text), text with surrogates."""
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text_col)
    apart, _ = write_table(spark, _taken_apart(rows), "taken-apart")
    uses = apart.select("_row", F.explode("lines").alias("l")).select("_row", F.explode("l.parts").alias("p")).filter("p.kind is not null").select("_row", "p.*")
    known = _known(uses.groupBy("kind", "value").agg(F.lit(1).alias("one")).drop("one"), key)
    entry = F.struct(F.concat("kind", F.lit(_MARK), "value").alias("key"), F.col("surrogate").alias("value"))
    named = uses.distinct().join(known, ["kind", "value"])
    named = named.groupBy("_row").agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    placed = apart.join(named, "_row", "left")

    def replaced(x: Column) -> Column:
        new = F.transform(x["parts"], lambda p: F.coalesce(F.element_at("known", F.concat(p["kind"], F.lit(_MARK), p["value"])), p["value"]))
        return F.concat(x["gap"], F.when(x["parts"].isNotNull(), F.array_join(new, " ")).otherwise(F.coalesce(x["value"], F.lit(""))))

    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def place(state: Column, x: Column) -> Column:
        span = F.concat_ws(":", x["kind"], state["at"] + F.length(x["gap"]), state["at"] + size(x))
        more = F.when(x["kind"].isNotNull(), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size(x)).alias("at"), more.alias("spans"))

    n = F.size(F.filter("lines", lambda x: x["kind"].isNotNull())).cast("long")
    spans = F.array_join(F.aggregate("lines", start, place)["spans"], ",")
    text = F.array_join(F.transform("lines", replaced), "")
    rebuilt = placed.select("doc_id", n.alias("n_entities"), spans.alias("spans"), text.alias("text"))
    clean = rows.filter(~F.col("text").rlike(_hint) | (F.when(F.col("text").rlike(_hint), F.regexp_count("text", F.lit(_any))) == 0))
    return rebuilt.unionByName(clean.select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("spans"), "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return replace_personal_data(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
