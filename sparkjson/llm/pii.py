"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values are permuted inside their own format by a keyed, alternating Feistel network of ``ROUNDS`` rounds, so
equal values get equal pseudonyms in all documents and different values stay different:

* payment cards: 13-19 digits that pass the Luhn check; the check digit is made anew; other digit runs stay;
* telephone numbers: the digits after the country code; separators stay;
* IPv4 addresses: the 32 bits;
* social security numbers whose area, group and serial are allowed ones: the number's place among all allowed ones;
* dates (yyyy-mm-dd) of the years 1700-2500 that exist: the day's place among all days of these years.

The two halves of a network need not be alike, so it permutes just the allowed values and no pseudonym leaves its format.

Two kinds are no numbers: an e-mail address becomes ``user`` and keyed hex digits at the reserved domain
``example.invalid``, and a hexadecimal secret of 32-64 digits becomes keyed hex digits of its length and case.

Neighbouring numbers do not hide each other.  Mail, secrets, addresses, dates and social security numbers are found
first, then cards, then telephone numbers, each in what the kinds before it left.  In a run of numbers with single
spaces or hyphens between them, cards in a usual shape (one number, 4-4-4-4, 4-6-5 and the like) come before any other
neighbours that pass as one card.  A run that has a card's shape as a whole but a wrong check digit stays.

The key is a Column, so that ``key_from`` can read it from a file when the job runs and no plan or event log shows it; a
plain string works too, but stands in the plan.

Whole texts are searched.  A text without a match comes back unchanged, null stays null, the empty text stays
empty; equal rows get equal results.  Other columns are carried along.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, scratch_path

ROUNDS = 8
#: Days of the years 1700-2500 as a product, and allowed social security numbers as areas and the rest.
DAYS, SSNS = (37, 7907), (898, 99 * 9999)

#: Possessive, so that no number of labels exhausts the stack.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
HEX = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d-])|(?<![\d+])\+\d{8,15}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
#: Numbers of 13 digits and more with single separators, and a hyphen behind them.  Possessive, so no run exhausts the stack.
RUN = r"(?<![\d.,-])\d(?:[ -]?\d){12,}+-?"
#: The usual shapes of cards.
SHAPE = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])(?:\d{6}\2\d{4,5}|\d{3}\2\d{3}\2\d{3})"
#: Stand for what was found while later kinds are searched; those of the text itself count as found, so none is mixed up.
MARKS = ("\ue000", "\ue001", "\ue002", "\ue003")
FIRST = "|".join((EMAIL, HEX, IPV4, DATE, SSN, f"[{MARKS[0]}-{MARKS[-1]}]"))
#: What is left of cards by then has a wrong check digit.
LAST = rf"(?<![\d.,-])(?<!\d )(?:{SHAPE})(?![ -]?\d|-)|{PHONE}"
_POWERS = [10**k for k in range(19)]


def _power(n: Column) -> Column:
    return F.get(F.array(*(F.lit(p).cast("long") for p in _POWERS)), n)


def _digest(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, *parts), 256)


def key_from(spark: SparkSession, path: str) -> Column:
    """The key in the file ``path``, read when a job runs; line ends around it do not count."""
    return spark.read.text(path, wholetext=True).select(F.trim(F.col("value"), F.lit("\r\n"))).scalar()


def store_key(spark: SparkSession, key: str) -> str:
    """Write ``key`` to a new file of the shared folder and return its path."""
    path = scratch_path(spark, "key")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(key.encode()))
    out.close()
    return path


def permute(key: Column, tweak: Column, left: Column, right: Column, m_left: Column, m_right: Column, body) -> Column:
    """Apply the Feistel permutation of Z(m_left) x Z(m_right); ``body(left, right)`` makes the result."""

    def shift(i: Column, value: Column) -> Column:
        return F.conv(F.substring(_digest(key, tweak, i.cast("string"), value.cast("string")), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + shift(i, s["r"]), m_left)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + shift(i, s["l"]), m_right)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: body(s["l"], s["r"]))


def permute_digits(key: Column, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of the same length (2 to 36 digits)."""

    def of(d: Column) -> Column:
        n = F.length(d)
        a = (n / 2).cast("int")
        b = n - a
        out = lambda l, r: F.concat(F.lpad(l.cast("string"), a, "0"), F.lpad(r.cast("string"), b, "0"))  # noqa: E731,E741
        return permute(key, F.concat(F.lit(kind), n.cast("string")), F.substr(d, F.lit(1), a), F.substr(d, a + 1, b), _power(a), _power(b), out)

    return let(digits, of)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    done = F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(
            c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
        lambda s: s["out"],
    )
    return F.when(F.length(form) > 0, done).otherwise(F.lit(""))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; digits whose distance from the right end has parity ``doubled`` count twice."""
    n = F.length(digits)

    def term(k: Column) -> Column:
        d = F.substr(digits, n - k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, k: s + term(k))


def card(key: Column, value: Column) -> Column:
    """The pseudonym of a card that passes the Luhn check."""

    def of(d: Column) -> Column:
        fresh = let(
            permute_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1)),
            lambda p: F.concat(p, F.pmod(F.lit(10) - F.pmod(luhn_sum(p, 0), F.lit(10)), F.lit(10)).cast("string")),
        )
        return let(fresh, lambda x: refill(value, x))

    return let(only_digits(value), of)


def cards(run: Column, shaped: bool, mark: str) -> Column:
    """struct(text, found): ``run`` with a mark for each card in it, leftmost and longest first, and these cards.

    ``shaped``: cards of a usual shape between any separators, else neighbours between spaces.
    """

    def of(numbers: Column) -> Column:  # each with the separator behind it
        def candidate(i: Column, k: Column) -> Column:
            joined = F.array_join(F.slice(numbers, i, k), "")
            return F.struct(i.alias("i"), k.alias("k"), joined.alias("joined"), F.rtrim(joined, F.lit(" -")).alias("card"), F.translate(joined, " -", "").alias("digits"))

        def good(x: Column) -> Column:
            if shaped:
                fits = x["card"].rlike(f"^(?:{SHAPE})$")
            else:
                fits = ~F.endswith(x["joined"], F.lit("-")) & ((x["i"] == 1) | ~F.endswith(F.get(numbers, x["i"] - 2), F.lit("-")))
            return F.length(x["digits"]).between(13, 19) & fits & (F.pmod(luhn_sum(x["digits"], 1), F.lit(10)) == 0)

        def step(s: Column, i: Column) -> Column:
            sizes = F.sequence(F.least(F.lit(19), F.size(numbers) - i + 1), F.lit(1), F.lit(-1))
            tried = F.filter(F.transform(sizes, lambda k: candidate(i, k)), good)
            take = lambda x: F.when(x.isNull(), s).otherwise(F.struct((i + x["k"]).alias("next"), F.concat(s["found"], F.array(x)).alias("found")))
            return F.when(i < s["next"], s).otherwise(let(F.get(tried, F.lit(0)), take))

        def built(found: Column) -> Column:
            end = lambda n: F.when(n == 0, F.lit(1)).otherwise(F.get(found, n - 1)["i"] + F.get(found, n - 1)["k"])
            part = lambda first, after: F.array_join(F.slice(numbers, first, after - first), "")
            parts = F.transform(found, lambda x, n: F.concat(part(end(n), x["i"]), F.lit(mark), F.substr(x["joined"], F.length(x["card"]) + 1)))
            rest = part(end(F.size(found)), F.size(numbers) + 1)
            return F.struct(F.concat(F.array_join(parts, ""), rest).alias("text"), F.transform(found, lambda x: x["card"]).alias("found"))

        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<i:int,k:int,joined:string,card:string,digits:string>>").alias("found"))
        return let(F.aggregate(F.sequence(F.lit(1), F.size(numbers)), start, step, lambda s: s["found"]), built)

    cut = let(F.regexp_extract_all(run, F.lit(r"\d+[ -]?"), F.lit(0)), of)
    if not shaped:
        return cut
    none = F.struct(run.alias("text"), F.array().cast("array<string>").alias("found"))
    return F.when(run.rlike(rf"(?<!\d)(?:{SHAPE})(?!\d)"), cut).otherwise(none)


def phone(key: Column, value: Column) -> Column:
    head = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)

    def of(h: Column) -> Column:
        rest = F.substr(value, F.length(h) + 1)
        return let(
            only_digits(rest),
            lambda d: F.when(F.length(d).between(7, 15), F.concat(h, let(permute_digits(key, "phone", d), lambda x: refill(rest, x)))).otherwise(value),
        )

    return let(head, of)


def ipv4(key: Column, value: Column) -> Column:
    def of(o: Column) -> Column:
        n = lambda k: F.get(o, k).cast("long")
        octets = lambda x: F.concat((x / 256).cast("long").cast("string"), F.lit("."), F.pmod(x, F.lit(256)).cast("string"))
        half = F.lit(65536)
        out = permute(key, F.lit("ipv4"), n(0) * 256 + n(1), n(2) * 256 + n(3), half, half, lambda l, r: F.concat(octets(l), F.lit("."), octets(r)))  # noqa: E741
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), out).otherwise(value)

    return let(F.split(value, r"\."), of)


def ssn(key: Column, value: Column) -> Column:
    good = ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")

    def of(d: Column) -> Column:
        part = lambda first, n: F.substr(d, F.lit(first), F.lit(n)).cast("long")
        area = part(1, 3)
        left = area - F.when(area > 666, 2).otherwise(1)
        right = (part(4, 2) - 1) * 9999 + part(6, 4) - 1
        padded = lambda n, width: F.lpad(n.cast("long").cast("string"), width, "0")
        body = lambda l, r: F.concat(padded(l + F.when(l > 664, 2).otherwise(1), 3), padded(r / 9999 + 1, 2), padded(F.pmod(r, F.lit(9999)) + 1, 4))  # noqa: E731,E741
        return permute(key, F.lit("ssn"), left, right, F.lit(SSNS[0]), F.lit(SSNS[1]), body)

    return F.when(good, let(let(only_digits(value), of), lambda x: refill(value, x))).otherwise(value)


def date(key: Column, value: Column) -> Column:
    origin = F.lit("1700-01-01").cast("date")

    def of(day: Column) -> Column:
        body = lambda l, r: F.date_format(F.date_add(origin, (l * DAYS[1] + r).cast("int")), "yyyy-MM-dd")  # noqa: E731,E741
        out = permute(key, F.lit("date"), (day / DAYS[1]).cast("int"), F.pmod(day, F.lit(DAYS[1])), F.lit(DAYS[0]), F.lit(DAYS[1]), body)
        return F.when(day.isNotNull() & F.substring(value, 1, 4).between("1700", "2500"), out).otherwise(value)

    return let(F.datediff(F.try_to_date(value, "yyyy-MM-dd"), origin), of)


def email(key: Column, value: Column) -> Column:
    return F.concat(F.lit("user"), F.substring(_digest(key, F.lit("email"), F.lower(value)), 1, 16), F.lit("@example.invalid"))


def secret(key: Column, value: Column) -> Column:
    fresh = F.substr(_digest(key, F.lit("hex"), value), F.lit(1), F.length(value))
    return F.when(~value.rlike("[0-9]"), value).when(value.rlike("[A-F]"), F.upper(fresh)).otherwise(fresh)


def pseudonym(key: Column, value: Column) -> Column:
    """The pseudonym of a match of FIRST; one that fails its validation comes back as it is."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.contains(value, F.lit("@")), email(key, value))
        .when(whole(HEX), secret(key, value))
        .when(whole(IPV4), ipv4(key, value))
        .when(whole(DATE), date(key, value))
        .when(whole(SSN), ssn(key, value))
        .otherwise(value)
    )


def fill(text: Column, pattern: str, new: Column) -> Column:
    """``text`` with the matches of ``pattern`` replaced, in order, by ``new``."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def pseudonymize(docs: DataFrame, secret_key: str | Column, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced and ``n_replaced`` added (replacing a column of that name).

    A null key is an error, as soon as a text is searched.
    """
    t, key = F.col(text), F.col("__key")
    named = secret_key if isinstance(secret_key, Column) else F.lit(secret_key)
    docs = docs.withColumn("__key", named)
    all_of = lambda body, pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    pair = lambda body, found: F.struct(body.alias("text"), found.alias("found"))

    def marked(body: Column, pattern: str, mark: str) -> Column:
        return let(all_of(body, pattern), lambda found: pair(F.when(F.size(found) > 0, F.regexp_replace(body, pattern, mark)).otherwise(body), found))

    def marked_cards(body: Column, shaped: bool, mark: str) -> Column:
        runs = F.transform(all_of(body, RUN), lambda run: cards(run, shaped, mark))
        joined = lambda x: pair(F.when(F.size(x) > 0, fill(body, RUN, F.transform(x, lambda y: y["text"]))).otherwise(body), F.flatten(F.transform(x, lambda y: y["found"])))
        return let(runs, joined)

    # A column for each step: in one expression, each level of lambdas would be worked out anew by those around it.
    checked = F.when(key.isNotNull(), t).otherwise(F.raise_error(F.lit("the key is null")).cast("string"))
    out = docs.withColumn("__a", F.when(t.rlike("[0-9@]"), marked(checked, FIRST, MARKS[0])))
    out = out.withColumn("__b", F.when(F.col("__a").isNotNull(), marked_cards(F.col("__a")["text"], True, MARKS[1])))
    out = out.withColumn("__c", F.when(F.col("__b").isNotNull(), marked_cards(F.col("__b")["text"], False, MARKS[2])))
    out = out.withColumn("__d", F.when(F.col("__c").isNotNull(), marked(F.col("__c")["text"], LAST, MARKS[3])))
    number = lambda k, m: F.when(m.rlike(f"^(?:{SHAPE})$"), m).otherwise(phone(k, m))
    kinds = {"__a": pseudonym, "__b": card, "__c": card, "__d": number}
    found = {c: F.col(c)["found"] for c in kinds}
    out = out.withColumn("__new", F.struct(*(F.transform(found[c], partial(make, key)).alias(c) for c, make in kinds.items())))
    body = F.col("__d")["text"]
    for c, mark in reversed([*zip(kinds, MARKS, strict=True)]):
        body = fill(body, mark, F.col("__new")[c])
    changed = F.filter(F.zip_with(F.concat(*found.values()), F.concat(*(F.col("__new")[c] for c in kinds)), lambda x, y: x != y), lambda x: x)
    searched = F.col("__a").isNotNull()
    swapped = {text: F.when(searched, body).otherwise(t), "n_replaced": F.when(searched, F.size(changed)).otherwise(0).cast("long")}
    return out.withColumns(swapped).drop(*kinds, "__new", "__key")


def op6_pii_pseudonyms(spark, sf_dir):
    return pseudonymize(documents(spark, sf_dir, "doc_id", "text"), key_from(spark, store_key(spark, "demo-key")))
