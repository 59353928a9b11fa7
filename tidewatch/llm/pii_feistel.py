"""Format-preserving pseudonyms for personal data in texts: keyed Feistel permutations, DataFrame functions only.

Values are found by pattern and validated (card numbers by their Luhn sum, dates by the calendar, IPv4 octets, phone
numbers by length, US social security numbers by their reserved ranges; a phone number without country code is one of
three, three and four digits). A number that stands next to a value is not
drawn into it: no group of a phone or card number begins another value, phone numbers of plans with one length end
there, and cards are looked for inside a run of digit groups, those in a card's own grouping first. After a country
code of another plan a further number cannot be told from the phone number: up to 15 digits are taken, from the ninth
on without a group that may begin a card. A valid value is permuted by a ten-round Feistel network
over its own format, keyed by `key`: digits stay digits, letters stay letters of their case, all separators stay, a card
stays Luhn-valid and a date stays a date. Being a permutation that depends on the value alone, equal values stay equal,
and different ones different, in every document, without any table of values or shuffle: it is one map over the rows.
Of an e-mail address the part before the @ is permuted, its domain stays in clear; of a phone number the country code.

Defined cases: a null text stays null and has null pii; texts without values stay as they are and have null pii; a
number that fails its check is left alone; texts of any length are treated whole; repeated rows are treated alike. Other
columns are kept, but one named pii is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
# Kinds of personal data in order of precedence, with their patterns.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "date": r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "ssn": r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
}
# What no group of a longer number may begin: another value.
OTHER = "|".join(KINDS.values())
CARD_START = r"\d(?:[ -]?\d){12}"
# Digits after the country code in plans of one length: there a further number does not belong to the phone number.
PLANS = {8: "45|47|65|852", 9: "27|31|33|34|41|48|61|351|380|420", 10: "1|7|44|52|57|90|91"}


def _phone() -> str:
    """A phone number of a known plan, or else the most groups that have 8 to 15 digits together."""
    gap = rf"(?:[ .-](?!{OTHER}))"
    known = "|".join(rf"(?:{codes})(?:{gap}?\(0\))?(?:(?:{gap}|{gap}?\(|\){gap}?)?\d){{{n}}}" for n, codes in PLANS.items())
    # up to 8 digits any group belongs to the number, then none that may begin a card
    first, more = rf"(?:(?:{gap}(?=\d\d))?\d)", rf"(?:(?:{gap}(?=\d\d)(?!{CARD_START}))?\d)"
    rest = lambda had: rf"{first}{{{8 - had}}}{more}{{0,7}}"
    area = "|".join(rf"\d{{{c}}}[ .-]?\(\d{{{n}}}\)[ .-]?\d{rest(c + n + 1)}" for c in (3, 2, 1) for n in (1, 2, 3, 4))
    return rf"(?<![\w+])\+(?:(?:{known})|(?:{area})|\d{rest(1)})(?!\d)"


KINDS["phone"] = _phone()
NATIONAL = r"(?<![\d+(.-])(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\d-]|\.\d)"
KINDS["national phone"] = NATIONAL
# A run of digit groups with 13 digits or more: cards are looked for inside.
RUN = rf"(?<!\d)(?={CARD_START})\d++(?:[ -](?!{OTHER}|{NATIONAL})\d++)*+"
ANY = "|".join(f"(?:{p})" for p in [*KINDS.values(), RUN])
# Lengths of the groups of a card.
CARD_GROUPS = r"^(?:1[3-9]|4-4-4-4|4-4-4-4-3|4-6-5|4-6-4|4-3-3-3|4-4-5|6-13)$"
# 19 digits are tried before 16 for these first digits only.
LONG_CARDS = "^(?:6|5[0678])"
# 1900-01-01 to 2099-12-31 has 17 * 4297 days.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _hash(key: str, *parts: Column) -> Column:
    """A number from 0 to 2^60 - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def _shift(c: Column, by: Column) -> Column:
    """c moved on by `by` places in its own class: digits, small or capital letters; others stay."""
    code = F.ascii(c)
    moved = lambda first, size: F.chr((F.lit(first) + F.pmod(code - first + by, F.lit(size))).cast("long"))
    return (
        F.when(c.between("0", "9") & (F.length(c) == 1), moved(48, 10))
        .when(c.between("a", "z"), moved(97, 26))
        .when(c.between("A", "Z"), moved(65, 26))
        .otherwise(c)
    )


def permute_text(value: Column, key: str) -> Column:
    """Feistel network over the two halves of a string of letters and digits, of any length; its pattern stays.

    A value of one character is permuted by the keyed shift alone.
    """
    n = F.length(value)
    left_n = F.floor(n / 2).cast("int")
    moved = lambda half, other, i: F.array_join(
        F.transform(
            F.filter(F.split(half, ""), lambda c: c != ""),
            lambda c, j: _shift(c, F.pmod(_hash(key, i.cast("string"), j.cast("string"), other), F.lit(260)).cast("int")),
        ),
        "",
    )
    start = F.struct(F.substring(value, F.lit(1), left_n).alias("a"), F.substring(value, left_n + 1, n).alias("b"))
    rounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.struct(
            F.when(i % 2 == 1, moved(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 0, moved(s["b"], s["a"], i)).otherwise(s["b"]).alias("b"),
        ),
        lambda s: F.concat(s["a"], s["b"]),
    )
    return rounds


def permute_number(value: Column, a: int, b: int, key: str) -> Column:
    """Feistel network on 0 .. a*b - 1, the halves being remainder and quotient by b."""
    start = F.struct(F.floor(value / b).cast("long").alias("x"), F.pmod(value, F.lit(b)).cast("long").alias("y"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.struct(
            F.when(i % 2 == 1, F.pmod(s["x"] + _hash(key, i.cast("string"), s["y"].cast("string")), F.lit(a))).otherwise(s["x"]).cast("long").alias("x"),
            F.when(i % 2 == 0, F.pmod(s["y"] + _hash(key, i.cast("string"), s["x"].cast("string")), F.lit(b))).otherwise(s["y"]).cast("long").alias("y"),
        ),
        lambda s: s["x"] * b + s["y"],
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Sum of the digits, every second one doubled; odd: 1 if the last is doubled."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, j: F.when(j % 2 == 1 - odd, F.lit(2) * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced in turn by `digits`."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("at"),
        ),
        lambda s: s["out"],
    )


def kind_of(value: Column) -> Column:
    """The kind of a string that matched ANY ("run": a run of digit groups), or null where its check fails."""
    out = F.when(value.rlike(f"^(?:{KINDS['email']})$"), "email").when(value.rlike(f"^(?:{KINDS['ip']})$"), "ip")
    out = out.when(value.rlike(f"^(?:{KINDS['date']})$"), F.when(F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit("date")))
    out = out.when(value.rlike(f"^(?:{KINDS['ssn']})$"), "ssn")
    digits = F.length(_digits(value))
    return out.when(value.rlike(f"^(?:{NATIONAL})$"), "phone").when(value.startswith("+"), F.when(digits.between(8, 15), F.lit("phone"))).otherwise("run")


def _ends(groups: Column, seps: Column, i: Column) -> Column:
    """(whole, whole_n, loose, loose_n, usual): how many groups from the i-th on, and how many characters, are a valid
    card in a card's grouping, and in another one.

    Loose: up to five groups, or the whole run, the longest first. Null where there is none. Usual: whole, and with a
    first digit of the large card networks. Groups are read by number, since a slice copies the whole run each time; only
    the run itself, looked at from its first group, is joined.
    """
    n = F.size(groups)
    group = lambda j: F.get(groups, i - 1 + j)
    sep = lambda j: F.get(seps, i - 1 + j)

    def few(k: int) -> Column:
        shape = F.concat_ws("-", *[F.length(group(j)).cast("string") for j in range(k)])
        alike = F.lit(True)
        for j in range(1, k - 1):
            alike = alike & (sep(j) == sep(0))
        return F.struct(F.lit(k).alias("k"), F.concat(*[group(j) for j in range(k)]).alias("digits"), shape.alias("shape"), alike.alias("alike"))

    run = F.struct(n.alias("k"), F.array_join(groups, "").alias("digits"), F.array_join(F.transform(groups, lambda g: F.length(g).cast("string")), "-").alias("shape"), (F.size(F.array_distinct(seps)) <= 1).alias("alike"))
    counts = F.array(*[F.when(F.length(F.concat(*[group(j) for j in range(k)])).between(13, 19), few(k)) for k in range(1, 6)], F.when((i == 1) & n.between(6, 19), run))
    valid = F.filter(counts, lambda c: c.isNotNull() & F.length(c["digits"]).between(13, 19) & (F.pmod(_luhn_sum(c["digits"], 0), F.lit(10)) == 0))
    place = lambda c: F.struct(c["k"].alias("k"), (F.length(c["digits"]) + c["k"] - 1).alias("n"))
    lead = F.element_at(groups, i)

    def chosen(v: Column) -> Column:
        whole = F.transform(F.filter(v, lambda c: c["alike"] & c["shape"].rlike(CARD_GROUPS)), place)
        best = F.when(lead.rlike(LONG_CARDS), F.array_max(whole)).otherwise(F.array_min(whole))
        loose = F.array_max(F.transform(v, place))
        return F.struct(best["k"].alias("whole"), best["n"].alias("whole_n"), loose["k"].alias("loose"), loose["n"].alias("loose_n"), (best.isNotNull() & lead.rlike("^[3-6]")).alias("usual"))

    # an array of one element, so that the valid ones are found once
    return F.transform(F.array(F.struct(valid.alias("v"))), lambda x: chosen(x["v"]))[0]


def cards_in(run: Column) -> Column:
    """(at, n): first character and length of each card in a run of digit groups, from left to right.

    A card in a card's grouping goes before one in another grouping that overlaps it.
    """
    groups, seps = F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)), F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0))

    def met(x: Column, i: Column, k: Column, test: object) -> Column:
        """Whether one of the k - 1 groups after the i-th passes the test; a slice for long runs only."""
        near = F.lit(False)
        for j in range(1, 5):
            near = near | ((k > j) & F.coalesce(test(F.get(x["ends"], i - 1 + j)), F.lit(False)))
        return F.when(k > 5, F.exists(F.slice(x["ends"], i + 1, F.greatest(k, F.lit(1)) - 1), test)).otherwise(near)

    def size(x: Column, s: Column, e: Column) -> Column:
        whole = F.when(e["whole"].isNotNull(), F.when(e["usual"] | ~met(x, s["i"], e["whole"], lambda o: o["usual"]), F.struct(e["whole"].alias("k"), e["whole_n"].alias("n"))))
        loose = F.when(e["loose"].isNotNull(), F.when(~met(x, s["i"], e["loose"], lambda o: o["whole"].isNotNull()), F.struct(e["loose"].alias("k"), e["loose_n"].alias("n"))))
        return F.when(s["i"] >= s["free"], F.coalesce(whole, loose))

    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("free"), F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))

    def step(s: Column, e: Column, card: Column) -> Column:
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.coalesce(s["i"] + card["k"], s["free"]).alias("free"),
            (s["at"] + e["size"] + 1).alias("at"),
            F.when(card.isNotNull(), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), card["n"].alias("n"))))).otherwise(s["out"]).alias("out"),
        )

    def ends(x: Column) -> Column:
        each = F.transform(x["groups"], lambda g, j: F.struct(F.length(g).alias("size"), _ends(x["groups"], x["seps"], j + 1).alias("e")))
        flat = F.transform(each, lambda y: F.struct(y["size"].alias("size"), *[y["e"][c].alias(c) for c in ("whole", "whole_n", "loose", "loose_n", "usual")]))
        return F.struct(flat.alias("ends"))

    def walked(x: Column) -> Column:
        # the card at a group, if any, is made once for each group
        one = lambda s, e: F.transform(F.array(F.struct(size(x, s, e).alias("c"))), lambda y: step(s, e, y["c"]))[0]
        return F.aggregate(x["ends"], start, one, lambda s: s["out"])

    # arrays of one element, so that groups and ends are made once
    made = F.transform(F.transform(F.array(F.struct(groups.alias("groups"), seps.alias("seps"))), ends), walked)
    return made[0]


def _parts(value: Column, kind: Column) -> Column:
    """A match as an array of (value, kind): itself, or the cards of a run and what stands between them."""

    def cut(cards: Column) -> Column:
        end = lambda j: F.when(j == 0, 1).otherwise(F.try_element_at(cards, j)["at"] + F.try_element_at(cards, j)["n"])
        none = F.lit(None).cast("string")
        plain = lambda j, to: F.struct(F.substring(value, end(j), to - end(j)).alias("value"), none.alias("kind"))
        each = F.transform(cards, lambda c, j: F.array(plain(j, c["at"]), F.struct(F.substring(value, c["at"], c["n"]).alias("value"), F.lit("card").alias("kind"))))
        return F.concat(F.flatten(each), F.array(plain(F.size(cards), F.length(value) + 1)))

    return F.when(kind == "run", F.transform(F.array(cards_in(value)), cut)[0]).otherwise(F.array(F.struct(value.alias("value"), kind.alias("kind"))))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of the given kind; the value itself where kind is null."""
    at = F.instr(value, "@")
    email = F.concat(permute_text(F.substring(value, F.lit(1), at - 1), f"{key}/email"), F.substring(value, at, F.length(value)))
    octet = lambda k: F.split_part(value, F.lit("."), F.lit(k)).cast("long")
    number = permute_number(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4), 1 << 16, 1 << 16, f"{key}/ip")
    ip = _once(number, lambda n: F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
    day = permute_number(F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit(FIRST_DAY)).cast("long"), *DAYS, f"{key}/date")
    date = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")), "yyyy-MM-dd")
    part = lambda k: F.split_part(value, F.lit("-"), F.lit(k)).cast("long")
    area = part(1) - 1 - F.when(part(1) > 666, 1).otherwise(0)
    ssn_n = permute_number((area * 99 + part(2) - 1) * 9999 + part(3) - 1, 898, 99 * 9999, f"{key}/ssn")

    def ssn_of(n: Column) -> Column:
        low, high = F.pmod(n, F.lit(99 * 9999)), F.floor(n / (99 * 9999)) + 1
        return F.format_string("%03d-%02d-%04d", (high + F.when(high >= 666, 1).otherwise(0)).cast("long"), (F.floor(low / 9999) + 1).cast("long"), (F.pmod(low, F.lit(9999)) + 1).cast("long"))

    ssn = _once(ssn_n, ssn_of)
    # the country code stays
    code = F.length(F.regexp_extract(value, r"^\+(1|7|\d\d)", 1))
    digits = _digits(value)
    phone = _once(F.concat(F.substring(digits, F.lit(1), code), permute_text(F.substring(digits, code + 1, F.length(digits)), f"{key}/phone")), lambda d: _refill(value, d))
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), f"{key}/card")
    checked = _once(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn_sum(b, 1), F.lit(10)), F.lit(10)).cast("string")))
    card = _once(checked, lambda d: _refill(value, d))
    by_kind = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
    out = value
    for name, new in by_kind.items():
        out = F.when(kind == name, new).otherwise(out)
    return out


def pseudonymise(df: DataFrame, key: str = "tidewatch", text_col: str = "text") -> DataFrame:
    """df with the personal data in text_col replaced and a column pii: array of (kind, pseudonym) in text order."""
    text = F.col(text_col)
    some = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = F.transform(some, lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    kept = [F.col(f"`{c}`") for c in df.columns if c != "pii"]
    at = free_name(df, "_found")
    step = df.select(*kept, found.alias(at))
    step = step.withColumn(at, F.when(F.size(at) > 0, F.transform(at, lambda m: _parts(m["value"], m["kind"]))))
    made = F.transform(at, lambda m: F.transform(m, lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"))))
    step = step.withColumn(at, F.when(F.size(at) > 0, made))
    # the text between the values, then value by value
    values = F.transform(at, lambda m: F.array_join(F.transform(m, lambda x: x["pseudonym"]), ""))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), values, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    new = F.when(F.size(at) > 0, joined).otherwise(text)
    pii = F.filter(F.flatten(F.coalesce(F.col(at), F.array())), lambda m: m["kind"].isNotNull())
    return step.withColumns({text_col: new, "pii": F.when(F.col(at).isNull(), F.lit(None)).otherwise(pii)}).drop(at)
