"""Personal data and secrets, in DataFrame functions only.

Four base kinds are exact patterns. Beyond them high-recall generators propose spans that may overlap (long tokens and whatever a
word for a secret is set to, digit groups, e-mail addresses written out), of any length; gradient-boosted trees score each by its
format and the BEFORE characters of text before it; the score is calibrated, and spans at or above their generator's threshold are
selected. Of overlapping proposals the best stays, and base spans always stay. The trees are plain data (pii_model.py, made by pii_training.py)
and become CASE expressions.

Patterns use possessive quantifiers and look-behind, so that no run of characters is scanned again from each of its positions.
Sums and maxima along an array are worked out in steps of STEP, so that a text with many matches takes time in proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylark.llm import pii_model

_LOCAL = "A-Za-z0-9._%+-"
#: A match may begin where a run of the local part begins, or right after the last match.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Chains of digits with single separators are maximal, so only those of 13 to 19 digits are taken out.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

_TOKEN = "A-Za-z0-9_/+-"
_SECRET_WORDS = "passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|auth|bearer|credentials?|passwort|contraseña|mot de passe"
#: A word for a secret is looked for only where something is set.
_SET = rf"[=:](?i:(?<=(?:{_SECRET_WORDS}) ?[=:]))"
SECRET = rf"(?i)(?<![\p{{L}}{_TOKEN}])(?:[{_TOKEN}]{{16,}}+(?!\p{{L}})|(?<=[=:] ?[\"']?)(?<=(?:{_SECRET_WORDS}) ?[=:] ?[\"']?)[^\s\"',;<>()]{{6,}}+)"
NUMBER = r"(?<![0-9A-Za-z.+])\(?[0-9](?:[ .()-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"
WRITTEN = rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]++)++"
ADDED = ("secret", "number", "email_written")
KINDS = BASE + ADDED

FEATURES = ("generator", "length", "digits", "letters", "hex", "separators", "luhn", "secret_words", "phone_words", "card_words", "id_words", "assigned", "phone_shape", "id_shape", "upper", "single_word")
#: Code points before a span that features look at.
BEFORE = 24
STEP = 256


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once: inside a lambda a plain expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def running(values: Column, greatest: bool = False) -> Column:
    """array<int>: the sum (or the greatest) of the values up to each, STEP values at a time: no step copies what came before."""
    more = (lambda a, b: F.greatest(a, b)) if greatest else (lambda a, b: a + b)
    empty = F.array().cast("array<int>")

    def along(part: Column) -> Column:
        return F.aggregate(part, empty, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) > 0, more(F.get(acc, F.size(acc) - 1), v)).otherwise(v))))

    def joined(parts: Column) -> Column:
        def added(ends: Column) -> Column:
            return F.flatten(F.transform(parts, lambda p, i: F.when(i > 0, F.transform(p, lambda v: more(v, F.get(ends, i - 1)))).otherwise(p)))

        return let(along(F.transform(parts, lambda p: F.get(p, F.size(p) - 1))), added)

    def stepped(x: Column) -> Column:
        steps = F.sequence(F.lit(0), ((F.size(x) - 1) / STEP).cast("int"))
        return F.when(F.size(x) <= STEP, along(x)).otherwise(let(F.transform(steps, lambda i: along(F.slice(x, i * STEP + 1, F.lit(STEP)))), joined))

    return let(values, stepped)


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct<s, e, v, before>>: begin and end of each match in code points, its text, and if asked the BEFORE code points before
    it. The parts between matches, from split(), give both."""

    def place(x: Column) -> Column:
        found, between = x["found"], x["between"]
        steps = F.transform(found, lambda v, i: F.length(F.get(between, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))

        def tail(i: Column) -> Column:  # a match has six code points or more, so four of them and what lies between are enough
            parts = [F.coalesce(F.right(F.get(a, i - j), F.lit(BEFORE)), F.lit("")) for j in range(4, 0, -1) for a in (between, found)]
            return F.right(F.concat(*parts, F.get(between, i)), F.lit(BEFORE))

        before = lambda i: (F.lower(tail(i)) if context else F.lit(None).cast("string")).alias("before")
        return let(running(steps), lambda s: F.transform(found, lambda v, i: F.struct(F.get(s, i).alias("s"), (F.get(s, i) + F.length(v)).alias("e"), v.alias("v"), before(i))))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), place)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def term(i: Column) -> Column:
        one = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, one).otherwise(one * 2 - F.when(one > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e, v>> of the base kinds, in their order, then by position."""

    def of(k: int, pattern: str, guard: Column, keep: Callable[[Column], Column] | None) -> Column:
        found = matches(text, pattern)
        if keep is not None:
            found = F.filter(found, lambda m: keep(m["v"]))
        out = F.transform(found, lambda m: F.struct(F.lit(k).alias("k"), m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v")))
        return F.when(guard, out).otherwise(F.array().cast("array<struct<k:int,s:int,e:int,v:string>>"))

    number = text.rlike("[0-9]")
    return F.concat(
        of(0, EMAIL, F.contains(text, F.lit("@")), None),
        of(1, IP, number, lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        of(2, CARD, number, lambda v: let(digits(v), luhn)),
        of(3, PHONE, F.contains(text, F.lit("+")), lambda v: F.length(digits(v)).between(9, 15)),
    )


def _words(alternatives: str) -> str:
    """Words that begin so, also after an underscore; short ones whole."""
    return "(?:^|[^a-z])(?:" + "|".join(w + "(?![a-z])" if len(w) < 5 else w for w in alternatives.split("|")) + ")"


def candidates(text: Column) -> Column:
    """array<struct<g, s, e, f>>: generator, begin, end and FEATURES of each proposed span."""

    def of(g: int, pattern: str, guard: Column) -> Column:
        def described(m: Column) -> Column:
            def features(x: Column) -> Column:
                v, before, d = x["v"], x["before"], x["d"]
                flag = lambda c: c.cast("int")
                return F.struct(
                    F.lit(g).alias("g"), m["s"].alias("s"), m["e"].alias("e"),
                    F.array(
                        F.lit(g), F.length(v), F.length(d), F.length(F.regexp_replace(v, "[^A-Za-z]", "")), flag(v.rlike("^[0-9a-fA-F]+$")), F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
                        F.when(F.length(d).between(13, 19), flag(luhn(d))).otherwise(0),
                        flag(before.rlike(_words("token|secret|passw|pwd|api.?key|key|bearer|auth|credential"))), flag(before.rlike(_words("tel|telephone|telefon|phone|call|mobile|fax|whatsapp|handy|portable"))),
                        flag(before.rlike(_words("card|visa|master|amex|credit|karte|carte|tarjeta"))), flag(before.rlike(_words("ssn|social|passport|iban|account|konto|ausweis|pasaporte|passeport"))),
                        flag(before.rlike("[=:] *[\"']?$")), flag(v.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")), flag(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
                        F.length(F.regexp_replace(v, "[^A-Z]", "")), flag(v.rlike("^[A-Z]?[a-z]+$")),
                    ).alias("f"),
                )

            return let(F.struct(m["v"].alias("v"), m["before"].alias("before"), digits(m["v"]).alias("d")), features)

        empty = F.array().cast("array<struct<g:int,s:int,e:int,f:array<int>>>")
        return F.when(guard, F.transform(matches(text, pattern, True), described)).otherwise(empty)

    number = text.rlike("[0-9]")
    return F.concat(of(0, SECRET, text.rlike(rf"[{_TOKEN}]{{16}}|{_SET}")), of(1, NUMBER, number), of(2, WRITTEN, text.rlike(r"(?i)[\[(] ?at ?[\])]")))


def boosted(f: Column, trees: list) -> Column:
    """Sum of the trees: [feature, threshold, left, right] or a leaf; a value up to the threshold goes left."""

    def node(t: list | float) -> Column:
        if not isinstance(t, list):
            return F.lit(float(t))
        return F.when(F.get(f, F.lit(t[0])) <= t[1], node(t[2])).otherwise(node(t[3]))

    total = F.lit(pii_model.PRIOR)
    for t in trees:
        total = total + node(t)
    return total


def probability(f: Column) -> Column:
    """Calibrated by a logistic curve over the trees' sum."""
    a, b = pii_model.CALIBRATION
    return 1 / (1 + F.exp(-(boosted(f, pii_model.TREES) * a + b)))


def runs(spans: Column) -> Column:
    """array<struct<i, n, e>> of spans sorted by begin: where each run of overlapping ones starts, how many it has and where it ends."""

    def of(top: Column) -> Column:
        first = F.filter(F.transform(spans, lambda c, i: F.when((i == 0) | (F.get(top, i - 1) <= c["s"]), i)), lambda i: i.isNotNull())
        last = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(spans))
        return let(first, lambda f: F.transform(f, lambda i, j: F.struct(i.alias("i"), (last(f, j) - i).alias("n"), F.get(top, last(f, j) - 1).alias("e"))))

    return let(running(F.transform(spans, lambda c: c["e"]), True), of)


SPANS = "array<struct<s:int,e:int,k:int,p:double>>"


def scored(text: Column) -> Column:
    """array<struct<s, e, k, p>>: the proposals that reach their generator's threshold."""
    threshold = F.array(*[F.lit(x) for x in pii_model.THRESHOLDS])

    def kept(found: Column) -> Column:
        every = F.transform(found, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), (c["g"] + len(BASE)).alias("k"), probability(c["f"]).alias("p")))
        return F.filter(every, lambda c: c["p"] >= F.get(threshold, c["k"] - len(BASE)))

    return let(candidates(text), kept)


def free(every: Column) -> Column:
    """Of proposals and base spans (k < 4) by begin the proposals that meet no base span: none before reaches them, none after begins in
    them."""
    none = 2**31 - 1
    reach = running(F.transform(every, lambda c: F.when(c["k"] < len(BASE), c["e"]).otherwise(0)), True)
    follow = F.reverse(running(F.reverse(F.transform(every, lambda c: F.when(c["k"] < len(BASE), -c["s"]).otherwise(-none))), True))
    alone = lambda c, x, i: (c["k"] >= len(BASE)) & (F.get(x["reach"], i) <= c["s"]) & (-F.get(x["follow"], i) >= c["e"])
    marked = lambda x: F.filter(F.transform(every, lambda c, i: F.when(alone(c, x, i), c)), lambda c: c.isNotNull())
    return let(F.struct(reach.alias("reach"), follow.alias("follow")), marked)


def likeliest(good: Column) -> Column:
    """Of overlapping proposals, sorted by begin, the likelier, then the earlier."""

    def keep(kept: Column, c: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        apart = (F.size(kept) == 0) | (last["e"] <= c["s"])
        better = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(c))
        return F.when(apart, F.concat(kept, F.array(c))).when(c["p"] > last["p"], better).otherwise(kept)

    one = lambda r: F.aggregate(F.slice(good, r["i"] + 1, r["n"]), F.array().cast(SPANS), keep)
    return F.flatten(F.transform(runs(good), one))


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """The table and out: array<struct<k, s, e>> of the text's spans by kind, then begin; of a null text none. Each step is a projection
    of its own, since one expression of them all would be too deep to be analysed."""
    text, base, found = f"`{text_col}`", f"_{out}_base", f"_{out}_found"
    t = F.coalesce(F.col(text), F.lit(""))
    # what no pattern can find anything in
    some = t.rlike(rf"[0-9@+]|[\[(] ?(?i:at) ?[\])]|[{_TOKEN}]{{16}}|{_SET}")
    shown = F.transform(base, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["k"].alias("k"), F.lit(0.0).alias("p")))
    none = F.array().cast(SPANS)
    any_ = F.size(found) > 0
    df = docs.withColumn(base, F.when(some, let(t, base_spans)).otherwise(F.array().cast("array<struct<k:int,s:int,e:int,v:string>>")))
    df = df.withColumn(found, F.when(some, let(t, scored)).otherwise(none))
    df = df.withColumn(found, F.when(any_, let(F.array_sort(F.concat(F.col(found), shown)), free)).otherwise(none))
    df = df.withColumn(found, F.when(any_, let(F.col(found), likeliest)).otherwise(none))
    flat = lambda c: F.transform(c, lambda m: F.struct(m["k"].alias("k"), m["s"].alias("s"), m["e"].alias("e")))
    return df.withColumn(out, F.array_sort(F.concat(flat(F.col(base)), flat(F.col(found))))).drop(base, found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: array<struct<k, s, e>> by kind (an index of KINDS), then begin; positions in code points, end exclusive.

    A null text is empty and has no spans. Repeated rows and null doc_ids are carried; other columns are left out. A very long text,
    or one with many matches, is handled whole, in time in proportion to both. An empty table gives no rows."""
    return with_spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))


def as_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"].cast("string"), m["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first kind in brackets; null stays null. The text is cut
    into blocks once, since a part of a long string is found only by going through it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    size = 4096

    def part(blocks: Column, a: Column, b: Column) -> Column:
        i, j = (a / size).cast("int"), ((b - 1) / size).cast("int")
        one = F.substring(F.get(blocks, i), a % size + 1, b - a)
        several = F.concat(F.substring(F.get(blocks, i), a % size + 1, F.lit(size)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(blocks, j), F.lit(1), (b - 1) % size + 1))
        return F.when(b <= a, "").when(i == j, one).otherwise(several)

    def fill(x: Column) -> Column:
        m, o, blocks = x["runs"], x["spans"], x["blocks"]
        before = lambda j: F.when(j > 0, F.get(m, j - 1)["e"]).otherwise(0)
        filled = F.transform(m, lambda r, j: F.concat(part(blocks, before(j), F.get(o, r["i"])["s"]), F.get(names, F.get(o, r["i"])["k"])))
        return F.concat(F.array_join(filled, ""), part(blocks, F.get(m, F.size(m) - 1)["e"], F.length(text)))

    by_place = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(by_place, lambda o: let(F.struct(runs(o).alias("runs"), o.alias("spans"), blocks.alias("blocks")), fill)))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (strings of kind:begin:end) of what find() returns."""
    def number(i: int) -> Column:
        return F.size(F.filter("spans", lambda m: m["k"] == i)).cast("long").alias(f"n_{BASE[i]}")

    counts = [number(i) for i in range(len(BASE))]
    base = as_string(F.filter("spans", lambda m: m["k"] < len(BASE)))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"))
