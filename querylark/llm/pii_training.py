"""Makes pii_model.py: gradient boosting in numpy over proposed spans in made-up sentences, with the features that the DataFrame
operator computes. The calibration curve and the thresholds come from sentences of another style than the trees learn from. `python -m querylark.llm.pii_training` writes the file; the result depends only on the seed."""

from __future__ import annotations

import random
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SEED, TREES, DEPTH, RATE = 5, 32, 3, 0.3
#: Share of the calibration's personal spans that a generator's threshold has to let through.
RECALL = 0.99


@dataclass(frozen=True)
class Style:
    """Words and forms of made-up sentences; those that thresholds are chosen on differ from those that trees learn from."""

    words: list[str]
    set_to: tuple[str, ...]  # before a secret
    shown: tuple[str, ...]  # before a digest or name
    phones: tuple[str, ...]
    phone_forms: tuple[str, ...]
    ids: tuple[str, ...]
    cards: tuple[str, ...]
    numbers: tuple[str, ...]
    at: tuple[tuple[str, str], ...]


LEARN = Style(
    "the report from last week shows that item was moved to north hall and seen by staff under order page total year und der die les pour una casa required expired".split(),
    ("token = ", "TOKEN = ", "secret: ", "api_key=", "password = ", "token=", "auth: ", "pwd: "), ("commit ", "sha1 ", "see ", "file ", "etag: ", ""),
    ("tel ", "call ", "phone: ", "mobile ", "fax ", "whatsapp ", ""), ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"), ("account ", "passport: ", "konto ", "iban "), ("card ", "visa ", "credit card: ", "karte "),
    ("", "order ", "number ", "isbn ", "total "), (("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", ".")),
)
CHOOSE = Style(
    "a letter of spring tells how many boats lay in harbour while rain fell on roofs eine kleine stadt am fluss dans un petit village muchas gracias pending missing".split(),
    ("access_key: ", "Token: ", "passwd=", "SECRET=", "api-key = ", "password: ", "credentials: ", "auth = "), ("version ", "md5 ", "cf. ", "blob ", "digest: ", "", "id "),
    ("telephone ", "Handy: ", "phone ", "call ", "mobile: ", "fax: "), ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}"), ("account: ", "iban: ", "passport ", "Ausweis "), ("mastercard ", "credit ", "amex: ", "card: "),
    ("", "parcel ", "row ", "ticket ", "sum ", "serial "), (("[at]", "[dot]"), ("(at)", "."), (" [AT] ", " [DOT] "), ("[ at ]", "(dot)")),
)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn(d: str) -> str:
    """The digits and their check digit."""
    total = sum((int(c) if i % 2 else int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d)))
    return d + str(-total % 10)


def examples(n: int, seed: int, style: Style = LEARN) -> list[tuple[str, str, int]]:
    """(text, the span's text, whether it is personal or secret)."""
    r = random.Random(seed)
    out = []
    hexa, mixed, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "abcdefghijklmnopqrstuvwxyz"
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    plain = lambda k: " ".join(r.choice(style.words) for _ in range(k))
    phone = lambda: r.choice(style.phone_forms).format(_digits(r, 3), _digits(r, 3), _digits(r, 4))
    for _ in range(n):
        kind = r.randrange(15)
        before, after, y = "", "", 1
        quote = r.choice(("", '"', "'"))
        if kind == 0:
            v, before, after = some(hexa, r.choice((32, 40, 64))), r.choice(style.set_to) + quote, quote
        elif kind == 1:
            v, before, after = some(mixed, r.randrange(19, 48)), r.choice(style.set_to) + quote, quote
        elif kind == 2:  # digests, versions, slugs
            v, before, y = r.choice((some(hexa, r.choice((32, 40, 64))), "chapter-" + _digits(r, 2) + "-of-the-manual", "IMG_2024" + _digits(r, 10), "part_" + _digits(r, 4) + "_north_hall")), r.choice(style.shown), 0
        elif kind == 3:
            v, before = phone(), r.choice(style.phones)
        elif kind == 4:
            v, before = f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", r.choice(("ssn ", "ssn: ", "social security ", ""))
        elif kind == 5:
            v, before = _digits(r, r.randrange(13, 17)), r.choice(style.cards)
        elif kind == 6:  # order numbers, counters, sums with a wrong check digit
            d = _luhn(_digits(r, 15))
            v, before, y = r.choice((d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10), _digits(r, r.randrange(7, 13)))), r.choice(style.numbers), 0
        elif kind == 7:
            v, before, y = r.choice((f"{_digits(r, 4)}-{_digits(r, 2)}-{_digits(r, 2)}", f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", f"{_digits(r, 2)}.{_digits(r, 2)}.{_digits(r, 4)}")), r.choice(("", "on ", "of ", "from ")), 0
        elif kind == 8:
            a, b = r.choice(style.at)
            v = f"{r.choice(style.words)}.{r.choice(style.words)}{_digits(r, r.randrange(3))}{a}{r.choice(style.words)}{b}com"
        elif kind == 9:
            v, before = _digits(r, r.randrange(8, 13)), r.choice(style.ids)
        elif kind == 10:
            v, before = _digits(r, r.randrange(9, 12)), r.choice(style.phones[:-1])
        elif kind == 11:  # secrets of letters, or short with marks
            v, before, after = r.choice((some(letters, r.randrange(12, 90)), some(mixed + "!#%", r.randrange(8, 15)) + "7")), r.choice(style.set_to) + quote, quote
        elif kind == 12:  # long words and paths
            v, y = r.choice((some(letters, r.randrange(16, 40)), some(letters, 1).upper() + some(letters, r.randrange(15, 30)), "/".join(some(letters, r.randrange(3, 9)) for _ in range(5)), "-".join(some(letters, 5) for _ in range(4)))), 0
            before = r.choice(("", "", "see ", "the "))
        elif kind == 13:  # a word about a secret
            v, before, y = r.choice([w for w in style.words if len(w) >= 6]), r.choice(style.set_to[:3]), 0
        else:
            v, before, y = f"{r.choice(style.words)} (at) {_digits(r, r.randrange(1, 3))}.{_digits(r, 2)}", r.choice(("", "met ")), 0
        out.append((f"{plain(4)} {before}{v}{after} {plain(4)}", v, y))
    return out


def table(spark: SparkSession, n: int, seed: int, style: Style = LEARN) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels; a proposal is positive if it overlaps a positive example's span."""
    from querylark.llm.pii import candidates

    df = spark.createDataFrame([(i, *e) for i, e in enumerate(examples(n, seed, style))], "i long, text string, v string, y int")
    df = df.withColumn("at", F.expr("locate(v, text) - 1")).select("i", "y", "at", F.expr("length(v)").alias("size"), F.explode(candidates(F.col("text"))).alias("c"))
    hit = (F.col("c.s") < F.col("at") + F.col("size")) & (F.col("at") < F.col("c.e"))
    rows = df.filter(hit).select("i", F.col("c.f").alias("f"), "y").orderBy("i", "f").collect()
    return np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows])


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> list | float:
    leaf = round(float(RATE * g.sum() / (h.sum() + 1.0)), 6)
    if not depth or len(x) < 8:
        return leaf
    best, cut = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in values[:-1]:
            left = x[:, j] <= t
            gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - whole
            if gain > best + 1e-9:
                best, cut = gain, (j, int(t), left)
    if cut is None:
        return leaf
    j, t, left = cut
    return [j, t, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)]


def raw(x: np.ndarray, prior: float, trees: list) -> np.ndarray:
    def one(t: list | float, row: np.ndarray) -> float:
        while isinstance(t, list):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    return np.array([prior + sum(one(t, row) for t in trees) for row in x])


def train(spark: SparkSession) -> dict:
    x, y = table(spark, 4000, SEED)
    prior = round(float(np.log(y.mean() / (1 - y.mean()))), 6)
    trees: list = []
    z = np.full(len(y), prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(_tree(x, y - p, p * (1 - p), DEPTH))
        z += raw(x, 0.0, trees[-1:])
    cx, cy = table(spark, 4000, SEED + 1, CHOOSE)  # other words and forms than the trees saw
    s = raw(cx, prior, trees)
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt: Newton steps
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((cy - p) * s).sum() - 0.1 * a, (cy - p).sum()])
        hess = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum()]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-(a * s + b)))
    thresholds = []
    for g in range(3):  # the greatest threshold that RECALL of the generator's personal spans reach
        own = np.sort(p[(cx[:, 0] == g) & (cy == 1)])
        thresholds.append(float(np.floor(own[int((1 - RECALL) * len(own))] * 1e4) / 1e4))
    return {"PRIOR": prior, "TREES": trees, "CALIBRATION": (round(float(a), 6), round(float(b), 6)), "THRESHOLDS": thresholds}


def main() -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    model = train(spark)
    lines = ['"""Made by pii_training.py: trees over pii.FEATURES, as [feature, threshold, left, right] or a leaf."""', ""]
    lines += [f"{k} = {v!r}" if k != "TREES" else "TREES = [\n" + "".join(f"    {t!r},\n" for t in v) + "]" for k, v in model.items()]
    Path(__file__).with_name("pii_model.py").write_text("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
