"""Query text on the driver: modifiers, parser, dates, addresses, names, stemmers."""

import random

import pytest

from querylark.analysis import cjk, stemmers
from querylark.analysis.analyzers import fold, plain
from querylark.functions import names
from querylark.query import dates, ip, modifiers, parser
from querylark.schema import Field, Ghost, Schema, SchemaError, widen


@pytest.mark.parametrize(
    "text, query, limit, fields, sort",
    [
        ("a b limit 5", "a b", 5, None, None),
        ("a return x,y limit 3", "a", 3, ["x", "y"], None),
        ("a return x, y sort z desc", "a", None, ["x", "y"], ("z", True)),
        ("a sort z:asc limit 2", "a", 2, None, ("z", False)),
        ("limit 5", "limit 5", None, None, None),
        ("a limit many", "a limit many", None, None, None),
        ("sort by date", "sort by date", None, None, None),
        ("a return tax forms", "a return tax forms", None, None, None),
        ("a limit 5 b", "a limit 5 b", None, None, None),
        ("a limit 5 limit 6", "a limit 5", 6, None, None),
    ],
)
def test_modifier_run(text, query, limit, fields, sort):
    m = modifiers.split(text)
    assert (m.query, m.limit, m.fields, m.sort) == (query, limit, fields, sort)


def test_measures_repeat_and_continue_across_commas():
    m = modifiers.split("* limit 0 min(a) min(b, c) max(d)")
    assert (m.query, m.least, m.most, m.limit) == ("*", ["a", "b", "c"], ["d"], 0)
    assert modifiers.split("* min(a b)").least == []


@pytest.mark.parametrize(
    "text, shown",
    [
        ("title:rust AND NOT tag:draft", "+title:rust -tag:draft"),
        ("title:rust OR NOT tag:draft", "title:rust (* -tag:draft)"),
        ("NOT NOT a", "a"),
        ("a b AND c", "a (+b +c)"),
        ("f:(a OR b)", "f:a f:b"),
        ("f:[1 TO *}", "f:[1 TO *}"),
        ("f:>=5", "f:[5 TO *]"),
        ('f:"a b"~2', 'f:"a b"~2'),
        (r"f:a\*b", "f:a*b"),
        ("k8s.node:w-1", "k8s.node:w-1"),
        ("f: IN [a b]", "f: IN [a b]"),
    ],
)
def test_normal_form(text, shown):
    assert parser.show(parser.parse(text).clause) == shown


def test_depth_is_limited():
    parser.parse("(" * 60 + "a" + ")" * 60)
    with pytest.raises(parser.QueryRefused):
        parser.parse("(" * 70 + "a")


def test_odd_text_never_raises_anything_else():
    r = random.Random(5)
    bits = ["a", "é漢", ":", "(", ")", '"', "[", "]", "{", "TO", "AND", "OR", "NOT", "IN", "*", "^2", "~", "+", "-", "\\", "/", " ", " ", ">", "<=", "f:"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 25)))
        try:
            parser.parse(text)
        except parser.QueryRefused:
            pass


def test_point_lookup():
    assert parser.point_lookup("id:abc-1", ("id",)) == "abc-1"
    assert parser.point_lookup(r"id:doc\^2", ("id",)) == "doc^2"
    for text in ("id:a b", "id:a*", "id:>3", "other:a", 'id:"a"'):
        assert parser.point_lookup(text, ("id",)) is None


@pytest.mark.parametrize(
    "text",
    "2024-06-15T12:00:00Z|2024-06-15T14:00:00+02:00|Sat, 15 Jun 2024 12:00:00 +0000|2024-06-15 12:00:00|2024/06/15 12:00|2024.06.15T12:00|06/15/2024 12:00|15.06.2024 12:00:00|20240615120000|202406151200|1718452800|2024-06-15T12:00:00.250Z".split("|"),
)
def test_date_forms(text):
    assert dates.parse(text) == 1718452800


def test_dates_that_are_partial_wrong_or_far():
    assert dates.parse("2024-06") == dates.parse("2024-06-01") == dates.parse("June 1, 2024") == dates.parse("1 Jun 2024")
    assert dates.parse("2024") == dates.parse("20240101")
    for bad in ("15/03/2024", "03.15.2024", "24-01-01", "2024-13-01", "soon", "12345"):
        assert dates.parse(bad) is None
    assert dates.parse("9999-01-01") == dates.MOST and dates.parse("0001-01-01") == dates.LEAST


def test_addresses():
    assert ip.key("10.1.2.3") == ip.key("::ffff:10.1.2.3") < ip.key("2001:db8::1")
    assert ip.block("10.9.9.9/8") == (ip.key("10.0.0.0"), ip.key("10.255.255.255"))
    assert ip.key("x") is None and ip.block("10.0.0.0") is None
    assert ip.prefix_block("10.1.*") == "10.1.0.0/16"


def test_names():
    assert [names.id_rank(n) for n in ("id", "sha256", "md5Hash", "digest", "uuid", "userID", "pk_main", "seqno", "width", "name")] == [0, 3, 6, 7, 8, 9, 10, 11, 12, 13]
    assert names.suggestions("titel", ["title", "body"])[0] == "title"
    assert names.suggestions("compile_date", ["date_binary_compiled_on", "zzz"]) == ["date_binary_compiled_on"]
    assert names.spellings("austen, jane") == ["austen, jane", "Austen, jane", "Austen, Jane", "AUSTEN, JANE"]


@pytest.mark.parametrize(
    "fn, words, stems",
    [
        (stemmers.english, "running ponies caresses generously nationality hopping argued agreement sky dying", "run poni caress generous nation hop argu agreement sky die"),
        (stemmers.german, "aufeinander häuser jahre aufgaben freundlichkeit", "aufeinand haus jahr aufgab freundlich"),
        (stemmers.french, "continuellement majestueusement nationalités finissons", "continuel majestu national fin"),
        (stemmers.spanish, "cheques torneos nacionalidad corriendo", "chequ torne nacional corr"),
        (stemmers.italian, "abbandonata pronunciamento propizio", "abbandon pronunc propiz"),
        (stemmers.portuguese, "boataria quilométricas quiosques", "boat quilométr quiosqu"),
    ],
)
def test_stemmers(fn, words, stems):
    assert [fn(w) for w in words.split()] == stems.split()


def test_folds_and_cjk():
    assert fold("čšžđ ß æ é") == "cszd ss ae e"
    assert plain("Naïve-Test, 3x!") == ["naïve", "test", "3x"]
    assert plain(cjk.split("孔子曰 abc")) == ["孔", "子", "曰", "abc"]
    assert stemmers.german_plain("neue mueller quelle") == "neue muller quelle"


def test_schema_rules():
    assert widen("i64", "f64") == "f64" and widen("i64", "date") == "text"
    text = Field("t", "text")
    Schema((text, Field("g", "text", ghost=Ghost("t"))), ("t",)).validate(["default"])
    for bad in (
        Schema((text, text)), Schema((Field("a", "vector"),)), Schema((Field("a", "text", tokenizer="none"),)), Schema((text,), ("nope",)),
        Schema((Field("g", "text", ghost=Ghost("missing")),)), Schema((text,), description="x" * 600),
    ):
        with pytest.raises(SchemaError):
            bad.validate(["default"])
    a = Schema((text,))
    b = a.learn(Schema((text, Field("n", "i64"))))
    assert not b.get("n").indexed and b.version == 2
    assert b.learn(Schema((Field("n", "f64"),))).get("n").type == "f64"
    assert a.thumbprint() != b.thumbprint() == Schema(tuple(reversed(b.fields))).thumbprint()


def test_terms_are_mapped_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    from querylark.analysis import analyzers

    seen = []
    monkeypatch.setattr(analyzers, "PART_BYTES", 40, raising=False)
    monkeypatch.setattr(analyzers, "MOST_SEEN", 5, raising=False)
    texts = [" a  b  a ", None, "", *[f" t{i}  b " for i in range(50)], " a " * 40]
    got = [x for out in analyzers._mapped(lambda t: seen.append(t) or t.upper())(iter([pa.array(texts[:20]), pa.array(texts[20:]), pa.array([], pa.string())])) for x in out.to_pylist()]
    assert got == [t and " " + "  ".join(t.upper().split()) + " " for t in texts]
    assert seen.count("b") == 1 and 1 <= seen.count("a") <= 2
