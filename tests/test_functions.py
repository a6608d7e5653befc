"""Text and identifier functions on small vectors."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import identity as idn
from quire.functions import text as tx
from quire.functions.urls import normalize_repository_host


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in rows.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    texts = ["Ｎｏ.７ GROẞ 漢", "東京都", "v2東京 x", "…—", None, "\U00020010\U00020011"]
    want = [["no", "7", "gross", "漢"], ["東", "京", "都", "東京", "京都"], ["v2", "東", "京", "東京", "x"], [], [], ["\U00020010", "\U00020011", "\U00020010\U00020011"]]
    assert column(spark, texts, tx.tokenize) == want


def test_folding_keeps_double_marks(spark):
    assert column(spark, ["café å ế й ß"], tx.folded) == ["cafe a ế й ß"]


def test_segment_id(spark):
    got = spark.range(1).select(tx.segment_id(F.lit("o"), F.lit("s"), F.lit(3))).first()[0]
    assert got == "seg_" + hashlib.sha256(b"segment-v1\0o\0s\x003").hexdigest()


def test_lines(spark):
    texts = ["a\r\nb c\n", "", "x", "\n\ny\x0b"]
    assert column(spark, texts, tx.lines) == [t.splitlines() for t in texts]


def test_doi(spark):
    forms = ["10.5555/Qu.9", "DOI:10.5555/qu.9", " http://dx.doi.org/10.5555/QU.9 ", "10.5555%2fqu.9", "10.5555/qu.9;."]
    assert column(spark, [*forms, "9.5555/qu", "10.5555/p+q%zz", None], idn.normalize_doi) == ["10.5555/qu.9"] * 5 + [None, "10.5555/p+q%zz", None]


def test_arxiv(spark):
    got = column(spark, ["arxiv: 1905.00123v4", "http://www.arxiv.org/abs/cond-mat/0211002v1", "hep-TH/9812345", "https://arxiv.org/pdf/1905.00123.pdf", "1905"], idn.normalize_arxiv)
    assert [g and tuple(g) for g in got] == [("1905.00123", 4), ("cond-mat/0211002", 1), ("hep-th/9812345", None), ("1905.00123", None), None]


def ten(nine):
    check = -sum((10 - i) * int(d) for i, d in enumerate(nine)) % 11
    return nine + ("X" if check == 10 else str(check))


def thirteen(twelve):
    return twelve + str(-sum((1, 3)[i % 2] * int(d) for i, d in enumerate(twelve)) % 10)


def test_isbn(spark):
    bodies = ["316148410", "012345672", "999999999", "155404295"]
    full = [thirteen("978" + b) for b in bodies]
    assert column(spark, [ten(b) for b in bodies] + full, idn.normalize_isbn) == full * 2
    broken = [b[:-1] + str((int(b[-1]) + 1) % 10) for b in full]
    assert column(spark, [*broken, "97" + full[0], "", None], idn.normalize_isbn) == [None] * 7
    spaced = f"{full[0][:3]}-{full[0][3:5]} {full[0][5:]}"
    assert column(spark, [f"x; {spaced},{ten(bodies[0])}\n{ten(bodies[1])}", f"{full[0]} {full[1]}"], idn.isbn_values) == [[full[0], full[1]], []]


def test_urls(spark):
    given = ["HTTP://MÜLLER.example:80//a/./b/../c/%7eX/%2f?Y=%7e#z", "mailto:me@x.org", "https://me@x.org/", "https://x.org:8443?q", "x.org/a", "https://x.org/a/b/..", "https://[2001:DB8::1]:443/", "https://x..org/", "https://x.org:70000/", " https://x.org/", None]
    want = ["http://xn--mller-kva.example/a/c/~X/%2F?Y=%7e", None, None, "https://x.org:8443/?q", None, "https://x.org/a", "https://[2001:db8::1]/", None, None, None, None]
    assert column(spark, given, idn.canonicalize_url) == want
    hosts = ["Code.Müller.Example.", "intranet", "192.168.7.7", "*.y.org", "y.org:22", "me@y.org", "y.org/z", "-y.org", "y_z.org", "999.1.1.1", "a" * 64 + ".org", "", None]
    assert column(spark, hosts, normalize_repository_host) == ["code.xn--mller-kva.example"] + [None] * 8 + ["999.1.1.1"] + [None] * 3
    repos = ["https://github.com/me/tool.git/", "https://github.com/me", "https://github.com/me/tool/wiki", "https://gitlab.com/us/sub/tool", "https://gitlab.com/us/tool/-/tree/x", "https://ours.net/me/tool", "https://theirs.net/me/tool", "https://ours.net/me/tool#x", "https://ours.net/me//tool", "https://ours.net/me/a%20b", "git@github.com:me/tool"]
    got = column(spark, repos, lambda c: idn.normalize_repository_url(c, ["ours.net"]))
    assert [g and g.path for g in got] == ["me/tool", None, None, "us/sub/tool", None, "me/tool", None, None, None, None, None]


@pytest.mark.parametrize("value,kind,want", [("10.5555/q", None, "paper"), ("1905.00123", None, "paper"), (thirteen("978155404295"), None, "book"), ("https://github.com/me/tool", None, "oss"), ("https://github.com/me/tool", "web", "web"), ("https://y.org", None, "web"), ("two words", None, None), (thirteen("978155404295"), "paper", None)])
def test_recognition(spark, value, kind, want):
    rows = spark.createDataFrame([(value, kind)], "c string, k string")
    got = rows.select(idn.recognize_input(F.col("c"), F.col("k")).alias("x")).first().x
    assert (got.type, got.code) == (want, None if want else "ADD_INPUT_INVALID")


def test_managed_hash_ignores_form_and_empty_fields(spark):
    rows = spark.createDataFrame([("Se\u00f1al", None), ("Sen\u0303al", "")], "title string, doi string")
    got = rows.select(idn.managed_fields_hash({"title": F.col("title"), "doi": F.col("doi")}).alias("h")).collect()
    assert got[0].h == got[1].h == "sha256:" + hashlib.sha256('{"title":"Se\u00f1al"}'.encode()).hexdigest()


def test_categories(spark):
    codes = ["PATH_UNSAFE", "RELATION_MISSING", "FRONTMATTER_MISSING", "FRONTMATTER_INVALID", "OBJECT_ID_DUPLICATE"]
    assert column(spark, codes, tx.finding_category) == ["security", "relation", "reference", "parse", "contract"]
