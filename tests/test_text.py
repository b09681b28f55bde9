import re

import pytest
from pyspark.sql import functions as F

from pagesift.functions import text, urls
from pagesift.functions.css import selector_steps


def column(spark, fn, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalise_string(spark):
    got = column(
        spark, text.normalise_string, "Harry   Potter!", "GTA: san-andreas", "a+b $5", "!!!", None, " x Y ",
        "ΟΔΟΣ İx ıx", "Straße — ßa", "ÉCOLE d'été",
    )
    assert got == ["Harry Potter", "Gta Sanandreas", "A+b $5", "", "", "X Y", "Οδοσ İx ıx", "Straße ßa", "École Dété"]


def test_normalise_is_idempotent_on_its_output(spark):
    texts = ["Harry   Potter!", "ÉCOLE d'été", "a+b $5 <x>", "the THE The"]
    once = column(spark, text.normalise_string, *texts)
    assert column(spark, text.normalise_string, *once) == once


def test_clean_title(spark):
    got = column(spark, text.clean_title, "GTA mcLovin foo a", "straße ßa", "  two\n\twords ", "ⓐb 𝐀b")
    assert got == ["GTA mcLovin Foo A", "Straße ßa", "Two Words", "Ⓐb 𝐀b"]


def test_pager_text(spark):
    got = column(spark, text.is_pager_text, "12", "Next", "»", "1.5", "x" * 26, "", " 7 ", "3000000000", "-3")
    assert got == [True, True, True, False, False, False, True, False, True]


def test_complexity_and_escape(spark):
    row = spark.range(1).select(
        text.complexity(F.lit(3), F.lit(" " + "y" * 730)).alias("c"), text.css_escape(F.lit("a:x/b-c_1é")).alias("e")
    ).first()
    assert row.c == 115
    assert row.e == r"a\:x\/b-c_1\é"


def test_skip_words_are_substrings(spark):
    got = column(spark, lambda x: text.has_any_word(x, ["cli", "t.me"]), "Click here", "CLI", "tXme", "https://T.ME/x", None)
    assert got == [True, True, False, True, False]


def test_result_href(spark):
    hrefs = ["/tag/x", "/x", "https://vintage.com/x", "/movie/x", " ", None, "//tags//x//", "tag", "/Genres/a/"]
    got = column(spark, lambda x: urls.is_result_href(x, ["category", "tag", "genre"]), *hrefs)
    assert got == [False, True, False, True, False, False, False, True, False]


def test_url_slug(spark):
    got = column(
        spark, urls.url_slug, "https://x.org/g/batman-arkham_knight/", "https://x.org/", "/rel",
        "https://x.org/a/b%20c.html?q=1#f", "https://x.org",
    )
    assert got == ["batman arkham knight", "", "", "b%20c.html", ""]


def test_abs_url(spark):
    base = F.lit("https://X.org:443/a/b?x=1#f")
    refs = {
        "c": "https://x.org/a/c",
        "/c/../d": "https://x.org/d",
        "?q=2": "https://x.org/a/b?q=2",
        "#z": "https://x.org/a/b?x=1#z",
        "//H.com/p": "https://h.com/p",
        "https://Q.com": "https://q.com/",
        "../x y/é": "https://x.org/x%20y/%C3%A9",
        "mailto:a@b": "mailto:a@b",
        "a%20b%zz|": "https://x.org/a/a%20b%25zz%7C",
        ".": "https://x.org/a/",
        "../../..": "https://x.org/",
        " \n": None,
        None: None,
    }
    assert column(spark, lambda x: urls.abs_url(base, x), *refs) == list(refs.values())
    assert column(spark, lambda x: urls.abs_url(F.lit("/no/base"), x), "c") == [None]
    # A normal absolute URL resolves to itself.
    same = ["https://x.org/a/b?c=d#e", "http://x.org:8080/", "https://x.org/%C3%A9"]
    assert column(spark, lambda x: urls.abs_url(base, x), *same) == same


def test_search_template(spark):
    def made(action, name="q r"):
        return urls.search_template(F.lit("https://x.org/shop/?a=1"), F.lit(action), F.lit(name))

    row = spark.range(1).select(
        made("").alias("blank"), made("/find?old=1#top").alias("frag"), made("https://h:443/p", "q").alias("port"),
        made("find", "").alias("noname"),
    ).first()
    assert row.blank == "https://x.org/shop/?q%20r={0}"
    assert row.frag == "https://x.org/find?q%20r={0}#top"
    assert row.port == "https://h/p?q={0}"
    assert row.noname == "https://x.org/shop/find?={0}"


def test_two_ways_to_fill_a_template(spark):
    q = F.lit("a b~*(é)!")
    row = spark.range(1).select(
        urls.fill_template_uri(F.lit("u?q={0}"), q).alias("uri"), urls.fill_template_form(F.lit("u?q={0}"), q).alias("form")
    ).first()
    assert row.uri == "u?q=a%20b~%2A%28%C3%A9%29%21"
    assert row.form == "u?q=a+b%7E*(%C3%A9)!"


def plain_dots(path):
    """RFC 3986, 5.2.4, for a path that begins with a slash."""
    out = []
    parts = path.split("/")[1:]
    for i, s in enumerate(parts):
        if s == "..":
            out = out[:-1]
        elif s != ".":
            out.append(s)
        if s in (".", "..") and i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def test_dot_segments(spark):
    import random

    rng = random.Random(7)
    paths = ["/" + "/".join(rng.choice(["a", "b", "..", ".", "", "..."]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    paths += ["/" + "/".join(rng.choice(["a", "..", "b"]) for _ in range(2000)) for _ in range(3)]
    got = column(spark, lambda x: urls.abs_url(F.lit("https://x.org"), F.concat(F.lit("https://x.org"), x)), *paths)
    assert got == ["https://x.org" + plain_dots(p) for p in paths]


def test_escapes(spark):
    from urllib.parse import quote

    legal = "-._~:/?#[]@!$&'()*+,;="
    texts = ["%41%zz%", "%", "%%41", "%2541", "a%é%4", "".join(map(chr, range(32, 127))), "é\U0001f600 \t x", "%25%2525", "+%2B ~%7E"]

    def want(t):
        parts = re.split("(%[0-9A-Fa-f]{2})", t)
        return "".join(p if i % 2 else quote(p, safe=legal) for i, p in enumerate(parts))

    got = column(spark, lambda x: urls.abs_url(F.lit("https://x.org"), F.concat(F.lit("https://x.org/-"), x, F.lit("-"))), *texts)
    assert got == ["https://x.org/-" + want(t) + "-" for t in texts]


MB = 1 << 20
LONG = {
    "legal": "a" * MB,
    "illegal": "<" * MB,
    "mixed": "<a b='é'>%41%" * (MB // 13),
    "blank": "x" + " " * MB + "x",
    "only blank": "\u3000" * (MB // 3),
    "slashes": "/" * MB,
    "segments": "a/" * (MB // 2),
    "dots": "./a/../" * (MB // 7) + "b",
    "up": "a/" * (MB // 4) + "../" * (MB // 6),
    "escapes": "\\:" * (MB // 2),
    "svg": "data:image/svg+xml;utf8,<svg xmlns='http://www.w3.org/2000/svg'>" + "<path d='M0 0 L1 1'/>" * (MB // 21) + "</svg>",
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_linear_time(spark, name):
    """A megabyte of anything, in each function, within seconds: no recursion, no search from every position."""
    import time

    base = F.lit("https://x.org/a/b")
    functions = {
        "abs_url": lambda x: urls.abs_url(base, x),
        "as base": lambda x: urls.abs_url(F.concat(F.lit("https://x.org/"), x), F.lit("c?d")),
        "template": lambda x: urls.search_template(base, x, F.lit("q")),
        "slug": lambda x: urls.url_slug(F.concat(F.lit("https://x.org/"), x)),
        "href": lambda x: urls.is_result_href(x, ["page"]).cast("string"),
        "trim": text.trim_ws,
        "blank": lambda x: text.is_blank(x).cast("string"),
        "title": text.clean_title,
        "normal": text.normalise_string,
        "steps": lambda x: F.size(selector_steps(x)).cast("string"),
    }
    frame = spark.createDataFrame([(LONG[name],)], "x string").cache()
    frame.count()
    for label, fn in functions.items():
        fn_of = frame.select(F.length(F.coalesce(fn(F.col("x")), F.lit(""))).alias("n"))
        start = time.time()
        fn_of.collect()
        assert time.time() - start < 10, label
